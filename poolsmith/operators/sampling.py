"""Allocation of sample sizes and stratified samples without replacement.

Samples are by hash of seed and id: the same rows whatever the partitions, with exactly the allocated counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from poolsmith.sources.shared import shared_table


def source_targets(tiers: DataFrame, questions_per_chunk: int) -> DataFrame:
    """tiers with ``chunks_to_sample``: queries wanted over questions a chunk, rounded up."""
    if questions_per_chunk <= 0:
        raise ValueError("questions_per_chunk must be positive")
    return tiers.withColumn("chunks_to_sample", F.ceil(F.col("queries_per_source") / F.lit(questions_per_chunk)).cast("int"))


def largest_remainder(sizes: DataFrame, group: str, target: Column | str = "target", *by: str) -> DataFrame:
    """sizes (by..., group, size, target) with ``allocated``: in proportion to size, the largest fractions rounded up, ties by name, none above its size.

    As a share below the whole never exceeds its size, one pass deals out all that is left.
    """
    w, whole = Window.partitionBy(*by), F.sum("size")
    target = F.col(target) if isinstance(target, str) else target
    rows = sizes.withColumn("_t", target.cast("double")).withColumn("_all", whole.over(w))
    rows = rows.withColumn("_raw", F.when(F.col("_all") > 0, F.col("_t") * F.col("size") / F.col("_all")).otherwise(0.0)).withColumn("_low", F.least(F.floor("_raw"), F.col("size")))
    rows = rows.withColumn("_rest", F.col("_t") - F.sum("_low").over(w))
    rank = F.row_number().over(w.orderBy(F.desc(F.col("_low") < F.col("size")), F.desc(F.col("_raw") - F.col("_low")), group))
    rows = rows.withColumn("_n", rank)
    out = F.when(F.col("_t") >= F.col("_all"), F.col("size")).otherwise(F.col("_low") + (F.col("_n") <= F.col("_rest")).cast("long"))
    return rows.withColumn("allocated", out.cast("long")).drop("_t", "_all", "_raw", "_low", "_rest", "_n")


def hamilton(populations: DataFrame, group: str, total: int) -> DataFrame:
    """populations (group, population) with ``target``: largest fractions rounded up; of equal ones, the larger population first. A few rows: one a tier."""
    w = Window.partitionBy()
    rows = populations.withColumn("_raw", F.lit(float(total)) * F.col("population") / F.sum("population").over(w)).withColumn("_low", F.floor("_raw"))
    rows = rows.withColumn("_rest", F.lit(total) - F.sum("_low").over(w)).withColumn("_n", F.row_number().over(w.orderBy(F.desc(F.col("_raw") - F.col("_low")), F.desc("population"), F.desc(group))))
    return rows.withColumn("target", F.col("_low") + (F.col("_n") <= F.col("_rest")).cast("long")).drop("_raw", "_low", "_rest", "_n")


def with_floor(targets: DataFrame, group: str, poor: str, donor: str) -> DataFrame:
    """A tier that is there, yet got nothing, gets one from the donor; a target beyond its population is an error when it is reached."""
    w = Window.partitionBy()
    give = F.max(((F.col(group) == poor) & (F.col("population") > 0) & (F.col("target") == 0)).cast("int")).over(w)
    rows = targets.withColumn("_g", give).withColumn("target", F.col("target") + F.when(F.col(group) == poor, F.col("_g")).when(F.col(group) == donor, -F.col("_g")).otherwise(0))
    return rows.withColumn("target", F.when(F.col("target") <= F.col("population"), F.col("target")).otherwise(F.raise_error(F.lit("a target exceeds its population")))).drop("_g")


def order_of(seed: int, id_col: str) -> Column:
    """Random, yet the same everywhere: the MD5 of seed and id."""
    return F.md5(F.concat_ws(":", F.lit(seed).cast("string"), F.col(id_col).cast("string")))


#: Parts in which a stratum is cut to its size before it is sorted as a whole.
PARTS = 32


def stratified(rows: DataFrame, sizes: DataFrame, strata: list[str], id_col: str, seed: int, count: str = "allocated") -> DataFrame:
    """As many rows of each stratum as ``sizes`` says, the first by hash of seed and id; ids are unique.

    Ids alone are sorted. Each of PARTS parts of a stratum is cut to the stratum's size first, so that no task sorts a whole stratum, however large.
    """
    ids = rows.select(*strata, id_col).join(sizes.select(*strata, F.col(count).alias("_c")), strata).where("_c > 0").withColumn("_h", order_of(seed, id_col))
    first = lambda df, *by: df.withColumn("_n", F.row_number().over(Window.partitionBy(*strata, *by).orderBy("_h", id_col))).where(F.col("_n") <= F.col("_c")).drop("_n")
    chosen = first(first(ids.withColumn("_p", F.pmod(F.xxhash64(id_col), F.lit(PARTS))), "_p").drop("_p")).select(*strata, id_col)
    return chosen if set(rows.columns) == {*strata, id_col} else rows.join(chosen, [*strata, id_col], "left_semi")


def sample_sources(usable: DataFrame, targets: DataFrame, seed: int) -> DataFrame:
    """usable (chunk_id, source, section, pos, ...): each source's target, in proportion over its sections; ``pos`` tells the corpus's order. Give ids alone: rows are sorted by section."""
    sizes = usable.groupBy("source", "section").agg(F.count("*").alias("size")).join(targets.select("source", F.col("chunks_to_sample").alias("target")), "source")
    return stratified(usable, largest_remainder(sizes, "section", "target", "source"), ["source", "section"], "chunk_id", seed)


def sampling_report(classified: DataFrame, sampled: DataFrame, targets: DataFrame) -> DataFrame:
    """source, tier, total, filtered, usable, target, sampled, shortfall, section_count, filter_reasons; classified has ``reason``, null for usable chunks."""
    by = classified.groupBy("source").agg(F.count("*").alias("total"), F.count("reason").alias("filtered"), F.countDistinct(F.when(F.col("reason").isNull(), F.col("section"))).alias("section_count"))
    reasons = classified.where("reason IS NOT NULL").groupBy("source", "reason").agg(F.count("*").alias("n")).groupBy("source").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "n")))).alias("filter_reasons"))
    got = sampled.groupBy("source").agg(F.count("*").alias("sampled"))
    rows = targets.select("source", "tier", F.col("chunks_to_sample").alias("target")).join(by, "source", "left").join(got, "source", "left").join(reasons, "source", "left").fillna(0, ["total", "filtered", "section_count", "sampled"])
    return rows.select("source", "tier", "total", "filtered", (F.col("total") - F.col("filtered")).alias("usable"), "target", "sampled", F.greatest(F.lit(0), F.col("target") - F.col("sampled")).alias("shortfall"), "section_count", F.coalesce("filter_reasons", F.expr("cast(map() as map<string, bigint>)")).alias("filter_reasons"))


def audit_sample(queries: DataFrame, total: int, tiers: list[str], poor: str, donor: str, seed: int) -> tuple[DataFrame, DataFrame]:
    """(sampled queries, tier and target): ``total`` queries dealt over the tiers by population, the poor tier getting at least one from the donor; queries of other tiers are left out. queries: query_id, tier, ..."""
    known = queries.where(F.col("tier").isin(*tiers))
    targets = with_floor(hamilton(known.groupBy("tier").agg(F.count("*").alias("population")), "tier", total), "tier", poor, donor)
    targets = shared_table(targets, "targets")
    return stratified(known, targets, ["tier"], "query_id", seed, "target"), targets


def fraction(rows: DataFrame, id_col: str, share: float, seed: int) -> DataFrame:
    """ceil(share * n) rows by hash: ids alone are sorted."""
    import math

    chosen = rows.select(id_col).orderBy(order_of(seed, id_col), id_col).limit(math.ceil(rows.count() * share))
    return rows.join(chosen, id_col, "left_semi")
