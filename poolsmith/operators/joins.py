"""Joins, set operations and guards over queries, chunks, rankings and labels. All are equi-joins; Spark picks the strategy, and nothing is broadcast by hint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from poolsmith.sources.shared import shared_table

PAIR = ["query_id", "chunk_id"]


def ordered_lookup(ids: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """rows of the listed ids (key, pos), with pos; an id without a row fails when it is reached."""
    hit = rows.withColumn("_hit", F.lit(True))
    guard = F.when(F.col("_hit"), F.col(key)).otherwise(F.raise_error(F.concat(F.lit("no row for "), F.col(key).cast("string"))))
    return ids.join(hit, key, "left").withColumn(key, guard).drop("_hit")


def restrict(labels: DataFrame, queries: DataFrame) -> DataFrame:
    return labels.join(queries.select("query_id"), "query_id", "left_semi")


def unjudged(pairs: DataFrame, judged: DataFrame) -> DataFrame:
    """Candidate pairs that have no label yet."""
    return pairs.join(judged.select(*PAIR), PAIR, "left_anti")


def first_few(rows: DataFrame, by: list[str], order: list[str], n: int) -> DataFrame:
    """The first n rows of each group; Spark cuts each task's part of a group to n before it shuffles."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def numbered(rows: DataFrame, name: str, *order: str | Column) -> DataFrame:
    """rows with their place from 1 on in the given order. Rows are sorted by ranges over all tasks; what one task adds up is the number of rows in each range."""
    placed = shared_table(rows.orderBy(*order).withColumn("_m", F.monotonically_increasing_id()).withColumn("_range", F.shiftright("_m", 33)), "numbered")
    before = F.sum("_in").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    ranges = placed.groupBy("_range").agg(F.count("*").alias("_in"), F.min("_m").alias("_first")).withColumn("_before", F.coalesce(before, F.lit(0)))  # a row for each task
    return placed.join(F.broadcast(ranges), "_range").withColumn(name, (F.col("_before") + F.col("_m") - F.col("_first") + 1).cast("int")).drop("_m", "_range", "_in", "_first", "_before")


def with_query_text(pairs: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, query_text, candidates: pairs regrouped under their query's text."""
    return regroup(pairs).join(queries.select("query_id", "query_text"), "query_id").select("query_id", "query_text", "candidates")


def with_chunk_text(pairs: DataFrame, chunks: DataFrame) -> tuple[DataFrame, int]:
    """(pairs with their chunk's text, number of pairs whose chunk is missing)."""
    joined = pairs.join(chunks.select("chunk_id", "text"), "chunk_id", "left")
    return joined.where("text IS NOT NULL"), pairs.join(chunks.where("text IS NOT NULL").select("chunk_id"), "chunk_id", "left_anti").count()


def regroup(pairs: DataFrame) -> DataFrame:
    """query_id, candidates: sorted; queries without a pair are not there."""
    return pairs.groupBy("query_id").agg(F.array_sort(F.collect_set("chunk_id")).alias("candidates"))


def top(rankings: DataFrame, k: int) -> DataFrame:
    return rankings.where(F.col("rank") <= k)


def marked(pairs: DataFrame, judged: DataFrame) -> DataFrame:
    """pairs with ``judged``: whether a label exists."""
    return pairs.join(judged.select(*PAIR).distinct().withColumn("_j", F.lit(True)), PAIR, "left").withColumn("judged", F.coalesce("_j", F.lit(False))).drop("_j")


def missed(relevant: DataFrame, pool: DataFrame) -> DataFrame:
    """Relevant pairs that the pool lacks."""
    return relevant.join(pool.select(*PAIR), PAIR, "left_anti")


def enriched(labels: DataFrame, chunks: DataFrame, queries: DataFrame, chars: int = 1200) -> DataFrame:
    """labels with query and chunk texts; a chunk that isn't in the corpus says so."""
    from poolsmith.functions.text import truncated

    joined = labels.join(queries.select("query_id", "query_text"), "query_id", "left").join(chunks.select("chunk_id", "source", "text"), "chunk_id", "left")
    return joined.withColumn("in_corpus", F.col("text").isNotNull()).withColumn("text", F.coalesce(truncated(F.col("text"), chars), F.lit("NOT IN CORPUS")))


def must_match(left: DataFrame, right: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Each row of left with the last row (by ``order``) of right for its keys; a missing one fails when it is reached."""
    from poolsmith.sources.corpus import one_a_key

    last = one_a_key(right, keys, order, "last").drop(order).withColumn("_hit", F.lit(True))
    joined = left.join(last, keys, "left")
    guard = F.when(F.col("_hit"), F.col(keys[0])).otherwise(F.raise_error(F.lit("a row has no counterpart")))
    return joined.withColumn(keys[0], guard).drop("_hit")


def referenced(ids: DataFrame, chunks: DataFrame, complete: bool = True) -> DataFrame:
    """The referenced chunks, of several with one id the first; ids without a chunk are an error if ``complete``."""
    from poolsmith.sources.corpus import one_a_key

    wanted = ids.select("chunk_id").distinct()
    if complete and (n := wanted.join(chunks.select("chunk_id"), "chunk_id", "left_anti").count()):
        raise ValueError(f"{n} referenced chunks aren't in the corpus")
    return one_a_key(chunks.join(wanted, "chunk_id", "left_semi"), ["chunk_id"], "pos")


def override(base: DataFrame, over: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Rows of either side; where both have a key, the second side's values hold."""
    b = over.select(*keys, *(F.col(v).alias(f"_{v}") for v in values), F.lit(True).alias("_there"))
    joined = base.select(*keys, *values).join(b, keys, "full")
    return joined.select(*keys, *(F.when(F.col("_there"), F.col(f"_{v}")).otherwise(F.col(v)).alias(v) for v in values))


def union_of_top(rankings: DataFrame, k: int) -> DataFrame:
    """query_id, chunk_id, ranks (retriever -> rank), first: place of the first retriever, by name, that has the pair."""
    cut = top(rankings, k)
    return cut.groupBy(*PAIR).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("retriever", "rank")))).alias("ranks"), F.min(F.struct("retriever", "rank")).alias("first"))


def merge_labels(existing: DataFrame, batch: DataFrame, current: Column, source: str) -> DataFrame:
    """What of a batch may be appended: valid under the current contract, not there yet, each pair once; tagged with its source."""
    fresh = batch.where(current).dropDuplicates(PAIR)
    return fresh.join(existing.select(*PAIR), PAIR, "left_anti").withColumn("source", F.lit(source))


def current_contract(schema_version: str, prompt_hash: str, backend: str, model: str, prefix: str = "", needs: str | None = None) -> Column:
    """Rows made under exactly this contract, with a non-null column ``needs`` if one is named."""
    col = lambda x: F.col(f"{prefix}{x}")
    ok = (col("schema_version") == schema_version) & (col("prompt_hash") == prompt_hash) & (col("backend") == backend) & (col("model") == model)
    return ok & F.col(needs).isNotNull() if needs else ok


def remaining(wanted: DataFrame, done: DataFrame, keys: list[str], current: Column) -> tuple[DataFrame, DataFrame]:
    """(what is still to be done, stale rows): only rows under the current contract count as done."""
    return wanted.join(done.where(current).select(*keys), keys, "left_anti"), done.where(~F.coalesce(current, F.lit(False)))


def require_all(ids: DataFrame, rows: DataFrame, key: str) -> None:
    """Fail if a listed id has no row."""
    gone = ids.select(key).join(rows.select(key), key, "left_anti")
    if (first := gone.take(1)):
        raise ValueError(f"no row for {first[0][key]}")


def shard(df: DataFrame, index: int, count: int, order: str, contiguous: bool = False, total: int | None = None) -> DataFrame:
    """One of ``count`` shards by the column ``order`` (0, 1, ...): every count-th row, or blocks of ceil(total / count)."""
    if contiguous:
        return df.where(F.floor(F.col(order) / F.lit(-(-total // count))) == index)
    return df.where(F.pmod(F.col(order), F.lit(count)) == index)


def shuffled(df: DataFrame, key: str, seed: int, limit: int | None = None) -> DataFrame:
    """A stable shuffle: ordered by a hash of seed and key."""
    from poolsmith.operators.sampling import order_of

    out = df.orderBy(order_of(seed, key), key)
    return out if limit is None else out.limit(limit)


def first_seen(rankings: DataFrame, retrievers: list[str]) -> DataFrame:
    """query_id, chunk_id, ord: pairs in the order in which going through the retrievers' lists meets them."""
    place = F.array_position(F.array(*map(F.lit, retrievers)), F.col("retriever"))
    met = rankings.groupBy(*PAIR).agg(F.min(F.struct(place.alias("r"), "rank")).alias("m"))
    return met.select(*PAIR, F.row_number().over(Window.partitionBy("query_id").orderBy("m")).alias("ord"))


def review(chunks: DataFrame, source: str | None = None, section: str | None = None, contains: str | None = None, min_words: int | None = None, max_words: int | None = None, offset: int = 0, limit: int | None = None, seed: int | None = None) -> DataFrame:
    """Chunks to look at: ordinals and word counts are of all rows, then filters, then a page of them or a seeded sample."""
    from poolsmith.functions import text as X

    if offset < 0 or (limit or 0) < 0:
        raise ValueError("offset and limit must not be negative")
    rows = numbered(chunks.select("chunk_id", "pos"), "ordinal", "pos").drop("pos").join(chunks, "chunk_id").withColumn("words", X.word_count(F.col("text")))
    like = lambda c, x: F.contains(F.lower(c), F.lit(x.lower()))
    for given, test in ((source, lambda: F.col("source") == source), (section, lambda: like(F.col("section"), section)), (contains, lambda: like(F.concat_ws("\n", "breadcrumb", "section", "text"), contains)), (min_words, lambda: F.col("words") >= min_words), (max_words, lambda: F.col("words") <= max_words)):
        if given is not None:
            rows = rows.where(test())
    rows = rows.orderBy("ordinal") if seed is None else shuffled(rows, "chunk_id", seed)
    rows = rows.offset(offset) if offset else rows
    return rows if limit is None else rows.limit(limit)
