"""Ranking metrics over long frames: rankings (query_id, retriever, rank, chunk_id), labels (query_id, chunk_id, score).

Each function shuffles rankings once and works out all thresholds and depths in that one aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from poolsmith.functions import fixed

PAIR = ["query_id", "chunk_id"]


def stats(df: DataFrame, column: str, *by: str) -> DataFrame:
    """n, mean, min, max; nulls where there is nothing."""
    c = F.col(column).cast("double")
    return df.groupBy(*by).agg(F.count(c).alias("n"), F.avg(c).alias("mean"), F.min(c).alias("min"), F.max(c).alias("max"))


def judged(rankings: DataFrame, labels: DataFrame, k: int) -> DataFrame:
    """The top k with their scores; unjudged pairs score 0."""
    return rankings.where(F.col("rank") <= k).select("retriever", "rank", *PAIR).join(labels.select(*PAIR, "score"), PAIR, "left").withColumn("score", F.coalesce("score", F.lit(0)))


def _long(frame: DataFrame, keys: list[str], cells: dict[tuple[int, int], dict[str, Column]]) -> DataFrame:
    """keys, threshold, k and the named values, a row for each cell."""
    rows = [F.struct(F.lit(t).alias("threshold"), F.lit(k).alias("k"), *(c.alias(n) for n, c in named.items())) for (t, k), named in cells.items()]
    return frame.select(*keys, F.explode(F.array(*rows)).alias("c")).select(*keys, "c.*")


def per_query(rankings: DataFrame, labels: DataFrame, ks: list[int], thresholds: list[int]) -> DataFrame:
    """retriever, query_id, threshold, k, hits, first: how many of the top k reach the threshold, and the first one's rank."""
    grid = [(t, k) for t in thresholds for k in ks]
    hit = lambda t, k: (F.col("score") >= t) & (F.col("rank") <= k)
    sums = [a for t, k in grid for a in (F.count_if(hit(t, k)).alias(f"h{t}_{k}"), F.min(F.when(hit(t, k), F.col("rank"))).alias(f"f{t}_{k}"))]
    frame = judged(rankings, labels, max(ks)).groupBy("retriever", "query_id").agg(*sums)
    return _long(frame, ["retriever", "query_id"], {(t, k): {"hits": F.col(f"h{t}_{k}"), "first": F.col(f"f{t}_{k}")} for t, k in grid})


def relevant_counts(labels: DataFrame, thresholds: list[int]) -> DataFrame:
    """query_id, threshold, n_relevant: of queries that have any."""
    counted = labels.groupBy("query_id").agg(*(F.count_if(F.col("score") >= t).alias(f"n{t}") for t in thresholds))
    rows = F.explode(F.array(*(F.struct(F.lit(t).alias("threshold"), F.col(f"n{t}").alias("n_relevant")) for t in thresholds)))
    return counted.select("query_id", rows.alias("c")).select("query_id", "c.*").where("n_relevant > 0")


def hit_precision_mrr(rankings: DataFrame, labels: DataFrame, ks: list[int], thresholds: list[int], empty: str) -> DataFrame:
    """retriever, threshold, k, n, hr, precision, mrr.

    empty: "exclude" averages over the queries that have a relevant chunk; "zero" over all queries that have
    labels, those without a relevant chunk or a result counting 0. Precision divides by k, whatever was returned.
    """
    by = ["retriever", "threshold", "k"]
    found = per_query(rankings, labels, ks, thresholds)
    if empty == "exclude":
        found = found.join(relevant_counts(labels, thresholds), ["query_id", "threshold"])
        spine = relevant_counts(labels, thresholds).groupBy("threshold").agg(F.count("*").alias("n"))
    else:
        found = found.join(labels.select("query_id").distinct(), "query_id", "left_semi")
        spine = labels.agg(F.countDistinct("query_id").alias("n"))
    sums = found.groupBy(*by).agg(F.sum((F.col("hits") > 0).cast("double")).alias("hr"), F.sum(F.col("hits") / F.col("k")).alias("precision"), F.sum(F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias("mrr"))
    joined = sums.join(spine, "threshold") if empty == "exclude" else sums.crossJoin(spine)  # one row
    return joined.select(*by, "n", *((F.col(m) / F.col("n")).alias(m) for m in ("hr", "precision", "mrr")))


def recall(rankings: DataFrame, labels: DataFrame, ks: list[int], thresholds: list[int]) -> DataFrame:
    """retriever, threshold, k, n, mean, min, max of the share of a query's relevant chunks in the top k; queries without any are left out."""
    relevant = relevant_counts(labels, thresholds)
    retrievers = rankings.select("retriever").distinct()
    found = per_query(rankings, labels, ks, thresholds)
    grid = F.explode(F.array(*map(F.lit, ks))).alias("k")
    spine = relevant.crossJoin(retrievers).select("*", grid)  # as many retrievers as there are; they are few and are each a value
    share = spine.join(found, ["retriever", "query_id", "threshold", "k"], "left").withColumn("recall", F.coalesce("hits", F.lit(0)) / F.col("n_relevant"))
    return stats(share, "recall", "retriever", "threshold", "k")


def set_recall(pool: DataFrame, labels: DataFrame, threshold: int) -> DataFrame:
    """query_id, recall of a set of pairs (query_id, chunk_id); queries without a relevant chunk are left out."""
    flags = labels.where(F.col("score") >= threshold).select(*PAIR).distinct().join(pool.select(*PAIR).distinct().withColumn("_in", F.lit(1.0)), PAIR, "left")
    return flags.groupBy("query_id").agg(F.avg(F.coalesce("_in", F.lit(0.0))).alias("recall"))


def union_recall(rankings: DataFrame, labels: DataFrame, subsets: dict[str, list[str]], ks: list[int], threshold: int) -> DataFrame:
    """subset, k, n, mean, min, max of the recall of each subset's union of top k."""
    relevant = labels.where(F.col("score") >= threshold).select(*PAIR).distinct()
    best = rankings.where(F.col("rank") <= max(ks)).join(relevant, PAIR, "left_semi")
    best = best.groupBy(*PAIR).agg(*(F.min(F.when(F.col("retriever").isin(r), F.col("rank"))).alias(f"b{i}") for i, r in enumerate(subsets.values())))
    flags = relevant.join(best, PAIR, "left")
    cells = [(name, k, F.avg((F.coalesce(F.col(f"b{i}"), F.lit(10**9)) <= k).cast("double")).alias(f"c{i}_{k}")) for i, name in enumerate(subsets) for k in ks]
    wide = flags.groupBy("query_id").agg(*(c for _, _, c in cells))
    rows = F.explode(F.array(*(F.struct(F.lit(name).alias("subset"), F.lit(k).alias("k"), F.col(f"c{list(subsets).index(name)}_{k}").alias("recall")) for name, k, _ in cells)))
    return stats(wide.select("query_id", rows.alias("r")).select("query_id", "r.*"), "recall", "subset", "k")


def ndcg(rankings: DataFrame, labels: DataFrame, k: int) -> DataFrame:
    """retriever, n, ndcg: gain 2^score - 1; the ideal ranks the best k judged scores of the query; queries without a positive score are left out."""
    gain, discount = F.pow(F.lit(2.0), F.col("score")) - 1, F.log2(F.col("rank") + 1.0)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    ideal = labels.where("score > 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).groupBy("query_id").agg(F.sum(gain / discount).alias("ideal"))
    got = judged(rankings, labels, k).where("score > 0").groupBy("retriever", "query_id").agg(F.sum(gain / discount).alias("dcg"))
    sums = got.join(ideal, "query_id").groupBy("retriever").agg(F.sum(F.col("dcg") / F.col("ideal")).alias("s"))
    n = ideal.agg(F.count("*").alias("n"))
    every = rankings.select("retriever").distinct().join(sums, "retriever", "left")
    return every.crossJoin(n).select("retriever", "n", (F.coalesce("s", F.lit(0.0)) / F.col("n")).alias("ndcg"))  # one row


def weighted(rankings: DataFrame, labels: DataFrame, k: int, top_score: int = 6) -> DataFrame:
    """retriever, n, whr, wp: the best and the summed share of the top score in the top k; over all queries that have labels."""
    share = F.col("score") / F.lit(float(top_score))
    spine = labels.select("query_id").distinct()
    q = judged(rankings, labels, k).join(spine, "query_id", "left_semi").groupBy("retriever", "query_id").agg(F.max(share).alias("whr"), (F.sum(share) / k).alias("wp"))
    n = spine.agg(F.count("*").alias("n"))
    return q.groupBy("retriever").agg(F.sum("whr").alias("whr"), F.sum("wp").alias("wp")).crossJoin(n).select("retriever", "n", (F.col("whr") / F.col("n")).alias("whr"), (F.col("wp") / F.col("n")).alias("wp"))  # one row


def coverage(rankings: DataFrame, labels: DataFrame, k: int, divisor: float | None = None) -> DataFrame:
    """retriever, query_id, labelled, coverage: of the top k, how many are labelled, over ``divisor`` (k where none is given)."""
    there = labels.select(*PAIR).distinct().withColumn("_l", F.lit(1))
    return rankings.where(F.col("rank") <= k).join(there, PAIR, "left").groupBy("retriever", "query_id").agg(F.count("_l").alias("labelled")).withColumn("coverage", F.col("labelled") / F.lit(float(divisor or k)))


def coverage_gate(covered: DataFrame) -> DataFrame:
    """retriever, mean, verdict: from 0.8 on judging may be skipped, below 0.5 it must run."""
    c = F.col("mean")
    return covered.groupBy("retriever").agg(F.avg("coverage").alias("mean")).withColumn("verdict", F.when(c >= 0.8, "skip").when(c >= 0.5, "run").otherwise("must"))


def implied_precision(rankings: DataFrame, labels: DataFrame, k: int) -> DataFrame:
    """retriever, n, lenient, strict: shares of scores 1 and 2, and of 2, among the labelled of the top k."""
    found = rankings.where(F.col("rank") <= k).select("retriever", *PAIR).join(labels.select(*PAIR, "score"), PAIR)
    return found.groupBy("retriever").agg(F.count("*").alias("n"), F.avg((F.col("score") >= 1).cast("double")).alias("lenient"), F.avg((F.col("score") == 2).cast("double")).alias("strict"))


def distribution(labels: DataFrame, top_score: int) -> DataFrame:
    """score, n, at_least: for each score from 0 on, also those that nobody has."""
    every = labels.sparkSession.range(top_score + 1).select(F.col("id").cast("int").alias("score"))
    counted = every.join(labels.groupBy("score").agg(F.count("*").alias("c")), "score", "left").select("score", F.coalesce("c", F.lit(0)).alias("n"))
    return counted.withColumn("at_least", F.sum("n").over(Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)))  # top_score + 1 rows


def agreement(a: DataFrame, b: DataFrame, thresholds: list[int]) -> DataFrame:
    """threshold, n, exact, within_one, agree, precision, recall of labels a against the reference b."""
    both = a.select(*PAIR, F.col("score").alias("a")).join(b.select(*PAIR, F.col("score").alias("b")), PAIR)
    rate = lambda c: F.avg(c.cast("double"))
    cell = lambda t: F.struct(F.lit(t).alias("threshold"), F.count("*").alias("n"), rate(F.col("a") == F.col("b")).alias("exact"), rate(F.abs(F.col("a") - F.col("b")) <= 1).alias("within_one"), rate((F.col("a") >= t) == (F.col("b") >= t)).alias("agree"), F.try_divide(F.count_if((F.col("a") >= t) & (F.col("b") >= t)).cast("double"), F.count_if(F.col("a") >= t)).alias("precision"), F.try_divide(F.count_if((F.col("a") >= t) & (F.col("b") >= t)).cast("double"), F.count_if(F.col("b") >= t)).alias("recall"))
    return both.agg(F.array(*map(cell, thresholds)).alias("c")).select(F.explode("c").alias("c")).select("c.*")


def size_stats(sets: DataFrame, spine: DataFrame) -> DataFrame:
    """mean, min, max of the sizes of queries' sets (query_id, chunk_id): the mean is over all queries of the spine, the others over queries that have a set."""
    sizes = sets.select(*PAIR).distinct().groupBy("query_id").agg(F.count("*").alias("n"))
    every = spine.select("query_id").distinct().agg(F.count("*").alias("queries"))
    return sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("s"), F.min("n").cast("double").alias("min"), F.max("n").cast("double").alias("max")).crossJoin(every).select("queries", F.try_divide(F.col("s").cast("double"), F.col("queries")).alias("mean"), "min", "max")  # one row


def score_views(rankings: DataFrame, first: DataFrame, second: DataFrame, k: int) -> DataFrame:
    """view, score, n: scores of the top k under either set of labels, and under both, where the second one holds."""
    top = rankings.where(F.col("rank") <= k).select("retriever", *PAIR)
    side = lambda df, name: df.select(*PAIR, F.col("score").alias(name))
    joined = top.join(side(first, "a"), PAIR, "left").join(side(second, "b"), PAIR, "left")
    views = F.array(*(F.struct(F.lit(v).alias("view"), c.alias("score")) for v, c in (("first", F.col("a")), ("second", F.col("b")), ("union", F.coalesce("b", "a")))))
    return joined.select(F.explode(views).alias("v")).select("v.*").where("score IS NOT NULL").groupBy("view", "score").agg(F.count("*").alias("n"))


def sanity_gate(pairs: DataFrame) -> DataFrame:
    """same_min, unrelated_max, verdict of pairs (kind: "same" or "unrelated", cosine): an encoder is sound when all texts on one topic are near, and unrelated ones far."""
    found = pairs.agg(F.min(F.when(F.col("kind") == "same", F.col("cosine"))).alias("same_min"), F.max(F.when(F.col("kind") == "unrelated", F.col("cosine"))).alias("unrelated_max"))
    sound = (F.col("same_min") > fixed.SANE_SAME) & (F.col("unrelated_max") < fixed.SANE_UNRELATED)
    return found.withColumn("verdict", F.when(sound, "pass").otherwise("fail"))


def paired_gap(a: DataFrame, b: DataFrame, value: str, keys: list[str], tolerance: float) -> DataFrame:
    """keys, a, b, gap, close: two runs of a metric side by side."""
    return a.select(*keys, F.col(value).alias("a")).join(b.select(*keys, F.col(value).alias("b")), keys).withColumn("gap", F.col("a") - F.col("b")).withColumn("close", F.abs("gap") < tolerance)
