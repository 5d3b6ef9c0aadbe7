"""End-to-end plans: sample a corpus, assemble queries, pool candidates, judge, report."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poolsmith.functions import fixed, rubric
from poolsmith.functions import text as X
from poolsmith.operators import joins, retrieval, sampling
from poolsmith.plans import models
from poolsmith.sources.shared import shared_table, spread
from poolsmith.sources.sinks import append_new, table_at


def classified_chunks(chunks: DataFrame, tiers: DataFrame) -> DataFrame:
    """chunk_id, source, tier, section, reason, pos of the configured sources' chunks, written once: texts are read and judged in one pass and go no further."""
    known = chunks.join(tiers.select("source", "tier"), "source")
    return shared_table(X.with_reason(spread(known)).withColumn("section", X.section(F.col("breadcrumb"))).select("chunk_id", "source", "tier", "section", "reason", "pos"), "classified")


def sampled_corpus(chunks: DataFrame, tiers: DataFrame, questions_per_chunk: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(sampled chunks with tier and section, report): configured sources, usable chunks, in proportion over sections.

    Sampling works on ids; the texts of the sample alone are joined to it, at the end.
    """
    targets = sampling.source_targets(tiers, questions_per_chunk)
    classified = classified_chunks(chunks, targets)
    chosen = shared_table(sampling.sample_sources(classified.where("reason IS NULL").select("chunk_id", "source", "tier", "section", "pos"), targets, seed), "sample")
    sampled = chunks.drop("source", "tier", "section", "pos").join(retrieval.sent(chosen), "chunk_id")
    return sampled, sampling.sampling_report(classified, chosen, targets)


def topics(kept: DataFrame, at_least: int = 3, passages: int = 6, chars: int = 600) -> DataFrame:
    """topic, chunks (pos, chunk_id, source, tier, passage; the first ``passages`` by place): topics of enough chunks. Each task sends on the first few of a topic alone."""
    named = kept.select("chunk_id", "source", "tier", "pos", X.topic(F.col("breadcrumb"), F.col("section")).alias("topic"), F.substring("text", 1, chars).alias("passage"))
    sizes = named.groupBy("topic").agg(F.count("*").alias("n")).where(F.col("n") >= at_least)
    first = joins.first_few(named, ["topic"], ["pos", "chunk_id"], passages).join(sizes, "topic")
    return first.groupBy("topic").agg(F.array_sort(F.collect_list(F.struct("pos", "chunk_id", "source", "tier", "passage"))).alias("chunks"))


def synthesised(found: DataFrame, model: Callable[[str], dict | str], retries: int = 2, wait: float = 1.0) -> DataFrame:
    """query_text, seed_chunk_id, seed_chunk_ids, source, tier, topic: one query over the passages of each topic; topics whose reply fails are left out.

    The first chunk that the model names is the seed; where it isn't one of the topic's, the topic's first chunk is.
    """
    message = F.concat_ws("\n", "topic", F.array_join(F.transform("chunks", lambda c: c["chunk_id"]), ","), F.array_join(F.transform("chunks", lambda c: F.concat(F.lit("["), c["chunk_id"], F.lit("] "), c["passage"])), "\n\n"))
    said = models.asked(found, ["topic"], message, model, "query_text string, seed_chunk_ids array<string>", lambda r: (str(r["query_text"]), [str(x) for x in r["seed_chunk_ids"]]), (None, None), retries, wait)
    joined = found.join(said.where("_error = ''"), "topic")
    named = F.get("seed_chunk_ids", F.lit(0))
    primary = F.coalesce(F.get(F.filter("chunks", lambda c: c["chunk_id"] == named), F.lit(0)), F.col("chunks")[0])
    return joined.withColumn("p", primary).select("query_text", F.col("p.chunk_id").alias("seed_chunk_id"), "seed_chunk_ids", F.col("p.source").alias("source"), F.col("p.tier").alias("tier"), "topic")


def rewritten(queries: DataFrame, model: Callable[[str], dict | str], share: float, seed: int, retries: int = 2, wait: float = 1.0) -> DataFrame:
    """queries with adversarial_type and the model's rewrite for query_text, for a share of them; rewrites that change nothing are left out. queries: query_text, seed_chunk_id, ..."""
    digits = F.substring(sampling.order_of(seed + 1, "seed_chunk_id"), 1, 8)
    kind = F.element_at(F.array(*map(F.lit, fixed.REWRITE_TYPES)), (F.pmod(F.conv(digits, 16, 10).cast("long"), F.lit(len(fixed.REWRITE_TYPES))) + 1).cast("int"))
    chosen = sampling.fraction(queries, "seed_chunk_id", share, seed).withColumn("adversarial_type", kind)
    said = models.asked(chosen, ["seed_chunk_id"], F.concat_ws("\n", "adversarial_type", "query_text"), model, "rewrite string", lambda r: (str(r["rewrite"]),), (None,), retries, wait)
    found = chosen.join(said.where("_error = ''").select("seed_chunk_id", "rewrite"), "seed_chunk_id")
    return found.withColumn("query_text", rubric.accepted_rewrite(F.col("rewrite"), F.col("query_text"))).where("query_text IS NOT NULL").drop("rewrite")


def assembled_queries(kept: DataFrame, synthesis: Callable[[str], dict | str], rewrite: Callable[[str], dict | str], share: float = 0.15, seed: int = 42) -> DataFrame:
    """Per-chunk queries, one synthesis row for each topic of enough chunks, and rewritten ones for a share of the first; ids are consecutive, in this order.

    kept: chunk_id, source, tier, section, breadcrumb, text, seed_query, pos.
    """
    base = kept.select(F.col("seed_query").alias("query_text"), F.col("chunk_id").alias("seed_chunk_id"), "source", "tier", F.lit("per_chunk").alias("query_type"), F.col("pos").alias("_o"))
    synth = synthesised(topics(kept), synthesis).withColumn("query_type", F.lit("synthesis")).withColumnRenamed("topic", "_t")
    rewrites = rewritten(base, rewrite, share, seed).withColumn("query_type", F.lit("adversarial"))
    every = base.withColumn("_k", F.lit(0)).unionByName(synth.withColumn("_k", F.lit(1)), allowMissingColumns=True).unionByName(rewrites.withColumn("_k", F.lit(2)), allowMissingColumns=True)
    numbered = joins.numbered(every, "n", "_k", "_o", "_t").withColumn("query_id", X.sequential_id(F.col("n")))
    return numbered.select("query_id", "query_text", "seed_chunk_id", "source", "tier", "query_type", "adversarial_type", "seed_chunk_ids")


def pooled(queries: DataFrame, runs: dict[str, DataFrame], top_k: int = 10) -> DataFrame:
    """Candidates of each query from the named runs (query_id, chunk_id, rank), its seed chunk included."""
    rankings = None
    for name, run in runs.items():
        rows = run.select("query_id", "chunk_id", "rank", F.lit(name).alias("retriever"))
        rankings = rows if rankings is None else rankings.unionByName(rows)
    return retrieval.candidates(rankings, queries.select("query_id", "seed_chunk_id"), list(runs), top_k)


def pool_candidates(queries: DataFrame, chunks: DataFrame, retrievers: dict[str, Callable[[DataFrame, DataFrame], DataFrame]], path: str, top_k: int = 10) -> tuple[DataFrame, int]:
    """(the pool at ``path``, number of candidates whose chunk the corpus lacks): each retriever is run on the queries that have no candidates there yet, and what it finds is fused and appended.

    A retriever takes (queries, chunks) and gives query_id, chunk_id, rank. Running it again pools nothing twice.
    """
    there = table_at(queries.sparkSession, path)
    todo = queries if there is None else queries.join(there.select("query_id").distinct(), "query_id", "left_anti")
    if not todo.isEmpty():
        append_new(pooled(todo, {name: run(todo, chunks) for name, run in retrievers.items()}, top_k), path, ["query_id", "chunk_id"])
    pool = queries.sparkSession.read.parquet(path)
    return pool, pool.join(chunks.select("chunk_id"), "chunk_id", "left_anti").count()


def to_judge(pool: DataFrame, judged: DataFrame, queries: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs of the pool without a label, with both texts; pairs without a label whose chunk is not in the corpus)."""
    todo = joins.unjudged(pool.select("query_id", "chunk_id"), judged)
    missing = todo.join(chunks.select("chunk_id"), "chunk_id", "left_anti").select("query_id", "chunk_id")
    return todo.join(queries.select("query_id", "query_text"), "query_id").join(chunks.select("chunk_id", "text"), "chunk_id"), missing
