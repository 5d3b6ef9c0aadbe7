"""Lexical and dense retrieval, fusion of ranked lists, candidate pools.

Ties everywhere: score descending, rounded to six digits, then chunk_id ascending.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from poolsmith.functions.text import tokens
from poolsmith.sources.shared import shared_table, spread

PAIR = ["query_id", "chunk_id"]


def ranked(scores: DataFrame, k: int, *by: str) -> DataFrame:
    """The top k a query with rank; Spark cuts each partition to k rows a query before it shuffles."""
    order = Window.partitionBy(*by, "query_id").orderBy(F.desc(F.round("score", 6)), "chunk_id")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


#: At most so many rows are sent to every task; more are joined by a shuffle.
SENT = 1 << 20
#: About so many scores, or terms of chunks, are summed up in one task.
SUMMED = 1 << 19


def sent(df: DataFrame) -> DataFrame:
    """df, to be sent to every task where it is small; it is counted first."""
    return F.broadcast(df) if df.count() <= SENT else df


def tokenised(chunks: DataFrame, text: Column | None = None) -> DataFrame:
    """chunk_id, dl, w: each chunk's tokens and their number, written once, so that texts are read and cut in one pass."""
    read = spread(chunks.select("chunk_id", (F.col("text") if text is None else text).alias("text")))
    words = read.select("chunk_id", tokens(F.col("text")).alias("w"))
    return shared_table(words.select("chunk_id", F.size("w").alias("dl"), "w"), "tokens")


def postings(words: DataFrame) -> DataFrame:
    """term, chunk_id, tf, dl: one row for each term of a chunk. Counted within the chunk's task before anything is shuffled."""
    return words.select("chunk_id", "dl", F.explode("w").alias("term")).groupBy("chunk_id", "dl", "term").agg(F.count("*").alias("tf"))


def term_statistics(words: DataFrame) -> DataFrame:
    """term, df, total: in how many chunks a term is, and how often. Each task combines its chunks' counts first."""
    distinct = words.select(F.explode(F.array_distinct("w")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    total = words.select(F.explode("w").alias("term")).groupBy("term").agg(F.count("*").alias("total"))
    return distinct.join(total, "term")


def bm25(queries: DataFrame, chunks: DataFrame, k: int, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25, include_breadcrumb: bool = False, fill: bool = True, words: DataFrame | None = None) -> DataFrame:
    """query_id, chunk_id, score, rank of the Okapi top k. words: the chunks' tokens, where they have been made already.

    idf = ln(n - df + 0.5) - ln(df + 0.5), negative ones become epsilon times the mean idf; a query's terms
    count as often as it has them. Only tokens that are query terms leave their chunk's task, so that a stop
    word that no query has costs nothing; their counts are dealt by chunk, where the scores are summed without
    another shuffle. There are as many parts as the number of scores asks for, so that a task's memory doesn't
    grow with the tables. fill: chunks that share no term with a query have score 0, and compete in order of id.
    """
    words = words or tokenised(chunks, F.concat_ws("\n", F.nullif("breadcrumb", F.lit("")), "text") if include_breadcrumb else None)
    n, avgdl = words.agg(F.count("*"), F.avg("dl")).first()
    df = shared_table(words.select(F.explode(F.array_distinct("w")).alias("term")).groupBy("term").agg(F.count("*").alias("df")), "terms")
    rarity = F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    mean = df.agg(F.avg(rarity)).first()[0]
    asked = queries.select("query_id", F.explode(tokens(F.col("query_text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    idf = F.when(rarity < 0, F.lit(epsilon) * F.lit(mean)).otherwise(rarity)
    asked = shared_table(asked.join(df, "term").select("query_id", "term", (F.col("qtf") * idf * (k1 + 1)).alias("weight"), "df"), "asked")
    terms = sent(asked.select("term").distinct())
    added, by = asked.agg(F.sum("df"), F.count_distinct("query_id")).first()
    held = asked.groupBy("term").agg(F.first("df").alias("df")).agg(F.sum("df")).first()[0]
    parts = max(words.sparkSession.sparkContext.defaultParallelism, -(-max(min(added or 0, n * by), held or 0) // SUMMED))
    counted = words.select("chunk_id", "dl", F.explode("w").alias("term")).join(terms, "term", "left_semi").repartition(parts, "chunk_id").groupBy("chunk_id", "dl", "term").agg(F.count("*").alias("tf"))
    part = F.col("weight") * F.col("tf") / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.lit(avgdl)))
    asked = asked.drop("df")
    scores = counted.join(sent(asked), "term").groupBy("chunk_id", "query_id").agg(F.sum(part).alias("score")).select(*PAIR, "score")
    if not fill:
        return ranked(scores, k)
    top = shared_table(ranked(scores, k), "top")
    short = queries.select("query_id").join(top.where(F.round("score", 6) > 0).groupBy("query_id").agg(F.count("*").alias("m")), "query_id", "left").where(F.coalesce("m", F.lit(0)) < k).select("query_id")
    if short.isEmpty():
        return top
    # of the chunks without a shared term, the k first by id are enough; with less than k matches, they are among the first 2 k
    # chunks, and with more matches whose scores are negative, among as many more
    most = scores.groupBy("query_id").agg(F.count("*").alias("m")).join(short, "query_id", "left_semi").agg(F.max("m")).first()[0] or 0
    first = words.select("chunk_id").orderBy("chunk_id").limit(k + most)
    shared = words.join(first, "chunk_id", "left_semi").select("chunk_id", F.explode(F.array_distinct("w")).alias("term")).join(asked.join(short, "query_id", "left_semi"), "term").select(*PAIR).distinct()
    zero = short.crossJoin(first).join(shared, PAIR, "left_anti").withColumn("score", F.lit(0.0))  # some more than k rows a query
    return ranked(top.drop("rank").unionByName(ranked(zero, k).drop("rank")), k)


def containing(queries: DataFrame, chunks: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """query_id, chunk_id: chunks whose text holds the query's.

    What holds a text has each of its inner tokens; chunks with its rarest one are looked up and compared. Only
    the first and last token may be part of a longer one, so texts of less than three tokens, which have no
    inner token, are held against all chunks.
    """
    cut = queries.select("query_id", "query_text", tokens(F.col("query_text")).alias("w")).where("query_text IS NOT NULL")
    inner = cut.where(F.size("w") > 2).select("query_id", "query_text", F.explode(F.array_distinct(F.slice("w", 2, F.size("w") - 2))).alias("term"))
    words = (words or tokenised(chunks)).select("chunk_id", F.explode(F.array_distinct("w")).alias("term"))
    df = words.join(sent(inner.select("term").distinct()), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    rarest = shared_table(inner.join(df, "term").groupBy("query_id", "query_text").agg(F.min_by("term", F.struct("df", "term")).alias("term")), "rarest")
    near = words.join(sent(rarest.select("term").distinct()), "term", "left_semi").join(sent(rarest), "term")
    found = near.join(chunks.select("chunk_id", "text"), "chunk_id").where(F.contains("text", F.col("query_text"))).select(*PAIR)
    short = cut.where(F.size("w") <= 2).select("query_id", "query_text")
    if short.isEmpty():
        return found
    return found.unionByName(chunks.select("chunk_id", "text").crossJoin(short).where(F.contains("text", F.col("query_text"))).select(*PAIR))  # a stated query set against all rows


# --- vectors, in blocks -------------------------------------------------------------------------

#: Vectors in a block of queries and of the corpus; blocks of queries of at most so many bytes in all are sent to every task.
QUERY_BLOCK, CORPUS_BLOCK, SENT_BYTES = 256, 1024, 64 << 20


def packed(rows: DataFrame, name: str, size: int) -> DataFrame:
    """ids, counts, matrix: rows (id, arrays of vectors) of a partition in blocks of ``size`` rows. Rows without vectors are left out."""
    kind = rows.schema[name].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, size):
                part = batch.slice(i, size)
                vectors = part.column(1).flatten()
                numbers = np.ascontiguousarray(vectors.flatten().to_numpy(zero_copy_only=False), np.float32)
                yield pa.RecordBatch.from_arrays([pa.array([part.column(0).to_pylist()], pa.list_(part.schema.field(0).type)), pa.array([part.column(1).value_lengths().to_pylist()], pa.list_(pa.int32())), pa.array([numbers.tobytes()], pa.large_binary() if len(numbers) >= 1 << 29 else pa.binary())], names=["ids", "counts", "matrix"])

    return rows.where(F.size("vectors") > 0).select(name, F.col("vectors").cast("array<array<float>>")).mapInArrow(run, f"ids array<{kind}>, counts array<int>, matrix binary")


def best_of_blocks(queries: DataFrame, corpus: DataFrame, k: int, unit: bool) -> DataFrame:
    """query_id, chunk_id, score, rank: queries and corpus as (id, vectors: an array of vectors).

    A score is the sum, over the query's vectors, of the best product with one of the chunk's. Blocks of
    queries meet blocks of the corpus: a pair of blocks is one product of matrices, which gives out k rows a query.
    """
    asked = packed(queries, "query_id", QUERY_BLOCK)
    q_type, c_type = queries.schema["query_id"].dataType, corpus.schema["chunk_id"].dataType
    asked = shared_table(asked.select(F.col("ids").alias("q_ids"), F.col("counts").alias("q_counts"), F.col("matrix").alias("q_matrix")), "queries")
    weight = asked.agg(F.sum(F.octet_length("q_matrix"))).first()[0] or 0

    def matrix(raw: bytes, counts: np.ndarray) -> np.ndarray:
        m = np.frombuffer(raw, np.float32).astype(np.float64).reshape(counts.sum(), -1)
        return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12) if unit else m

    def first(counts: np.ndarray) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(counts)[:-1]])

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                c_ids, c_counts, c_raw, q_ids, q_counts, q_raw = (batch.column(j)[i] for j in range(6))
                c_counts, q_counts = (x.values.to_numpy() for x in (c_counts, q_counts))
                scores = matrix(q_raw.as_py(), q_counts) @ matrix(c_raw.as_py(), c_counts).T
                scores = np.add.reduceat(np.maximum.reduceat(scores, first(c_counts), axis=1), first(q_counts), axis=0)
                # everything that is as good as the k-th best, ties in the rounded score included
                rounded = np.round(scores, 6)
                cut = -np.partition(-rounded, k - 1, axis=1)[:, k - 1 : k] if scores.shape[1] > k else np.full((len(scores), 1), -np.inf)
                q, c = np.nonzero(rounded >= cut)
                yield pa.RecordBatch.from_arrays([q_ids.values.take(pa.array(q)), c_ids.values.take(pa.array(c)), pa.array(scores[q, c])], names=["query_id", "chunk_id", "score"])

    # a stated query set against all rows, in blocks
    pairs = packed(corpus, "chunk_id", CORPUS_BLOCK).crossJoin(F.broadcast(asked) if weight <= SENT_BYTES else asked)
    schema = f"query_id {q_type.simpleString()}, chunk_id {c_type.simpleString()}, score double"
    return ranked(pairs.mapInArrow(multiply, schema), k)


def dense(queries: DataFrame, corpus: DataFrame, k: int, cosine: bool = True) -> DataFrame:
    """query_id, chunk_id, score, rank of the exact top k. queries: query_id, embedding; corpus: chunk_id, embedding; rows without one are left out."""
    one = lambda df, name: df.where("embedding IS NOT NULL").select(name, F.array("embedding").alias("vectors"))
    return best_of_blocks(one(queries, "query_id"), one(corpus, "chunk_id"), k, cosine)


def late_interaction(queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """query_id, chunk_id, score, rank by summed best matches. queries: query_id, vectors; corpus: chunk_id, vectors (arrays of vectors). Exact: each query meets each chunk."""
    return best_of_blocks(queries, corpus, k, False)


#: Texts that an encoder is given at once.
ENCODED = 256


def encoded(rows: DataFrame, encode, text: str = "text") -> DataFrame:
    """rows with ``embedding``: ``encode`` makes vectors of a list of texts; any model can stand behind it.

    Texts become Python's a few at a time. The model is asked once for each row: as the function isn't said to be
    deterministic, Spark doesn't run it again for a filter on its result.
    """
    kind = pa.list_(pa.float32())

    @F.arrow_udf("array<float>")
    def run(texts: pa.Array) -> pa.Array:
        given = (texts.slice(i, ENCODED).to_pylist() for i in range(0, len(texts), ENCODED))
        return pa.concat_arrays([pa.array([], kind), *(pa.array(list(map(list, encode([t or "" for t in some]))), kind) for some in given)])

    return rows.withColumn("embedding", run.asNondeterministic()(text))


def hashing_encoder(dims: int = 64):
    """A stand-in for a model: signed hashes of words."""
    from zlib import crc32

    def encode(texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), dims))
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = crc32(w.encode())
                out[i, h % dims] += 1.0 if h >> 16 & 1 else -1.0
        return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)).tolist()

    return encode


def rrf(rankings: DataFrame, k: int = 60) -> DataFrame:
    """query_id, chunk_id, rrf_score, rank, fused by reciprocal ranks."""
    fused = rankings.groupBy(*PAIR).agg(F.sum(1.0 / (F.lit(k) + F.col("rank"))).alias("rrf_score"))
    return fused.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("rrf_score", 12)), "chunk_id")))


def candidates(rankings: DataFrame, seeds: DataFrame, retrievers: list[str], top_k: int, k: int = 60) -> DataFrame:
    """query_id, chunk_id, <retriever>_rank..., rrf_score, seed: each query's pool, and its seed chunk with score 0 where nobody found it.

    seeds: query_id, seed_chunk_id. Ranks and the fused score come from one aggregation.
    """
    rank = [F.min(F.when(F.col("retriever") == r, F.col("rank"))).alias(f"{r}_rank") for r in retrievers]
    pool = rankings.where(F.col("rank") <= top_k).groupBy(*PAIR).agg(*rank, F.bround(F.sum(1.0 / (F.lit(k) + F.col("rank"))), 6).alias("rrf_score"))
    seed = seeds.select("query_id", F.col("seed_chunk_id").alias("chunk_id"), F.lit(True).alias("_s"))
    joined = pool.join(seed.where("chunk_id IS NOT NULL"), PAIR, "full")
    return joined.select(*PAIR, *(f"{r}_rank" for r in retrievers), F.coalesce("rrf_score", F.lit(0.0)).alias("rrf_score"), F.coalesce("_s", F.lit(False)).alias("seed"))


def nested_candidates(pool: DataFrame, retrievers: list[str]) -> DataFrame:
    """query_id, candidates: the pool in order, what nobody found at the end."""
    row = F.struct((-F.col("rrf_score")).alias("_o"), "chunk_id", *(f"{r}_rank" for r in retrievers), "rrf_score", "seed")
    return pool.groupBy("query_id").agg(F.array_sort(F.collect_list(row)).alias("c")).select("query_id", F.transform("c", lambda x: x.dropFields("_o")).alias("candidates"))


def token_batches(rows: DataFrame, by: str, order: str, max_tokens: int = 90_000, max_rows: int = 1000) -> DataFrame:
    """rows with ``batch``: cut where one more text would make too many tokens or rows. Greedy, so it goes through each group of ``by`` in order, group by group."""
    from poolsmith.functions.text import token_estimate

    schema = rows.withColumn("tokens", token_estimate(F.col("text")).cast("long")).withColumn("batch", F.lit(0)).schema

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, number, used, n = object(), 0, 0, 0
        for frame in frames:
            batches = []
            for g, t in zip(frame[by], frame["tokens"], strict=True):
                if g != group:
                    group, number, used, n = g, 0, 0, 0
                elif n and (used + t > max_tokens or n == max_rows):
                    number, used, n = number + 1, 0, 0
                used, n = used + t, n + 1
                batches.append(number)
            yield frame.assign(batch=np.array(batches, np.int32))

    counted = rows.withColumn("tokens", token_estimate(F.col("text")).cast("long"))
    return counted.repartition(by).sortWithinPartitions(by, order).mapInPandas(cut, schema)
