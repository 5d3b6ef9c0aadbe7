"""Registered queries, one or more for each operator, with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from poolsmith.functions import fixed, rubric, vectors
from poolsmith.functions import text as X
from poolsmith.operators import joins, metrics, retrieval, sampling
from poolsmith.plans import models, pipelines
from poolsmith.plans.stand_ins import relation, with_relations
from poolsmith.sources.corpus import nested_rankings, one_a_key, rankings_from_nested
from poolsmith.sources.shared import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
SEED = 42


def query(name: str, relations: str, sql: str | None = None):
    """Register a function of the named relations, and its SQL over the same ones."""

    def register(f):
        QUERIES[name] = lambda spark, sf_dir: f(*(relation(spark, sf_dir, r) for r in relations.split()))
        if sql:
            SQL[name] = with_relations(relations, sql)
        return f

    return register


# --- dense retrieval to metrics, the flagship ---------------------------------------------------

DENSE_SQL = """WITH q AS (SELECT chunk_id AS query_id, embedding AS e, label AS l FROM vectors WHERE chunk_id % 20 = 0),
 unit AS (SELECT chunk_id, label, list_transform(embedding, lambda x: x::double) AS v FROM vectors),
 s AS (SELECT q.query_id, u.chunk_id, q.l = u.label AS same,
        list_dot_product(list_transform(q.e, lambda x: x::double), u.v) / sqrt(list_dot_product(u.v, u.v)) / sqrt(list_dot_product(list_transform(q.e, lambda x: x::double), list_transform(q.e, lambda x: x::double))) AS score
       FROM q, unit u WHERE u.chunk_id <> q.query_id),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, chunk_id) AS rank FROM s)
"""


def dense_run(v: DataFrame, k: int) -> DataFrame:
    """Every twentieth vector as a query against all others."""
    asked = v.where("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), "embedding")
    best = retrieval.dense(asked, v.select("chunk_id", "embedding"), k + 1).where("chunk_id != query_id")
    return retrieval.ranked(best.drop("rank"), k)


@query("t3_dense_top_k", "vectors", DENSE_SQL + "SELECT query_id, chunk_id, round(score, 4) AS score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 10")
def _(v):
    return dense_run(v, 10).select("query_id", "chunk_id", F.round("score", 4).alias("score"), "rank")


@query("flagship_dense_metrics", "vectors", DENSE_SQL + "SELECT query_id, CAST(max(CASE WHEN same THEN 1 ELSE 0 END) AS DOUBLE) AS hr, sum(CASE WHEN same THEN 1 ELSE 0 END) / 3.0::double AS precision, coalesce(1.0::double / min(CASE WHEN same THEN rank END), 0) AS mrr FROM r WHERE rank <= 3 GROUP BY query_id")
def flagship(v):
    run = dense_run(v, 3).join(v.select(F.col("chunk_id").alias("query_id"), F.col("label").alias("l")), "query_id").join(v.select("chunk_id", "label"), "chunk_id")
    hit = F.col("l") == F.col("label")
    return run.groupBy("query_id").agg(F.max(hit.cast("double")).alias("hr"), (F.count_if(hit) / F.lit(3.0)).alias("precision"), F.coalesce(F.lit(1.0) / F.min(F.when(hit, F.col("rank"))), F.lit(0.0)).alias("mrr"))


@query("f18_f19_vector_functions", "vectors", "SELECT chunk_id, round(sqrt(list_dot_product(v, v)), 4) AS norm, round(v[1] / greatest(sqrt(list_dot_product(v, v)), 1e-12), 4) AS first_unit, round(list_dot_product(v, list_reverse(v)) / list_dot_product(v, v), 4) AS reversed_cosine FROM (SELECT chunk_id, list_transform(embedding, lambda x: x::double) AS v FROM vectors) t")
def _(v):
    e = F.col("embedding")
    return v.select("chunk_id", F.round(vectors.norm(e), 4).alias("norm"), F.round(vectors.normalised(e)[0], 4).alias("first_unit"), F.round(vectors.cosine(e, F.reverse(e)), 4).alias("reversed_cosine"))


@query("t6_late_interaction", "vectors", """WITH m AS (SELECT chunk_id, list_transform(embedding, lambda x: x::double) AS v FROM vectors),
 parts AS (SELECT chunk_id, [v[1:32], v[33:64]] AS p FROM m),
 s AS (SELECT q.chunk_id AS query_id, d.chunk_id, greatest(list_dot_product(q.p[1], d.p[1]), list_dot_product(q.p[1], d.p[2])) + greatest(list_dot_product(q.p[2], d.p[1]), list_dot_product(q.p[2], d.p[2])) AS score FROM parts q, parts d WHERE q.chunk_id % 20 = 0),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, chunk_id) AS rank FROM s)
 SELECT query_id, chunk_id, round(score, 4) AS score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 5""")
def _(v):
    halves = v.select("chunk_id", F.array(F.slice("embedding", 1, 32), F.slice("embedding", 33, 32)).alias("vectors"))
    asked = halves.where("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), "vectors")
    return retrieval.late_interaction(asked, halves, 5).select("query_id", "chunk_id", F.round("score", 4).alias("score"), "rank")


# --- lexical retrieval --------------------------------------------------------------------------

TOKENS = "list_filter(string_split_regex(regexp_replace(lower({t}), '[^a-z0-9]', ' ', 'g'), ' +'), lambda x: x <> '')"
BM25_SQL = f"""WITH w AS (SELECT chunk_id, {TOKENS.format(t='text')} AS w FROM chunks),
 posted AS (SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest(w) AS term FROM w) a GROUP BY chunk_id, term),
 dl AS (SELECT chunk_id, len(w) AS dl FROM w), corpus AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
 idf0 AS (SELECT term, count(*) AS df, ln(max(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM posted, corpus GROUP BY term),
 idf AS (SELECT term, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM idf0) ELSE idf END AS idf FROM idf0),
 asked AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({TOKENS.format(t='query_text')}) AS term FROM queries) a GROUP BY query_id, term),
 s AS (SELECT query_id, posted.chunk_id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM asked JOIN idf USING (term) JOIN posted USING (term) JOIN dl USING (chunk_id), corpus GROUP BY query_id, posted.chunk_id),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, chunk_id) AS rank FROM s)
"""


@query("t1_bm25_top_k", "queries chunks", BM25_SQL + "SELECT query_id, chunk_id, round(score, 4) AS score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 10")
def _(q, c):
    return retrieval.bm25(q, c, 10).select("query_id", "chunk_id", F.round("score", 4).alias("score"), "rank")


@query("t1_bm25_containment_metrics", "queries chunks", BM25_SQL + """, rel AS (SELECT query_id, chunk_id FROM queries JOIN chunks ON contains(text, query_text))
 SELECT count(*) AS n, avg(CAST(hit IS NOT NULL AS INT)) AS hr, avg(coalesce(1.0::double / hit, 0)) AS mrr FROM (
  SELECT rel.query_id, min(rank) AS hit FROM rel LEFT JOIN (SELECT * FROM r WHERE rank <= 10) t ON t.query_id = rel.query_id AND t.chunk_id = rel.chunk_id GROUP BY rel.query_id) x""")
def _(q, c):
    words = retrieval.tokenised(c)
    run = retrieval.bm25(q, c, 10, words=words)
    found = retrieval.containing(q, c, words)
    hit = found.join(run.select("query_id", "chunk_id", "rank"), ["query_id", "chunk_id"], "left").groupBy("query_id").agg(F.min("rank").alias("hit"))
    return hit.agg(F.count("*").alias("n"), F.avg(F.col("hit").isNotNull().cast("double")).alias("hr"), F.avg(F.coalesce(1.0 / F.col("hit"), F.lit(0.0))).alias("mrr"))


@query("a21_corpus_statistics", "chunks", f"WITH w AS (SELECT chunk_id, {TOKENS.format(t='text')} AS w FROM chunks) SELECT term, count(DISTINCT chunk_id) AS df, CAST(count(*) AS BIGINT) AS total FROM (SELECT chunk_id, unnest(w) AS term FROM w) a GROUP BY term")
def _(c):
    return retrieval.term_statistics(retrieval.tokenised(c))


# --- fusion and pools ---------------------------------------------------------------------------


@query("t8_a11_rrf", "rankings", "SELECT query_id, chunk_id, round(s, 9) AS rrf_score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, chunk_id) AS INT) AS rank FROM (SELECT query_id, chunk_id, sum(1.0::double / (60 + rank)) AS s FROM rankings GROUP BY query_id, chunk_id) x")
def _(r):
    return retrieval.rrf(r).withColumn("rrf_score", F.round("rrf_score", 9))


@query("t9_candidates_with_seed", "rankings", """WITH seeds AS (SELECT query_id, max(chunk_id) AS chunk_id FROM rankings WHERE rank >= 15 GROUP BY query_id),
 pool AS (SELECT query_id, chunk_id, min(rank) FILTER (retriever = 'r0') AS r0_rank, min(rank) FILTER (retriever = 'r1') AS r1_rank, min(rank) FILTER (retriever = 'r2') AS r2_rank, min(rank) FILTER (retriever = 'r3') AS r3_rank, sum(1.0::double / (60 + rank)) AS s FROM rankings WHERE rank <= 10 GROUP BY query_id, chunk_id)
 SELECT coalesce(p.query_id, s.query_id) AS query_id, coalesce(p.chunk_id, s.chunk_id) AS chunk_id, r0_rank, r1_rank, r2_rank, r3_rank, coalesce(round(p.s, 6), 0) AS rrf_score, s.query_id IS NOT NULL AS seed FROM pool p FULL JOIN seeds s ON p.query_id = s.query_id AND p.chunk_id = s.chunk_id""")
def _(r):
    seeds = r.where("rank >= 15").groupBy("query_id").agg(F.max("chunk_id").alias("seed_chunk_id"))
    return retrieval.candidates(r, seeds, ["r0", "r1", "r2", "r3"], 10)


@query("o1_o2_union_pool", "rankings", "SELECT query_id, chunk_id, CAST(count(*) AS BIGINT) AS n_retrievers, min(rank) AS best, string_agg(retriever || ':' || rank, ',' ORDER BY retriever) AS ranks FROM rankings WHERE rank <= 10 GROUP BY query_id, chunk_id")
def _(r):
    u = joins.union_of_top(r, 10)
    e = F.map_entries("ranks")
    return u.select("query_id", "chunk_id", F.size("ranks").cast("long").alias("n_retrievers"), F.array_min(F.map_values("ranks")).alias("best"), F.array_join(F.transform(e, lambda x: F.concat_ws(":", x["key"], x["value"].cast("string"))), ",").alias("ranks"))


@query("w5_first_seen_order", "rankings", "SELECT query_id, chunk_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY place, rank) AS INT) AS ord FROM (SELECT query_id, chunk_id, place, rank, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY place, rank) AS n FROM (SELECT *, CASE retriever WHEN 'r2' THEN 1 WHEN 'r0' THEN 2 WHEN 'r3' THEN 3 ELSE 4 END AS place FROM rankings) a) b WHERE n = 1")
def _(r):
    return joins.first_seen(r, ["r2", "r0", "r3", "r1"])


@query("w3_sparse_ranks", "rankings", "SELECT query_id, 'r1' AS retriever, chunk_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank) AS INT) AS rank FROM rankings WHERE retriever = 'r1' AND rank % 2 = 0")
def _(r):
    wide = r.where("rank % 2 = 0").groupBy("query_id", "chunk_id").pivot("retriever", ["r0", "r1"]).agg(F.min("rank"))
    long = wide.select("query_id", "chunk_id", F.expr("stack(2, 'r0', r0, 'r1', r1) AS (retriever, sparse)")).where("sparse IS NOT NULL AND retriever = 'r1'")
    return long.select("query_id", "retriever", "chunk_id", F.row_number().over(Window.partitionBy("query_id").orderBy("sparse")).alias("rank"))


@query("src11_src12_nested_rankings", "rankings", "SELECT query_id, retriever, rank, chunk_id, score FROM rankings WHERE rank <= 5")
def _(r):
    return rankings_from_nested(nested_rankings(r, 5))


# --- joins and sets -----------------------------------------------------------------------------


@query("j3_j4_unjudged_pairs", "rankings labels", "SELECT DISTINCT query_id, chunk_id FROM rankings r WHERE rank <= 10 AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.query_id = r.query_id AND l.chunk_id = r.chunk_id)")
def _(r, lab):
    return joins.unjudged(joins.top(r, 10).select("query_id", "chunk_id").distinct(), lab)


@query("j3_j8_regrouped", "rankings labels", """SELECT query_id, concat('query ', CAST(query_id AS VARCHAR)) AS query_text, string_agg(CAST(chunk_id AS VARCHAR), ',' ORDER BY chunk_id) AS candidates FROM (SELECT DISTINCT query_id, chunk_id FROM rankings r WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.query_id = r.query_id AND l.chunk_id = r.chunk_id)) x GROUP BY query_id""")
def _(r, lab):
    texts = r.select("query_id").distinct().withColumn("query_text", F.concat(F.lit("query "), F.col("query_id").cast("string")))
    return joins.with_query_text(joins.unjudged(r.select("query_id", "chunk_id"), lab), texts).withColumn("candidates", F.array_join(F.col("candidates").cast("array<string>"), ","))


@query("j10_p15_missing_chunks", "queries chunks", """SELECT count(*) AS wanted, count(c.chunk_id) AS found, count(*) - count(c.chunk_id) AS missing FROM (SELECT query_id, seed_chunk_id AS chunk_id FROM queries UNION ALL SELECT query_id, concat('gone', query_id) FROM queries) q LEFT JOIN chunks c ON c.chunk_id = q.chunk_id""")
def _(q, c):
    pairs = q.select("query_id", F.col("seed_chunk_id").alias("chunk_id")).unionByName(q.select("query_id", F.concat(F.lit("gone"), "query_id").alias("chunk_id")))
    found, missing = joins.with_chunk_text(pairs, c)
    return found.agg(F.count("*").alias("found")).select((F.col("found") + missing).alias("wanted"), "found", F.lit(missing).cast("long").alias("missing"))


@query("j5_marked_pool", "rankings labels", "SELECT r.query_id, r.retriever, r.chunk_id, l.query_id IS NOT NULL AS judged FROM rankings r LEFT JOIN labels l ON l.query_id = r.query_id AND l.chunk_id = r.chunk_id WHERE rank <= 5")
def _(r, lab):
    return joins.marked(joins.top(r, 5).select("query_id", "retriever", "chunk_id"), lab)


@query("j6_missed_relevant", "rankings labels", "SELECT query_id, chunk_id, score FROM labels l WHERE score >= 5 AND NOT EXISTS (SELECT 1 FROM rankings r WHERE r.rank <= 10 AND l.query_id = r.query_id AND l.chunk_id = r.chunk_id)")
def _(r, lab):
    return joins.missed(lab.where("score >= 5").select("query_id", "chunk_id", "score"), joins.top(r, 10))


@query("j2_src13_restricted_labels", "labels rankings", "SELECT query_id, chunk_id, score FROM labels WHERE query_id IN (SELECT query_id FROM rankings WHERE rank > 15)")
def _(lab, r):
    return joins.restrict(lab, r.where("rank > 15")).select("query_id", "chunk_id", "score")


@query("j1_w7_ordered_lookup", "queries", "SELECT query_id, query_text, CAST(row_number() OVER (ORDER BY query_id DESC) AS INT) AS pos FROM queries")
def _(q):
    ids = joins.numbered(q.select("query_id"), "pos", F.desc("query_id"))
    return joins.ordered_lookup(ids, q.select("query_id", "query_text"), "query_id")


@query("j7_review_rows", "chunks queries", "SELECT q.query_id, q.seed_chunk_id AS chunk_id, c.chunk_id IS NOT NULL AS in_corpus, CASE WHEN c.chunk_id IS NULL THEN 'NOT IN CORPUS' WHEN length(c.text) > 200 THEN rtrim(substr(c.text, 1, 200), ' ') || ' […]' ELSE c.text END AS text FROM queries q LEFT JOIN chunks c ON c.chunk_id = q.seed_chunk_id")
def _(c, q):
    seeds = q.select("query_id", F.col("seed_chunk_id").alias("chunk_id"))
    return joins.enriched(seeds, c, q, 200).select("query_id", "chunk_id", "in_corpus", "text")


@query("j9_j10_kept_chunks", "results chunks", "SELECT c.chunk_id, c.source, c.page, r.seed_query FROM results r JOIN chunks c ON c.chunk_id = r.chunk_id WHERE r.seed_query IS NOT NULL")
def _(res, c):
    return c.join(res.where("seed_query IS NOT NULL").select("chunk_id", "seed_query"), "chunk_id").select("chunk_id", "source", "page", "seed_query")


@query("j11_traces", "labels", "SELECT query_id, chunk_id, score, concat('trace of ', CAST(query_id + 1 AS VARCHAR)) AS trace FROM labels")
def _(lab):
    keys = lab.select("query_id", "chunk_id")
    traces = keys.withColumn("o", F.lit(1)).withColumn("t", F.col("query_id")).unionByName(keys.withColumn("o", F.lit(2)).withColumn("t", F.col("query_id") + 1))
    joined = joins.must_match(lab.select("query_id", "chunk_id", "score"), traces, ["query_id", "chunk_id"], "o")
    return joined.select("query_id", "chunk_id", "score", F.concat(F.lit("trace of "), F.col("t").cast("string")).alias("trace"))


@query("j12_referenced_chunks", "chunks queries", "SELECT chunk_id, source, page FROM chunks WHERE chunk_id IN (SELECT seed_chunk_id FROM queries)")
def _(c, q):
    known = joins.restrict(q.select(F.col("seed_chunk_id").alias("query_id")), c.select(F.col("chunk_id").alias("query_id"))).withColumnRenamed("query_id", "chunk_id")
    return joins.referenced(known, c).select("chunk_id", "source", "page")


@query("j19_missing_sources", "chunks", "SELECT source FROM (SELECT concat('src', CAST(range AS VARCHAR)) AS source FROM range(40)) x WHERE source NOT IN (SELECT source FROM chunks WHERE source IS NOT NULL)")
def _(c):
    configured = c.sparkSession.range(40).select(F.concat(F.lit("src"), F.col("id").cast("string")).alias("source"))
    return configured.join(c.select("source"), "source", "left_anti")


@query("o3_label_override", "labels labels_v1", "SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.chunk_id, b.chunk_id) AS chunk_id, CASE WHEN b.query_id IS NOT NULL THEN b.score ELSE a.score END AS score FROM labels a FULL JOIN labels_v1 b ON a.query_id = b.query_id AND a.chunk_id = b.chunk_id")
def _(a, b):
    return joins.override(a, b, ["query_id", "chunk_id"], ["score"])


@query("o4_o5_o6_set_sizes", "labels labels_v1", """WITH a AS (SELECT query_id, chunk_id FROM labels), b AS (SELECT query_id, chunk_id FROM labels_v1)
 SELECT (SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b) x) AS both_sides, (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b) x) AS first_only, (SELECT count(*) FROM (SELECT * FROM a UNION SELECT * FROM b) x) AS either""")
def _(a, b):
    k = ["query_id", "chunk_id"]
    sides = a.select(*k).distinct().withColumn("a", F.lit(1)).join(b.select(*k).distinct().withColumn("b", F.lit(1)), k, "full")
    return sides.agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("both_sides"), F.count_if(F.col("b").isNull()).alias("first_only"), F.count("*").alias("either"))


@query("o8_merged_labels", "labels labels_v1", "SELECT query_id, chunk_id, score, 'late' AS source FROM labels_v1 b WHERE score >= 1 AND NOT EXISTS (SELECT 1 FROM labels a WHERE a.query_id = b.query_id AND a.chunk_id = b.chunk_id)")
def _(a, b):
    return joins.merge_labels(a, b.select("query_id", "chunk_id", "score"), F.col("score") >= 1, "late")


@query("p10_u6_resume", "chunks results", "SELECT c.chunk_id, EXISTS (SELECT 1 FROM results r WHERE r.chunk_id = c.chunk_id) AS stale FROM chunks c WHERE NOT EXISTS (SELECT 1 FROM results r WHERE r.chunk_id = c.chunk_id AND schema_version = 'v-now' AND prompt_hash = 'p1' AND backend = 'local' AND model = 'large' AND seed_query IS NOT NULL)")
def _(c, res):
    todo, stale = joins.remaining(c.select("chunk_id"), res, ["chunk_id"], joins.current_contract("v-now", "p1", "local", "large", needs="seed_query"))
    return todo.join(stale.select("chunk_id", F.lit(True).alias("stale")), "chunk_id", "left").select("chunk_id", F.coalesce("stale", F.lit(False)).alias("stale"))


@query("p11_p12_admission", "results", "SELECT chunk_id FROM results WHERE starts_with(schema_version, 'v-') AND coalesce(_error, '') = ''")
def _(res):
    return res.where(F.startswith("schema_version", F.lit("v-")) & (F.coalesce("_error", F.lit("")) == "")).select("chunk_id")


@query("p17_p18_shards", "chunks", "SELECT chunk_id, 'blocks' AS kind FROM chunks WHERE floor(pos / ceil((SELECT count(*) FROM chunks) / 8.0)) = 3 UNION ALL SELECT chunk_id, 'modulo' FROM chunks WHERE pos % 8 = 3")
def _(c):
    return joins.shard(c, 3, 8, "pos", True, c.count()).select("chunk_id", F.lit("blocks").alias("kind")).unionByName(joins.shard(c, 3, 8, "pos").select("chunk_id", F.lit("modulo").alias("kind")))


@query("w6_keep_first_and_last", "rankings", "SELECT query_id, chunk_id, min(rank) AS first_rank, max(rank) AS last_rank FROM rankings GROUP BY query_id, chunk_id")
def _(r):
    k = ["query_id", "chunk_id"]
    return one_a_key(r, k, "rank").select(*k, F.col("rank").alias("first_rank")).join(one_a_key(r, k, "rank", "last").select(*k, F.col("rank").alias("last_rank")), k)


# --- metrics ------------------------------------------------------------------------------------


@query("a1_score_stats", "labels", "SELECT query_id, count(score) AS n, avg(score) AS mean, min(score)::double AS min, max(score)::double AS max FROM labels GROUP BY query_id")
def _(lab):
    return metrics.stats(lab, "score", "query_id")


@query("a5_score_distribution", "labels", "SELECT score, n, CAST(sum(n) OVER (ORDER BY score DESC) AS BIGINT) AS at_least FROM (SELECT CAST(range AS INT) AS score, count(l.score) AS n FROM range(7) LEFT JOIN labels l ON l.score = range GROUP BY range) x")
def _(lab):
    return metrics.distribution(lab, 6)


HITS = """WITH j AS (SELECT r.*, coalesce(l.score, 0) AS s FROM rankings r LEFT JOIN labels l ON r.query_id = l.query_id AND r.chunk_id = l.chunk_id),
 g AS (SELECT * FROM (VALUES (3), (5)) t(threshold), (VALUES (3), (5), (10), (20)) k(k)), rel AS (SELECT query_id, threshold, count(*) AS n_rel FROM labels, (VALUES (3), (5)) t(threshold) WHERE score >= threshold GROUP BY query_id, threshold),
 q AS (SELECT retriever, query_id, threshold, k, count(*) FILTER (s >= threshold AND rank <= k) AS hits, min(rank) FILTER (s >= threshold AND rank <= k) AS f FROM j, g GROUP BY ALL)
"""


@query("m8_m10_hit_precision_all_queries", "rankings labels", HITS + "SELECT retriever, threshold, k, (SELECT count(DISTINCT query_id) FROM labels) AS n, round(sum(CAST(hits > 0 AS INT)) / (SELECT count(DISTINCT query_id) FROM labels)::double, 9) AS hr, round(sum(hits / k::double) / (SELECT count(DISTINCT query_id) FROM labels), 9) AS precision, round(sum(coalesce(1.0::double / f, 0)) / (SELECT count(DISTINCT query_id) FROM labels), 9) AS mrr FROM q WHERE query_id IN (SELECT query_id FROM labels) GROUP BY retriever, threshold, k")
def _(r, lab):
    return rounded(metrics.hit_precision_mrr(r, lab, [3, 5, 10, 20], [3, 5], "zero"))


@query("m4_m5_m6_hit_precision_mrr", "rankings labels", HITS + ", n AS (SELECT threshold, count(*) AS n FROM rel GROUP BY threshold) SELECT retriever, q.threshold, k, any_value(n.n) AS n, round(sum(CAST(hits > 0 AS INT)) / any_value(n.n)::double, 9) AS hr, round(sum(hits / k::double) / any_value(n.n), 9) AS precision, round(sum(coalesce(1.0::double / f, 0)) / any_value(n.n), 9) AS mrr FROM q JOIN rel ON rel.query_id = q.query_id AND rel.threshold = q.threshold JOIN n ON n.threshold = q.threshold GROUP BY retriever, q.threshold, k")
def _(r, lab):
    return rounded(metrics.hit_precision_mrr(r, lab, [3, 5, 10, 20], [3, 5], "exclude"))


@query("m2_m11_recall_at_k", "rankings labels", HITS + "SELECT retriever, threshold, k, count(*) AS n, round(avg(x), 9) AS mean, round(min(x), 9) AS min, round(max(x), 9) AS max FROM (SELECT rr.retriever, rel.threshold, kk.k, coalesce(hits, 0) / n_rel::double AS x FROM rel CROSS JOIN (SELECT DISTINCT retriever FROM rankings) rr CROSS JOIN (VALUES (3), (5), (10), (20)) kk(k) LEFT JOIN q ON q.query_id = rel.query_id AND q.threshold = rel.threshold AND q.k = kk.k AND q.retriever = rr.retriever) y GROUP BY retriever, threshold, k")
def _(r, lab):
    return rounded(metrics.recall(r, lab, [3, 5, 10, 20], [3, 5]))


@query("m1_pool_recall", "rankings labels", "SELECT query_id, round(avg(CAST(p IS NOT NULL AS INT)), 9) AS recall FROM (SELECT l.query_id, l.chunk_id, any_value(r.rank) AS p FROM labels l LEFT JOIN (SELECT * FROM rankings WHERE rank <= 10) r ON l.query_id = r.query_id AND l.chunk_id = r.chunk_id WHERE l.score >= 3 GROUP BY l.query_id, l.chunk_id) x GROUP BY query_id")
def _(r, lab):
    return rounded(metrics.set_recall(joins.top(r, 10), lab, 3))


@query("m3_j18_union_recall", "rankings labels", """WITH best AS (SELECT l.query_id, l.chunk_id, min(rank) FILTER (retriever IN ('r0', 'r1')) AS a, min(rank) AS b FROM labels l LEFT JOIN rankings r ON l.query_id = r.query_id AND l.chunk_id = r.chunk_id WHERE l.score >= 3 GROUP BY l.query_id, l.chunk_id),
 q AS (SELECT query_id, k, avg(CAST(coalesce(a, 99) <= k AS INT)) AS a, avg(CAST(coalesce(b, 99) <= k AS INT)) AS b FROM best, (VALUES (5), (10), (20)) k(k) GROUP BY query_id, k),
 u AS (SELECT 'two' AS subset, k, a AS x FROM q UNION ALL SELECT 'all' AS subset, k, b FROM q)
 SELECT subset, k, count(*) AS n, round(avg(x), 9) AS mean, round(min(x), 9) AS min, round(max(x), 9) AS max FROM u GROUP BY subset, k""")
def _(r, lab):
    return rounded(metrics.union_recall(r, lab, {"two": ["r0", "r1"], "all": ["r0", "r1", "r2", "r3"]}, [5, 10, 20], 3))


@query("m7_ndcg", "rankings labels", """WITH ideal AS (SELECT query_id, sum((pow(2.0, score) - 1) / log2(rank + 1.0)) AS ideal FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC) AS rank FROM labels WHERE score > 0) x WHERE rank <= 10 GROUP BY query_id),
 dcg AS (SELECT r.retriever, r.query_id, sum((pow(2.0, l.score) - 1) / log2(r.rank + 1.0)) AS dcg FROM rankings r JOIN labels l ON r.query_id = l.query_id AND r.chunk_id = l.chunk_id WHERE r.rank <= 10 AND l.score > 0 GROUP BY r.retriever, r.query_id)
 SELECT retriever, (SELECT count(*) FROM ideal) AS n, round(sum(dcg / ideal) / (SELECT count(*) FROM ideal), 9) AS ndcg FROM dcg JOIN ideal USING (query_id) GROUP BY retriever""")
def _(r, lab):
    return rounded(metrics.ndcg(r, lab, 10))


@query("m9_weighted", "rankings labels", "WITH q AS (SELECT retriever, r.query_id, max(coalesce(l.score, 0) / 6.0::double) AS whr, sum(coalesce(l.score, 0) / 6.0::double) / 3 AS wp FROM rankings r LEFT JOIN labels l ON r.query_id = l.query_id AND r.chunk_id = l.chunk_id WHERE rank <= 3 AND r.query_id IN (SELECT query_id FROM labels) GROUP BY retriever, r.query_id) SELECT retriever, (SELECT count(DISTINCT query_id) FROM labels) AS n, round(sum(whr) / (SELECT count(DISTINCT query_id) FROM labels), 9) AS whr, round(sum(wp) / (SELECT count(DISTINCT query_id) FROM labels), 9) AS wp FROM q GROUP BY retriever")
def _(r, lab):
    return rounded(metrics.weighted(r, lab, 3))


@query("m12_queries_with_relevant", "labels", "SELECT threshold, count(DISTINCT query_id) AS n FROM labels, (VALUES (3), (5)) t(threshold) WHERE score >= threshold GROUP BY threshold")
def _(lab):
    return metrics.relevant_counts(lab, [3, 5]).groupBy("threshold").agg(F.count("*").alias("n"))


COVERAGE = "WITH c AS (SELECT retriever, r.query_id, count(l.query_id) AS labelled, count(l.query_id) / 3.0::double AS coverage FROM rankings r LEFT JOIN labels l ON r.query_id = l.query_id AND r.chunk_id = l.chunk_id WHERE rank <= 3 GROUP BY retriever, r.query_id) "


@query("m13_a12_coverage_gate", "rankings labels", COVERAGE + "SELECT retriever, round(avg(coverage), 9) AS mean, CASE WHEN avg(coverage) >= 0.8 THEN 'skip' WHEN avg(coverage) >= 0.5 THEN 'run' ELSE 'must' END AS verdict FROM c GROUP BY retriever")
def _(r, lab):
    return rounded(metrics.coverage_gate(metrics.coverage(r, lab, 3)))


@query("a13_coverage_histogram", "rankings labels", COVERAGE + "SELECT retriever, labelled, count(*) AS n FROM c GROUP BY retriever, labelled")
def _(r, lab):
    return metrics.coverage(r, lab, 3).groupBy("retriever", "labelled").agg(F.count("*").alias("n"))


@query("m14_a14_implied_precision", "rankings labels_v1", "SELECT retriever, count(*) AS n, round(avg(CAST(l.score >= 1 AS INT)), 9) AS lenient, round(avg(CAST(l.score = 2 AS INT)), 9) AS strict FROM rankings r JOIN labels_v1 l ON r.query_id = l.query_id AND r.chunk_id = l.chunk_id WHERE rank <= 3 GROUP BY retriever")
def _(r, lab):
    return rounded(metrics.implied_precision(r, lab, 3))


COSINE = "list_dot_product(list_transform(a.embedding, lambda x: x::double), list_transform(b.embedding, lambda x: x::double)) / sqrt(list_dot_product(list_transform(a.embedding, lambda x: x::double), list_transform(a.embedding, lambda x: x::double))) / sqrt(list_dot_product(list_transform(b.embedding, lambda x: x::double), list_transform(b.embedding, lambda x: x::double)))"


@query("m15_sanity_gate", "vectors", f"""WITH c AS (SELECT CASE WHEN a.label = b.label THEN 'same' ELSE 'unrelated' END AS kind, {COSINE} AS c FROM vectors a JOIN vectors b ON b.chunk_id = a.chunk_id + 1),
 m AS (SELECT round(min(c) FILTER (kind = 'same'), 6) AS same_min, round(max(c) FILTER (kind = 'unrelated'), 6) AS unrelated_max FROM c)
 SELECT *, CASE WHEN same_min > 0.5 AND unrelated_max < 0.3 THEN 'pass' ELSE 'fail' END AS verdict FROM m""")
def _(v):
    """Pairs of neighbouring ids: of one label they should be near, of two far."""
    nxt = v.select((F.col("chunk_id") - 1).alias("chunk_id"), F.col("embedding").alias("e"), F.col("label").alias("l"))
    pairs = v.join(nxt, "chunk_id").select(F.when(F.col("label") == F.col("l"), "same").otherwise("unrelated").alias("kind"), vectors.cosine(F.col("embedding"), F.col("e")).alias("cosine"))
    return rounded(metrics.sanity_gate(pairs), 6)


@query("m16_paired_gap", "rankings labels", COVERAGE + "SELECT a.retriever, round(a.m, 9) AS a, round(b.m, 9) AS b, round(a.m - b.m, 9) AS gap, abs(a.m - b.m) < 0.03 AS close FROM (SELECT retriever, avg(coverage) AS m FROM c GROUP BY retriever) a JOIN (SELECT retriever, avg(coverage) AS m FROM c WHERE query_id % 2 = 0 GROUP BY retriever) b ON a.retriever = b.retriever")
def _(r, lab):
    c = metrics.coverage(r, lab, 3)
    mean = lambda x: x.groupBy("retriever").agg(F.avg("coverage").alias("m"))
    return rounded(metrics.paired_gap(mean(c), mean(c.where("query_id % 2 = 0")), "m", ["retriever"], 0.03))


@query("a22_judge_agreement", "labels labels_v1", "WITH b AS (SELECT a.score AS a, b.score AS b FROM labels a JOIN labels_v1 b ON a.query_id = b.query_id AND a.chunk_id = b.chunk_id) SELECT threshold, count(*) AS n, round(avg(CAST(a = b AS INT)), 9) AS exact, round(avg(CAST(abs(a - b) <= 1 AS INT)), 9) AS within_one, round(avg(CAST((a >= threshold) = (b >= threshold) AS INT)), 9) AS agree, round(sum(CAST(a >= threshold AND b >= threshold AS INT)) / sum(CAST(a >= threshold AS INT))::double, 9) AS precision, round(sum(CAST(a >= threshold AND b >= threshold AS INT)) / sum(CAST(b >= threshold AS INT))::double, 9) AS recall FROM b, (VALUES (1), (2)) t(threshold) GROUP BY threshold")
def _(a, b):
    return rounded(metrics.agreement(a, b, [1, 2]))


@query("a9_a10_pool_sizes", "rankings labels", "SELECT (SELECT count(DISTINCT query_id) FROM labels) AS queries, round(sum(c) / (SELECT count(DISTINCT query_id) FROM labels)::double, 9) AS mean, min(c)::double AS min, max(c)::double AS max FROM (SELECT query_id, count(DISTINCT chunk_id) AS c FROM rankings WHERE rank <= 10 AND query_id % 3 > 0 GROUP BY query_id) x")
def _(r, lab):
    return rounded(metrics.size_stats(joins.top(r, 10).where("query_id % 3 > 0"), lab), only=["mean"])


@query("a14_three_label_views", "rankings labels labels_v1", """WITH j AS (SELECT a.score AS a, b.score AS b FROM rankings r LEFT JOIN labels a ON r.query_id = a.query_id AND r.chunk_id = a.chunk_id LEFT JOIN labels_v1 b ON r.query_id = b.query_id AND r.chunk_id = b.chunk_id WHERE rank <= 3)
 SELECT 'first' AS view, a AS score, count(*) AS n FROM j WHERE a IS NOT NULL GROUP BY a UNION ALL SELECT 'second', b, count(*) FROM j WHERE b IS NOT NULL GROUP BY b UNION ALL SELECT 'union', coalesce(b, a), count(*) FROM j WHERE coalesce(b, a) IS NOT NULL GROUP BY coalesce(b, a)""")
def _(r, a, b):
    return metrics.score_views(r, a, b, 3)


@query("a9_surfaced_by", "rankings", "SELECT query_id, chunk_id, string_agg(DISTINCT retriever, ', ' ORDER BY retriever) AS surfaced_by FROM rankings WHERE rank <= 10 GROUP BY query_id, chunk_id")
def _(r):
    return joins.top(r, 10).groupBy("query_id", "chunk_id").agg(F.array_join(F.sort_array(F.collect_set("retriever")), ", ").alias("surfaced_by"))


def rounded(df: DataFrame, digits: int = 9, only: list[str] | None = None) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" and (only is None or c in only) else c for c, t in df.dtypes))


# --- grades -------------------------------------------------------------------------------------


@query("g2_g3_rubric_v2", "labels", "SELECT query_id, chunk_id, d1 AS d1, CASE WHEN d1 THEN CASE WHEN d3 >= 1 AND d2 = 0 THEN 1 ELSE d2 END ELSE 0 END AS d2, CASE WHEN d1 THEN d3 ELSE 0 END AS d3, CASE WHEN d1 THEN least(d4 * 2, 2) ELSE 0 END AS d4, CASE WHEN d1 THEN CASE WHEN d3 >= 1 AND d2 = 0 THEN 1 ELSE d2 END + d3 + least(d4 * 2, 2) ELSE 0 END AS score, CASE WHEN d1 THEN d2 + d3 + d4 ELSE 0 END AS raw_score FROM labels")
def _(lab):
    return lab.withColumn("g", rubric.grade_v2(F.col("d1"), F.col("d2"), F.col("d3"), F.col("d4") * 2)).select("query_id", "chunk_id", "g.d1", "g.d2", "g.d3", "g.d4", "g.score", rubric.score_v2(F.col("d1"), F.col("d2"), F.col("d3"), F.col("d4")).alias("raw_score"))


@query("g1_p16_rubric_v1_problems", "labels_v1", "SELECT query_id, chunk_id, CASE WHEN d1 THEN CAST(d2 OR d3 AS INT) + CAST(d3 AS INT) ELSE 0 END AS score, CAST(score <> CAST(d1 AS INT) * (CAST(d2 AS INT) + CAST(d3 AS INT)) AS INT) + CAST(NOT d1 AND (d2 OR d3) AS INT) + CAST(d3 AND NOT d2 AS INT) AS n_problems FROM labels_v1")
def _(lab):
    d = [F.col(x) for x in ("d1", "d2", "d3")]
    return lab.select("query_id", "chunk_id", rubric.grade_v1(*d)["score"].alias("score"), F.size(rubric.problems(*d, F.col("score"))).alias("n_problems"))


@query("g4_tolerant_int", "labels", """WITH said AS (SELECT DISTINCT d4, score FROM labels), t AS (SELECT score, unnest(['D2=', 'score=', 'score: ', 'score=D3=', 'D2=D2=', '1score=', ' ', '-', 'x', 'true', '1e', '.']) AS p, unnest([score, score, score, score, 0, 0, score, -score, 0, 0, CASE score WHEN 0 THEN 1 WHEN 1 THEN 10 WHEN 2 THEN 100 WHEN 3 THEN 1000 WHEN 4 THEN 10000 WHEN 5 THEN 100000 ELSE 1000000 END, 0]) AS value FROM said)
 SELECT DISTINCT concat(p, CAST(score AS VARCHAR)) AS said, CAST(value AS INT) AS value FROM t UNION SELECT DISTINCT concat('D4=', CAST(score AS VARCHAR), '.7'), score FROM labels""")
def _(lab):
    prefix = F.explode(F.array(*map(F.lit, ["D2=", "score=", "score: ", "score=D3=", "D2=D2=", "1score=", " ", "-", "x", "true", "1e", "."])))
    score = F.col("score").cast("string")
    said = lab.select("score", prefix.alias("p")).select(F.concat("p", score).alias("said")).unionByName(lab.select(F.concat(F.lit("D4="), score, F.lit(".7")).alias("said"))).distinct()
    return said.select("said", rubric.tolerant_int(F.col("said")).alias("value"))


@query("g7_accepted_rewrites", "queries", "SELECT query_id, CASE WHEN CAST(substr(query_id, 2) AS INT) % 2 = 0 THEN concat(query_text, '?') END AS rewrite FROM queries")
def _(q):
    said = F.when(F.substring("query_id", 2, 9).cast("int") % 2 == 0, F.concat(F.lit(' "'), F.coalesce("query_text", F.lit("")), F.lit('?" '))).otherwise(F.upper("query_text"))
    return q.select("query_id", rubric.accepted_rewrite(said, F.col("query_text")).alias("rewrite"))


# --- texts --------------------------------------------------------------------------------------


@query("f1_f2_f20_text_measures", "chunks", f"SELECT chunk_id, len({TOKENS.format(t='text')})::INT AS n_tokens, len(regexp_extract_all(text, '[A-Za-z0-9]+(?:[-''][A-Za-z0-9]+)?'))::INT AS n_words, substr(sha256(text), 1, 16) AS content_id, CAST(greatest(1, floor(length(text) / 4.0)) AS BIGINT) AS tokens_estimate FROM chunks")
def _(c):
    t = F.col("text")
    return c.select("chunk_id", F.size(X.tokens(t)).alias("n_tokens"), X.word_count(t).alias("n_words"), X.content_id(t).alias("content_id"), X.token_estimate(t).cast("long").alias("tokens_estimate"))


@query("p1_breadcrumbs", "chunks", r"""SELECT chunk_id, CASE WHEN pos % 4 = 0 THEN '' ELSE breadcrumb END AS breadcrumb, sha256(regexp_replace(regexp_replace(concat('- ', text), '^([ \t]*\n)+', ''), '(\n[ \t]*)+$', '')) AS text_sha256 FROM chunks""".replace("\\\\", "\\"))
def _(c):
    head = F.when(F.col("pos") % 4 == 0, F.lit("")).otherwise(F.concat(F.lit("\n> "), F.replace("breadcrumb", F.lit(" > "), F.lit(" >\n> ")), F.lit("\n")))
    body = F.concat(head, F.lit("\n- "), "text", F.lit("\n\n"))
    return c.select("chunk_id", X.split_breadcrumb(body).alias("s")).select("chunk_id", "s.breadcrumb", F.sha2("s.text", 256).alias("text_sha256"))


@query("p3_f9_sections", "chunks", "SELECT chunk_id, trim(split_part(breadcrumb, '>', 1)) AS section, split_part(breadcrumb, ' > ', 1) AS topic, concat(CAST(pos AS VARCHAR), '::', chunk_id) AS pair, printf('q_%05d', pos) AS query_id FROM chunks")
def _(c):
    b = F.col("breadcrumb")
    return c.select("chunk_id", X.section(b).alias("section"), X.topic(b, F.lit(None).cast("string")).alias("topic"), X.pair_key(F.col("pos"), F.col("chunk_id")).alias("pair"), X.sequential_id(F.col("pos")).alias("query_id"))


def _regex_sql(column: str, patterns: list[str]) -> str:
    return f"regexp_matches({column}, '(?i)" + "|".join(patterns).replace("'", "''") + "')"


def _reason_sql() -> str:
    """The classifier in DuckDB's words: null breadcrumbs don't occur there."""
    plain_ = "text"
    for pattern, by in fixed.MARKDOWN:
        plain_ = f"regexp_replace({plain_}, '{pattern}', '{by}', 'g')"
    listed = "(" + ", ".join("'" + h.replace("'", "''") + "'" for h in fixed.BOILERPLATE_HEADINGS) + ")"
    first = r"lower(regexp_replace(regexp_replace(trim(regexp_replace(rows[1], '^#+\s*', ''), '*_ '), '[:.]+$', ''), '\s+', ' ', 'g'))"
    cases = [(f"length(trim({plain_})) < {fixed.MIN_BODY_CHARS}", "'short_text'"), (f"first IN {listed}", "'heading_' || replace(first, ' ', '_')"), (f"lower(section) IN {listed}", "'section_' || replace(lower(section), ' ', '_')")]
    cases += [(_regex_sql("head", p), f"'{r}'") for r, p in fixed.FRONT_MATTER_PATTERNS]
    cases += [(_regex_sql("head", p) + " OR " + _regex_sql("breadcrumb", p), f"'{r}'") for r, p in fixed.STRUCTURAL_PATTERNS]
    cases += [(_regex_sql("text", p), f"'{r}'") for r, p in fixed.FULL_BODY_PATTERNS]
    cases += [
        ("regexp_full_match(first, '[\\pL]') AND len(list_filter(rows[2:], lambda x: starts_with(x, '**'))) >= 2", "'glossary_fragment'"),
        ("len(list_filter(rows, lambda x: NOT (starts_with(x, '#') OR (starts_with(x, '**') AND ends_with(x, '**') AND length(x) > 4)))) = 0", "'heading_only'"),
        (r"len(tables) >= 4 AND 2 * len(list_filter(tables, lambda x: regexp_replace(x, '[|\s-]', '', 'g') = '')) > len(tables)", "'empty_form_table'"),
    ]
    when = " ".join(f"WHEN {test} THEN {reason}" for test, reason in cases)
    return rf"""cut AS (SELECT *, coalesce(nullif(trim(split_part(breadcrumb, '>', 1)), ''), '{fixed.ROOT_SECTION}') AS section,
  list_filter(list_transform(string_split_regex(text, '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e]'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS rows FROM noted),
 ready AS (SELECT *, array_to_string(rows[1:5], chr(10)) AS head, list_filter(rows, lambda x: starts_with(x, '|')) AS tables, coalesce({first}, '') AS first FROM cut),
 judged AS (SELECT *, CASE {when} END AS reason FROM ready)
"""


#: Openings, by place in the corpus, that give the rules something to find; most chunks keep their text.
NOTED = """SELECT chunk_id, source, tier, pos, CASE WHEN pos % 17 = 0 THEN concat(upper(substr(source, 1, 1)), 'ims > ', lang_) WHEN pos % 23 = 0 THEN 'Instructions for use' ELSE breadcrumb END AS breadcrumb, concat(CASE pos % 31
  WHEN 1 THEN '## **References:**' WHEN 2 THEN 'Suggested Citation of this' WHEN 3 THEN '# Endorsed by' WHEN 4 THEN 'a table of contents' WHEN 5 THEN 'Acknowledgment' WHEN 6 THEN 'Copyright 2020' WHEN 7 THEN 'ISBN 12' WHEN 8 THEN 'version no. 3'
  WHEN 9 THEN 'Case number : 5' WHEN 10 THEN 'They invite all of the learners' WHEN 11 THEN 'Write it on the blackboard' WHEN 12 THEN 'role/play' WHEN 13 THEN 'Questions that may be asked' WHEN 14 THEN concat('# B', chr(10), '**Bag** one', chr(10), '**Bed** two')
  WHEN 15 THEN concat('| a |', chr(10), '|---|', chr(10), '| |', chr(10), '|  |', chr(10), '| - |') WHEN 16 THEN '# Preface' WHEN 17 THEN '[away](x) ![gone](y)' WHEN 18 THEN 'Planning follow-up' ELSE '' END, chr(10), text) AS text
 FROM (SELECT *, split_part(breadcrumb, ' > ', 1) AS lang_ FROM chunks) c"""
REASON_SQL = f"WITH noted AS ({NOTED}), " + _reason_sql()


def noted(c: DataFrame) -> DataFrame:
    return c.sparkSession.sql(NOTED.replace("FROM chunks", "FROM {chunks}"), chunks=c)


@query("p4_boilerplate_reasons", "chunks", REASON_SQL + "SELECT chunk_id, section, reason FROM judged")
def _(c):
    return X.with_reason(spread(noted(c))).select("chunk_id", X.section(F.col("breadcrumb")).alias("section"), "reason")


@query("p5_a3_a4_reasons_by_source", "chunks", REASON_SQL + "SELECT source, reason, count(*) AS n FROM judged GROUP BY source, reason")
def _(c):
    return X.with_reason(spread(noted(c))).groupBy("source", "reason").agg(F.count("*").alias("n"))


@query("p7_p8_review", "chunks", "SELECT chunk_id, ordinal, words FROM (SELECT *, CAST(row_number() OVER (ORDER BY pos) AS INT) AS ordinal, len(regexp_extract_all(text, '[A-Za-z0-9]+(?:[-''][A-Za-z0-9]+)?'))::INT AS words FROM chunks) x WHERE contains(lower(concat_ws(chr(10), breadcrumb, 'en', text)), 'src1') AND words BETWEEN 20 AND 400 ORDER BY ordinal LIMIT 50 OFFSET 5")
def _(c):
    return joins.review(c.withColumn("section", F.lit("en")), contains="SRC1", min_words=20, max_words=400, offset=5, limit=50).select("chunk_id", "ordinal", "words")


@query("a2_breadcrumb_coverage", "chunks", "SELECT source, count(*) AS n, count(*) FILTER (pos % 3 <> 0) AS with_breadcrumb, round(100.0::double * count(*) FILTER (pos % 3 <> 0) / count(*), 6) AS percent FROM chunks GROUP BY source")
def _(c):
    has = F.when(F.col("pos") % 3 == 0, F.lit("")).otherwise(F.col("breadcrumb")) != ""
    return c.groupBy("source").agg(F.count("*").alias("n"), F.count_if(has).alias("with_breadcrumb"), F.round(F.try_divide(F.lit(100.0) * F.count_if(has), F.count("*")), 6).alias("percent"))


@query("a16_topic_groups", "chunks", "SELECT topic, count(*) AS n, string_agg(chunk_id, ',' ORDER BY pos) FILTER (o <= 6) AS first_chunks FROM (SELECT chunk_id, pos, split_part(breadcrumb, ' > ', 1) AS topic, row_number() OVER (PARTITION BY split_part(breadcrumb, ' > ', 1) ORDER BY pos) AS o FROM chunks) x GROUP BY topic HAVING count(*) >= 3")
def _(c):
    t = c.withColumn("topic", X.topic(F.col("breadcrumb"), F.lit(None).cast("string")))
    first = t.withColumn("o", F.row_number().over(Window.partitionBy("topic").orderBy("pos"))).where("o <= 6").groupBy("topic").agg(F.array_sort(F.collect_list(F.struct("pos", "chunk_id"))).alias("f"))
    return t.groupBy("topic").agg(F.count("*").alias("n")).where("n >= 3").join(first, "topic").select("topic", "n", F.array_join(F.transform("f", lambda x: x["chunk_id"]), ",").alias("first_chunks"))


@query("a17_a18_w9_shares", "chunks", "SELECT tier, source, n, round(100.0::double * n / sum(n) OVER (), 2) AS share FROM (SELECT tier, source, count(*) AS n FROM chunks GROUP BY tier, source) x")
def _(c):
    by = c.groupBy("tier", "source").agg(F.count("*").alias("n"))
    return by.withColumn("share", F.round(F.lit(100.0) * F.col("n") / F.sum("n").over(Window.partitionBy()), 2))  # one row a source


@query("a19_duplicate_ids", "chunks", "SELECT count(*) AS n, count(DISTINCT substr(sha256(text), 1, 16)) AS ids, count(*) - count(DISTINCT substr(sha256(text), 1, 16)) AS duplicates FROM chunks")
def _(c):
    i = X.content_id(F.col("text"))
    return c.agg(F.count("*").alias("n"), F.countDistinct(i).alias("ids"), (F.count("*") - F.countDistinct(i)).alias("duplicates"))


# --- sampling -----------------------------------------------------------------------------------

SIZES = "WITH sizes AS (SELECT tier, source, count(*) AS size FROM chunks GROUP BY tier, source), raw AS (SELECT *, 30.0::double * size / sum(size) OVER (PARTITION BY tier) AS raw, sum(size) OVER (PARTITION BY tier) AS total FROM sizes), r AS (SELECT *, floor(raw) AS low, row_number() OVER (PARTITION BY tier ORDER BY raw - floor(raw) DESC, source) AS n FROM raw), d AS (SELECT *, 30 - sum(low) OVER (PARTITION BY tier) AS rest FROM r) "


@query("l2_largest_remainder", "chunks", SIZES + "SELECT tier, source, size, CAST(CASE WHEN total <= 30 THEN size ELSE low + CAST(n <= rest AS INT) END AS BIGINT) AS allocated FROM d")
def _(c):
    sizes = c.groupBy("tier", "source").agg(F.count("*").alias("size")).withColumn("target", F.lit(30))
    return sampling.largest_remainder(sizes, "source", "target", "tier").drop("target")


@query("l3_l4_stratified_sample", "chunks", SIZES + ", a AS (SELECT tier, source, CASE WHEN total <= 30 THEN size ELSE low + CAST(n <= rest AS INT) END AS allocated FROM d), o AS (SELECT tier, source, chunk_id, row_number() OVER (PARTITION BY tier, source ORDER BY md5('42:' || chunk_id), chunk_id) AS o FROM chunks) SELECT o.tier, o.source, chunk_id FROM o JOIN a ON o.tier = a.tier AND o.source = a.source WHERE o.o <= allocated")
def _(c):
    sizes = c.groupBy("tier", "source").agg(F.count("*").alias("size")).withColumn("target", F.lit(30))
    ids = c.select("tier", "source", "chunk_id")
    return sampling.stratified(ids, sampling.largest_remainder(sizes, "source", "target", "tier"), ["tier", "source"], "chunk_id", SEED)


HAMILTON = "WITH p AS (SELECT tier, count(*) AS population FROM chunks GROUP BY tier), r AS (SELECT *, 13.0::double * population / sum(population) OVER () AS raw FROM p), t AS (SELECT *, floor(raw) + CAST(row_number() OVER (ORDER BY raw - floor(raw) DESC, population DESC, tier DESC) <= 13 - sum(floor(raw)) OVER () AS INT) AS target FROM r), g AS (SELECT *, max(CAST(tier = 'low_moderate' AND target = 0 AS INT)) OVER () AS g FROM t), h AS (SELECT tier, population, CAST(target + CASE tier WHEN 'low_moderate' THEN g WHEN 'moderate' THEN -g ELSE 0 END AS BIGINT) AS target FROM g) "


@query("l7_a17_a18_audit_sample", "chunks", HAMILTON + "SELECT o.tier, chunk_id AS query_id FROM (SELECT tier, chunk_id, row_number() OVER (PARTITION BY tier ORDER BY md5('42:' || chunk_id), chunk_id) AS o FROM chunks) o JOIN h ON h.tier = o.tier WHERE o <= target")
def _(c):
    asked = c.select("tier", F.col("chunk_id").alias("query_id"))
    return sampling.audit_sample(asked, 13, ["very_high", "high", "moderate_high", "moderate", "low_moderate"], "low_moderate", "moderate", SEED)[0]


@query("p19_seeded_shuffle", "chunks", "SELECT chunk_id FROM chunks ORDER BY md5('42:' || chunk_id), chunk_id LIMIT 25")
def _(c):
    return joins.shuffled(c.select("chunk_id"), "chunk_id", SEED, 25)


@query("l5_l6_hamilton", "chunks", HAMILTON + "SELECT * FROM h")
def _(c):
    return sampling.with_floor(sampling.hamilton(c.groupBy("tier").agg(F.count("*").alias("population")), "tier", 13), "tier", "low_moderate", "moderate")


@query("l1_source_targets", "chunks", "SELECT tier, source, CAST(ceil(count(*) / 7.0) AS INT) AS chunks_to_sample FROM chunks GROUP BY tier, source")
def _(c):
    t = c.groupBy("tier", "source").agg(F.count("*").cast("int").alias("queries_per_source"))
    return sampling.source_targets(t, 7).select("tier", "source", "chunks_to_sample")


@query("l8_fraction", "chunks", "SELECT chunk_id FROM chunks ORDER BY md5('42:' || chunk_id), chunk_id LIMIT (SELECT CAST(ceil(count(*) * 0.15) AS BIGINT) FROM chunks)")
def _(c):
    return sampling.fraction(c.select("chunk_id"), "chunk_id", 0.15, SEED)


def _tiers(c: DataFrame) -> DataFrame:
    return c.groupBy("source", "tier").agg(F.lit(5).alias("queries_per_source"), F.min("pos").cast("int").alias("ord"))


SAMPLED_SQL = """WITH noted AS (SELECT * FROM chunks), """ + _reason_sql() + """, sizes AS (SELECT source, section, count(*) AS size FROM judged WHERE reason IS NULL GROUP BY source, section),
 raw AS (SELECT *, 5.0::double * size / sum(size) OVER (PARTITION BY source) AS raw, sum(size) OVER (PARTITION BY source) AS total FROM sizes), r AS (SELECT *, floor(raw) AS low FROM raw),
 a AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY CAST(low < size AS INT) DESC, raw - low DESC, section) AS n, 5 - sum(low) OVER (PARTITION BY source) AS rest FROM r),
 b AS (SELECT source, section, CASE WHEN total <= 5 THEN size ELSE low + CAST(n <= rest AS INT) END AS allocated FROM a),
 o AS (SELECT chunk_id, source, tier, section, row_number() OVER (PARTITION BY source, section ORDER BY md5('42:' || chunk_id), chunk_id) AS o FROM judged WHERE reason IS NULL),
 chosen AS (SELECT chunk_id, o.source, tier, o.section FROM o JOIN b ON o.source = b.source AND o.section = b.section WHERE o <= allocated)
"""


@query("plan_sampled_corpus", "chunks", SAMPLED_SQL + "SELECT * FROM chosen")
def _(c):
    return pipelines.sampled_corpus(c.drop("tier"), _tiers(c), 1, SEED)[0].select("chunk_id", "source", "tier", "section")


@query("plan_sampling_report", "chunks", SAMPLED_SQL + """, f AS (SELECT source, reason, count(*) AS n FROM judged WHERE reason IS NOT NULL GROUP BY source, reason), g AS (SELECT source, '{' || string_agg(concat('"', reason, '":', n), ',' ORDER BY reason) || '}' AS reasons FROM f GROUP BY source),
 t AS (SELECT source, any_value(tier) AS tier, count(*) AS total, count(reason) AS filtered, count(DISTINCT CASE WHEN reason IS NULL THEN section END) AS section_count FROM judged GROUP BY source), s AS (SELECT source, count(*) AS sampled FROM chosen GROUP BY source)
 SELECT t.source, tier, total, filtered, total - filtered AS usable, 5 AS target, coalesce(sampled, 0) AS sampled, greatest(0, 5 - coalesce(sampled, 0)) AS shortfall, section_count, coalesce(reasons, '{}') AS filter_reasons FROM t LEFT JOIN g ON t.source = g.source LEFT JOIN s ON t.source = s.source""")
def _(c):
    report = pipelines.sampled_corpus(c.drop("tier"), _tiers(c), 1, SEED)[1]
    return report.withColumn("filter_reasons", F.to_json("filter_reasons"))


@query("u2_p9_decisions", "chunks", """SELECT chunk_id, CASE WHEN length(t) >= 1000 THEN concat('what of ', split_part(t, ' ', 1)) END AS seed_query, 'length' AS reason, '' AS _error, 1 AS _attempts FROM (SELECT chunk_id, trim(regexp_replace(concat('about ', text), '[^ -~]+', ' ', 'g')) AS t FROM chunks) x""")
def _(c):
    said = c.withColumn("text", F.trim(F.regexp_replace(F.concat(F.lit("about "), "text"), "[^ -~]+", " ")))
    return models.decided(said, models.stub_filter, "local", "stub").select("chunk_id", "seed_query", "reason", "_error", "_attempts")


KINDS = "[" + ", ".join(f"'{k}'" for k in fixed.REWRITE_TYPES) + "]"


@query("u3_u7_assembled_queries", "chunks", f"""WITH base AS (SELECT concat('what of ', source) AS query_text, chunk_id AS seed_chunk_id, source, tier, pos, split_part(breadcrumb, ' > ', 1) AS topic FROM chunks),
 o AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY pos) AS o, count(*) OVER (PARTITION BY topic) AS n FROM base),
 synth AS (SELECT concat('synthesis: ', topic) AS query_text, min_by(seed_chunk_id, pos) AS seed_chunk_id, min_by(source, pos) AS source, min_by(tier, pos) AS tier, topic, string_agg(seed_chunk_id, ',' ORDER BY pos) AS ids FROM o WHERE o <= 6 AND n >= 3 GROUP BY topic),
 chosen AS (SELECT *, {KINDS}[1 + CAST(concat('0x', substr(md5('43:' || seed_chunk_id), 1, 8)) AS BIGINT) % 8] AS kind FROM base ORDER BY md5('42:' || seed_chunk_id), seed_chunk_id LIMIT (SELECT CAST(ceil(count(*) * 0.15) AS BIGINT) FROM base)),
 every AS (SELECT 0 AS k, pos, NULL AS topic, query_text, seed_chunk_id, source, tier, 'per_chunk' AS query_type, NULL AS adversarial_type, NULL AS seed_chunk_ids FROM base UNION ALL SELECT 1, NULL, topic, query_text, seed_chunk_id, source, tier, 'synthesis', NULL, ids FROM synth
  UNION ALL SELECT 2, pos, NULL, concat(kind, ': ', query_text), seed_chunk_id, source, tier, 'adversarial', kind, NULL FROM chosen)
 SELECT printf('q_%05d', row_number() OVER (ORDER BY k, pos, topic)) AS query_id, query_text, seed_chunk_id, source, tier, query_type, adversarial_type, seed_chunk_ids FROM every""")
def _(c):
    kept = c.withColumn("section", X.section(F.col("breadcrumb"))).withColumn("seed_query", F.concat(F.lit("what of "), "source"))
    return pipelines.assembled_queries(kept, models.stub_synthesis, models.stub_rewrite).withColumn("seed_chunk_ids", F.array_join("seed_chunk_ids", ","))


WORDS = "list_distinct(list_filter(string_split_regex(lower({t}), '[ \\n\\t\\r\\f\\v]+'), lambda x: x <> ''))"
JUDGED_SQL = BM25_SQL + f""", pool AS (SELECT query_id, chunk_id FROM r WHERE rank <= 3 UNION SELECT query_id, seed_chunk_id FROM queries),
 shared AS (SELECT p.query_id, p.chunk_id, len(list_intersect({WORDS.format(t='q.query_text')}, {WORDS.format(t='c.text')})) AS n FROM pool p JOIN queries q ON q.query_id = p.query_id JOIN chunks c ON c.chunk_id = p.chunk_id)
"""


@query("u1_t10_judged_pairs", "queries chunks", JUDGED_SQL + "SELECT query_id, chunk_id, n > 0 AS d1, CAST(least(2, n) AS INT) AS d2, CAST(least(2, n // 2) AS INT) AS d3, CAST(least(2, n // 3) AS INT) AS d4, '' AS _error, 1 AS _attempts, 'stub' AS model FROM shared")
def _(q, c):
    pool = pipelines.pooled(q, {"bm25": retrieval.bm25(q, c, 3, fill=False)}, 3)
    pairs, _ = pipelines.to_judge(pool, pool.where("false"), q, c)
    return models.judge(pairs, models.stub_judge, {"model": "stub"})


@query("u1_p11_judged_by_first_rubric", "queries chunks", JUDGED_SQL + "SELECT query_id, chunk_id, n > 0 AS d1, n >= 1 AS d2, n >= 2 AS d3, CAST(n >= 1 AS INT) + CAST(n >= 2 AS INT) AS score FROM shared")
def _(q, c):
    pool = pipelines.pooled(q, {"bm25": retrieval.bm25(q, c, 3, fill=False)}, 3)
    pairs, _ = pipelines.to_judge(pool, pool.where("false"), q, c)
    found = models.judge(pairs, models.stub_judge, models.RUBRICS["v1_boolean"].contract("local", "stub"), rubric_name="v1_boolean")
    return found.where(models.successful("v1_boolean")).select("query_id", "chunk_id", "d1", "d2", "d3", "score")


@query("f22_messages", "chunks", """SELECT chunk_id, sha256(concat('## Query', chr(10), 'why?', chr(10), chr(10), '## Guideline chunk', chr(10), CASE WHEN pos % 5 = 0 THEN '' ELSE concat('Source: ', source, ' | ') END, 'Page: ', CAST(page AS VARCHAR), chr(10), '---', chr(10), 'of ', source, chr(10), '---')) AS judged,
 sha256(concat(CASE WHEN pos % 5 = 0 THEN '' ELSE concat('Source: ', source, chr(10)) END, 'Page: ', CAST(page AS VARCHAR), chr(10), 'Breadcrumb: ', breadcrumb, chr(10), chr(10), 'Chunk:', chr(10), 'of ', source)) AS filtered FROM chunks""")
def _(c):
    source, text = F.when(F.col("pos") % 5 == 0, F.lit(" ")).otherwise(F.col("source")), F.concat(F.lit(" of "), "source", F.lit("\n"))
    return c.select("chunk_id", F.sha2(models.judge_message(F.lit("why?"), source, F.col("page"), text), 256).alias("judged"), F.sha2(models.filter_message(source, F.col("page"), F.col("breadcrumb"), text), 256).alias("filtered"))


@query("t11_token_batches", "chunks", """WITH RECURSIVE t AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY pos) AS rn, CAST(greatest(1, floor(length(text) / 4.0)) AS BIGINT) AS tokens FROM chunks),
 b AS (SELECT source, rn, tokens, tokens AS used, 1 AS n, 0 AS batch FROM t WHERE rn = 1 UNION ALL SELECT t.source, t.rn, t.tokens, CASE WHEN b.used + t.tokens > 20000 OR b.n = 40 THEN t.tokens ELSE b.used + t.tokens END, CASE WHEN b.used + t.tokens > 20000 OR b.n = 40 THEN 1 ELSE b.n + 1 END, b.batch + CAST(b.used + t.tokens > 20000 OR b.n = 40 AS INT) FROM b JOIN t ON t.source IS NOT DISTINCT FROM b.source AND t.rn = b.rn + 1)
 SELECT source, batch, count(*) AS n, CAST(sum(tokens) AS BIGINT) AS tokens FROM b GROUP BY source, batch""")
def _(c):
    return retrieval.token_batches(c.select("chunk_id", "source", "pos", "text"), "source", "pos", 20_000, 40).groupBy("source", "batch").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"))


@query("t7_encoded_top_k", "queries chunks")
def _(q, c):
    encode = retrieval.hashing_encoder()
    asked = retrieval.encoded(q, encode, "query_text").select("query_id", "embedding")
    return retrieval.dense(asked, retrieval.encoded(c, encode).select("chunk_id", "embedding"), 5).withColumn("score", F.round("score", 6))


# --- extras: incremental arrivals, on the platform's own windows ---------------------------------


def _arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    from poolsmith.streaming.judging import arrivals

    return arrivals(spark.read.parquet(f"{sf_dir}/events.parquet"))


QUERIES["extra_arrival_windows"] = _arrivals
SQL["extra_arrival_windows"] = "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2"
