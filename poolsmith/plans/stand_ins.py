"""The benchmark's relations taken from the driver's tables, in SQL that Spark and DuckDB read alike.

Labels and ranks are arithmetic on keys: they exercise the operators and mean nothing else.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TIER = "CASE CAST(substr({s}, 4) AS INT) % 5 WHEN 0 THEN 'very_high' WHEN 1 THEN 'high' WHEN 2 THEN 'moderate_high' WHEN 3 THEN 'moderate' ELSE 'low_moderate' END"

RELATIONS = {
    "chunks": f"""
        SELECT concat('c', CAST(doc_id AS VARCHAR(20))) AS chunk_id, source, CAST(doc_id % 97 + 1 AS INT) AS page,
               concat(lang, ' > ', source) AS breadcrumb, coalesce(text, '') AS text, doc_id AS pos, {TIER.format(s='source')} AS tier
        FROM documents""",
    "queries": """
        SELECT concat('q', CAST(item_id AS VARCHAR(20))) AS query_id, text AS query_text, concat('c', CAST(item_id * 7 % 200 AS VARCHAR(20))) AS seed_chunk_id FROM benchmark""",
    # four retrievers over parts, for queries made of order keys: the dearest lines first
    "rankings": """
        SELECT query_id, retriever, CAST(rank AS INT) AS rank, chunk_id, score FROM (
            SELECT query_id, retriever, chunk_id, score, row_number() OVER (PARTITION BY query_id, retriever ORDER BY score DESC, chunk_id) AS rank FROM (
                SELECT l_orderkey % 3185 AS query_id, concat('r', CAST(l_suppkey % 4 AS VARCHAR(5))) AS retriever, l_partkey AS chunk_id, max(l_extendedprice) AS score
                FROM lineitem GROUP BY l_orderkey % 3185, concat('r', CAST(l_suppkey % 4 AS VARCHAR(5))), l_partkey) a) b
        WHERE rank <= 20""",
    "labels": """
        SELECT query_id, chunk_id, d1, d2, d3, d4, CASE WHEN d1 THEN d2 + d3 + d4 ELSE 0 END AS score FROM (
            SELECT DISTINCT l_orderkey % 3185 AS query_id, l_partkey AS chunk_id, l_partkey % 5 <> 0 AS d1, CAST(l_partkey % 3 AS INT) AS d2,
                   CAST(floor(l_partkey / 3.0) AS INT) % 3 AS d3, CAST((l_orderkey % 3185 + l_partkey) % 3 AS INT) AS d4
            FROM lineitem WHERE (l_orderkey % 3185 + l_partkey) % 4 <> 0) x""",
    "labels_v1": """
        SELECT DISTINCT l_orderkey % 3185 AS query_id, l_partkey AS chunk_id, l_partkey % 4 <> 0 AS d1, l_partkey % 3 = 0 AS d2, l_partkey % 7 = 0 AS d3, CAST(l_partkey % 3 AS INT) AS score
        FROM lineitem WHERE l_partkey % 5 <> 0""",
    "results": """
        SELECT concat('c', CAST(doc_id AS VARCHAR(20))) AS chunk_id, CASE WHEN doc_id % 3 = 0 THEN 'v-old' ELSE 'v-now' END AS schema_version, CASE WHEN doc_id % 5 = 0 THEN 'p0' ELSE 'p1' END AS prompt_hash,
               'local' AS backend, CASE WHEN doc_id % 7 = 0 THEN 'small' ELSE 'large' END AS model, CASE WHEN doc_id % 2 = 0 THEN concat('what of ', lang) END AS seed_query, CASE WHEN doc_id % 11 = 0 THEN 'timeout' ELSE '' END AS _error
        FROM documents""",
    "vectors": "SELECT vec_id AS chunk_id, embedding, label FROM embeddings",
}
SOURCES = {"chunks": ["documents"], "queries": ["benchmark"], "rankings": ["lineitem"], "labels": ["lineitem"], "labels_v1": ["lineitem"], "results": ["documents"], "vectors": ["embeddings"]}


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = RELATIONS[name]
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in SOURCES[name]}
    for t in frames:
        sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}")
    return spark.sql(sql, **frames)


def with_relations(names: str, sql: str) -> str:
    """The SQL with the named relations as common tables before it."""
    word = next((w for w in ("WITH RECURSIVE ", "WITH ") if sql.lstrip().upper().startswith(w)), None)
    extra = ", " + sql.lstrip()[len(word) :] if word else "\n" + sql
    return (word or "WITH ") + ",\n".join(f"{n} AS ({RELATIONS[n]})" for n in names.split()) + extra
