"""The operators' queries and their SQL, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame

from poolsmith.llm import chat_format, exact_dedup, html_extract, license_scan, packing, piece_codec, pii, quality, simhash, toxicity
from poolsmith.llm.common import table

MODULES = {
    "op1_contextual_pii": pii,
    "op2_curve_packing": packing,
    "op3_rare_token_licenses": license_scan,
    "op4_reply_trees": chat_format,
    "op5_string_kernel_toxicity": toxicity,
    "op6_template_html": html_extract,
    "op7_simhash_near_dedup": simhash,
    "op8_piece_viterbi": piece_codec,
    "op9_exact_dedup": exact_dedup,
    "op10_isolation_forest": quality,
}



# --- what SQL can say of operators whose methods are beyond it: base columns, over all documents ----------------


def base_pii(spark, sf_dir: str) -> DataFrame:
    return pii.scan(table(spark, sf_dir, "documents")).select("doc_id", *(f"n_{k}" for k in pii.KINDS[:4]))


def base_licenses(spark, sf_dir: str) -> DataFrame:
    return license_scan.query(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def base_quality(spark, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


PII_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
 found AS (SELECT doc_id, regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') AS emails, regexp_extract_all(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)') AS ips,
  list_transform(regexp_extract_all(t, '[0-9]([\x20-]?[0-9])+'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')) AS cards, list_transform(regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]'), lambda x: length(regexp_replace(x, '[^0-9]', '', 'g'))) AS phones FROM d),
 digits AS (SELECT *, list_transform(list_filter(cards, lambda x: length(x) BETWEEN 14 AND 19), lambda x: list_transform(range(1, length(x) + 1), lambda i: CAST(x[length(x) + 1 - i] AS INT) * (2 - i % 2))) AS doubled FROM found)
SELECT doc_id, len(emails) AS n_email, len(list_filter(ips, lambda x: len(list_filter(string_split(x, '.'), lambda p: TRY_CAST(p AS UTINYINT) IS NULL)) = 0)) AS n_ip,
 len(list_filter(doubled, lambda x: list_sum(list_transform(x, lambda v: v // 10 + v % 10)) % 10 = 0)) AS n_card, len(list_filter(phones, lambda n: n BETWEEN 10 AND 15)) AS n_phone FROM digits
"""

LICENSES_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
 p AS (SELECT doc_id, w, list_filter(range(1, len(w) + 1), lambda i: w[i] = 'mit' AND w[i + 1] = 'license') AS mit, list_filter(range(1, len(w) + 1), lambda i: w[i] = 'apache' AND w[i + 1] = 'license' AND w[i + 2] = 'version' AND w[i + 3] = '2') AS apache, list_filter(range(1, len(w) + 1), lambda i: w[i] = 'cc' AND w[i + 1] = 'by' AND w[i + 2] = 'nc') AS cc FROM w),
 a AS (SELECT *, list_concat(list_concat(mit, apache), cc) AS places FROM p)
SELECT doc_id, len(w) AS n_words, len(places) AS n_base, list_min(places) - 1 AS first_word, list_max(places) - 1 AS last_word,
 array_to_string(list_filter([CASE WHEN len(apache) > 0 THEN 'apache-2' END, CASE WHEN len(cc) > 0 THEN 'cc-by-nc' END, CASE WHEN len(mit) > 0 THEN 'mit' END], lambda x: x IS NOT NULL), ',') AS base_labels FROM a
"""

QUALITY_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents), w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
 win AS (SELECT r, i, array_to_string(w[i : i + 7], ' ') AS words FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) >= 8) x),
 twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, words) AS n FROM win) x WHERE n > 1), rep AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, i + unnest(range(0, 8)) AS j FROM twice) x GROUP BY r),
 c AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words FROM w LEFT JOIN rep ON rep.r = w.r)
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c
"""

BASE = {"base_columns_pii": (base_pii, PII_SQL), "base_columns_licenses": (base_licenses, LICENSES_SQL), "base_columns_quality": (base_quality, QUALITY_SQL)}


def queries() -> dict:
    return {name: m.query for name, m in MODULES.items()} | {name: q for name, (q, _) in BASE.items()}


def oracle_sql() -> dict[str, str]:
    return {name: m.SQL for name, m in MODULES.items() if getattr(m, "SQL", None)} | {name: sql for name, (_, sql) in BASE.items()}
