"""Every operator on nulls in any column, empty and very long texts, ties, repeated rows, empty tables and further columns with clashing names."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from poolsmith.llm import chat_format, exact_dedup, html_extract, license_scan, packing, pii, piece_codec, quality, queries, simhash, toxicity
from poolsmith.llm.common import hot_keys, spread_join
from poolsmith.llm.components import components

LONG = "word and other words " * 8000 + "x" * 50_000 + " end@example.org"
TEXTS = [(1, "Same text, twice."), (1, "Same text, twice."), (None, "Same text, twice."), (2, None), (3, ""), (None, None), (4, " \n\t "), (5, LONG), (6, "Same text, twice."), (7, "é́ 日本 🙂 \x00 ­"), (8, "i " * 400)]
EXTRA = "doc_id long, text string, row long, key long, n long, ids string, f0 long, h long, rid long, digest string, kept string, chain string, spans string, score string, host string, _row long, _text_sha256 string, anomaly string, root long, node long, id long"


def table(spark, rows, schema=EXTRA):
    width = schema.count(",") + 1
    return spark.createDataFrame([(*r, *[None] * (width - len(r))) for r in rows], schema)


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


OPERATORS = {
    "pii": lambda spark, d: pii.find(d),
    "packing": lambda spark, d: packing.pack(d, packing.default_tokenizer()).where("start = 0"),
    "licenses": lambda spark, d: license_scan.scan(d),
    "toxicity": lambda spark, d: toxicity.scored(d, toxicity.fit(d, labels(spark, [(1, None, None), (2, 1, 0), (None, 1, 1)]))),
    "simhash": lambda spark, d: simhash.near_duplicates(d),
    "pieces": lambda spark, d: piece_codec.encode(d, piece_codec.default_model()),
    "exact": lambda spark, d: exact_dedup.exact_dedup(d),
    "quality": lambda spark, d: quality.quality(d, labels(spark, [(1, 1, 0), (5, 0, 0), (None, 0, 0), (3, None, 1)])),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_a_row_for_each_row(spark, name):
    found = OPERATORS[name](spark, table(spark, TEXTS)).collect()
    assert sorted(str(r["doc_id"]) for r in found) == sorted(str(i) for i, _ in TEXTS)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark, table(spark, [])).collect() == []


def test_exact_results(spark):
    found = exact_dedup.exact_dedup(table(spark, TEXTS)).collect()
    same = [r for r in found if r["group_size"] == 4]
    assert len(same) == 4 and {r["keep_id"] for r in same} == {6} and sum(r["kept"] for r in found) == len({t or "" for _, t in TEXTS})
    twice = exact_dedup.exact_dedup(table(spark, [(9, "a"), (9, "a"), (None, "a")])).collect()
    assert sum(r["kept"] for r in twice) == 1


def test_pages(spark):
    rows = [(1, None, None), (1, None, None), (None, "http://h/1", ""), (2, "http://h/2", "<p>a" * 3), (3, "http://h/3", "<article>" + "word " * 50_000), (4, "no host", "<p>x</p><p>x</p>")]
    df = table(spark, rows, "page_id long, url string, html string, host string, text string, salt int, template string")
    found = {(r["page_id"], r["url"]): r["text"] for r in html_extract.extract(df).collect()}
    assert found[1, None] == found[None, "http://h/1"] == "" and found[2, "http://h/2"] == "a a a" and found[4, "no host"] == "x x" and len(found[3, "http://h/3"]) == 249_999
    assert html_extract.extract(df.limit(0)).collect() == []


def test_conversations(spark):
    rows = [(1, 0, "user", "hi"), (1, 0, "user", "hi"), (1, None, None, None), (None, 3, "assistant", "x" * 100_000), (2, 1, "assistant", ""), (3, 5, "sy\nstem\\n", "a <|end|>\n\\<| </s>[INST]")]
    df = table(spark, rows, "conv_id long, turn long, role string, text string, node string, up long, leaf string")
    read = chat_format.read_back(chat_format.format_trees(chat_format.conversation_chains(df))).collect()
    found = {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in read}
    assert found == {1: [("", ""), ("user", "hi"), ("user", "hi")], None: [("assistant", "x" * 100_000)], 2: [("assistant", "")], 3: [("sy\nstem\\n", "a <|end|>\n\\<| </s>[INST]")]}
    assert chat_format.format_trees(chat_format.conversation_chains(df.limit(0))).collect() == []


def test_stages_keep_columns(spark):
    df = table(spark, TEXTS)
    for stage in (exact_dedup.keep_one, simhash.keep_one, pii.redact):
        out = stage(df)
        assert out.columns == df.columns and dict(out.dtypes) == dict(df.dtypes)
        assert stage(df.limit(0)).collect() == []
    assert exact_dedup.keep_one(df).count() == len({t or "" for _, t in TEXTS})
    assert pii.redact(df).count() == len(TEXTS) and pii.redact(df).where(F.contains("text", F.lit("[EMAIL]"))).count() == 1


def test_first_and_last_stage(spark, tmp_path):
    """They read labels and a tokenizer besides: clashing columns stay, empty tables stay empty."""
    df = table(spark, TEXTS).drop("row", "key")
    labels(spark, [(1, 1, 0), (5, 0, 1), (None, 0, 0)]).write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.reject_toxic(spark, df, str(tmp_path))
    assert out.columns == df.columns and out.count() <= len(TEXTS) and corpus_pipeline.reject_toxic(spark, df.limit(0), str(tmp_path)).collect() == []
    pieces = corpus_pipeline.pack(spark, df, str(tmp_path))
    assert sorted(str(r["doc_id"]) for r in pieces.where("start = 0").collect()) == sorted(str(i) for i, _ in TEXTS)
    assert corpus_pipeline.pack(spark, df.limit(0), str(tmp_path)).collect() == []


@pytest.mark.parametrize("rows", [[], TEXTS])
def test_run_on_odd_tables(spark, tmp_path, rows):
    table(spark, rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    labels(spark, [(1, 1, 0)]).write.parquet(f"{tmp_path}/labels.parquet")
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert bool(found) == bool(rows)


def test_models_are_the_same_for_any_order_of_rows(spark):
    """Ids that several texts have: the least text is learnt from."""
    rows = [(i % 40, f"{'bad worse' if i % 2 else 'fine good'} text {i * 7919 % 101} of words") for i in range(120)]
    known = labels(spark, [(i, i % 2, i % 2) for i in range(40)])
    other = labels(spark, [(i, 1, (i + 1) % 2) for i in range(40)])  # copies, the first of which is toxic: no word is common, none tells the kinds apart
    assert toxicity.fit(spark.createDataFrame([(i, "same") for i in range(40)], "doc_id long, text string"), other).kernel is None
    a, b = (spark.createDataFrame(r, "doc_id long, text string").repartition(n) for r, n in ((rows, 2), (rows[::-1], 5)))
    first, second = (quality.fit(d, known) for d in (a, b))
    assert first[1] == second[1] and (first[0] is None) == (second[0] is None)
    texts = [t.encode() for _, t in rows]
    assert (toxicity.fit(a, known).scores(texts) == toxicity.fit(b, known).scores(texts)).all()


def test_links_with_nulls(spark):
    links = spark.createDataFrame([(1, 2), (2, None), (None, 3), (4, 4), (2, 1), (1, 2), (5, 1)], "a long, b long")
    assert {r["node"]: r["root"] for r in components(links).collect()} == {1: 1, 2: 1, 5: 1}
    assert components(links.limit(0)).collect() == []


def test_hot_keys_are_spread(spark):
    rows = spark.range(6000).selectExpr("id", "if(id % 3 = 0, -1, id) AS k")
    entries = spark.range(-1, 4000).selectExpr("id AS k", "id * 2 AS v")
    hot = hot_keys(rows, ["k"])
    assert [r["k"] for r in hot.collect()] == [-1] and hot_keys(rows, ["id"]) is None
    for how in ("inner", "left"):
        assert sorted(map(str, spread_join(rows, entries, ["k"], how, hot).collect())) == sorted(map(str, rows.join(entries, "k", how).collect()))


@pytest.mark.parametrize("name", sorted(queries.BASE))
def test_base_columns_against_sql(same, name):
    same(*queries.BASE[name])


def test_labels_of_one_kind(spark):
    d = table(spark, TEXTS)
    assert toxicity.scored(d, toxicity.fit(d, labels(spark, [(2, 1, 0), (3, 1, 0)]))).where("toxicity > 0").count() == 0
    assert quality.quality(d, labels(spark)).where("kept and base_failed").count() == 0
