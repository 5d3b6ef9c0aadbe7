import math

import pytest
from pyspark.sql import functions as F

from poolsmith.functions import rubric
from poolsmith.functions import text as X
from poolsmith.operators import joins, metrics, retrieval, sampling

LONG = "The midwife listens to the heart of the child and writes down what she hears, each time and for each visit, so that a change is seen early. " * 2


def chunk(spark, text, breadcrumb="Section > Child"):
    return spark.createDataFrame([(text, breadcrumb)], "t string, b string").transform(X.with_reason, "reason", "t", "b").first()["reason"]


@pytest.mark.parametrize(
    "text, breadcrumb, reason",
    [
        ("too short.", "A > B", "short_text"),
        ("## Suggested citation\n\n" + LONG, "A > B", "heading_suggested_citation"),
        ("# " + "One long heading of many words " * 3 + "\n\n## " + "Another long heading of words " * 3 + "\n### " + "third heading " * 4, "A", "heading_only"),
        (LONG, "How to use this book > Part", "section_how_to_use_this_book"),
        ("## In this chapter:\n\n| a | b |\n" + LONG, "A", "heading_in_this_chapter"),
        ("# Activity\n" + LONG, "A", "heading_activity"),
        (LONG, "Facilitator's schedule and preparation activities", "section_facilitator's_schedule_and_preparation_activities"),
        ("## **A**\n\n**Abdomen** " + LONG + "\n**Abortion** " + LONG, "A", "glossary_fragment"),
        ("WHO Library Cataloguing data\n" + LONG, "A", "cataloguing"),
        (LONG + "\n|  |  |\n| --- | --- |\n|  |  |\n| x | y |\n", "A", "empty_form_table"),
        (LONG + "\n| a | b |\n| --- | --- |\n| 1 | 2 |\n| 3 | 4 |\n", "A", None),
        ("# Show slide 24\n" + LONG, "A", "educator_instruction"),
        ("# Title\n" + LONG + "\nmore\nand more\nand more\nQuestions that arise are these.", "A", "scenario_reflection"),
        ("# Title\n" + LONG + "\nIn order to confirm that a student is competent, watch.", "A", "scenario_reflection"),
        ("References :\n" + LONG, "A", None),
        ("**References**:\n" + LONG, "A", None),
        ("**References:**\n" + LONG, "A", "heading_references"),
        ("# É\n**Eau** x\n**Air** y\n" + LONG, "A", "glossary_fragment"),
        ("short [](u) " + "[a]() " * 40, "A", None),
        ("[a link with many words in it to make it long](https://example.org) " * 9, "A", "short_text"),
        ("ISBN 123\x0b" + LONG, "A", "license"),
        ("one\x0btwo\u2028three\x85four\x1cfive\nCopyright 2020\n" + LONG, "A", None),
        ("one\ntwo\nCOPYRIGHT 2020\n" + LONG, "A", "copyright"),
        ("éisbn one\n" + LONG, "A", None),
        (LONG, None, None),
        (None, None, "short_text"),
        (LONG, "A", None),
    ],
)
def test_boilerplate(spark, text, breadcrumb, reason):
    assert chunk(spark, text, breadcrumb) == reason


def test_sections(spark):
    df = spark.createDataFrame([("A > B",), ("",), (" > B",), (None,)], "b string").select(X.section(F.col("b")))
    assert [r[0] for r in df.collect()] == ["A", "__root__", "__root__", "__root__"]


def allocate(spark, sizes, target):
    df = spark.createDataFrame(list(sizes.items()), "g string, size long").withColumn("target", F.lit(target)).withColumn("s", F.lit(1))
    return {r["g"]: r["allocated"] for r in sampling.largest_remainder(df, "g", "target", "s").collect()}


def test_largest_remainder(spark):
    assert allocate(spark, {"a": 1, "b": 1, "c": 1}, 2) == {"a": 1, "b": 1, "c": 0}
    assert allocate(spark, {"a": 2, "b": 3}, 9) == {"a": 2, "b": 3}
    assert allocate(spark, {"a": 5, "b": 5}, 0) == {"a": 0, "b": 0}


def test_hamilton(spark):
    df = spark.createDataFrame([("a", 5), ("b", 15)], "g string, population long")
    assert {r["g"]: r["target"] for r in sampling.hamilton(df, "g", 2).collect()} == {"a": 0, "b": 2}
    tiers = spark.createDataFrame([("moderate", 90, 10), ("low_moderate", 5, 0)], "g string, population long, target long")
    assert {r["g"]: r["target"] for r in sampling.with_floor(tiers, "g", "low_moderate", "moderate").collect()} == {"moderate": 9, "low_moderate": 1}
    with pytest.raises(Exception, match="exceeds"):
        sampling.with_floor(tiers.withColumn("target", F.lit(99)), "g", "low_moderate", "moderate").collect()


def test_targets(spark):
    df = spark.createDataFrame([("s", 165)], "source string, queries_per_source int")
    assert sampling.source_targets(df, 2).first()["chunks_to_sample"] == 83
    with pytest.raises(ValueError):
        sampling.source_targets(df, 0)


def test_rubrics(spark):
    v2 = spark.createDataFrame([(True, 0, 1, 5), (False, 2, 2, 2), (None, 1, 1, 1), (True, None, 0, -3)], "a boolean, b int, c int, d int")
    assert [tuple(r[0]) for r in v2.select(rubric.grade_v2(*map(F.col, "abcd"))).collect()] == [(True, 1, 1, 2, 4), (False, 0, 0, 0, 0), (False, 0, 0, 0, 0), (True, 0, 0, 0, 0)]
    v1 = spark.createDataFrame([(True, False, True), (False, True, True)], "a boolean, b boolean, c boolean")
    assert [tuple(r[0]) for r in v1.select(rubric.grade_v1(*map(F.col, "abc"))).collect()] == [(True, True, True, 2), (False, False, False, 0)]
    said = spark.createDataFrame([("D2=2",), ("score=1.7",), (None,), ("true",), ("x",), (" 3 ",), ("-1",)], "s string")
    assert [r[0] for r in said.select(rubric.tolerant_int(F.col("s"))).collect()] == [2, 1, 0, 0, 0, 3, -1]
    odd = spark.createDataFrame([("D2=D2=3",), ("1score=",), ("score=D3=2",), ("2score=",), (" \n+2 ",), ("2e0",)], "s string")
    assert [r[0] for r in odd.select(rubric.tolerant_int(F.col("s"))).collect()] == [0, 0, 2, 0, 2, 2]
    assert [r[0] for r in spark.createDataFrame([(True,), (False,), (None,)], "b boolean").select(rubric.boolean_int(F.col("b"))).collect()] == [1, 0, 0]


def test_replies(spark):
    cases = {'</think>{"a":1} tail': ('{"a": 1}', "", ""), '<think>hm</think>\n```json\n{"a": 2}\n```': ('{"a": 2}', "hm", ""), "<think>open": (None, "open", "empty reply"), 'well {"a": {"b": "}"}} x': ('{"a": {"b": "}"}}', "well", ""), "none": (None, "", "no object")}
    for reply, want in cases.items():
        assert rubric.read_reply(reply) == want
    df = rubric.replies(spark.createDataFrame([(x,) for x in cases], "reply string"))
    assert {r["reply"]: (r["json"], r["thinking"], r["error"]) for r in df.collect()} == cases


def frames(spark, ranked, graded):
    r = spark.createDataFrame([("r", q, i + 1, c) for q, cs in ranked.items() for i, c in enumerate(cs)], "retriever string, query_id string, rank int, chunk_id string")
    return r, spark.createDataFrame([(q, c, s) for q, cs in graded.items() for c, s in cs.items()], "query_id string, chunk_id string, score int")


def test_metrics_by_hand(spark):
    r, lab = frames(spark, {"q": ["a", "b", "c"]}, {"q": {"a": 0, "b": 2, "c": 1}})
    want = (3 / math.log2(3) + 1 / 2) / (3 + 1 / math.log2(3))
    assert metrics.ndcg(r, lab, 3).first()["ndcg"] == pytest.approx(want, abs=1e-9) == pytest.approx(0.659, abs=1e-3)
    m = metrics.hit_precision_mrr(r, lab, [3], [1], "exclude").first()
    assert (m["hr"], m["mrr"]) == (1.0, 0.5) and m["precision"] == pytest.approx(2 / 3)


def test_empty_policies(spark):
    r, lab = frames(spark, {"q": ["a"], "p": ["b"]}, {"q": {"a": 2}, "p": {"b": 0}, "none": {"z": 2}})
    zero, out = (metrics.hit_precision_mrr(r, lab, [3], [1], e).first() for e in ("zero", "exclude"))
    assert (zero["n"], out["n"]) == (3, 2) and zero["hr"] == pytest.approx(1 / 3) and out["hr"] == 0.5
    assert zero["precision"] == pytest.approx(1 / 9)  # one result returned, still divided by k
    w = metrics.weighted(*frames(spark, {"q": ["a", "b"]}, {"q": {"a": 6, "b": 3}}), 3).first()
    assert (w["whr"], w["wp"]) == (1.0, 0.5)


def test_invariants(spark):
    from poolsmith.plans.stand_ins import relation

    r, lab = (relation(spark, "/root/testdata/sf0.001", x) for x in ("rankings", "labels"))
    rec = metrics.recall(r, lab, [3, 5, 10], [3]).collect()
    for name in {x["retriever"] for x in rec}:
        means = [x["mean"] for x in sorted((x for x in rec if x["retriever"] == name), key=lambda x: x["k"])]
        assert all(b >= a - 1e-12 for a, b in zip(means, means[1:], strict=False))
    assert all(x["hr"] >= x["precision"] for x in metrics.hit_precision_mrr(r, lab, [3, 10], [3], "zero").collect())
    pairs = r.select("query_id", "chunk_id").distinct()
    assert joins.unjudged(pairs, lab).count() + pairs.join(lab, ["query_id", "chunk_id"], "left_semi").count() == pairs.count()


def test_fusion(spark):
    r = spark.createDataFrame([("q", x, rank, "a") for x, rank in (("r0", 1), ("r1", 1), ("r2", 2))] + [("q", "r0", 3, "b"), ("q", "r1", 5, "b")], "query_id string, retriever string, rank int, chunk_id string")
    fused = {x["chunk_id"]: x["rrf_score"] for x in retrieval.rrf(r).collect()}
    assert fused["a"] == pytest.approx(0.048916, abs=1e-6) and fused["b"] == pytest.approx(0.031258, abs=1e-6)
    seeds = spark.createDataFrame([("q", "lost")], "query_id string, seed_chunk_id string")
    pool = {x["chunk_id"]: x for x in retrieval.candidates(r, seeds, ["r0", "r1", "r2"], 10).collect()}
    assert pool["lost"]["seed"] and pool["lost"]["rrf_score"] == 0 and pool["lost"]["r0_rank"] is None and pool["b"]["r2_rank"] is None
    nested = retrieval.nested_candidates(retrieval.candidates(r, seeds, ["r0", "r1", "r2"], 10), ["r0", "r1", "r2"]).first()["candidates"]
    assert [c["chunk_id"] for c in nested] == ["a", "b", "lost"]


def test_bm25_fills(spark):
    q = spark.createDataFrame([("q", "rare word")], "query_id string, query_text string")
    c = spark.createDataFrame([(f"c{i}", "a rare word" if i == 3 else "nothing here", "") for i in range(6)], "chunk_id string, text string, breadcrumb string")
    assert [x["chunk_id"] for x in retrieval.bm25(q, c, 3).orderBy("rank").collect()] == ["c3", "c0", "c1"]


def test_bm25_parts_grow_with_scores(spark, monkeypatch):
    """However many chunks and queries there are, a task sums up about SUMMED scores, and parts change no rank."""
    q = spark.createDataFrame([(f"q{i}", f"the word{i % 7} word{i % 5}") for i in range(10)], "query_id string, query_text string")
    seen, ranked = [], retrieval.ranked

    def watched(scores, k):
        seen.append([r["n"] for r in scores.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()])
        return ranked(scores, k)

    monkeypatch.setattr(retrieval, "ranked", watched)
    for n in (100, 400):
        c = spark.createDataFrame([(f"c{i:03}", f"the word{i % 11} and word{i % 13}" * (i % 3 + 1), "") for i in range(n)], "chunk_id string, text string, breadcrumb string")
        tops = []
        for summed in (1 << 19, 100):
            monkeypatch.setattr(retrieval, "SUMMED", summed, raising=False)
            tops.append(sorted((r["query_id"], r["chunk_id"], round(r["score"], 6), r["rank"]) for r in retrieval.bm25(q, c, 5, fill=False).collect()))
        assert tops[0] == tops[1] and len(tops[0]) == 50
        assert sum(seen[-1]) == 10 * n and max(seen[-1]) <= 300


def test_token_batches(spark):
    c = spark.createDataFrame([("s", i, "x" * 40) for i in range(7)] + [("s", 7, "y" * 4000)], "g string, pos int, text string")
    got = [r["batch"] for r in retrieval.token_batches(c, "g", "pos", 30, 100).orderBy("pos").collect()]
    assert got == [0, 0, 0, 1, 1, 1, 2, 3]


def test_guards(spark):
    ids = spark.createDataFrame([("a", 1), ("b", 2)], "k string, pos int")
    rows = spark.createDataFrame([("a", 5)], "k string, v int")
    with pytest.raises(ValueError, match="b"):
        joins.require_all(ids, rows, "k")
    with pytest.raises(Exception, match="no row"):
        joins.ordered_lookup(ids, rows, "k").collect()
    with pytest.raises(ValueError):
        joins.review(rows, offset=-1)


def test_resume(spark):
    done = spark.createDataFrame([("a", "v", "p", "b", "m"), ("b", "old", "p", "b", "m"), ("c", "v", "p", "b", "other")], "chunk_id string, schema_version string, prompt_hash string, backend string, model string")
    want = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "chunk_id string")
    todo, stale = joins.remaining(want, done, ["chunk_id"], joins.current_contract("v", "p", "b", "m"))
    assert sorted(r[0] for r in todo.collect()) == ["b", "c", "d"] and stale.count() == 2


def test_attempts():
    from poolsmith.plans import models

    waits, calls = [], []

    def fails(times, error):
        calls.clear(), waits.clear()

        def call():
            calls.append(1)
            if len(calls) <= times:
                raise error
            return "fine"

        return call

    assert models.attempt(fails(2, OSError("busy")), sleep=waits.append) == ("fine", "", 3) and waits == [1.0, 2.0]
    assert models.attempt(fails(3, OSError("busy")), sleep=waits.append) == (None, "OSError: busy", 3)
    assert models.attempt(fails(1, KeyError("d1")), sleep=waits.append)[2] == 1 and waits == []
    assert models.encoded_with_retry(lambda t: fails(0, None)(), sleep=waits.append)(["x"]) == "fine"
    with pytest.raises(RuntimeError, match="down"):
        models.encoded_with_retry(lambda t: (_ for _ in ()).throw(OSError("down")), sleep=waits.append)(["x"])
    assert waits == [2.0, 4.0, 8.0, 16.0]


def test_judging_by_both_rubrics(spark):
    from poolsmith.plans import models

    pairs = spark.createDataFrame([("q", "a", "one two", "one two three"), ("q", "b", "one", "none of it"), ("q", "c", None, "x")], "query_id string, chunk_id string, query_text string, text string")
    model = lambda q, t: '<think>so</think> {"d1": true, "d2": 0, "d3": 1, "d4": 2, "reasoning": "r"} ok' if t.startswith("one") else "no"
    v1 = {r["chunk_id"]: r for r in models.judge(pairs, model, models.RUBRICS["v1_boolean"].contract("local", "m"), rubric_name="v1_boolean").collect()}
    assert (v1["a"]["d2"], v1["a"]["score"], v1["a"]["reasoning"]) == (True, 2, "r") and v1["b"]["score"] == -1 and v1["b"]["_error"] and v1["b"]["_attempts"] == 1
    v2 = {r["chunk_id"]: r for r in models.judge(pairs, model, {}).collect()}
    assert (v2["a"]["d1"], v2["a"]["d4"], v2["a"]["_error"]) == (True, 2, "") and v2["b"]["d4"] == 0 and "ValueError" in v2["b"]["_error"]
    versions = {n: (r.schema_version, r.prompt_hash) for n, r in models.RUBRICS.items()}
    assert versions["v1_boolean"][0] == v1["a"]["schema_version"] != versions["v2_graded"][0] and versions["v1_boolean"][1] != versions["v2_graded"][1]


def test_decisions(spark):
    from poolsmith.plans import models

    chunks = spark.createDataFrame([("a", "s", 1, "", "keep me"), ("b", "s", None, "A > B", "drop"), ("c", "", 2, None, "fails")], "chunk_id string, source string, page int, breadcrumb string, text string")

    def model(message):
        if "fails" in message:
            raise ValueError("bad")
        return {"query": "why?" if message == "Source: s\nPage: 1\n\nChunk:\nkeep me" else " ", "reason": message}

    found = models.decided(chunks, model, "local", "m")
    by = {r["chunk_id"]: r for r in found.collect()}
    assert by["a"]["seed_query"] == "why?" and by["b"]["seed_query"] is None and by["b"]["reason"] == "Source: s\nBreadcrumb: A > B\n\nChunk:\ndrop" and by["c"]["_error"] == "ValueError: bad"
    assert [r["seed_query"] for r in models.kept(chunks, found).collect()] == ["why?"]


def test_synthesis_seed_falls_back(spark):
    from poolsmith.plans import pipelines

    kept = spark.createDataFrame([(f"c{i}", "s", "t", i, "T > x", "", "text") for i in range(4)], "chunk_id string, source string, tier string, pos int, breadcrumb string, section string, text string")
    found = lambda ids: pipelines.synthesised(pipelines.topics(kept), lambda m: {"query_text": "q", "seed_chunk_ids": ids}).collect()
    assert found(["c2", "c1"])[0]["seed_chunk_id"] == "c2" and found(["gone"])[0]["seed_chunk_id"] == "c0" and found([])[0]["seed_chunk_id"] == "c0"
    assert pipelines.synthesised(pipelines.topics(kept), lambda m: "nothing").collect() == []


def test_pooling_goes_on_where_it_stopped(spark, tmp_path):
    from poolsmith.plans import pipelines

    chunks = spark.createDataFrame([(f"c{i}", f"word{i} and", "") for i in range(6)], "chunk_id string, text string, breadcrumb string")
    queries = spark.createDataFrame([("q1", "word1", "c5"), ("q2", "word2", "gone")], "query_id string, query_text string, seed_chunk_id string")
    asked = []

    def bm25(q, c):
        asked.append(sorted(r["query_id"] for r in q.collect()))
        return retrieval.bm25(q, c, 2)

    path = str(tmp_path / "pool")
    pool, missing = pipelines.pool_candidates(queries.where("query_id = 'q1'"), chunks, {"bm25": bm25}, path)
    assert (pool.count(), missing) == (3, 0)
    pool, missing = pipelines.pool_candidates(queries, chunks, {"bm25": bm25}, path)
    pipelines.pool_candidates(queries, chunks, {"bm25": bm25}, path)
    assert asked == [["q1"], ["q2"]] and missing == 1 and pool.where("seed").count() == 2
    pairs, gone = pipelines.to_judge(pool, pool.where("false"), queries, chunks)
    assert pairs.count() == 5 and [tuple(r) for r in gone.collect()] == [("q2", "gone")]


def test_numbered(spark):
    df = spark.range(1000).selectExpr("id", "id * 7919 % 1000 AS k").repartition(7)
    assert sorted((r["k"], r["n"]) for r in joins.numbered(df, "n", "k").collect()) == [(i, i + 1) for i in range(1000)]
    assert joins.numbered(df.where("false"), "n", "k").count() == 0


def test_vector_blocks(spark, monkeypatch):
    """Blocks of any size, sent or not, give what all products give; ties go by id."""
    import numpy as np

    r = np.random.default_rng(2)
    m = r.integers(-2, 3, (90, 4)).astype(float)
    m[:, 0] += 5
    rows = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(90, None)], "chunk_id int, embedding array<float>")
    asked = rows.where("chunk_id % 9 = 0").withColumnRenamed("chunk_id", "query_id")
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    s = np.round(u @ u.T, 6)
    want = {(q, n + 1): c for q in range(0, 90, 9) for n, c in enumerate(sorted(range(90), key=lambda c: (-s[q, c], c))[:5])}
    for sizes in ((256, 1024, 1 << 20), (3, 7, 1 << 20), (3, 7, 0)):
        monkeypatch.setattr(retrieval, "QUERY_BLOCK", sizes[0]), monkeypatch.setattr(retrieval, "CORPUS_BLOCK", sizes[1]), monkeypatch.setattr(retrieval, "SENT_BYTES", sizes[2])
        assert {(x["query_id"], x["rank"]): x["chunk_id"] for x in retrieval.dense(asked, rows, 5).collect()} == want


def test_containing(spark):
    chunks = spark.createDataFrame([("a", "xone two threex"), ("b", "One two three"), ("c", "one two"), ("d", None)], "chunk_id string, text string")
    queries = spark.createDataFrame([("q", "one two three"), ("p", "two"), ("r", ""), ("n", None)], "query_id string, query_text string")
    found = sorted((r["query_id"], r["chunk_id"]) for r in retrieval.containing(queries, chunks).collect())
    assert found == sorted([("q", "a"), *(("p", c) for c in "abc"), *(("r", c) for c in "abc")])


def test_tokens(spark):
    import re

    texts = ["", "One two-THREE_4", "\u212aelvin \u0130stanbul É a", "  x ", "ÀB", "ſs", "1\n2\t3", None]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(X.tokens(F.col("t"))).collect()]
    assert got == [re.sub("[^a-zA-Z0-9]", " ", t.lower()).split() for t in texts[:-1]] + [None]


def test_rewrites_in_other_case(spark):
    """What is unchanged but for case is no rewrite, whatever its letters' forms in capitals; single quotes belong to the text."""
    from poolsmith.functions import rubric

    taken = lambda df: df.select(rubric.accepted_rewrite(F.col("said"), F.col("text")).alias("r"))
    letters = [c for c in map(chr, range(0x110000)) if c.upper() != c or c.lower() != c]
    signs = spark.createDataFrame([(f"a{c}z",) for c in letters], "text string")
    assert taken(signs.withColumn("said", F.upper("text"))).where("r IS NOT NULL").count() == 0
    assert taken(signs.withColumn("said", F.lower("text"))).where("r IS NOT NULL").count() == 0
    rows = [("stra\u00dfe", "STRASSE"), ("stra\u00dfe", ' "stra\u00dfe?" '), ("'a' b", "\"'a' b?\""), (None, ' "?" '), ("a", '""'), ("a", None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, text string, said string").orderBy("i")
    assert [r["r"] for r in taken(df).collect()] == [None, "stra\u00dfe?", "'a' b?", "?", None, None]


def test_encoder_is_asked_once_and_for_few_texts(spark, tmp_path):
    """A model sees each row's text once, whatever is filtered afterwards, and few texts at a time."""
    log, stand_in = str(tmp_path / "asked"), retrieval.hashing_encoder(8)

    def encode(texts):
        with open(log, "a") as f:
            f.write(f"{len(texts)}\n")
        return stand_in(texts)

    c = spark.createDataFrame([(f"c{i}", None if i == 7 else f"word{i} and word{i % 9}") for i in range(3000)], "chunk_id string, text string").coalesce(1)
    q = spark.createDataFrame([("q", [float(x) for x in stand_in(["word5 and word5"])[0]])], "query_id string, embedding array<float>")
    top = retrieval.dense(q, retrieval.encoded(c, encode).select("chunk_id", "embedding"), 3).collect()
    asked = [int(n) for n in open(log).read().split()]
    assert len(top) == 3 and sum(asked) == 3000 and max(asked) <= 256
    vectors = {r["chunk_id"]: r["embedding"] for r in retrieval.encoded(c, stand_in).collect()}
    texts = {r["chunk_id"]: r["text"] or "" for r in c.collect()}
    assert all(vectors[k] == pytest.approx(stand_in([t])[0], abs=1e-6) for k, t in texts.items())


@pytest.mark.parametrize("name", ["u1_t10_judged_pairs", "u1_p11_judged_by_first_rubric"])
def test_judged_pairs_over_many_parts(spark, same, monkeypatch, name):
    """The judged queries' scores are dealt into parts by their number, too, and give the rows of their SQL."""
    from poolsmith.plans.queries import QUERIES, SQL

    seen, ranked = [], retrieval.ranked

    def watched(scores, k):
        seen.append(scores.rdd.getNumPartitions())
        return ranked(scores, k)

    monkeypatch.setattr(retrieval, "ranked", watched)
    monkeypatch.setattr(retrieval, "SUMMED", 500, raising=False)
    same(QUERIES[name], SQL[name])
    assert seen and min(seen) >= 10
