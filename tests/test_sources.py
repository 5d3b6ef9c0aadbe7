import json
import struct

import pytest

from poolsmith.sources import corpus, sinks

TWO = "<sep>[SOURCE:alpha|PAGE:3|CID:00ff]\n> Part > Chapter\n\n## Title\n\nSome words with <sep> inside.\n\n<sep>[SOURCE:beta|PAGE:4|CID:00fe]\nNo crumbs here.\n"


def write(tmp_path, text, name="corpus.txt"):
    p = tmp_path / name
    p.write_bytes(text.encode())
    return str(p)


def test_strict_scan(spark, tmp_path):
    for text in (TWO, "\n\n" + TWO, TWO.replace("\n", "\r\n"), TWO.rstrip("\n")):
        found = [r.asDict() for r in corpus.strict_chunks(spark, write(tmp_path, text)).orderBy("pos").collect()]
        assert [(f["source"], f["page"], f["chunk_id"], f["breadcrumb"], f["text"]) for f in found] == [
            ("alpha", 3, "00ff", "Part > Chapter", "## Title\n\nSome words with <sep> inside."),
            ("beta", 4, "00fe", "", "No crumbs here."),
        ]


@pytest.mark.parametrize("bad", ["<sep>[SOURCE:alpha|PAGE:3]\nx\n", "early text\n" + TWO, TWO + "<sep>[SOURCE:a|PAGE:x|CID:00ff]\nx"])
def test_strict_scan_fails(spark, tmp_path, bad):
    with pytest.raises(Exception, match="not a chunk header"):
        corpus.strict_chunks(spark, write(tmp_path, bad)).collect()


def test_lenient_scan(spark, tmp_path):
    text = "early\n<sep>[SOURCE:a|PAGE:iv|CID:Q1] tail\nbody\n<sep>broken\nmore\n<sep>[SOURCE:b|PAGE:2|CID:Q1]\nlast\n"
    path = write(tmp_path, text)
    found = corpus.lenient_chunks(spark, path).orderBy("pos").collect()
    assert [(r["chunk_id"], r["page"], r["text"]) for r in found] == [("Q1", "iv", "body\n<sep>broken\nmore"), ("Q1", "2", "last")]
    assert [r["text"] for r in corpus.lenient_chunks(spark, path, "last").collect()] == ["last"]


def test_crumbs_of_several_lines(spark):
    from pyspark.sql import functions as F

    from poolsmith.functions.text import split_breadcrumb

    bodies = ["\n> One > Two\n\n## H\n\nbody\n", "> One\n> Two\nbody", "plain", "", "> only", "body\n> not a crumb"]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i int, b string").select("i", split_breadcrumb(F.col("b")).alias("s")).orderBy("i")
    assert [(r["s"]["breadcrumb"], r["s"]["text"]) for r in df.collect()] == [("One > Two", "## H\n\nbody"), ("One Two", "body"), ("", "plain"), ("", ""), ("only", ""), ("", "body\n> not a crumb")]


def test_ids_and_points(spark, tmp_path):
    path = write(tmp_path, TWO)
    assert [r["chunk_id"] for r in corpus.chunk_ids(spark, path).orderBy("pos").collect()] == ["00ff", "00fe"]
    chunks = corpus.strict_chunks(spark, path)
    assert corpus.chunk_at(chunks, pos=2).first()["chunk_id"] == corpus.chunk_at(chunks, "00fe").first()["chunk_id"] == "00fe"
    assert [r["id"] for r in corpus.id_list(spark, write(tmp_path, " a \n\nb\n", "ids")).orderBy("pos").collect()] == ["a", "b"]


def test_json_lines(spark, tmp_path):
    good, bad = write(tmp_path, '{"a": 1}\n\n{"a": 2}\n', "g.jsonl"), write(tmp_path, '{"a": 1}\n{oops\n', "b.jsonl")
    assert corpus.json_lines(spark, good, "a int").count() == 2
    with pytest.raises(Exception):
        corpus.json_lines(spark, bad, "a int").collect()
    lax = corpus.json_lines(spark, bad, "a int", strict=False).cache()
    assert [r["_corrupt_record"] for r in lax.where("_corrupt_record is not null").collect()] == ["{oops"]


def test_vectors(spark, tmp_path):
    import sqlite3

    blob = lambda *x: b"VF32" + struct.pack(f"<{len(x)}f", *x)
    with sqlite3.connect(tmp_path / "v.db") as db:
        db.execute("CREATE TABLE t (e BLOB)")
        db.executemany("INSERT INTO t VALUES (?)", [(blob(i, 0.5),) for i in range(10)])
    found = corpus.sqlite_vectors(spark, str(tmp_path / "v.db"), "t", "e", partitions=3)
    assert sorted(r["embedding"][0] for r in corpus.checked_vectors(found, 2).collect()) == [float(i) for i in range(10)]
    with pytest.raises(Exception, match="dimensions"):
        corpus.checked_vectors(found, 3).collect()


def test_settings(spark, tmp_path):
    yaml = pytest.importorskip("yaml")
    path = write(tmp_path, yaml.dump({"tiers": {"high": {"queries_per_source": 5, "sources": ["b", "a"]}}}), "s.yaml")
    tiers = corpus.source_tiers(spark, corpus.settings(path)["tiers"]).orderBy("ord").collect()
    assert [(r["source"], r["tier"], r["queries_per_source"]) for r in tiers] == [("b", "high", 5), ("a", "high", 5)]
    with pytest.raises(ValueError):
        corpus.settings(write(tmp_path, "- 1", "l.yaml"))


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("q", "r", 1, "c", 0.5)], sinks.SCHEMAS["rankings"])
    path = str(tmp_path / "rankings")
    for _ in range(2):
        sinks.write_release(df, path, "rankings")
    back = spark.read.parquet(path)
    assert sinks.preview(back)["rows"] == 1 and dict(back.dtypes)["rank"] == "int"
    with pytest.raises(ValueError):
        sinks.enforce_schema(df.drop("score"), sinks.SCHEMAS["rankings"])
    assert sinks.fingerprint(["b", "a"]) == sinks.fingerprint(["a", "b"]) != sinks.fingerprint(["a"])
    assert sinks.append_new(df, str(tmp_path / "log"), ["query_id"]) == 1
    assert sinks.append_new(df.union(df), str(tmp_path / "log"), ["query_id"]) == 0
    long = spark.createDataFrame([("r", "hr", 3, 5, 0.5)], "retriever string, metric string, threshold int, k int, value double")
    assert json.loads(sinks.metric_json(long)) == {"r": {"hr@threshold=3@k=5": 0.5}}
    assert sinks.markdown(long).splitlines()[2] == "| r | hr | 3 | 5 | 0.500 |"
    assert sinks.manifest({"rankings": back}, made_by="test")["relations"]["rankings"]["rows"] == 1


def test_sharded_lenient_scan(spark, tmp_path):
    """Headers that are malformed belong to the chunk before, across the parts of a split file."""
    words = ["early"]
    for i in range(300):
        words += [f"<sep>[SOURCE:s|PAGE:{i}|CID:{i:04x}]", f"body {i} " + "x" * 50] + [f"<sep>broken {i}", "more"] * (i % 3)
    path = write(tmp_path, "\n".join(words) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        found = corpus.lenient_chunks(spark, path).orderBy("pos").collect()
        assert spark.read.option("lineSep", "\n<sep>").text(path).rdd.getNumPartitions() > 3
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [(r["chunk_id"], r["page"]) for r in found] == [(f"{i:04x}", str(i)) for i in range(300)]
    assert [r["text"] for r in found] == ["\n".join([f"body {i} " + "x" * 50] + [f"<sep>broken {i}", "more"] * (i % 3)) for i in range(300)]


def test_located_errors(spark, tmp_path):
    good = write(tmp_path, '{"a": 1}\n\n{"a": 2}\n', "g.jsonl")
    assert sorted(r["a"] for r in corpus.located_json_lines(spark, good, "a int").collect()) == [1, 2]
    bad = write(tmp_path, '{"a": 1}\n\n{"a": 2}\n{oops\n{"a": 3}\n', "b.jsonl")
    with pytest.raises(ValueError, match=r"b\.jsonl:4: invalid JSON"):
        corpus.located_json_lines(spark, bad, "a int")
    with pytest.raises(Exception, match="blank line"):
        corpus.json_lines(spark, good, "a int", blanks=False).collect()
    assert corpus.json_lines(spark, write(tmp_path, '{"a": 1}\n', "one.jsonl"), "a int", blanks=False).collect()[0]["a"] == 1


def test_sqlite_texts(spark, tmp_path):
    import hashlib
    import sqlite3

    blob = lambda *x: b"VF32" + struct.pack(f"<{len(x)}f", *x)
    with sqlite3.connect(tmp_path / "t.db") as db:
        db.execute("CREATE TABLE t (body TEXT, e BLOB)")
        db.executemany("INSERT INTO t VALUES (?, ?)", [(f"title {i}\ntext {i % 4}", blob(3.0, 4.0)) for i in range(5)])
    found, twice = corpus.sqlite_texts(spark, str(tmp_path / "t.db"), "t", "body", "e", 2)
    rows = found.collect()
    assert twice == 1 and {r["chunk_id"] for r in rows} == {hashlib.sha256(f"text {i}".encode()).hexdigest()[:16] for i in range(4)}
    assert all(abs(r["embedding"][0] - 0.6) < 1e-6 for r in rows)
    with sqlite3.connect(tmp_path / "t.db") as db:
        db.execute("DELETE FROM t WHERE rowid = 2")
    with pytest.raises(ValueError, match="gaps"):
        corpus.sqlite_vectors(spark, str(tmp_path / "t.db"), "t", "e", gapless=True)


def test_vectors_are_cached_by_content(spark, tmp_path):
    from poolsmith.operators.retrieval import hashing_encoder

    path, rows = str(tmp_path / "cache"), spark.createDataFrame([("a", "one"), ("b", "two"), ("c", "one")], "chunk_id string, text string")
    first = {r["chunk_id"]: r["embedding"] for r in corpus.cached_vectors(rows, path, hashing_encoder(8)).collect()}
    assert spark.read.parquet(path).count() == 2 and first["a"] == first["c"] != first["b"]

    def never(texts):
        assert not texts or texts == ["three"]
        return hashing_encoder(8)(texts)

    again = corpus.cached_vectors(rows.union(spark.createDataFrame([("d", "three")], rows.schema)), path, never)
    assert {r["chunk_id"]: r["embedding"] for r in again.collect()}["a"] == first["a"] and spark.read.parquet(path).count() == 3
    corpus.cached_vectors(rows.limit(1), path, hashing_encoder(8), model="other")
    assert spark.read.parquet(path).count() == 4


def test_paths(monkeypatch):
    monkeypatch.setenv("PLACE", "/data")
    assert corpus.expand_path("$PLACE/x") == "/data/x" and corpus.expand_path("x", "/base") == "/base/x"
    assert corpus.corpus_path({"corpus": {"chunks_path": "c.txt"}}, "/base") == "/base/c.txt"
    with pytest.raises(ValueError):
        corpus.corpus_path({})


def test_rankings_by_their_rank_column(spark):
    nested = spark.createDataFrame([("q", "r", [("a", 7, 0.5), ("b", 2, None)])], "query_id string, retriever string, results array<struct<chunk_id: string, rank: int, score: double>>")
    found = lambda by: {r["chunk_id"]: r["rank"] for r in corpus.rankings_from_nested(nested, by).collect()}
    assert found(True) == {"a": 1, "b": 2} and found(False) == {"a": 7, "b": 2}


def test_more_sinks(spark, tmp_path):
    lines = lambda p: sorted(x for f in (tmp_path / p).glob("*.json") for x in f.read_text().splitlines())
    df = spark.createDataFrame([("q", "ü", 1), ("p", "b", 2)], "zeta string, alpha string, n int")
    sinks.write_json_lines(df, str(tmp_path / "j"))
    assert lines("j") == ['{"alpha":"b","n":2,"zeta":"p"}', '{"alpha":"ü","n":1,"zeta":"q"}']
    from pyspark.sql import functions as F

    judged = spark.createDataFrame([("a", 1, ""), ("a", 2, ""), ("b", 3, "late"), ("b", 4, "late"), ("a", 0, "late"), ("c", 5, "lost"), ("c", 6, "")], "k string, n int, _error string")
    sinks.split_errors(judged, F.col("_error") == "", str(tmp_path / "ok"), str(tmp_path / "bad"), ["k"], "n")
    assert [json.loads(x)["n"] for x in lines("ok")] == [1, 6] and [json.loads(x)["n"] for x in lines("bad")] == [3]
    traces = spark.createDataFrame([("q", 1, "old"), ("q", 2, "new"), ("p", 1, "x")], "zeta string, at int, thinking string")
    sinks.append_column(df, traces, ["zeta"], str(tmp_path / "more"), "at")
    assert {r["zeta"]: r["thinking"] for r in spark.read.parquet(str(tmp_path / "more")).collect()} == {"q": "new", "p": "x"}
    text = sinks.report("Audit", {"Note": "by hand", "Counts": df.orderBy("n")})
    assert text.startswith("# Audit\n\n## Note\n\nby hand\n\n## Counts\n\n| zeta") and text.endswith("| p | b | 2 |\n")
    assert sinks.console("Counts", df.orderBy("n")).splitlines() == ["=== Counts ===", "zeta  alpha  n", "q     ü      1", "p     b      2"]
    assert sinks.prompt_text("Be brief. ", "Q: {question}\n", {"question": "x"}) == "Be brief.\n\nQ: <QUESTION>\n"
    assert sinks.prompt_hash("a", "b") != sinks.prompt_hash("a", "c") and len(sinks.prompt_hash("a", "b")) == 16
    assert sinks.table_at(spark, str(tmp_path / "nowhere")) is None


def test_shared_folder(spark, tmp_path):
    from poolsmith.sources import shared

    with shared.scratch(spark):
        kept = shared.shared_table(spark.range(5).toDF("x"), "t")
        files = kept.inputFiles()
        assert kept.count() == 5 and files
    import os

    assert not any(os.path.exists(f.removeprefix("file://")) for f in files)


def test_keys_of_several_files(spark, tmp_path):
    a = write(tmp_path, '{"query_id": "q", "chunk_id": "a", "score": 1}\n{"query_id": "p", "chunk_id": "a"}\n', "a.jsonl")
    b = write(tmp_path, '{"query_id": "q", "chunk_id": "a"}\n{"query_id": "q", "chunk_id": "b"}\n', "b.jsonl")
    assert corpus.shards(spark, [a, b], "query_id string, chunk_id string, score int").count() == 4
    found = corpus.label_keys(spark, [a, b], spark.createDataFrame([("q",)], "query_id string"))
    assert sorted(map(tuple, found.collect())) == [("q", "a"), ("q", "b")]
