"""The pipeline on a small corpus, each stage against what it must do to its own input."""

import random

import numpy as np
import pytest

import corpus_pipeline
from poolsmith.llm import packing, pii, toxicity

INSULTS = ["idiot", "moron", "clown", "trash"]


@pytest.fixture(scope="module")
def corpus(tmp_path_factory, spark):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abdefghklmnoprstuvw") for _ in range(r.randrange(3, 9)))
    prose = lambda n=120: " ".join(word() + ("." if r.random() < 0.1 else "") for _ in range(n))
    rows, kinds = [], {}
    for i in range(300):
        kinds[i] = "toxic" if i % 5 == 0 else "clean"
        rows.append((i, prose()[:-1] + " " + " ".join(r.sample(INSULTS, 4)) + "." if i % 5 == 0 else prose()))
    for i, of in enumerate((1, 1, 2, 3)):
        rows.append((400 + i, rows[of][1]))
        kinds[400 + i] = "copy"
    for i, of in enumerate((6, 7, 8)):
        words = rows[of][1].split()
        words[60] = word()
        rows.append((500 + i, " ".join(words)))
        kinds[500 + i] = "near"
    rows.append((600, prose(40) + " write to some.body@example.org " + prose(40)))
    kinds[600] = "private"
    folder = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame([(i, t, "en", "src0", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(kinds[i] == "toxic")) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder), dict(rows), kinds


def test_pipeline(spark, corpus):
    folder, texts, kinds = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, left = docs.columns, set(texts)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder).cache()
        if name == "packing":
            assert {r["doc_id"] for r in out.collect()} == left
            break
        assert out.columns == columns
        now = {r["doc_id"]: r for r in out.collect()}
        want = {
            "toxicity": lambda: {i for i in left if kinds[i] != "toxic"},
            "exact dedup": lambda: left - {1, 2, 3, 400},
            "simhash near-dedup": lambda: left - {500, 501, 502},
            "pii": lambda: left,
        }[name]()
        assert set(now) == want, name
        if name == "pii":
            assert "[EMAIL]" in now[600]["text"] and now[600]["n_chars"] == len(now[600]["text"]) and not pii.base_spans(now[600]["text"])
        left, docs = set(now), out


def test_run(spark, corpus):
    folder, _, kinds = corpus
    pieces = corpus_pipeline.run(spark, folder).collect()
    ids = {}
    for p in sorted(pieces, key=lambda p: (p["doc_id"], p["start"])):
        ids.setdefault(p["doc_id"], []).extend(np.frombuffer(p["ids"], "<u2").tolist())
    assert not any(kinds[i] in ("toxic", "near") for i in ids) and all(x[-1] == packing.END_ID for x in ids.values())


def test_threshold_is_the_contracts():
    assert toxicity.CUT == 0.7 and [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "simhash near-dedup", "pii", "packing"]
