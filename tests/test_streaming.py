from poolsmith.plans import models
from poolsmith.streaming.judging import PAIRS, arriving, judge_stream


def test_judged_once(spark, tmp_path):
    pairs, labels = str(tmp_path / "pairs"), str(tmp_path / "labels")
    put = lambda *rows: spark.createDataFrame(rows, PAIRS).coalesce(1).write.mode("append").parquet(pairs)
    run = lambda check: judge_stream(arriving(spark, pairs), lambda df: models.judge(df, models.stub_judge, {"model": "stub"}), labels, str(tmp_path / check)).awaitTermination()
    put(("q", "a", "one two", "one two three"), ("q", "a", "one two", "one two three"), ("q", "b", "one", "none of it"))
    run("c1")
    assert spark.read.parquet(labels).count() == 2
    put(("q", "b", "one", "none of it"), ("p", "a", "x", "x y"))
    run("c1")
    assert spark.read.parquet(labels).count() == 3
    run("c2")  # another checkpoint sees all files again
    found = {(r["query_id"], r["chunk_id"]): (r["d1"], r["d2"], r["_error"]) for r in spark.read.parquet(labels).collect()}
    assert found == {("q", "a"): (True, 2, ""), ("q", "b"): (False, 0, ""), ("p", "a"): (True, 1, "")}


def test_errors_are_data(spark):
    def broken(query, text):
        raise KeyError("d1")

    df = spark.createDataFrame([("q", "a", "x", "y")], PAIRS)
    assert models.judge(df, broken, {}).first()["_error"].startswith("KeyError")
