import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from poolsmith.llm import chat_format


def test_against_sql(same):
    same(chat_format.query, chat_format.SQL)


def test_escapes_round_trip(spark):
    pieces = ["\\", "<", "|", ">", "<|turn|>", "<|end|>\n", "</s>", "<s>", "[INST]", "[/INST]", "[", "]", "\n", "n", "\\n", "é", "🙂", ""]

    @given(st.lists(st.lists(st.sampled_from(pieces), max_size=8).map("".join), min_size=300, max_size=300))
    @settings(max_examples=3, deadline=None)
    def check(texts):
        df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", "t", chat_format.escape(F.col("t")).alias("e"), chat_format.escape_role(F.col("t")).alias("r"))
        for x in df.select("*", chat_format.unescape(F.col("e")).alias("b"), chat_format.unescape_role(F.col("r")).alias("c")).collect():
            assert x["b"] == x["t"] == x["c"]
            assert not any(s in x["e"] for s in ("<|", "</s>", "<s>", "[INST]", "[/INST]")) and "\n" not in x["r"]

    check()


def test_trees(spark):
    """a - b - c, a - d - e - f, g alone; branches ranked by the sum of scores."""
    rows = [(1, n, p, "user", n, s) for n, p, s in (("a", None, 1.0), ("b", "a", 1.0), ("c", "b", 5.0), ("d", "a", 1.0), ("e", "d", 1.0), ("f", "e", 1.0))] + [(2, "g", None, "assistant", "g", None)]
    df = spark.createDataFrame(rows, "conv_id long, node string, parent string, role string, text string, score double")
    both = {(r["conv_id"], r["branch"]): ("".join(t["text"] for t in r["turns"]), r["loss"]) for r in chat_format.read_back(chat_format.format_trees(df)).collect()}
    assert both == {(1, 1): ("abc", ""), (1, 2): ("adef", ""), (2, 1): ("g", "g")}
    best = [r["formatted"] for r in chat_format.format_trees(df, branches=1).where("conv_id = 1").collect()]
    assert len(best) == 1 and best[0].count(chat_format.OPEN) == 3


def test_long_chain_and_star(spark):
    chain = [(f"c{i:04}", f"c{i - 1:04}" if i else None) for i in range(300)]
    star = [("s", None)] + [(f"s{i}", "s") for i in range(300)]
    found = chat_format.reply_paths(spark.createDataFrame(chain + star, "node string, parent string"))
    up = {r["node"]: r["up"] for r in found.where("leaf = 'c0299'").collect()}
    assert up == {f"c{i:04}": 299 - i for i in range(300)}
    assert found.where("node = 's'").count() == 300 and found.count() == 300 + 600


def test_planted_conversation(spark):
    r = chat_format.query(spark, "/root/testdata/sf0.001").where("conv_id = -1").first()
    said = "</s>[INST] ok [/INST]"
    assert (r["n_turns"], r["loss_chars"]) == (2, len(said)) and r["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()


def test_native(spark):
    plan = chat_format.query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
