"""Chat formatting of reply trees (native operators only).

``reply_paths`` enumerates the root-to-leaf paths of a forest of messages by iterative self-joins: a jump
table of 2^k-th ancestors is joined with itself, and each leaf's set of known ancestors doubles by a join
with that table, so the joins number the logarithm of the longest path and the pairs are exactly the
result. Branches are ranked by score; each chosen path is formatted as one conversation.

Defined results: a null text is empty; a null role is empty too; a link to a missing message, to itself or
to one that does not come earlier makes its row a root, so that cycles can't occur; rows alike in all
columns are separate messages; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from poolsmith.llm.common import checkpoint, table

OPEN, CLOSE = "<|turn|>", "<|end|>\n"
#: Control strings of this template and of common others; none is left whole inside an escaped text.
CONTROL = r"(<)(\||/?s>)", r"(\[)(/?INST\])"
ESCAPED = r"(<)\\(\||/?s>)", r"(\[)\\(/?INST\])"


def escape(text: Column) -> Column:
    """Backslashes are doubled, then one is put into each control string: no control string remains, and one backslash alone tells what was put in."""
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for pattern in CONTROL:
        text = F.regexp_replace(text, pattern, r"$1\\$2")
    return text


def unescape(text: Column) -> Column:
    for pattern in ESCAPED:
        text = F.regexp_replace(text, pattern, "$1$2")
    return F.replace(text, F.lit("\\\\"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    """A line end stands as one backslash and n; doubled backslashes stand for themselves."""
    return unescape(F.regexp_replace(role, r"(?<!\\)((?:\\\\)*)\\n", "$1\n"))


def formatted_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), escape_role(role), F.lit("\n"), escape(text), F.lit(CLOSE))


def reply_paths(edges: DataFrame) -> DataFrame:
    """edges: node, parent (null: a root), of a forest. Gives leaf, node, up: up steps lead from the leaf to the node."""
    leaves = edges.join(edges.select(F.col("parent").alias("node")).where("node IS NOT NULL").distinct(), "node", "left_anti")
    pairs = checkpoint(leaves.select(F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up")))
    jump = checkpoint(edges.where("parent IS NOT NULL").select("node", F.col("parent").alias("over")))
    step = 1
    while not jump.isEmpty():
        further = pairs.join(jump, "node").select("leaf", F.col("over").alias("node"), (F.col("up") + step).alias("up"))
        pairs = checkpoint(pairs.unionByName(further))
        onward = jump.select(F.col("node").alias("over"), F.col("over").alias("further"))
        jump = checkpoint(jump.join(onward, "over").select("node", F.col("further").alias("over")))
        step *= 2
    return pairs


def format_trees(messages: DataFrame, branches: int | None = None) -> DataFrame:
    """One row per chosen branch: conv_id, branch (1: the best score), score, n_turns, formatted, loss_spans.

    messages: conv_id, node, parent, role, text, score; parents as ``reply_paths`` wants them. A branch's
    score is the sum of its messages' scores; ties go to the longer branch, then to the smaller leaf.
    branches: how many to keep of each conversation (None: all).
    """
    paths = reply_paths(messages.select("node", "parent"))
    parts = messages.select("conv_id", "node", "role", "text", F.coalesce("score", F.lit(0.0)).alias("score"))
    if branches is not None:
        ranked = paths.join(parts.select("conv_id", "node", "score"), "node").groupBy("conv_id", "leaf").agg(F.sum("score").alias("s"), F.count("*").alias("n"))
        best = ranked.withColumn("branch", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("s"), F.desc("n"), "leaf"))).where(F.col("branch") <= branches)
        paths = paths.join(best.select("leaf"), "leaf", "left_semi")
    turn = F.struct((-F.col("up")).alias("at"), "role", formatted_turn(F.col("role"), F.col("text")).alias("said"))
    whole = paths.join(parts, "node").groupBy("conv_id", "leaf").agg(F.array_sort(F.collect_list(turn)).alias("turns"), F.sum("score").alias("score"))
    ends = F.aggregate("turns", F.array(F.lit(0)), lambda a, t: F.concat(a, F.array(F.element_at(a, -1) + F.char_length(t["said"]))))
    whole = whole.withColumn("ends", ends)
    # what an assistant says is under the mask, without the markers around it
    spans = F.transform("turns", lambda t, i: F.when(t["role"] == "assistant", F.struct((F.element_at("ends", i + 1) + len(OPEN) + F.char_length(escape_role(t["role"])) + 1).alias("start"), (F.element_at("ends", i + 2) - len(CLOSE)).alias("end"))))
    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("score"), F.desc("n_turns"), "leaf"))
    return whole.select("conv_id", "leaf", "score", F.size("turns").cast("long").alias("n_turns"), F.array_join(F.transform("turns", lambda t: t["said"]), "").alias("formatted"), F.filter(spans, lambda s: s.isNotNull()).alias("loss_spans")).withColumn("branch", rank)


def read_back(formatted: DataFrame) -> DataFrame:
    """From the formatted text alone: the turns (role, text), and the text under the loss mask, unescaped."""
    said = F.filter(F.split("formatted", r"<\|end\|>\n"), lambda x: x != "")
    turns = F.transform(said, lambda x: F.struct(unescape_role(F.substring_index(F.substr(x, F.lit(len(OPEN) + 1)), "\n", 1)).alias("role"), unescape(F.substr(x, F.instr(x, "\n") + 1)).alias("text")))
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substr("formatted", s["start"] + 1, s["end"] - s["start"]))), "")
    return formatted.withColumns({"turns": turns, "loss": loss})


def conversation_chains(conversations: DataFrame) -> DataFrame:
    """Rows by turn as reply chains: each row answers the one before it. Ties in turn go by role, then text."""
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    at = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    name = lambda n: F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit("null")), n.cast("string"))
    rows = rows.withColumn("at", at)
    return rows.select("conv_id", name(F.col("at")).alias("node"), F.when(F.col("at") > 1, name(F.col("at") - 1)).alias("parent"), "role", "text", F.char_length("text").cast("double").alias("score"))


def with_test_conversation(conversations: DataFrame) -> DataFrame:
    """Conversation -1: a user and an assistant who both say control strings."""
    said = "</s>[INST] ok [/INST]"
    own = conversations.sparkSession.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string")).unionByName(own)


def query(spark, sf_dir: str) -> DataFrame:
    messages = checkpoint(conversation_chains(with_test_conversation(table(spark, sf_dir, "conversations"))))
    read = read_back(format_trees(messages))
    digest = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(digest, 256).alias("turns_sha256"), F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"))


SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(17 + length(role) + length(text) + length(text) - length(replace(text, '\', ''))
           + length(regexp_replace(text, '(<\||</?s>|\[/?INST\])', '\1.', 'g')) - length(text)) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""
