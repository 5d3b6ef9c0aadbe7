"""Reading chunk corpora, JSON lines, id lists, vectors and settings."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from poolsmith.functions import fixed
from poolsmith.functions import text as X

STRICT, LENIENT = fixed.STRICT_HEADER, fixed.LENIENT_HEADER


def raw_chunks(spark: SparkSession, path: str) -> DataFrame:
    """file, pos, header, body: the file cut before each line that begins with <sep>; a <sep> inside a line is text. A file may be split: nothing is ordered over the whole of it."""
    rows = spark.read.option("lineSep", "\n" + fixed.SEPARATOR).text(path)
    rows = rows.select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("pos"), F.col("_metadata.file_block_start").alias("block"), F.replace("value", F.lit("\r"), F.lit("")).alias("value"))
    # what follows a cut has lost its <sep>; a file's first record has it, or is text before the first header
    start = rows.where("block = 0").groupBy("file").agg(F.min("pos").alias("start"))
    has = F.startswith("value", F.lit(fixed.SEPARATOR))
    value = F.when(F.col("pos") != F.col("start"), F.concat(F.lit(fixed.SEPARATOR), "value")).when(has, F.col("value")).otherwise(F.concat(F.lit("\n"), "value"))
    rows = rows.join(start, "file").select("file", "pos", value.alias("value"))
    return rows.select("file", "pos", F.substring_index("value", "\n", 1).alias("header"), F.expr("substr(value, instr(value || '\n', '\n') + 1)").alias("body"))


def strict_chunks(spark: SparkSession, path: str) -> DataFrame:
    """chunk_id, source, page, breadcrumb, text, pos. A header that isn't well-formed, or text before the first, raises an error."""
    rows = raw_chunks(spark, path).where(F.rlike(F.concat("header", "body"), F.lit(r"\S")))
    found = rows.select("pos", F.regexp_extract("header", STRICT, 1).alias("source"), F.regexp_extract("header", STRICT, 2).try_cast("int").alias("page"), F.regexp_extract("header", STRICT, 3).alias("chunk_id"), X.split_breadcrumb(F.col("body")).alias("b"), "header")
    source = F.when(F.col("source") != "", F.col("source")).otherwise(F.raise_error(F.concat(F.lit("not a chunk header: "), F.col("header"))))
    return found.select("chunk_id", source.alias("source"), "page", "b.breadcrumb", "b.text", "pos")


def lenient_chunks(spark: SparkSession, path: str, keep: str = "all") -> DataFrame:
    """chunk_id, source, page (string), text, pos. Malformed headers are text of the chunk before; text before the first header goes.

    keep: "all" rows, or of rows with one chunk_id the "first" or the "last".
    """
    rows = raw_chunks(spark, path).withColumn("good", F.rlike(F.rtrim("header"), F.lit(LENIENT))).withColumn("part", F.shiftright("pos", 33))
    # the last good header at or before a row: within its part of the file, else the last one of the parts before, of which there is a row each
    carried = rows.groupBy("file", "part").agg(F.max(F.when(F.col("good"), F.col("pos"))).alias("last"))
    before = Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = carried.withColumn("carried", F.max("last").over(before)).drop("last")
    within = Window.partitionBy("file", "part").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("chunk", F.max(F.when(F.col("good"), F.col("pos"))).over(within)).join(carried, ["file", "part"]).withColumn("chunk", F.coalesce("chunk", "carried"))
    whole = F.when(F.col("good"), F.col("body")).otherwise(F.concat_ws("\n", "header", "body"))
    chunks = rows.where("chunk IS NOT NULL").groupBy("file", "chunk").agg(F.min("pos").alias("pos"), F.min_by("header", "pos").alias("header"), F.array_sort(F.collect_list(F.struct("pos", whole.alias("part")))).alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: p["part"]), "\n")
    out = chunks.select(F.regexp_extract("header", LENIENT, 3).alias("chunk_id"), F.regexp_extract("header", LENIENT, 1).alias("source"), F.regexp_extract("header", LENIENT, 2).alias("page"), F.regexp_replace(text, r"^\s+|\s+$", "").alias("text"), "pos")
    return out if keep == "all" else one_a_key(out, ["chunk_id"], "pos", keep)


def one_a_key(df: DataFrame, keys: list[str], order: str, which: str = "first") -> DataFrame:
    """Of the rows with equal keys, the first or the last by ``order``."""
    by = F.col(order).asc() if which == "first" else F.col(order).desc()
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(by))).where("_n = 1").drop("_n")


def chunk_ids(spark: SparkSession, path: str) -> DataFrame:
    """chunk_id, pos: headers alone, in the file's order."""
    return raw_chunks(spark, path).where(F.rlike("header", F.lit(STRICT))).select(F.regexp_extract("header", STRICT, 3).alias("chunk_id"), "pos")


def chunk_at(chunks: DataFrame, chunk_id: str | None = None, pos: int | None = None) -> DataFrame:
    """One chunk, by id or by place (from 1) in the corpus's order."""
    if chunk_id is not None:
        return chunks.where(F.col("chunk_id") == chunk_id)
    # the pos-th smallest: a bounded heap in each task, no sort of all rows
    at = chunks.select("pos").orderBy("pos").limit(pos).agg(F.max("pos").alias("pos"), F.count("*").alias("n")).where(F.col("n") == pos)
    return chunks.join(at.select("pos"), "pos", "left_semi")


def json_lines(spark: SparkSession, path: str | list[str], schema: T.StructType | str, strict: bool = True, blanks: bool = True) -> DataFrame:
    """Rows of JSON lines. strict: a line that isn't JSON fails; else it comes with ``_corrupt_record`` and ``_file``. blanks: blank lines are skipped; else they are lines that aren't JSON."""
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    if not blanks:
        raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"))
        bad = F.when(F.trim("value") == "", F.raise_error(F.concat(F.lit("a blank line in "), "_file"))).otherwise(F.col("value"))
        lines = raw.select(F.from_json(bad, schema, {"mode": "FAILFAST"}).alias("r"))
        return lines.select("r.*")
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    with_bad = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    return spark.read.schema(with_bad).option("mode", "PERMISSIVE").json(path).withColumn("_file", F.col("_metadata.file_path"))


def located_json_lines(spark: SparkSession, path: str | list[str], schema: T.StructType | str) -> DataFrame:
    """Rows of JSON lines; the first line of a file that isn't JSON is an error with the file's name and the line's number.

    Parsing is done line by line, wherever a line lies; only where one is bad are the lines before it counted, by part of the file.
    """
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    bad_name = "_corrupt_record"
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("pos"))
    parsed = raw.withColumn("r", F.from_json("value", T.StructType([*schema.fields, T.StructField(bad_name, T.StringType())]), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad_name}))
    bad = parsed.where((F.trim("value") != "") & F.col(f"r.{bad_name}").isNotNull())
    first = bad.groupBy("file").agg(F.min("pos").alias("bad")).orderBy("file").limit(1).collect()
    if first:
        number = raw.where((F.col("file") == first[0]["file"]) & (F.col("pos") <= first[0]["bad"])).count()
        raise ValueError(f"{first[0]['file']}:{number}: invalid JSON")
    return parsed.where(F.trim("value") != "").select(*(F.col("r")[f.name].alias(f.name) for f in schema.fields))


def shards(spark: SparkSession, paths: list[str], schema: T.StructType | str) -> DataFrame:
    """All rows of several files of JSON lines, as written by the shards of a job."""
    return json_lines(spark, paths, schema)


def label_keys(spark: SparkSession, paths: list[str], queries: DataFrame) -> DataFrame:
    """query_id, chunk_id: the pairs of the given queries that any of the files has a label for, each once."""
    keys = shards(spark, paths, "query_id string, chunk_id string").select("query_id", "chunk_id")
    return keys.join(queries.select("query_id"), "query_id", "left_semi").distinct()


def id_list(spark: SparkSession, path: str) -> DataFrame:
    """id, pos: one id a line, trimmed, blank lines dropped."""
    return spark.read.text(path).select(F.trim("value").alias("id"), F.monotonically_increasing_id().alias("pos")).where("id != ''")


def rankings_from_nested(nested: DataFrame, by_position: bool = True) -> DataFrame:
    """query_id, retriever, rank, chunk_id, score of query_id, retriever, results: array of (chunk_id, rank, score). by_position: the place in the array is the rank."""
    rows = nested.select("query_id", "retriever", F.posexplode("results").alias("at", "r"))
    rank = (F.col("at") + 1) if by_position else F.col("r.rank")
    return rows.select("query_id", "retriever", rank.cast("int").alias("rank"), F.col("r.chunk_id").alias("chunk_id"), F.col("r.score").cast("double").alias("score"))


def nested_rankings(rankings: DataFrame, top_k: int) -> DataFrame:
    """The other way: one row for each query and retriever."""
    result = F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "score")))
    return rankings.where(F.col("rank") <= top_k).groupBy("query_id", "retriever").agg(result.alias("r")).select("query_id", "retriever", F.lit(top_k).alias("top_k"), F.transform("r", lambda x: F.struct(x["chunk_id"].alias("chunk_id"), x["rank"].alias("rank"), x["score"].alias("score"))).alias("results"))


def checked_vectors(vectors: DataFrame, dims: int) -> DataFrame:
    """vectors (id, embedding), failing on another length."""
    return vectors.where(F.assert_true(F.size("embedding") == dims, F.lit(f"a vector hasn't {dims} dimensions")).isNull())


def sqlite_rows(spark: SparkSession, path: str, table: str, columns: dict[str, str], partitions: int = 8, gapless: bool = False) -> DataFrame:
    """The named columns (name: "rowid", "string" or "vector") of a sqlite table, read by ranges of rowid; the file must lie where all workers see it. gapless: row numbers that don't go from 1 to the number of rows are an error."""
    import sqlite3

    from poolsmith.functions.vectors import decode_blob

    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        low, high, n = db.execute(f"SELECT min(rowid), max(rowid), count(*) FROM {table}").fetchone()
    if gapless and n and (low, high) != (1, n):
        raise ValueError(f"row numbers of {table} have gaps: {n} rows from {low} to {high}")
    step = max(1, -(-((high or 0) - (low or 0) + 1) // partitions))
    read_as = {"rowid": ("long", int), "string": ("string", lambda x: None if x is None else str(x)), "vector": ("array<float>", decode_blob)}

    def read(batches):
        import pandas as pd

        for frame in batches:
            for start in frame["id"]:
                with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
                    rows = db.execute(f"SELECT {', '.join(columns)} FROM {table} WHERE rowid >= ? AND rowid < ? ORDER BY rowid", (int(start), int(start) + step)).fetchall()
                yield pd.DataFrame({c: [read_as[kind][1](r[i]) for r in rows] for i, (c, kind) in enumerate(columns.items())})

    return spark.range(low or 0, (high or -1) + 1, step, partitions).mapInPandas(read, ", ".join(f"{c} {read_as[kind][0]}" for c, kind in columns.items()))


def sqlite_vectors(spark: SparkSession, path: str, table: str, column: str, id_column: str = "rowid", partitions: int = 8, gapless: bool = False) -> DataFrame:
    """id, embedding of a sqlite table of blobs."""
    found = sqlite_rows(spark, path, table, {id_column: "string", column: "vector"}, partitions, gapless)
    return found.select(F.col(id_column).alias("id"), F.col(column).alias("embedding"))


def sqlite_texts(spark: SparkSession, path: str, table: str, text: str, vector: str, partitions: int = 8) -> tuple[DataFrame, int]:
    """(chunk_id, embedding; how many ids are there twice) of a table that holds texts with vectors but no ids.

    The first line of a text is its title; the id is told by a hash of what follows. Vectors come out of unit length.
    """
    from poolsmith.functions.vectors import normalised

    found = sqlite_rows(spark, path, table, {text: "string", vector: "vector"}, partitions)
    body = F.expr(f"substr({text}, instr({text} || '\n', '\n') + 1)")
    found = found.select(X.content_id(body).alias("chunk_id"), normalised(F.col(vector)).alias("embedding"))
    n = found.agg((F.count("*") - F.countDistinct("chunk_id")).alias("n")).first()["n"]
    return found, n


def cached_vectors(rows: DataFrame, path: str, encode, text: str = "text", model: str = "") -> DataFrame:
    """rows with ``embedding``, from the table at ``path`` where it has the text under this model, else encoded and appended to it.

    Vectors are kept by a hash of model and text, so that a changed text is never given an old vector; a run that stops begins again where the table ends.
    """
    from poolsmith.operators.retrieval import encoded
    from poolsmith.sources.sinks import append_new, table_at

    keyed = rows.withColumn("_key", F.sha2(F.concat_ws("\n", F.lit(model), F.col(text)), 256))
    known = table_at(rows.sparkSession, path)
    new = keyed.select("_key", F.col(text).alias("text")).dropDuplicates(["_key"])
    if known is not None:
        new = new.join(known.select("_key"), "_key", "left_anti")
    append_new(encoded(new, encode).select("_key", "embedding"), path, ["_key"])
    return keyed.join(table_at(rows.sparkSession, path), "_key").drop("_key")


def settings(path: str) -> dict:
    """A YAML file that holds a mapping."""
    import yaml

    found = yaml.safe_load(Path(path).expanduser().read_text())
    if not isinstance(found, dict):
        raise ValueError("settings must be a mapping")
    return found


def expand_path(path: str, base: str = ".") -> str:
    """A path as settings have it: ~ and variables expanded, relative to ``base``."""
    import os

    found = Path(os.path.expandvars(path)).expanduser()
    return str(found if found.is_absolute() else Path(base) / found)


def corpus_path(found: dict, base: str = ".") -> str:
    """Where the settings say that the chunks are."""
    try:
        return expand_path(found["corpus"]["chunks_path"], base)
    except KeyError as e:
        raise ValueError("settings name no corpus.chunks_path") from e


def source_tiers(spark: SparkSession, tiers: dict) -> DataFrame:
    """source, tier, queries_per_source, ord: the configured sources in the order of their tiers."""
    rows = [(s, tier, int(x["queries_per_source"])) for tier, x in tiers.items() for s in x["sources"]]
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "source string, tier string, queries_per_source int, ord int")
