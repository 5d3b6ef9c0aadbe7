"""Writing: JSON lines, typed Parquet releases, reports and manifests."""

from __future__ import annotations

import hashlib
import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from poolsmith.sources.shared import shared_table

SCHEMAS = {
    "rankings": "query_id string, retriever string, rank int, chunk_id string, score double",
    "judgments": "query_id string, chunk_id string, d1_topic boolean, d2_meaningful tinyint, d3_actionable tinyint, d4_density tinyint, score tinyint",
    "chunks": "chunk_id string, source string, page int, breadcrumb string, text string",
    "queries": "query_id string, query_text string, seed_chunk_id string, source string, tier string, query_type string, adversarial_type string",
}


def enforce_schema(df: DataFrame, schema: str | T.StructType) -> DataFrame:
    """df with exactly these columns, cast and in order; other names are an error."""
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    if set(df.columns) != set(schema.names):
        raise ValueError(f"columns differ: {sorted(set(df.columns) ^ set(schema.names))}")
    return df.select(*(F.col(f.name).cast(f.dataType) for f in schema))


def prompt_hash(system: str, rendered: str) -> str:
    """A version that changes with the system text and with how a message is rendered, told by a rendered example."""
    return hashlib.sha256(f"{system}\0{rendered}".encode()).hexdigest()[:16]


def fingerprint(fields: list[str]) -> str:
    """A version that changes with the set of fields."""
    return "v-" + hashlib.sha256("\0".join(sorted(fields)).encode()).hexdigest()[:8]


def write_json_lines(df: DataFrame, path: str) -> None:
    df.select(*sorted(df.columns)).write.mode("overwrite").json(path)


def write_release(df: DataFrame, path: str, relation: str) -> None:
    """One relation, typed; writing again replaces it and nothing else."""
    enforce_schema(df, SCHEMAS[relation]).write.mode("overwrite").option("compression", "snappy").parquet(path)


def table_at(spark, path: str) -> DataFrame | None:
    """The Parquet table at a path; None where there is none yet, or no file in it."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(place) or not any(f.getPath().getName().endswith(".parquet") for f in files.listStatus(place)):
        return None
    return spark.read.parquet(path)


def append_new(df: DataFrame, path: str, keys: list[str]) -> int:
    """Append what the table at ``path`` has no key of yet, each key once; gives the number of rows. Running it again appends nothing."""
    batch, there = df.dropDuplicates(keys), table_at(df.sparkSession, path)
    if there is not None:
        batch = batch.join(there.select(*keys), keys, "left_anti")
    batch = shared_table(batch, "batch")
    n = batch.count()
    if n:
        batch.write.mode("append").parquet(path)
    return n


def append_column(df: DataFrame, extra: DataFrame, keys: list[str], path: str, order: str) -> None:
    """df with a further column of ``extra`` (keys, order, the column), written beside it; of several rows for a key the last counts, and a row without one fails."""
    from poolsmith.operators.joins import must_match

    must_match(df, extra, keys, order).write.mode("overwrite").option("compression", "snappy").parquet(path)


def split_errors(df: DataFrame, good, path: str, errors: str, keys: list[str], order: str) -> None:
    """Rows deduplicated by keys, the first by ``order`` staying; those that aren't good go to the other path, deduplicated likewise where no good row has their keys."""
    from poolsmith.sources.corpus import one_a_key

    fine = one_a_key(df.where(good), keys, order)
    fine.write.mode("overwrite").json(path)
    one_a_key(df.where(~F.coalesce(good, F.lit(False))), keys, order).join(fine.select(*keys), keys, "left_anti").write.mode("overwrite").json(errors)


def preview(df: DataFrame) -> dict:
    """Row count, schema and first row of a relation."""
    first = df.limit(1).collect()
    return {"rows": df.count(), "columns": dict(df.dtypes), "first": first[0].asDict(recursive=True) if first else None}


def manifest(relations: dict[str, DataFrame], **provenance) -> dict:
    return {"relations": {name: {"rows": df.count(), "columns": dict(df.dtypes)} for name, df in relations.items()}, **provenance}


def metric_json(metrics: DataFrame) -> str:
    """A long metrics frame as nested JSON: retriever, then metric with its parameters."""
    out: dict = {}
    for r in metrics.collect():
        d = r.asDict()
        keys = [f"{k}={d[k]}" for k in ("threshold", "k") if d.get(k) is not None]
        out.setdefault(d["retriever"], {})["@".join([d["metric"], *keys])] = d["value"]
    return json.dumps(out, indent=2, sort_keys=True)


def markdown(rows: DataFrame, digits: int = 3) -> str:
    """A small result as a Markdown table."""
    cell = lambda x: "" if x is None else f"{x:.{digits}f}" if isinstance(x, float) else str(x)
    body = ["| " + " | ".join(map(cell, r)) + " |" for r in rows.collect()]
    return "\n".join(["| " + " | ".join(rows.columns) + " |", "|" + " --- |" * len(rows.columns), *body])


def report(title: str, sections: dict[str, DataFrame | str], digits: int = 3) -> str:
    """A report in Markdown: a heading for each section, with a text or a small result as a table."""
    parts = [f"# {title}"]
    for name, content in sections.items():
        parts += [f"## {name}", content if isinstance(content, str) else markdown(content, digits)]
    return "\n\n".join(parts) + "\n"


def console(title: str, rows: DataFrame, digits: int = 3) -> str:
    """A small result in columns, for a terminal."""
    cells = [rows.columns, *(["" if x is None else f"{x:.{digits}f}" if isinstance(x, float) else str(x) for x in r] for r in rows.collect())]
    widths = [max(map(len, column)) for column in zip(*cells, strict=True)]
    return "\n".join([f"=== {title} ===", *("  ".join(c.ljust(w) for c, w in zip(r, widths, strict=True)).rstrip() for r in cells)])


def checksum(path: str, expected: str | None = None) -> str:
    """A file's SHA-256; another than expected is an error."""
    found = hashlib.sha256(Path(path).read_bytes()).hexdigest()
    if expected and found != expected:
        raise ValueError(f"{path}: checksum {found}, expected {expected}")
    return found


def prompt_text(system: str, template: str, fields: dict[str, str]) -> str:
    """A prompt as released: the system text and the template with its placeholders named."""
    for name in fields:
        template = template.replace("{" + name + "}", f"<{name.upper()}>")
    return f"{system.strip()}\n\n{template.strip()}\n"
