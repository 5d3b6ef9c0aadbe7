"""What the operators share: reading, null texts, new names, and checkpoints and tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from poolsmith.sources.shared import checkpoint, shared_table

__all__ = ["checkpoint", "fresh", "hot_keys", "shared_table", "spread_join", "table", "text_or_empty"]

#: Keys with more than one row in so many are hot: there can't be more of them than that.
HOT = 1 << 11


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def fresh(name: str, columns: list[str]) -> str:
    """The name, or one made longer, that no column has (whatever its case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def hot_keys(rows: DataFrame, keys: list[str], least: int = 1000) -> DataFrame | None:
    """The keys with more than ``least`` rows and more than one in HOT of all rows; None where there are none."""
    counts = checkpoint(rows.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > least))
    if counts.isEmpty():
        return None
    hot = counts.where(F.col("n") > rows.count() // HOT).drop("n")
    return None if hot.isEmpty() else hot


def spread_join(rows: DataFrame, entries: DataFrame, keys: list[str], how: str = "inner", hot: DataFrame | None = None) -> DataFrame:
    """rows joined with entries, which have one row for each key. Rows of hot keys stay where they are, and the keys' entries, at most HOT, are sent to them."""
    if hot is None:
        return rows.join(entries, keys, how)
    few = F.broadcast(hot)
    return rows.join(few, keys, "left_anti").join(entries, keys, how).unionByName(rows.join(few, keys, "left_semi").join(F.broadcast(entries.join(few, keys, "left_semi")), keys, how))
