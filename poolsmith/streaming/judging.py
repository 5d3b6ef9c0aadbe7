"""Incremental judging: pairs arrive as files, each batch judges what has no label yet and appends it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from poolsmith.sources.sinks import append_new, table_at

PAIRS = "query_id string, chunk_id string, query_text string, text string"


def arriving(spark: SparkSession, path: str, schema: str | T.StructType = PAIRS, files_a_batch: int = 10) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def judge_stream(pairs: DataFrame, judge: Callable[[DataFrame], DataFrame], labels: str, checkpoint: str, keys: tuple[str, ...] = ("query_id", "chunk_id")) -> StreamingQuery:
    """Run over what has arrived and stop. A batch that is run again finds its labels there: nothing is judged or written twice."""

    def batch(df: DataFrame, _: int) -> None:
        fresh, there = df.dropDuplicates([*keys]), table_at(df.sparkSession, labels)
        if there is not None:
            fresh = fresh.join(there.select(*keys), [*keys], "left_anti")
        append_new(judge(fresh), labels, [*keys])

    return pairs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def arrivals(events: DataFrame, time: str = "ts", late: str = "10 minutes", every: str = "1 hour") -> DataFrame:
    """Counts of arriving labels by window and kind; on a stream, rows later than ``late`` are dropped."""
    return events.withWatermark(time, late).groupBy(F.window(time, every).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
