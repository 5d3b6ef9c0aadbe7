"""Tables and checkpoints in the folder that driver and executors share; they outlive any executor."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Paths made since the outermost ``scratch`` began; None outside of one.
_made: list[str] | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where it is unset, a fresh temporary one on a local session (tests); on a cluster that is an error."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or f"file://{tempfile.mkdtemp(prefix='poolsmith-')}")
    return named or sc.getCheckpointDir()


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    if _made is not None:
        _made.append(path)
    return path


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_table(df: DataFrame, label: str) -> DataFrame:
    """Write to a new table in the shared folder and read it back; compressed, columns pruned on reading."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Up to so many bytes a table is dealt to all cores before work on its texts.
SMALL = 1 << 30


def spread(df: DataFrame) -> DataFrame:
    """df, in as many parts as there are cores where it is small: a small file is one row group and so one task's. A large table comes in enough parts, and stays as it is."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size <= SMALL else df


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables made inside are removed at the end: what is read from them must be written elsewhere by then."""
    global _made
    before, _made = _made, []
    try:
        yield
    finally:
        for path in _made:
            remove(spark, path)
        _made = before
