"""The corpus pipeline: each stage works on what the one before it kept.

All stages but the last return the columns of documents. A null text is handled by each stage as its
operator says; repeated rows, null ids and further columns pass through all stages but packing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from poolsmith.llm import exact_dedup, packing, pii, simhash, toxicity
from poolsmith.llm.common import fresh, table
from poolsmith.sources.shared import remove, scratch, shared_dir


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the model, trained on labelled rows that are not held out, scores as toxic go."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    score = fresh("toxicity", docs.columns)
    return toxicity.scored(docs, model, out=score).where(F.col(score) < toxicity.CUT).drop(score)


def dedup_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id stays."""
    return exact_dedup.keep_one(docs)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents alike in 0.8 or more of their runs of five words, the one with the smallest doc_id stays."""
    return simhash.keep_one(docs)


def redact_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to its kind in brackets; n_chars follows."""
    return pii.redact(docs, length_col="n_chars")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 tokens, with their ids."""
    return packing.pack(docs, packing.default_tokenizer())


STAGES = [
    ("toxicity", reject_toxic),
    ("exact dedup", dedup_exact),
    ("simhash near-dedup", dedup_near),
    ("pii", redact_private),
    ("packing", pack),
]

#: Toxicity, fingerprints and packing are beyond SQL; tests/llm compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for i, (_, stage) in enumerate(STAGES):
        path = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}-{i}"
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
