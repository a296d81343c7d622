"""The corpus pipeline: five stages over ``documents``.

Toxic documents go, one document of each group of near copies stays, passages that
repeat an earlier one are cut, documents contaminated by the benchmark go, and the
rest is packed into sequences. Each stage's rows are written as Parquet and read
again as the next one's documents; all but the last have the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontaminate, neardup, packing, substrings
from tessera.llm import toxicity as toxic
from tessera.llm.common import table
from tessera.session import materialize, ready


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the severity model rejects."""
    ready(spark)
    return toxic.drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each near-duplicate class."""
    ready(spark)
    return neardup.drop_near_copies(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 20 words or more that start earlier in what is left."""
    ready(spark)
    return substrings.remove_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops contaminated documents."""
    ready(spark)
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Power-of-two pieces of the documents that are left."""
    ready(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", toxicity),
    ("near_copies", near_copies),
    ("repeated_passages", repeated_passages),
    ("decontamination", decontamination),
    ("packing", sequences),
]

#: Ordinal regression and ProbMinHash are no SQL; tests/llm compares run() with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the ``documents`` of ``sf_dir``."""
    ready(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
