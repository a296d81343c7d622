"""Fine-tuning data: weak (raw, redacted) pairs -> SFT examples -> audit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.corpus import drop_blank
from tessera.operators.redact import weak_pairs
from tessera.operators.sft import sft_examples
from tessera.sources.tables import load_corpus, read_table

SEGMENT_WORDS = 16
SFT_L = 256


def document_pairs(spark: SparkSession, base: str, n_words: int = SEGMENT_WORDS) -> DataFrame:
    return weak_pairs(drop_blank(load_corpus(spark, base)), n_words)


def conversation_pairs(spark: SparkSession, base: str) -> DataFrame:
    """User turn t paired with the assistant turn t+1 of the same conversation."""
    conv = read_table(spark, base, "conversations", ["conv_id", "turn", "role", "text"])
    u = conv.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("original_text"))
    a = conv.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("redacted_text"))
    return u.join(a, ["conv_id", "turn"])


def examples(spark: SparkSession, base: str, L: int = SFT_L, mode: str = "uniform") -> DataFrame:
    return sft_examples(document_pairs(spark, base), L, mode)


def prepare(spark: SparkSession, base: str, L: int = SFT_L, batch_size: int = 8, epochs: int = 2,
            seed: int = 42, mode: str = "uniform", n_words: int = SEGMENT_WORDS,
            out: str | None = None) -> tuple[str, str]:
    """Fine-tuning data job; returns ``(examples_path, schedule_path)``.

    Examples are computed once and written to the shared folder (the source
    re-tokenizes every row each epoch). The schedule is an index over
    ``example_id``: every epoch reshuffled, the short last batch kept, one
    update per batch.
    """
    from tessera.operators.batching import batches, shuffle, update_groups
    from tessera.session import shared_dir
    from tessera.sources.tables import write_windows

    ex = sft_examples(document_pairs(spark, base, n_words), L, mode).withColumn(
        "example_id", F.concat_ws(":", F.col("doc_id").cast("string"), F.col("seg_idx").cast("string")))
    ex_path = shared_dir(spark, "sft-examples")
    write_windows(ex, ex_path)
    ids = spark.read.parquet(ex_path).select("example_id")
    sched = update_groups(batches(shuffle(ids, seed, epochs, id_col="example_id"), batch_size, drop_last=False), 1)
    out = out or shared_dir(spark, "sft-schedule")
    write_windows(sched.select(F.col("epoch").cast("int").alias("epoch"), "batch_idx", "slot", "update_id",
                               "example_id"), out, partition_by=["epoch"])
    return ex_path, out
