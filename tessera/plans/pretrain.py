"""Pre-training data: read -> drop blank -> (cap) -> bytes -> pack -> shuffle -> batches -> updates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.batching import batches, epochs_needed, limit_steps, shuffle, update_groups
from tessera.operators.corpus import cap, drop_blank
from tessera.operators.packing import corpus_summary, pack, stream_bigrams
from tessera.functions.bytes import encode_ids, encoded_length, head_text, tail_text
from tessera.functions.text import EOS_TEXT
from tessera.operators.tokens import encode_bytes
from tessera.session import shared_dir
from tessera.sources.tables import load_corpus, write_windows
from tessera.sources.versions import save_version

#: Bytes of the windows that one bucket should hold.
BUCKET_BYTES = 64 << 20


@dataclass(frozen=True)
class PackConfig:
    L: int = 512
    batch_size: int = 8
    accum: int = 8
    steps: int = 10_000
    seed: int = 42
    max_samples: int | None = None


def corpus_ids(spark: SparkSession, base: str, max_samples: int | None = None,
               split: str | None = None) -> DataFrame:
    """``(doc_id, ids, n_ids)``: non-blank documents as byte ids, with their count
    computed from the text (so sizing passes skip the array)."""
    docs = drop_blank(load_corpus(spark, base, split=split))
    docs = cap(docs, max_samples)
    return encode_bytes(docs).select("doc_id", "ids", encoded_length("text").alias("n_ids"))


def corpus_text(spark: SparkSession, base: str, max_samples: int | None = None,
                split: str | None = None) -> DataFrame:
    """``(doc_id, text, n_ids)``: non-blank documents with their byte-token count."""
    docs = cap(drop_blank(load_corpus(spark, base, split=split)), max_samples)
    return docs.select("doc_id", "text", encoded_length("text").alias("n_ids"))


def windows(spark: SparkSession, base: str, L: int, max_samples: int | None = None, whole: bool = False) -> DataFrame:
    """Packed byte windows (``whole``: as L+1 ids). Documents cross the offsets shuffle as text and are
    encoded after it (4x less shuffle than int arrays)."""
    return pack(corpus_text(spark, base, max_samples), L, ids=encode_ids("text"), n_ids="n_ids",
                head_ids=encode_ids(head_text("text", L + 1)), tail_ids=encode_ids(tail_text("text", L + 1)), whole=whole)


def window_bigrams(spark: SparkSession, base: str, L: int, max_samples: int | None = None) -> DataFrame:
    """Next-token counts of the windows' (input, target) pairs, straight from
    the documents (no packing): ``packing.stream_bigrams``."""
    first = F.try_element_at(encode_ids(F.substring("text", 1, len(EOS_TEXT))), F.lit(1))
    return stream_bigrams(corpus_text(spark, base, max_samples), L, ids=encode_ids("text"), n_ids="n_ids", first_id=first)


def schedule(win: DataFrame, cfg: PackConfig, epochs: int) -> DataFrame:
    """B2-B5 on packed windows: epoch, rank, batch_idx, slot, update_id (within the budget)."""
    s = shuffle(win, cfg.seed, epochs, id_col="window_id")
    return limit_steps(update_groups(batches(s, cfg.batch_size, drop_last=True), cfg.accum), cfg.steps)


def prepare(spark: SparkSession, base: str, out: str | None = None, cfg: PackConfig = PackConfig(),
            windows_out: str | None = None) -> str:
    """The whole job, writing parquet; returns the schedule path.

    Windows are written once (a lineage cut in the shared folder), so a lost
    executor never re-runs tokenization and packing. The schedule is an index
    ``(epoch, batch_idx, slot, update_id, window_id)``: only window ids are
    shuffled per epoch, not the token arrays; ``batch_rows`` joins them back
    when physical batch rows are wanted.
    """
    win_path = windows_out or shared_dir(spark, "windows")
    write_windows(windows(spark, base, cfg.L, cfg.max_samples), win_path)
    win = spark.read.parquet(win_path)
    n = win.count()  # parquet footers: no scan of the arrays
    epochs = epochs_needed(n, cfg.batch_size, cfg.accum, cfg.steps)
    out = out or shared_dir(spark, "schedule")
    sched = schedule(win.select("window_id"), cfg, epochs).select(
        F.col("epoch").cast("int").alias("epoch"), "batch_idx", "slot", "update_id", "window_id")
    write_windows(sched, out, partition_by=["epoch"])
    return out


def enough_buckets(n_windows: int, L: int, least: int, bucket_bytes: int = BUCKET_BYTES) -> int:
    """``least``, or as many buckets as keep the two id arrays of their windows under ``bucket_bytes``."""
    return max(least, -(-int(n_windows or 0) * 2 * L * 4 // bucket_bytes))


def prepare_tables(spark: SparkSession, base: str, path: str, version: str, cfg: PackConfig = PackConfig(),
                   epochs: int | None = None, buckets: int = 64, bucket_bytes: int = BUCKET_BYTES) -> tuple[DataFrame, DataFrame]:
    """``prepare`` into versioned tables ``path/windows`` and ``path/schedule``, both bucketed by ``window_id``.

    Each is replaced whole; a call that was cut short goes on with what is missing. Returns the
    schedule and the windows, which ``batch_rows`` joins as they lie. A bucket is written and read by one task, so there
    are more than ``buckets`` where that many would hold over ``bucket_bytes`` each.
    """
    buckets = enough_buckets(corpus_summary(corpus_text(spark, base, cfg.max_samples), cfg.L, n_ids="n_ids").first()["windows"],
                             cfg.L, buckets, bucket_bytes)
    win = save_version(windows(spark, base, cfg.L, cfg.max_samples), f"{path}/windows", version, "window_id", buckets)
    epochs = epochs or epochs_needed(win.count(), cfg.batch_size, cfg.accum, cfg.steps)
    sched = schedule(win.select("window_id"), cfg, epochs).select(
        F.col("epoch").cast("int").alias("epoch"), "batch_idx", "slot", "update_id", "window_id")
    return save_version(sched, f"{path}/schedule", version, "window_id", buckets), win


def batch_rows(sched: DataFrame, win: DataFrame) -> DataFrame:
    """Physical rows of a schedule: join the window arrays by id (one shuffle join; none for tables of ``prepare_tables``)."""
    return sched.join(win, "window_id")
