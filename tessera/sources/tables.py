"""Corpus and pair loading, schema checks, prepared-data sinks."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table_path(base: str, name: str) -> str:
    return f"{base.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, base: str, name: str, columns: Iterable[str] | None = None) -> DataFrame:
    """Read one parquet table, projecting early so the scan prunes columns."""
    df = spark.read.parquet(table_path(base, name))
    return df.select(*columns) if columns else df


def balance(df: DataFrame, key: str) -> DataFrame:
    """Spread a scan that came out in fewer splits than the cluster has cores.

    A big corpus arrives in many row groups and is left alone (no shuffle).
    A small file written as one row group would be a single task; hash it by
    ``key`` (deterministic on retry) across the default parallelism instead.
    Planning-only check: no job runs.
    """
    try:
        want = df.sparkSession.sparkContext.defaultParallelism
        have = df.rdd.getNumPartitions()
    except Exception:  # noqa: BLE001 - sessions without RDD access: leave the scan as is
        return df
    return df.repartition(want, key) if have < want else df


def id_bounds(spark: SparkSession, base: str, table: str = "documents", id_col: str = "doc_id") -> tuple[int, int]:
    """(min, max) of an id column read on its own (the scan prunes every other
    column): a cheap, filter-independent range for order buckets."""
    row = spark.read.parquet(table_path(base, table)).agg(F.min(id_col).alias("lo"), F.max(id_col).alias("hi")).first()
    return (int(row["lo"] or 0), int(row["hi"] or 0))


def require_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """S3: fail fast (at plan time, no job) when expected columns are missing."""
    have = {f.name.lower() for f in df.schema.fields}
    missing = [n for n in names if n.lower() not in have]
    if missing:
        raise ValueError(f"missing columns {missing}; found {df.columns}")
    return df


def split_bucket(id_col) -> F.Column:
    """Stable 0..255 bucket of an id (first md5 byte) for train/holdout splits."""
    return F.conv(F.substring(F.md5(F.col(id_col).cast("string")), 1, 2), 16, 10).cast("int")


def load_corpus(spark: SparkSession, base: str, table: str = "documents", id_col: str = "doc_id",
                text_col: str = "text", split: str | None = None, holdout: int = 26) -> DataFrame:
    """``(doc_id, text)`` rows; ``split`` in {None,'train','holdout'}.

    The split is a hash of the id (md5 first byte < 256-holdout -> train), so
    it is deterministic, needs no shuffle and survives re-reads.
    """
    df = require_columns(spark.read.parquet(table_path(base, table)), [id_col, text_col])
    df = balance(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "doc_id")
    if split is None:
        return df
    cut = 256 - holdout
    if split == "train":
        return df.filter(split_bucket("doc_id") < cut)
    if split == "holdout":
        return df.filter(split_bucket("doc_id") >= cut)
    raise ValueError(f"unknown split {split!r}")


def load_pairs(df: DataFrame, src: str = "source_text", tgt: str = "target_text",
               id_col: str | None = None) -> DataFrame:
    """S2 + P2: (raw, redacted) pairs renamed to ``original_text``/``redacted_text``."""
    require_columns(df, [src, tgt] + ([id_col] if id_col else []))
    cols = [F.col(src).alias("original_text"), F.col(tgt).alias("redacted_text")]
    if id_col:
        cols.insert(0, F.col(id_col).alias("pair_id"))
    return df.select(*cols)


def rename_pairs(df: DataFrame, src: str = "source_text", tgt: str = "target_text") -> DataFrame:
    """Rename in place, keeping any other columns."""
    require_columns(df, [src, tgt])
    return df.withColumnsRenamed({src: "original_text", tgt: "redacted_text"})


def write_windows(df: DataFrame, path: str, partition_by: list[str] | None = None) -> str:
    """Persist prepared rows as parquet, replacing the whole folder each save."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path
