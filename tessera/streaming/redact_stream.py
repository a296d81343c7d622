"""Redact text as it arrives.

The redactor is stateless (one row in, one row out), so it runs in append
mode with no watermark and no state store; the checkpoint folder gives
exactly-once file output and restart after executor or driver loss.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tessera.functions.rules import DEFAULT_RULES, Rule, with_rules


def read_text_stream(spark: SparkSession, path: str, schema: StructType | str,
                     max_files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files arriving under ``path`` (a folder or a glob), explicit schema."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return reader.parquet(path)


def redact_stream(df: DataFrame, col: str = "text", rules: Sequence[Rule] = DEFAULT_RULES,
                  keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The batch redaction expressions on a streaming frame; every row comes back, blank and NULL ones as they are."""
    return with_rules(df, col, col, rules).select(*keep, col)


def write_redacted_stream(df: DataFrame, path: str, checkpoint: str, available_now: bool = True,
                          query_name: str | None = None) -> StreamingQuery:
    """Append redacted rows to parquet with a checkpoint (restartable, exactly-once files)."""
    w = (df.writeStream.format("parquet").outputMode("append")
         .option("path", path).option("checkpointLocation", checkpoint))
    if query_name:
        w = w.queryName(query_name)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def run_redaction_stream(spark: SparkSession, source_glob: str, schema: StructType | str,
                         sink: str, checkpoint: str, col: str = "text",
                         keep: Sequence[str] = ("doc_id",), timeout_s: float | None = None) -> DataFrame:
    """Drive S5 -> R3 -> S6 over what is available now and return the sink as a batch frame.

    It waits until the backlog is drained; ``timeout_s`` is an optional limit.
    """
    q = write_redacted_stream(redact_stream(read_text_stream(spark, source_glob, schema), col, keep=keep),
                              sink, checkpoint)
    if timeout_s is None:
        q.awaitTermination()
    elif not q.awaitTermination(timeout_s):
        q.stop()
        raise TimeoutError("redaction stream did not drain in time")
    if q.exception():
        raise RuntimeError(str(q.exception()))
    return spark.read.schema(_sink_schema(keep, col, schema)).parquet(sink)


def _sink_schema(keep: Sequence[str], col: str, schema: StructType | str) -> StructType:
    st = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    fields = [st[c] for c in keep] + [st[col]]
    return StructType(fields)
