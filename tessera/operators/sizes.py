"""Size checks before a side of a join is broadcast or collected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, StringType, StructType

BROADCAST_BYTES = 64 << 20
#: Entries of a dictionary that Python workers hold; each costs far more there than its text.
LOOKUP_BYTES = 16 << 20


def _bytes(c: Column, kind: DataType) -> Column:
    if isinstance(kind, (StringType, BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)).cast("long") + 16
    if isinstance(kind, ArrayType):
        return F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)).cast("long") * 8 + 16
    if isinstance(kind, StructType):
        row = F.lit(16).cast("long")
        for f in kind.fields:
            row = row + _bytes(c[f.name], f.dataType)
        return row
    return F.lit(8).cast("long")


def byte_size(df: DataFrame) -> int:
    """Bytes of all rows, from the lengths of their strings and arrays (one narrow aggregate)."""
    row = F.lit(16).cast("long")
    for f in df.schema.fields:
        row = row + _bytes(F.col(f.name), f.dataType)
    return int(df.agg(F.sum(row).alias("n")).first()["n"] or 0)


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its rows are measured to fit, else as it is."""
    return F.broadcast(df) if byte_size(df) <= limit else df
