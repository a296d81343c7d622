"""Global order without a single-partition window.

``Window.orderBy`` with no ``partitionBy`` pulls every row into one task. The
helpers here number rows in two levels:

1. the rows are range-sorted (Spark samples the keys, so outlier or clumped ids
   still give even parts) and written once to the shared folder, each with the
   place it was written at: its part and its position in that part;
2. totals per part come from a narrow aggregate, and their prefix sum gives each
   part (and group) its start: one row per part and group, joined back;
3. a running sum inside each part finishes the job.

The table on disk is the lineage cut: a lost executor re-reads it, and the parts
stay as they were written. A hot group spans as many parts as its rows need.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import materialize

#: Parts above which the table of their totals is joined without a broadcast hint.
MAX_BROADCAST_PARTS = 200_000


def prefix_sum(df: DataFrame, order: Sequence[str], weight: Column | None = None, by: Sequence[str] = (),
               before: str = "before", total: str | None = None, unique: bool = False, drop: Sequence[str] = ()) -> DataFrame:
    """Add ``before`` = sum of ``weight`` over rows earlier in ``order`` (within ``by``).

    ``order`` must break its own ties. With ``weight=None`` every row weighs 1, so
    ``before + 1`` is the rank. ``total`` (optional) receives the group total.
    ``unique`` makes a repeated key (``by`` and ``order``) an error. Columns in ``drop`` are sorted by but neither written nor returned.
    """
    by, order = list(by), list(order)
    if set(drop) & {*by, *(order if unique else ())}:
        raise ValueError("a dropped column is needed after the sort")
    w = (weight if weight is not None else F.lit(1)).cast("long")
    rows = df.withColumn("_wt", w).orderBy(*by, *order).drop(*drop).withColumn("_at", F.monotonically_increasing_id())
    rows = materialize(rows, "ordered").withColumn("_part", F.shiftright("_at", 33))
    totals = rows.groupBy(*by, "_part").agg(F.sum("_wt").alias("_pt"))
    # one row per part (and group in it): parts are files of the sorted table
    tw = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy("_part")
    starts = totals.withColumn(
        "_po", F.coalesce(F.sum("_pt").over(tw.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    keep = [F.col(c).alias(f"_g{i}") for i, c in enumerate(by)] + [F.col("_part").alias("_sp"), F.col("_po")]
    if total:
        whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
        keep.append(F.sum("_pt").over(whole).alias(total))
    starts = starts.select(*keep)
    if not by:
        # as many rows as parts; with groups the table grows with them, and Spark picks the join
        parts = rows.select("_part").distinct().limit(MAX_BROADCAST_PARTS + 1).count()
        starts = F.broadcast(starts) if parts <= MAX_BROADCAST_PARTS else starts
    same = F.col("_part") == F.col("_sp")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    joined = rows.join(starts, same).drop("_sp", *[f"_g{i}" for i in range(len(by))])
    here = Window.partitionBy(*by, "_part").orderBy("_at")
    value = F.col("_po") + F.coalesce(F.sum("_wt").over(here.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    if unique:
        again = F.lit(True)
        for c in order:
            again = again & F.col(c).eqNullSafe(F.lag(c).over(here)) & (F.row_number().over(here) > 1)
        value = F.when(again, F.raise_error(F.concat(
            F.lit("repeated key: "), F.concat_ws(", ", *[F.col(c).cast("string") for c in order]))).cast("long")).otherwise(value)
    return joined.withColumn(before, value).drop("_part", "_po", "_wt", "_at")


def global_rank(df: DataFrame, order: Sequence[str], by: Sequence[str] = (), name: str = "rank",
                total: str | None = None, drop: Sequence[str] = ()) -> DataFrame:
    """1-based position in ``order`` (ties must be broken by ``order`` itself)."""
    out = prefix_sum(df, order, None, by, before="_before", total=total, drop=drop)
    return out.withColumn(name, F.col("_before") + 1).drop("_before")
