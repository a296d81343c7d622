"""Corpus filters, input status, log sampling, first-N cap."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import nonblank
from tessera.operators.ordering import global_rank


def drop_blank(df: DataFrame, col: str = "text") -> DataFrame:
    """Keep rows whose text is not blank under Python's ``str.strip``.

    The text itself is kept verbatim (not stripped). NULL is dropped. The
    predicate is an ``rlike`` inside the scan's whole-stage-codegen span.
    """
    return df.filter(nonblank(col))


def scrub_status(df: DataFrame, col: str = "text", out: str = "status") -> DataFrame:
    """P5: ``'blank'`` / ``'ok'`` status; rows are never dropped."""
    return df.withColumn(out, F.when(nonblank(col), F.lit("ok")).otherwise(F.lit("blank")))


def cap(df: DataFrame, n: int | None, order: Sequence[str | Column] = ("doc_id",)) -> DataFrame:
    """B1: first ``n`` rows in ``order`` after filtering; 0/None mean no limit.

    ``orderBy(...).limit(n)`` plans as TakeOrderedAndProject: each task keeps
    its own top n, so only n rows per task reach the final merge.
    """
    if not n:
        return df
    return df.orderBy(*order).limit(int(n))


def sample_every(df: DataFrame, n: int, order: str, by: Sequence[str] = (), include_first: bool = True,
                 one_based: bool = True, step: str = "step") -> DataFrame:
    """Keep every n-th row of a log (by ``step`` = position in ``order`` within ``by``).

    ``one_based=True`` follows the pre-training log (``step % n == 0 or step == 1``);
    ``one_based=False`` the fine-tuning log (0-based ``step % n == 0``). The
    position comes from a two-level rank, so a hot ``by`` value is spread over
    many sorted parts instead of one window task.
    """
    if n < 1:
        raise ValueError("n must be positive")
    ranked = global_rank(df, [order], by=by, name=step)
    if not one_based:
        ranked = ranked.withColumn(step, F.col(step) - 1)
    keep = (F.col(step) % n == 0)
    if include_first:
        keep = keep | (F.col(step) == (1 if one_based else 0))
    return ranked.filter(keep)
