"""Column expressions and small helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import materialize

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: Separators of the plain word rule, applied after A-Z are lower-cased.
PLAIN_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{base.rstrip('/')}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only; other letters keep their case."""
    return F.translate(c, UPPER, LOWER)


def plain_words(text: Column) -> Column:
    """Words of a text: runs of digits, letters a-z and characters beyond ASCII. Null text: none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), PLAIN_SEPARATORS), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row.

    A column used inside a lambda is computed anew for each element once
    Catalyst inlines it; binding it as a lambda variable prevents that.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def tie_breaker(docs: DataFrame) -> tuple[Column, bool]:
    """Second part of a document key, and whether some ``doc_id`` occurs twice.

    0 while ``doc_id`` is unique, else a hash of the text. The check is one narrow
    aggregation over ``doc_id``; the constant keeps the key of every shuffled row
    short in the usual case.
    """
    if docs.groupBy("doc_id").count().filter("count > 1").limit(1).count():
        return F.xxhash64(F.coalesce(F.col("text"), F.lit(""))), True
    return F.lit(0).cast("long"), False


def keyed(docs: DataFrame) -> DataFrame:
    """``(doc_id, tie, text)`` with one row per document; rows equal in all three are one document."""
    tie, repeated = tie_breaker(docs)
    out = docs.select("doc_id", tie.alias("tie"), "text")
    return out.dropDuplicates(["doc_id", "tie"]) if repeated else out


def sample_texts(docs: DataFrame, ids: DataFrame, keys: list[str]) -> DataFrame:
    """The texts of a bounded table of ``ids (keys..., more columns)``: one row per id, however often a document repeats.

    Of several texts of an id the smallest is taken. Written once, since fitting reads it several times.
    """
    named = ids.withColumnsRenamed({k: f"_{k}" for k in keys})
    same = docs[keys[0]] == named[f"_{keys[0]}"]
    for k in keys[1:]:
        same = same & (docs[k] == named[f"_{k}"])
    more = [c for c in ids.columns if c not in keys]
    rows = docs.select(*keys, "text").join(F.broadcast(named), same).groupBy(*keys, *more).agg(F.min("text").alias("text"))
    return materialize(rows, "sample")
