"""E6, E7 with longer contexts: interpolated Kneser-Ney next-token models.

The highest order counts each token after its ``order - 1`` predecessors; a lower order counts how many
different tokens stand before each (context, token) of the order above it. Every order gives

    P(w | h) = max(c(h, w) - D, 0) / c(h) + D * t(h) / c(h) * P(w | h without its first token)

with ``c(h)`` the context's sum, ``t(h)`` its different tokens and ``D = n1 / (n1 + 2 n2)`` from the order's
counts of ones and twos; below the lowest order all tokens are alike, and an unseen context
passes its weight down whole.

A context is one long: its tokens as digits (0 stands for the beginning of a text), so dropping the first token is a
remainder, and equal longs are equal contexts. Counting is partially aggregated: a context that a third of all tokens
share has at most as many rows as the vocabulary. Scoring first reduces texts to their distinct (context,
token) pairs, gives each pair its probability once, and joins it back to the counts per text.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.sizes import broadcast_if_small
from tessera.session import materialize


@dataclass(frozen=True)
class Level:
    """One order: ``h, w, c`` rows, ``h, total, types`` rows and the discount."""

    counts: DataFrame
    contexts: DataFrame
    discount: float


def context_pairs(ids: Column, order: int, V: int) -> Column:
    """Array of ``(h, w)``: each token with its ``order - 1`` predecessors as one long."""
    if order < 1 or (V + 1) ** (order - 1) >= 1 << 63:
        raise ValueError(f"contexts of {order - 1} tokens out of {V} do not fit a long")

    def context(i: Column) -> Column:
        h = F.lit(0).cast("long")
        for back in range(order - 1, 0, -1):
            h = h * (V + 1) + F.when(i >= back, F.get(ids, i - back).cast("long") + 1).otherwise(0)
        return h
    return F.transform(ids, lambda w, i: F.struct(context(i).alias("h"), w.cast("int").alias("w")))


def _level(counts: DataFrame) -> Level:
    counts = materialize(counts, "ngrams")
    ones = counts.agg(F.sum(F.when(F.col("c") == 1, 1).otherwise(0)).alias("n1"), F.sum(F.when(F.col("c") == 2, 1).otherwise(0)).alias("n2")).first()
    n1, n2 = ones["n1"] or 0, ones["n2"] or 0
    contexts = counts.groupBy("h").agg(F.sum("c").alias("total"), F.count(F.lit(1)).alias("types"))
    return Level(counts, contexts, n1 / (n1 + 2 * n2) if n1 else 0.5)


def learn(df: DataFrame, order: int, V: int, ids: str = "ids") -> list[Level]:
    """The levels of the model, lowest order first, from the id arrays of ``df``."""
    # the array is its own column: a lambda that referenced its expression would build it anew for each element
    rows = df.select(F.col(ids).alias("_ids")).select(F.inline(context_pairs(F.col("_ids"), order, V)))
    levels = [_level(rows.groupBy("h", "w").agg(F.count(F.lit(1)).alias("c")))]
    for n in range(order - 1, 0, -1):
        shorter = levels[0].counts.groupBy(F.expr(f"h % {(V + 1) ** (n - 1)}L").alias("h"), "w").agg(F.count(F.lit(1)).alias("c"))
        levels.insert(0, _level(shorter))
    return levels


def probabilities(pairs: DataFrame, levels: Sequence[Level], V: int) -> DataFrame:
    """``pairs (h, w)`` with ``p``."""
    out = pairs.withColumn("p", F.lit(1.0 / V))
    for n, level in enumerate(levels):
        low = F.expr(f"h % {(V + 1) ** n}L")
        seen = level.counts.select(F.col("h").alias("_h"), F.col("w").alias("_w"), F.col("c").alias("_c"))
        whole = level.contexts.select(F.col("h").alias("_g"), "total", "types")
        out = out.withColumn("_low", low)
        out = out.join(broadcast_if_small(seen), (F.col("_low") == F.col("_h")) & (F.col("w") == F.col("_w")), "left")
        out = out.join(broadcast_if_small(whole), F.col("_low") == F.col("_g"), "left")
        own = F.greatest(F.coalesce("_c", F.lit(0)) - level.discount, F.lit(0.0)) / F.col("total")
        p = F.when(F.col("total").isNull(), F.col("p")).otherwise(own + level.discount * F.col("types") / F.col("total") * F.col("p"))
        out = out.withColumn("p", p).drop("_low", "_h", "_w", "_c", "_g", "total", "types")
    return out


def cross_entropy(df: DataFrame, levels: Sequence[Level], key: Sequence[str], V: int, ids: str = "ids") -> DataFrame:
    """Per ``key``: ``tokens`` and their mean negative log-probability ``nll`` (NULL without tokens)."""
    pairs = df.select(*key, F.col(ids).alias("_ids")).select(*key, F.inline_outer(context_pairs(F.col("_ids"), len(levels), V)))
    held = materialize(pairs.groupBy(*key, "h", "w").agg(F.count("w").alias("n")), "scored-pairs")
    table = probabilities(held.filter("n > 0").select("h", "w").distinct(), levels, V)
    table = materialize(table.select(F.col("h").alias("_h"), F.col("w").alias("_w"), F.log("p").alias("_lp")), "pair-scores")
    scored = held.join(broadcast_if_small(table), (F.col("h") == F.col("_h")) & (F.col("w") == F.col("_w")), "left")
    n = F.sum("n")
    return scored.groupBy(*key).agg(n.cast("long").alias("tokens"), (-F.sum(F.col("n") * F.col("_lp")) / F.nullif(n, F.lit(0))).alias("nll"))
