"""Score tables — softmax, temperature, top-k, top-p, seeded draws, losses.

A score table is long: ``(group..., item, score)``. Every per-group step is a
window partitioned by the group; a group's size is bounded by the vocabulary
(the candidates for one context), never by the corpus. Cumulative sums are
rounded to 1e-9 before they are compared, so different summation orders (and
engines) make the same keep/drop decision.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.bytes import IGNORE_INDEX
from tessera.operators.ordering import prefix_sum
from tessera.operators.sizes import broadcast_if_small
from tessera.session import materialize

ROUND_CMP = 9
# Threshold search of the nucleus: histogram bins of a round, rows below which a band is ordered, units of probability.
CUT_BINS = 256
CUT_ROWS = 10_000
MASS_UNITS = 1e17
# Broadcast the next-token count table only below this many rows.
COUNTS_BROADCAST_ROWS = 2_000_000


def _g(by: Sequence[str]) -> Window:
    if not by:
        raise ValueError("a score table needs a group column: without one all rows meet in one task")
    return Window.partitionBy(*by)


def with_temperature(df: DataFrame, temperature: float, score: str = "score") -> DataFrame:
    """Divide scores by T (> 0)."""
    if not temperature or temperature <= 0:
        raise ValueError("temperature must be > 0")
    return df.withColumn(score, F.col(score) / F.lit(float(temperature)))


def softmax(df: DataFrame, by: Sequence[str], score: str = "score", out: str = "prob",
            temperature: float = 1.0, method: str = "window") -> DataFrame:
    """E1 (+E2): max-subtracted softmax inside each group.

    ``window`` (default; used after top-k, when groups are small) computes max
    and sum as window aggregates. ``aggregate`` suits untrimmed tables whose
    groups may be huge: group max and sum are ``groupBy`` aggregates with
    map-side partial aggregation, joined back on the group key (AQE splits a
    hot key), so no task holds a whole group.
    """
    if temperature <= 0:
        raise ValueError("temperature must be > 0")
    z = F.col(score) / F.lit(float(temperature)) if temperature != 1.0 else F.col(score)
    if not by:
        raise ValueError("a score table needs a group column")
    if method == "aggregate":
        keys = list(by)
        with_z = df.withColumn("_z", z)
        mx = with_z.groupBy(*keys).agg(F.max("_z").alias("_m"))
        ex = _beside(with_z, mx, keys).withColumn("_e", F.exp(F.col("_z") - F.col("_m")))
        tot = ex.groupBy(*keys).agg(F.sum("_e").alias("_s"))
        return _beside(ex, tot, keys).withColumn(out, F.col("_e") / F.col("_s")).drop("_z", "_m", "_e", "_s")
    g = _g(by)
    e = F.exp(z - F.max(z).over(g))
    return df.withColumn("_e", e).withColumn(out, F.col("_e") / F.sum("_e").over(g)).drop("_e")


def top_k(df: DataFrame, by: Sequence[str], k: int, score: str = "score") -> DataFrame:
    """Keep rows whose score ranks <= k; ties at the k-th score are all kept.

    The filter sits directly over ``rank()`` so Spark's window group limit can
    cut each group to k ranks before the full window is computed.
    """
    if k < 1:
        raise ValueError("k must be >= 1")
    r = F.rank().over(_g(by).orderBy(F.col(score).desc()))
    return df.withColumn("_r", r).filter(F.col("_r") <= k).drop("_r")


def top_p(df: DataFrame, by: Sequence[str], p: float, score: str = "score", item: str = "item",
          method: str = "window", bins: int = CUT_BINS, small: int = CUT_ROWS) -> DataFrame:
    """Nucleus filter — drop an item once the mass *before* it exceeds p.

    Probabilities are re-normalized over the rows present (after top-k); the
    first item is always kept. ``window`` (default; after top-k) sorts each group in one
    task. ``threshold`` suits untrimmed tables whose groups may be huge: a group's cut is
    searched by histograms of its scores (partially aggregated, ``bins`` rows a group), each round
    inside the bin that holds the cut, until that has at most ``small`` rows or one score;
    only that bin is ordered, by a two-level prefix sum, so no task holds a group.
    """
    if method == "threshold":
        return _top_p_threshold(df, list(by), p, score, item, bins, small)
    if method != "window":
        raise ValueError(f"unknown method {method!r}")
    probs = softmax(df, by, score, out="_p")
    w = _g(by).orderBy(F.col(score).desc(), F.col(item)).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_p").over(w), F.lit(0.0))
    return probs.withColumn("_c", F.round(before, ROUND_CMP)).filter(F.col("_c") <= F.lit(float(p))).drop("_p", "_c")


def _beside(rows: DataFrame, table: DataFrame, by: Sequence[str]) -> DataFrame:
    """``rows`` with the columns of their group's row in ``table``; null keys are a group too."""
    named = table.withColumnsRenamed({c: f"_by{i}" for i, c in enumerate(by)})
    same = F.lit(True)
    for i, c in enumerate(by):
        same = same & rows[c].eqNullSafe(named[f"_by{i}"])
    return rows.join(named, same).drop(*[f"_by{i}" for i in range(len(by))])


def _top_p_threshold(df: DataFrame, by: list[str], p: float, score: str, item: str, bins: int, small: int) -> DataFrame:
    probs = materialize(softmax(df, by, score, out="_p", method="aggregate"), "nucleus")
    names = df.columns
    z = F.col(score).cast("double")
    # a group's open band of scores: ``_above`` is the mass of higher ones, ``_hi`` and ``_lo`` its highest and lowest score
    cuts = probs.groupBy(*by).agg(F.lit(0.0).alias("_above"), F.max(z).alias("_hi"), F.min(z).alias("_lo"), F.count(F.lit(1)).alias("_n"))
    cuts = materialize(cuts, "cuts")
    while cuts.filter((F.col("_n") > small) & (F.col("_hi") > F.col("_lo"))).limit(1).count():
        band = _beside(probs, cuts, by).filter(z.between(F.col("_lo"), F.col("_hi")))
        wide = (F.col("_n") > small) & (F.col("_hi") > F.col("_lo"))
        place = F.least(F.floor((F.col("_hi") - z) / (F.col("_hi") - F.col("_lo")) * bins), F.lit(bins - 1)).cast("int")
        parts = band.withColumn("_bin", F.when(wide, place).otherwise(0)).groupBy(*by, "_bin").agg(
            F.sum("_p").alias("_mass"), F.count(F.lit(1)).alias("_n"), F.max(z).alias("_hi"), F.min(z).alias("_lo"), F.first("_above").alias("_above"))
        up = Window.partitionBy(*by).orderBy("_bin")  # at most ``bins`` rows a group
        before = F.col("_above") + F.coalesce(F.sum("_mass").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        parts = parts.withColumn("_before", before).filter(F.round("_before", ROUND_CMP) <= float(p))
        # the last bin that starts within p holds the cut; all above it stay, all below it go
        last = F.max_by(F.struct(F.col("_before").alias("_above"), "_hi", "_lo", "_n"), "_bin")
        cuts = materialize(parts.groupBy(*by).agg(last.alias("_c")).select(*by, "_c.*"), "cuts")
    held = _beside(probs, cuts, by)
    whole = held.filter(z > F.col("_hi")).select(*names)
    inner = held.filter(z.between(F.col("_lo"), F.col("_hi"))).withColumn("_down", -z)
    inner = prefix_sum(inner, ["_down", item], F.round(F.col("_p") * MASS_UNITS), by=by, before="_units")
    kept = inner.filter(F.round(F.col("_above") + F.col("_units") / MASS_UNITS, ROUND_CMP) <= float(p))
    return whole.unionByName(kept.select(*names))


def cumulative_table(probs: DataFrame, by: Sequence[str], item: str = "item", prob: str = "prob", score: str | None = "score") -> DataFrame:
    """E5: one row per group: ``items`` in draw order and ``cum``, their running probability.

    Items stand in the order in which ``draw_one`` walks them. A group has at most as many as the vocabulary.
    """
    key = F.struct(*([(-F.col(score)).alias("down")] if score else []), F.col(item).alias("item"), F.col(prob).alias("prob"))
    rows = probs.groupBy(*by).agg(F.array_sort(F.collect_list(key)).alias("_r"))
    # the running sum is one fold; rounding as in draw_one
    zero = F.struct(F.lit(0.0).alias("sum"), F.array().cast("array<double>").alias("cum"))
    cum = F.aggregate("_r", zero, lambda a, r: F.struct((a["sum"] + r["prob"]).alias("sum"), F.concat(
        a["cum"], F.array(F.round(a["sum"] + r["prob"], ROUND_CMP))).alias("cum")), lambda a: a["cum"])
    return rows.select(*by, F.transform("_r", lambda r: r["item"]).alias("items"), cum.alias("cum"))


def first_above(cum: Column, u: Column) -> Column:
    """Place (from 0) of the first value of a rising array that is above ``u``, the last place if none is; by bisection."""
    n = F.size(cum)
    wide = F.struct(F.lit(0).alias("lo"), (n - 1).alias("hi"))

    def half(a: Column, _: Column) -> Column:
        mid = F.floor((a["lo"] + a["hi"]) / 2).cast("int")
        right = F.get(cum, mid) <= u
        return F.struct(F.when(right, F.least(mid + 1, a["hi"])).otherwise(a["lo"]).alias("lo"),
                        F.when(right, a["hi"]).otherwise(mid).alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.char_length(F.bin(n.cast("long"))) + 1), wide, half, lambda a: a["lo"])


def draw_rows(df: DataFrame, table: DataFrame, context: str, row: Sequence[str], seed: int, by: str = "prev",
              out: str = "drawn") -> DataFrame:
    """E5: one independent draw per row of ``df``, from the distribution of its ``context``.

    ``table`` is a ``cumulative_table`` by one column. ``u`` comes from the seed and the row's key, so rows of one
    context draw apart from each other and a lost task draws again alike. Rows whose context is not in the table get NULL.
    """
    t = broadcast_if_small(table.select(F.col(by).alias("_ctx"), F.col("items").alias("_items"), F.col("cum").alias("_cum")))
    joined = df.join(t, F.col(context) == F.col("_ctx"), "left")
    joined = joined.withColumn("_u", uniform_from(seed, row))
    drawn = F.get("_items", first_above(F.col("_cum"), F.col("_u")))
    return joined.withColumn(out, drawn).drop("_ctx", "_items", "_cum", "_u")


def uniform_from(seed: int, by: Sequence[str]) -> Column:
    """Deterministic u in [0, 1) per group: first 8 hex digits of md5(seed|group)."""
    key = F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in by])
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def draw_one(df: DataFrame, by: Sequence[str], seed: int, item: str = "item", prob: str = "prob",
             score: str | None = "score") -> DataFrame:
    """E5: one multinomial draw per group by inverse CDF.

    Items are walked in ``(score desc, item)`` order — the order top-p already
    sorted by, so no extra sort — or in ``item`` order when ``score`` is None.
    Picks the first item whose running probability exceeds u (the last item
    when rounding leaves the total just under u).
    """
    order = [F.col(score).desc(), F.col(item)] if score else [F.col(item)]
    w = _g(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cum = F.round(F.sum(prob).over(w), ROUND_CMP)
    pos = F.row_number().over(_g(by).orderBy(*order))
    marked = (df.withColumn("_cum", cum).withColumn("_pos", pos).withColumn("_u", uniform_from(seed, by))
              .withColumn("_hit", F.when(F.col("_cum") > F.col("_u"), F.col("_pos"))))
    # the first hit; with no hit (rounding) the last item: key 2**40 - pos
    first_hit = F.min_by(F.col(item), F.coalesce(F.col("_hit"), F.lit(1 << 40) - F.col("_pos")))
    return marked.groupBy(*by).agg(first_hit.alias("drawn"), F.first("_u").alias("u"))


def adjacent_pairs(ids: str) -> Column:
    """Array of (prev, next) structs for neighbouring tokens of one row."""
    n = F.size(ids)
    m = F.greatest(n - 1, F.lit(0))
    return F.arrays_zip(F.slice(ids, 1, m).alias("prev"), F.slice(ids, 2, m).alias("next"))


def bigrams(df: DataFrame, ids: str | None = "ids", prev: str | None = None, nxt: str | None = None) -> DataFrame:
    """Next-token counts ``(prev, next, count)``.

    Either neighbouring tokens of one array (``ids``) or aligned arrays
    (``prev``/``nxt``, e.g. a window's input and target). Counting is a
    partial aggregate: a hot pair costs one row per task before the shuffle.
    """
    if prev and nxt:
        pairs = F.arrays_zip(F.col(prev).alias("prev"), F.col(nxt).alias("next"))
    else:
        pairs = adjacent_pairs(ids)
    ex = df.select(F.explode(pairs).alias("p")).select(F.col("p.prev").alias("prev"), F.col("p.next").alias("next"))
    return ex.groupBy("prev", "next").agg(F.count(F.lit(1)).alias("count"))


def candidates(counts: DataFrame) -> DataFrame:
    """Score table from counts: group = prev, item = next, score = ln(count)."""
    return counts.select("prev", F.col("next").alias("item"), F.ln(F.col("count").cast("double")).alias("score"),
                         "count")


def _dense_model(counts: DataFrame, alpha: float, V: int) -> DataFrame:
    """``(prev, next, _lp)`` for all V*V pairs of token ids: log((c+a) / (c_prev+a*V))."""
    ids = F.sequence(F.lit(0), F.lit(V - 1))
    pairs = counts.sparkSession.range(V).select(F.col("id").cast("int").alias("prev"), F.explode(ids).alias("next"))
    c = counts.select(F.col("prev").cast("int").alias("prev"), F.col("next").cast("int").alias("next"), "count")
    prev_tot = c.groupBy("prev").agg(F.sum("count").alias("_cp"))
    n, cp = F.coalesce("count", F.lit(0)), F.coalesce("_cp", F.lit(0))
    return (pairs.join(c, ["prev", "next"], "left").join(prev_tot, "prev", "left")
            .select("prev", "next", F.log((n + alpha) / (cp + alpha * V)).alias("_lp")))


def _sparse_model(counts: DataFrame, alpha: float, V: int) -> tuple[DataFrame, DataFrame]:
    """Log-probabilities of the counted pairs, and of an uncounted one by ``prev``."""
    prev_tot = counts.groupBy("prev").agg(F.sum("count").alias("_cp"))
    table = counts.join(prev_tot, "prev").select(
        "prev", "next", F.log((F.col("count") + alpha) / (F.col("_cp") + alpha * V)).alias("_lp"))
    return table, prev_tot.select("prev", F.log(F.lit(alpha) / (F.col("_cp") + alpha * V)).alias("_lp0"))


def cross_entropy(df: DataFrame, counts: DataFrame, key: Sequence[str], V: int, alpha: float = 1.0,
                  ids: str | None = None, prev: str | None = None, nxt: str | None = None,
                  rows_bound: int | None = None, mask_ignored: bool = False) -> DataFrame:
    """Mean negative log-likelihood per ``key`` under the smoothed count model.

    ``mask_ignored`` skips target positions equal to -100 (token-weighted mean,
    like ``ignore_index``); an all-masked row yields NULL. With ``rows_bound`` (V*V
    for token ids 0..V-1, at most ``COUNTS_BROADCAST_ROWS``) the model is one dense
    table, broadcast and joined once; else its counted pairs are joined unhinted.
    """
    if prev and nxt:
        pairs = F.arrays_zip(F.col(prev).alias("prev"), F.col(nxt).alias("next"))
    else:
        pairs = adjacent_pairs(ids)
    ex = df.select(*key, F.explode_outer(pairs).alias("p")).select(
        *key, F.col("p.prev").alias("prev"), F.col("p.next").alias("next"))
    if mask_ignored:
        ex = ex.withColumn("next", F.when(F.col("next") != IGNORE_INDEX, F.col("next")))
    if rows_bound is not None and rows_bound <= COUNTS_BROADCAST_ROWS and V * V <= rows_bound:
        scored = ex.join(F.broadcast(_dense_model(counts, alpha, V)), ["prev", "next"], "left")
        lp = F.col("_lp")
    else:
        table, unseen = _sparse_model(counts, alpha, V)
        scored = ex.join(table, ["prev", "next"], "left").join(unseen, "prev", "left")
        lp = F.coalesce(F.col("_lp"), F.col("_lp0"), F.log(F.lit(1.0 / V)))
    nll = F.when(F.col("next").isNotNull(), -lp)
    return scored.groupBy(*key).agg(F.count(nll).alias("tokens"), F.avg(nll).alias("nll"))


def masked_cross_entropy(df: DataFrame, counts: DataFrame, key: Sequence[str], V: int, alpha: float = 1.0,
                         rows_bound: int | None = None) -> DataFrame:
    """Token-weighted mean NLL over targets that are not -100 (input/target arrays)."""
    return cross_entropy(df, counts, key, V, alpha, prev="input", nxt="target",
                         rows_bound=rows_bound, mask_ignored=True)


def perplexity(losses: DataFrame, tokens: str = "tokens", nll: str = "nll") -> DataFrame:
    """E7 over all rows of a loss table: ``tokens``, token-weighted mean ``nll`` and ``perplexity``."""
    n = F.sum(F.col(tokens)).cast("long")
    mean = F.sum(F.col(nll) * F.col(tokens)) / F.nullif(n, F.lit(0))
    return losses.agg(n.alias("tokens"), mean.alias("nll"), F.exp(mean).alias("perplexity"))
