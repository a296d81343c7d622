"""Epochs, seeded shuffle, batches, accumulation groups, step budget, collate, cuts.

The shuffle order is a seeded md5 key (engine-independent and restartable:
a lost task recomputes the same order). The global position inside an epoch
comes from a two-level rank over range-sorted parts, so no task sees more than
one part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.ordering import global_rank

# Rounds of the keyed permutation, and passes after which a walk is an error.
ROUNDS = 4
WALKS = 64


def with_epochs(df: DataFrame, epochs: int) -> DataFrame:
    """Repeat each row once per epoch (narrow ``explode``, no join)."""
    if epochs < 1:
        raise ValueError("epochs must be >= 1")
    return df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))


def shuffle_key(seed: int, id_col: str) -> F.Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("epoch").cast("string"), F.col(id_col).cast("string")))


def shuffle(df: DataFrame, seed: int, epochs: int = 1, id_col: str = "window_id") -> DataFrame:
    """B2: per-epoch permutation; adds ``epoch``, ``rank`` (1-based) and ``n_epoch``."""
    keyed = with_epochs(df, epochs).withColumn("_key", shuffle_key(seed, id_col))
    return global_rank(keyed, ["_key", id_col], by=["epoch"], name="rank", total="n_epoch", drop=["_key"])


def _domain(n: int) -> tuple[int, int]:
    """Bits of the left and the right half of the least power of two that holds ``n`` places."""
    bits = max(2, (n - 1).bit_length())
    return bits // 2, bits - bits // 2


def _round_value(half: Column, r: int, bits: int, seed: int, epoch: Column) -> Column:
    key = F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), F.lit(str(r)), half.cast("string"))
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") % (1 << bits)


def _feistel(x: Column, n: int, seed: int, epoch: Column, inverse: bool) -> Column:
    """One pass of the keyed permutation of the power of two around ``n``: each round adds a hash of one half to the other."""
    lbits, rbits = _domain(n)
    state = F.struct(F.shiftright(x, rbits).alias("l"), (x % (1 << rbits)).alias("r"))
    sign = -1 if inverse else 1

    def turned(r: int):
        def left(s: Column) -> Column:
            moved = F.pmod(s["l"] + sign * _round_value(s["r"], r, lbits, seed, epoch), F.lit(1 << lbits))
            return F.struct(moved.alias("l"), s["r"].alias("r"))

        def right(s: Column) -> Column:
            moved = F.pmod(s["r"] + sign * _round_value(s["l"], r, rbits, seed, epoch), F.lit(1 << rbits))
            return F.struct(s["l"].alias("l"), moved.alias("r"))
        return right if r % 2 else left

    for r in range(ROUNDS)[::-1 if inverse else 1]:
        state = F.element_at(F.transform(F.array(state), turned(r)), 1)
    return F.element_at(F.transform(F.array(state), lambda s: F.shiftleft(s["l"], rbits) + s["r"]), 1)


def permuted(index, n: int, seed: int, epoch, inverse: bool = False) -> Column:
    """B2 without a sort: the place (from 0) of ``index`` in the epoch's permutation of ``0 .. n-1``, or back.

    A keyed Feistel network permutes the next power of two; a value beyond ``n`` is permuted again until it
    lies below (cycle walking), so the result is a bijection of exactly ``n`` places. Each
    place is computed by itself: any batch of any epoch is a projection of a range, with no sort, exchange or written order.
    A walk needs fewer than two passes on average and more than ``WALKS`` with probability below ``2^-64`` each; that is an error.
    """
    if n < 1:
        raise ValueError("n must be positive")
    x, e = (F.col(c) if isinstance(c, str) else c for c in (index, epoch))
    once = lambda v: _feistel(v, n, seed, e, inverse)
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), once(x.cast("long")), lambda v, _: F.when(v < n, v).otherwise(once(v)))
    return F.element_at(F.transform(F.array(walked), lambda v: F.when(v < n, v).otherwise(
        F.raise_error(F.lit("a permutation walk did not end")).cast("long"))), 1)


def permuted_schedule(ids: DataFrame, n: int, seed: int, epochs: int = 1, id_col: str = "window_id") -> DataFrame:
    """B2 for ids ``0 .. n-1``: ``epoch``, ``rank`` (1-based) and ``n_epoch`` as ``shuffle`` gives, in one projection."""
    return with_epochs(ids, epochs).withColumn("rank", permuted(id_col, n, seed, "epoch") + 1).withColumn("n_epoch", F.lit(n).cast("long"))


def batch_ids(spark: SparkSession, n: int, size: int, seed: int, epoch: int, batch_idx: int) -> DataFrame:
    """``slot, id`` of one batch of one epoch, from its places alone: nothing else of the epoch is computed."""
    first = batch_idx * size
    places = spark.range(first, max(first, min(first + size, n)))
    return places.select((F.col("id") - first).cast("int").alias("slot"),
                         permuted(F.col("id"), n, seed, F.lit(epoch), inverse=True).alias("id"))


def batches(df: DataFrame, size: int, drop_last: bool) -> DataFrame:
    """``batch_idx``/``slot`` from ``rank``; ``drop_last`` removes the short tail batch."""
    if size < 1:
        raise ValueError("size must be positive")
    r0 = F.col("rank") - 1
    nb = (F.col("n_epoch") / size).cast("long") if drop_last else F.ceil(F.col("n_epoch") / size).cast("long")
    out = (df.withColumn("batch_idx", F.floor(r0 / size).cast("long"))
           .withColumn("slot", (r0 % size).cast("int"))
           .withColumn("n_batches", nb))
    return out.filter(F.col("batch_idx") < F.col("n_batches")) if drop_last else out


def update_groups(df: DataFrame, accum: int) -> DataFrame:
    """Optimizer update each micro-batch feeds.

    An update fires after every ``accum`` batches and ``batch_idx`` restarts
    each epoch, so an epoch's trailing batches join the next epoch's first
    update: ``update_id = epoch*U + batch_idx div accum + 1`` with
    ``U = n_batches div accum``. ``U = 0`` never updates (the source loops
    forever) and raises here.
    """
    if accum < 1:
        raise ValueError("accum must be positive")
    U = F.floor(F.col("n_batches") / accum).cast("long")
    uid = F.col("epoch") * U + F.floor(F.col("batch_idx") / accum).cast("long") + 1
    checked = F.when(U > 0, uid).otherwise(
        F.raise_error(F.lit("fewer batches per epoch than accumulation steps: no update would ever run")))
    return df.withColumn("update_id", checked.cast("long"))


def epochs_needed(n_rows: int, size: int, accum: int, steps: int, drop_last: bool = True) -> int:
    """Epochs that the step budget consumes: ``ceil(steps / U)`` with U updates per epoch."""
    nb = n_rows // size if drop_last else -(-n_rows // size)
    U = nb // accum
    if U == 0:
        raise ValueError("fewer batches per epoch than accumulation steps: no update would ever run")
    return max(1, -(-steps // U))


def limit_steps(df: DataFrame, steps: int) -> DataFrame:
    """Keep micro-batches whose update runs within the step budget."""
    return df.filter(F.col("update_id") <= steps)


def collate(df: DataFrame, cols: tuple[str, ...] = ("window_id", "input", "target")) -> DataFrame:
    """One row per (epoch, batch_idx) with rows ordered by slot (group size = batch size).

    Rows are dealt out before they are gathered: a task has few rows of a batch, so gathering them first would only cost
    memory and sorting.
    """
    items = F.array_sort(F.collect_list(F.struct("slot", *cols)))

    def field(name):
        return F.transform("_rows", lambda r: r[name]).alias(name)

    return (df.repartition("epoch", "batch_idx").groupBy("epoch", "batch_idx").agg(items.alias("_rows"))
            .select("epoch", "batch_idx", *[field(c) for c in cols]))


def last_tokens(df: DataFrame, L: int, ids: str = "ids", out: str | None = None) -> DataFrame:
    """Keep the last L tokens (context trim)."""
    n = F.size(ids)
    return df.withColumn(out or ids, F.slice(ids, F.greatest(n - L, F.lit(0)) + 1, L))


def cut_at(df: DataFrame, stop: int, max_new: int, ids: str = "ids", prompt_len: str = "prompt_len",
           out: str = "ids_cut") -> DataFrame:
    """Keep the prompt plus generated tokens up to the first ``stop`` (kept) or ``max_new``."""
    n = F.size(ids)
    gen = F.slice(ids, F.col(prompt_len) + 1, F.greatest(n - F.col(prompt_len), F.lit(0)))
    p = F.array_position(gen, stop)
    keep = F.when(p > 0, F.least(p, F.lit(max_new))).otherwise(F.lit(max_new)).cast("int")
    return df.withColumn(out, F.concat(F.slice(ids, 1, F.col(prompt_len)), F.slice(gen, 1, keep)))
