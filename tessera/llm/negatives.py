"""Hard negatives from Hilbert-ordered blocks with zone maps.

Vectors of whole numbers are ordered by label and by their place on a Hilbert curve
through the dimensions of largest variance, and cut into blocks of ``BLOCK`` rows of one
label. Each block is one Parquet row with the minimum and maximum of every dimension, its
zone map. The product of an anchor with any row of a block lies between two sums that
interval arithmetic takes from the zone map; these bounds choose the blocks that are read:

* for positives, blocks of the anchor's label, but those below a score that enough rows of
  other blocks are certain to reach;
* for negatives, blocks of other labels whose bounds meet one of the anchor's windows
  ``low * positive <= 100 * score <= high * positive``.

Anchors travel in groups of ``GROUP``, blocks in runs of ``RUN``: the plan, which reads zone
maps only, has a row per anchor group, run and needed block, and the search joins just those
blocks. Within a run blocks are taken from the highest bound down, and one whose bound
is below what an anchor has already is passed over. Each (group, run) returns the first few rows of
each anchor, which a window over them merges. Scores are exact: doubles while products fit 53
bits, 64-bit integers beyond.

Vectors that are shorter than others count as zero beyond their end. A row without id or
label, or with a null or non-finite component, takes no part; rows that share an id count
once, as the smallest by label and vector. Components beyond ``LARGEST`` are an error, as
their scores would not fit. Ties go to the smaller id. Extra columns are ignored; without
anchors, rows or windows that hold a row there is no result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.ordering import global_rank
from tessera.session import materialize

BLOCK = 256
RUN = 256
GROUP = 4096
CURVE_DIMENSIONS, CURVE_BITS = 8, 6
LARGEST = 1 << 24
PACKED = "ids array<long>, labels array<long>, vectors binary"
FOUND = "group long, anchor_id long, slot int, id long, score long"


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of ``cells`` (whole numbers of ``bits`` bits), at most 63 bits in all."""
    x = cells.astype(np.int64).T.copy()
    for shift in range(bits - 1, 0, -1):
        low = (1 << shift) - 1
        for i in range(len(x)):  # undo the turn of each smaller cube
            inside = (x[i] >> shift & 1).astype(bool)
            turned = np.where(inside, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(inside, low, turned)
            x[i] ^= turned
    for i in range(1, len(x)):  # Gray code across the axes
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], np.int64)
    for shift in range(bits - 1, 0, -1):
        flip ^= np.where(x[-1] >> shift & 1, (1 << shift) - 1, 0)
    x ^= flip
    out = np.zeros(x.shape[1], np.int64)
    for shift in range(bits - 1, -1, -1):
        for axis in x:
            out = out << 1 | (axis >> shift & 1)
    return out


def stacked(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    """Rows of a list column as a matrix of ``dims`` columns, zeros beyond the end of a row."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = column.value_lengths().to_numpy()
    out = np.zeros((len(column), dims), np.int64)
    out[np.arange(dims) < sizes[:, None]] = column.flatten().to_numpy()
    return out


def whole_vectors(embeddings: DataFrame, scale: int = 256) -> DataFrame:
    """``vec_id, label, v``: rows that take part, components as ``floor(scale * x)``, one row per id."""
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    rows = embeddings.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).filter(good)
    large = F.exists("embedding", lambda x: F.abs(x.cast("double")) >= LARGEST / scale)
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("int"))
    v = F.when(large, F.raise_error(F.lit(f"a component reaches {LARGEST / scale:g}")).cast("array<int>")).otherwise(v)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.struct(F.col("label").cast("long").alias("label"), v.alias("v")).alias("m"))
    return rows.groupBy("vec_id").agg(F.min("m").alias("m")).select("vec_id", "m.label", "m.v")


def _dimension_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        dims = int(b.column("v").value_lengths().to_numpy().max(initial=0))
        x = stacked(b.column("v"), dims).astype(float)
        if dims:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(dims), pa.int32()), pa.array(x.sum(0)), pa.array((x * x).sum(0)), pa.array(x.min(0)), pa.array(x.max(0))],
                ["dim", "s", "q", "lo", "hi"])


class Shape:
    """Dimensions, exact number kinds and the curve of a set of vectors, from one row per dimension."""

    def __init__(self, rows: DataFrame):
        part = rows.select("v").mapInArrow(_dimension_rows, "dim int, s double, q double, lo double, hi double")
        stats = part.groupBy("dim").agg(F.sum("s").alias("s"), F.sum("q").alias("q"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        stats = sorted(map(tuple, stats.collect()))  # one row per dimension
        n = max(1, rows.count())
        self.dims = len(stats)
        most = max((abs(v) for r in stats for v in r[3:]), default=0)
        self.stored = "<i2" if most < 1 << 15 else "<i4"
        self.worked = np.float64 if most * most * max(1, self.dims) < 1 << 53 else np.int64
        spread = sorted(stats, key=lambda r: (-(r[2] / n - (r[1] / n) ** 2), r[0]))[:CURVE_DIMENSIONS]
        self.axes = [r[0] for r in spread]
        self.low = np.array([r[3] for r in spread])
        self.step = np.array([(r[4] - r[3] + 1) / (1 << CURVE_BITS) for r in spread])

    def pack(self, v: np.ndarray) -> bytes:
        return v.astype(self.stored).tobytes()

    def unpack(self, raw: bytes, n: int) -> np.ndarray:
        return np.frombuffer(raw, self.stored).reshape(n, self.dims).astype(self.worked)

    def curve(self):
        axes, low, step = self.axes, self.low, self.step

        @F.pandas_udf("long")
        def place(v: pd.Series) -> pd.Series:
            x = np.zeros((len(v), len(axes)))
            for i, row in enumerate(v):
                known = [k for k, a in enumerate(axes) if a < len(row)]
                x[i, known] = row[[axes[k] for k in known]]
            return pd.Series(hilbert_index(np.floor((x - low) / step), CURVE_BITS) if axes else np.zeros(len(v), np.int64))
        return place("v")


def _table(schema: str, *columns) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    fields = [f.split() for f in schema.split(", ")]
    return pa.table([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields])


BLOCKS = "r long, no long, label long, n int, ids array<long>, vectors binary, low array<long>, high array<long>"


def vector_blocks(rows: DataFrame, shape: Shape, block: int = BLOCK, run: int = RUN) -> DataFrame:
    """The Parquet blocks of ``rows`` with ``h``: their run ``r``, number, label, ids, vectors and zone map."""
    ranked = global_rank(rows, ["h", "vec_id"], by=["label"], name="rank").withColumn("block", F.expr(f"(rank - 1) div {block}"))
    ranked = materialize(ranked.withColumn("run", F.expr(f"block div {run}")).select("label", "run", "block", "vec_id", "v"), "ranked")
    runs = global_rank(ranked.select("label", "run").distinct(), ["label", "run"], name="r")
    dims = shape.dims

    def packed(key, t):
        t = t.sort_by("vec_id")
        v = stacked(t["v"], dims)
        return _table("label long, run long, block long, n int, ids array<long>, vectors binary, low array<long>, high array<long>",
                      *([k.as_py()] for k in key), [len(v)], [t["vec_id"].to_pylist()], [shape.pack(v)], [v.min(0)], [v.max(0)])

    blocks = ranked.groupBy("label", "run", "block").applyInArrow(
        packed, "label long, run long, block long, n int, ids array<long>, vectors binary, low array<long>, high array<long>")
    no = F.expr(f"(r - 1) * {run} + block % {run}")
    out = blocks.join(runs, ["label", "run"]).select(
        (F.col("r") - 1).alias("r"), no.alias("no"), "label", "n", "ids", "vectors", "low", "high")
    return materialize(out.repartitionByRange("no").sortWithinPartitions("no"), "blocks")


def anchor_groups(anchors: DataFrame, shape: Shape, size: int = GROUP) -> DataFrame:
    """Anchors in curve order, ``size`` to a row: ``group, ids, labels, vectors``."""
    ranked = global_rank(anchors, ["label", "h", "vec_id"], name="rank").withColumn("group", F.expr(f"(rank - 1) div {size}"))

    def packed(key, t):
        t = t.sort_by("rank")
        return _table(f"group long, {PACKED}", [key[0].as_py()], [t["vec_id"].to_pylist()], [t["label"].to_pylist()],
                      [shape.pack(stacked(t["v"], shape.dims))])
    return materialize(ranked.select("group", "rank", "vec_id", "label", "v").groupBy("group").applyInArrow(
        packed, f"group long, {PACKED}"), "anchors")


def product_bounds(anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest product of each anchor with any vector between ``low`` and ``high`` of each block."""
    up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
    return up @ low.T + down @ high.T, up @ high.T + down @ low.T


class Asked:
    """The anchors of a group with the score windows that they ask for, one column per slot."""

    def __init__(self, t: pa.Table, shape: Shape, slots: int, low: int, high: int, wanted: int):
        row = t.filter(pc.equal(t["kind"], 0)).to_pylist()[0]
        self.ids, self.labels = (np.array(row[c], np.int64) for c in ("ids", "labels"))
        self.v = shape.unpack(row["vectors"], len(self.ids))
        self.wanted = wanted
        self.same = row["windows"] is None
        n, least, most = len(self.ids), np.iinfo(np.int64).min, np.iinfo(np.int64).max
        if self.same:  # positives: any score, own label, not the anchor itself
            self.lo, self.hi = np.full((n, 1), least), np.full((n, 1), most)
        else:
            self.lo, self.hi = np.full((n, slots), most), np.full((n, slots), least)
            w = np.array([(x["place"], x["slot"], x["score"]) for x in row["windows"]], np.int64).reshape(-1, 3)
            self.lo[w[:, 0], w[:, 1]] = -((-low * w[:, 2]) // 100)  # the least whole score with 100 * score >= low * positive
            self.hi[w[:, 0], w[:, 1]] = high * w[:, 2] // 100

    def may_ask(self, label: int) -> np.ndarray:
        return (self.labels == label) == self.same


def _zones(t: pa.Table, shape: Shape) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    b = t.filter(pc.equal(t["kind"], 1)).sort_by("no")
    return b, *(stacked(b[c], shape.dims).astype(shape.worked) for c in ("low", "high"))


def _needs(asked: Asked, b: pa.Table, lb: np.ndarray, ub: np.ndarray) -> np.ndarray:
    """Which anchors (rows) need which blocks (columns)."""
    label = b["label"].to_numpy()
    own = np.stack([asked.may_ask(x) for x in label], axis=1)
    if not asked.same:
        return own & np.any([(ub >= asked.lo[:, [k]]) & (lb <= asked.hi[:, [k]]) for k in range(asked.lo.shape[1])], axis=0)
    # the score that ``wanted`` rows and the anchor itself are certain to reach
    certain = np.where(own, lb, -np.inf)
    order = np.argsort(-certain, axis=1, kind="stable")
    rows = np.cumsum(np.where(np.take_along_axis(own, order, 1), b["n"].to_numpy()[order], 0), axis=1)
    enough = rows > asked.wanted
    first = np.argmax(enough, axis=1)[:, None]
    least = np.where(enough.any(axis=1, keepdims=True), np.take_along_axis(np.take_along_axis(certain, order, 1), first, 1), -np.inf)
    return own & (ub >= least)


def planner(shape: Shape, slots: int, low: int, high: int, wanted: int):
    def plan(key, t):
        asked = Asked(t, shape, slots, low, high, wanted)
        b, lows, highs = _zones(t, shape)
        some = _needs(asked, b, *product_bounds(asked.v, lows, highs)).any(axis=0)
        no = b["no"].to_numpy()[some]
        return _table("group long, r long, no long", *(np.full(len(no), k.as_py()) for k in key), no)
    return plan


def searcher(shape: Shape, slots: int, low: int, high: int, wanted: int):
    def search(key, t):
        asked = Asked(t, shape, slots, low, high, wanted)
        b, lows, highs = _zones(t, shape)
        lb, ub = product_bounds(asked.v, lows, highs)
        needs = _needs(asked, b, lb, ub)
        n, width = asked.lo.shape
        best = np.full((n, width, wanted), -np.inf if shape.worked is np.float64 else np.iinfo(np.int64).min, shape.worked)
        best_id = np.zeros((n, width, wanted), np.int64)
        held = np.zeros((n, width), np.int64)
        top = np.where(needs, ub, -np.inf).max(axis=0)
        for j in np.argsort(-top, kind="stable"):
            ids = np.array(b["ids"][int(j)].as_py(), np.int64)
            v = shape.unpack(b["vectors"][int(j)].as_py(), len(ids))
            # full slots whose last row is above the block's bound have nothing to gain
            open_ = (held < wanted) | (best[:, :, -1] <= ub[:, [j]])
            who = np.flatnonzero(needs[:, j] & open_.any(axis=1))
            if not len(who):
                continue
            scores = asked.v[who] @ v.T
            for k in range(width):
                fits = (scores >= asked.lo[who, k][:, None]) & (scores <= asked.hi[who, k][:, None])
                fits &= (held[who, k] < wanted)[:, None] | (scores >= best[who, k, -1][:, None])
                if asked.same:
                    fits &= ids != asked.ids[who][:, None]
                row, col = np.nonzero(fits)
                if not len(row):
                    continue
                mine = np.unique(row)
                at = who[mine]
                have, slot = np.nonzero(np.arange(wanted) < held[at, k][:, None])
                whose = np.concatenate((np.searchsorted(mine, row), have))
                score = np.concatenate((scores[row, col], best[at, k][have, slot]))
                name = np.concatenate((ids[col], best_id[at, k][have, slot]))
                order = np.lexsort((name, -score, whose))
                whose, score, name = whose[order], score[order], name[order]
                rank = np.arange(len(whose)) - np.searchsorted(whose, whose)
                keep = rank < wanted
                best[at[whose[keep]], k, rank[keep]] = score[keep]
                best_id[at[whose[keep]], k, rank[keep]] = name[keep]
                held[at, k] = np.bincount(whose[keep], minlength=len(at))
        who, k, at = np.nonzero(np.arange(wanted) < held[:, :, None])
        return _table(FOUND, np.full(len(who), key[0].as_py()), asked.ids[who], k, best_id[who, k, at], best[who, k, at].astype(np.int64))
    return search


def _searched(groups: DataFrame, pairs: DataFrame, blocks: DataFrame, shape: Shape, slots: int, low: int, high: int, wanted: int) -> DataFrame:
    """The first ``wanted`` rows of each slot of each anchor; ``pairs (group, r)`` says which runs may hold some."""
    told = groups.withColumn("kind", F.lit(0))
    zones = blocks.select("r", "no", "label", "n", "low", "high").withColumn("kind", F.lit(1))
    rows = pairs.join(told, "group").unionByName(pairs.join(zones, "r"), allowMissingColumns=True)
    plan = materialize(rows.groupBy("group", "r").applyInArrow(
        planner(shape, slots, low, high, wanted), "group long, r long, no long"), "plan")
    read = plan.join(blocks.drop("r").withColumn("kind", F.lit(1)), "no")
    rows = plan.select("group", "r").distinct().join(told, "group").unionByName(read, allowMissingColumns=True)
    found = rows.groupBy("group", "r").applyInArrow(searcher(shape, slots, low, high, wanted), FOUND)
    order = Window.partitionBy("group", "anchor_id", "slot").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= wanted)


def mine_negatives(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
                   block: int = BLOCK, run: int = RUN, group: int = GROUP) -> DataFrame:
    """Hard negatives of the rows ``(vec_id, label, v)`` for which ``is_anchor`` holds.

    Per anchor and each of its first ``positives`` rows of its own label, the first ``negatives`` rows
    of other labels with ``low * positive_score <= 100 * score <= high * positive_score``:
    ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.
    """
    vectors = materialize(vectors, "vectors")
    shape = Shape(vectors)
    vectors = materialize(vectors.withColumn("h", shape.curve()), "placed")
    blocks = vector_blocks(vectors, shape, block, run)
    groups = anchor_groups(vectors.filter(is_anchor), shape, group)
    runs = materialize(blocks.select("r", "label").distinct(), "runs")
    kind = "array<struct<place:int,slot:int,score:long>>"
    pairs = groups.select("group", F.explode(F.array_distinct("labels")).alias("label")).join(runs, "label").select("group", "r").distinct()
    found = _searched(groups.withColumn("windows", F.lit(None).cast(kind)), pairs, blocks, shape, 1, low, high, positives)
    found = materialize(found.select("group", "anchor_id", (F.col("rank") - 1).alias("slot"), F.col("id").alias("positive_id"),
                                     F.col("score").alias("positive_score")), "positives")
    places = groups.select("group", F.posexplode("ids").alias("place", "anchor_id"))
    asked = found.join(places, ["group", "anchor_id"]).groupBy("group").agg(
        F.collect_list(F.struct("place", F.col("slot").cast("int").alias("slot"), F.col("positive_score").alias("score"))).alias("windows"))
    groups = materialize(groups.join(asked, "group"), "windows")
    n_runs = runs.count()
    pairs = groups.select("group", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(n_runs - 1, 0)).cast("long"))).alias("r"))
    hard = _searched(groups, pairs, blocks, shape, positives, low, high, negatives)
    return hard.join(found, ["group", "anchor_id", "slot"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"))
