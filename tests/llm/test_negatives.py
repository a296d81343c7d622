"""Hard negatives against a plain search over all pairs, and the parts of the block search."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import negatives


def vectors(spark, rows):
    extra = "r long, no string, h double, kind string, rank int"
    return spark.createDataFrame([(*r, 1, "n", 0.5, "k", 2) for r in rows], f"vec_id long, embedding array<float>, label int, {extra}")


def brute(rows, every, positives=5, wanted=3, low=50, high=95):
    """Whole-number search in plain Python."""
    best = {}
    for vec_id, e, label in rows:
        if vec_id is None or e is None or label is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        v = (label, [math.floor(256 * float(np.float32(x))) for x in e])
        best[vec_id] = min(best.get(vec_id, v), v)
    out = []
    for a, (la, va) in best.items():
        if a % every:
            continue
        scores = sorted((-sum(x * y for x, y in zip(va, v, strict=False)), i) for i, (_, v) in best.items() if i != a)
        own = [(s, i) for s, i in scores if best[i][0] == la][:positives]
        for s, i in own:
            hard = [(t, j) for t, j in scores if best[j][0] != la and low * -s <= 100 * -t <= high * -s][:wanted]
            out += [(a, i, k + 1, j, -s, -t) for k, (t, j) in enumerate(hard)]
    return sorted(out)


def mined(df, every, **options):
    out = negatives.mine_negatives(negatives.whole_vectors(df), F.col("vec_id") % every == 0, **options)
    return sorted(map(tuple, out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()))


def rows_of(kind, n=240, dims=6):
    rng = np.random.default_rng(5)
    if kind == "ties":  # few distinct whole vectors: many equal scores
        v = rng.integers(-2, 3, (n, dims)) / 256
    elif kind == "clusters":
        v = rng.normal(size=(8, dims))[rng.integers(0, 8, n)] + rng.normal(scale=0.05, size=(n, dims))
    elif kind == "copies":  # a third of the rows are one vector of one label
        v = rng.normal(size=(n, dims))
        v[::3] = v[0]
    else:
        v = rng.normal(size=(n, dims)) * 3000  # wide components
    label = rng.integers(0, 4, n)
    if kind == "copies":
        label[::3] = 1
    return [(i, [float(np.float32(x)) for x in v[i]], int(label[i])) for i in range(n)]


@pytest.mark.parametrize("kind", ["ties", "clusters", "copies", "wide"])
@pytest.mark.parametrize("sizes", [{}, {"block": 8, "run": 3, "group": 7}])
def test_negatives_match_a_plain_search(spark, kind, sizes):
    rows = rows_of(kind)
    assert mined(vectors(spark, rows), 5, **sizes) == brute(rows, 5)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5], 0), (1, [0.9, 0.5], 0), (2, [0.5, 0.25], 1), (3, [0.6], 1), (4, [], 2), (5, [0.7, 0.3, 9.0], 2),
            (6, None, 1), (7, [0.5, None], 1), (8, [nan, 1.0], 1), (9, [inf, 1.0], 0), (None, [1.0, 1.0], 0), (10, [0.4, 0.4], None),
            (11, [0.5, 0.25], 3), (11, [0.5, 0.25], 3), (11, [0.6, 0.1], 2), (12, [-1.0, -1.0], 0), (13, [0.0, 0.0], 0)]
    got = mined(vectors(spark, rows), 1)
    assert got == brute(rows, 1) and any(r[3] == 11 for r in got)
    assert mined(vectors(spark, rows), 100) == brute(rows, 100)
    assert mined(vectors(spark, rows).limit(0), 1) == []
    assert mined(vectors(spark, [(4, [], 2), (5, [], 2), (6, [], 1)]), 1) == brute([(4, [], 2), (5, [], 2), (6, [], 1)], 1)
    assert mined(vectors(spark, rows[1:]), 50) == brute(rows[1:], 50)
    with pytest.raises(Exception, match="a component reaches"):
        mined(vectors(spark, [(1, [1e9], 1), (2, [1.0], 1)]), 1)


def test_scores_beyond_doubles(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(np.float32(x)) for x in rng.uniform(-65535, 65535, 48)], i % 3) for i in range(40)]
    assert mined(vectors(spark, rows), 4, block=4, run=2, group=3) == brute(rows, 4)


@pytest.mark.parametrize("dims, bits", [(2, 4), (3, 3), (4, 2), (1, 5)])
def test_curve_visits_neighbouring_cells(dims, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    at = negatives.hilbert_index(cells, bits)
    assert sorted(at) == list(range(len(cells)))
    steps = np.abs(np.diff(cells[np.argsort(at)], axis=0)).sum(axis=1)
    assert (steps == 1).all()


def test_bounds_hold_every_product():
    rng = np.random.default_rng(3)
    anchors, rows = rng.integers(-9, 10, (20, 5)), rng.integers(-9, 10, (30, 5))
    lb, ub = negatives.product_bounds(anchors, rows.min(0)[None], rows.max(0)[None])
    scores = anchors @ rows.T
    assert (lb[:, 0] <= scores.min(1)).all() and (scores.max(1) <= ub[:, 0]).all()


def test_clustered_blocks_are_left_unread(spark):
    """Far clusters: the plan names fewer blocks than there are."""
    rng = np.random.default_rng(4)
    centres = np.eye(8)[:, :8] * 4
    rows = [(i, [float(np.float32(x)) for x in centres[i % 8] + rng.normal(scale=0.02, size=8)], i % 2) for i in range(800)]
    v = negatives.whole_vectors(vectors(spark, rows)).cache()
    shape = negatives.Shape(v)
    placed = v.withColumn("h", shape.curve())
    blocks = negatives.vector_blocks(placed, shape, 16, 4)
    groups = negatives.anchor_groups(placed.filter("vec_id = 0"), shape).withColumn("kind", F.lit(0)).withColumn(
        "windows", F.lit(None).cast("array<struct<place:int,slot:int,score:long>>"))
    zones = blocks.select("r", "no", "label", "n", "low", "high").withColumn("kind", F.lit(1))
    pairs = blocks.select(F.lit(0).cast("long").alias("group"), "r").distinct()
    rows = pairs.join(groups, "group").unionByName(pairs.join(zones, "r"), allowMissingColumns=True)
    needed = rows.groupBy("group", "r").applyInArrow(negatives.planner(shape, 1, 50, 95, 5), "group long, r long, no long")
    per_run = blocks.groupBy("r").count().count()
    assert 0 < needed.count() < blocks.count() / 2 and per_run > 4
