"""E1-E8 against a numpy rendering of the selection steps."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import scores
from tessera.operators.scores import (bigrams, cross_entropy, draw_one, masked_cross_entropy, perplexity, softmax,
                                      top_k, top_p, with_temperature)


def ref_select(items, scores, T, k, p):
    """temperature -> top-k (ties kept) -> top-p (mass before item > p drops it) -> softmax."""
    z = np.array(scores, dtype=float) / T
    if k is not None:
        kth = np.sort(z)[::-1][min(k, len(z)) - 1]
        z[z < kth] = -np.inf
    if p is not None:
        order = sorted(range(len(z)), key=lambda i: (-z[i], items[i]))
        zs = z[order]
        e = np.exp(zs - zs.max())
        probs = e / e.sum()
        cum = np.cumsum(probs)
        mask = np.concatenate([[False], np.round(cum[:-1], 9) > p])
        for j, i in enumerate(order):
            if mask[j]:
                z[i] = -np.inf
    e = np.exp(z - z.max())
    pr = e / e.sum()
    return {items[i]: pr[i] for i in range(len(z)) if z[i] != -np.inf}


def make_groups(rnd, n_groups):
    rows = []
    for g in range(n_groups):
        size = rnd.choice([1, 2, 3, 5, 8])
        for it in range(size):
            rows.append((g, it, float(rnd.choice([0.0, 1.0, 1.0, 2.0, math.log(3), 0.5]))))  # ties on purpose
    return rows


@pytest.mark.parametrize("k,p", [(None, None), (2, None), (10, None), (3, 0.5), (None, 0.0), (None, 1.0), (1, 0.9)])
def test_select_matches_numpy(spark, k, p):
    rnd = random.Random(hash((k, p)) & 0xFFFF)
    rows = make_groups(rnd, 30)
    df = spark.createDataFrame(rows, "prev int, item int, score double")
    c = with_temperature(df, 0.8)
    if k is not None:
        c = top_k(c, ["prev"], k)
    if p is not None:
        c = top_p(c, ["prev"], p)
    got = {(r.prev, r.item): r.prob for r in softmax(c, ["prev"]).collect()}
    for g in {r[0] for r in rows}:
        items = [r[1] for r in rows if r[0] == g]
        scores = [r[2] for r in rows if r[0] == g]
        exp = ref_select(items, scores, 0.8, k, p)
        sub = {it: pr for (gg, it), pr in got.items() if gg == g}
        assert set(sub) == set(exp), (g, k, p)
        for it in exp:
            assert abs(sub[it] - exp[it]) < 1e-9
        assert abs(sum(sub.values()) - 1) < 1e-9 and len(sub) >= 1


def test_bad_temperature(spark):
    df = spark.createDataFrame([(0, 0, 1.0)], "prev int, item int, score double")
    with pytest.raises(ValueError):
        with_temperature(df, 0)


def test_draw_is_inverse_cdf(spark):
    rows = [(g, it, p) for g in range(40) for it, p in enumerate([0.5, 0.3, 0.2])]
    df = spark.createDataFrame(rows, "prev int, item int, prob double")
    out = {r.prev: (r.drawn, r.u) for r in draw_one(df, ["prev"], 11, score=None).collect()}
    for g, (d, u) in out.items():
        cum = np.cumsum([0.5, 0.3, 0.2])
        assert d == int(np.argmax(cum > u))
    again = {r.prev: r.drawn for r in draw_one(df, ["prev"], 11, score=None).collect()}
    assert again == {g: v[0] for g, v in out.items()}
    # walking items by descending score: item 2 (score 3) first, then 1, then 0
    scored = df.withColumn("score", F.col("item").cast("double"))
    by_score = {r.prev: (r.drawn, r.u) for r in draw_one(scored, ["prev"], 11).collect()}
    for g, (d, u) in by_score.items():
        cum = np.cumsum([0.2, 0.3, 0.5])
        assert d == [2, 1, 0][int(np.argmax(cum > u))]
    # totals just under u fall back to the last item in walk order
    tiny = spark.createDataFrame([(0, 0, 0.0, 0.0), (0, 1, 0.0, -1.0)], "prev int, item int, prob double, score double")
    assert draw_one(tiny, ["prev"], 1).first().drawn == 1


def test_bigrams_and_losses(spark):
    docs = [(0, [1, 2, 1, 2, 3]), (1, [2, 3]), (2, [4])]
    df = spark.createDataFrame(docs, "doc_id long, ids array<int>")
    counts = {(r.prev, r.next): r["count"] for r in bigrams(df, "ids").collect()}
    assert counts == {(1, 2): 2, (2, 1): 1, (2, 3): 2}
    V, a = 5, 1.0
    ce = {r.doc_id: (r.tokens, r.nll) for r in cross_entropy(df, bigrams(df, "ids"), ["doc_id"], V, a,
                                                                ids="ids", rows_bound=25).collect()}
    cp = {1: 2, 2: 3}

    def nll(p_, n_):
        return -math.log((counts.get((p_, n_), 0) + a) / (cp.get(p_, 0) + a * V))
    assert abs(ce[0][1] - np.mean([nll(1, 2), nll(2, 1), nll(1, 2), nll(2, 3)])) < 1e-12
    assert ce[2] == (0, None)
    ex = spark.createDataFrame([(0, [1, 2, 2], [2, -100, 3]), (1, [1, 1], [-100, -100])],
                               "k int, input array<int>, target array<int>")
    m = {r.k: (r.tokens, r.nll) for r in masked_cross_entropy(ex, bigrams(df, "ids"), ["k"], V, a,
                                                                rows_bound=25).collect()}
    assert m[1] == (0, None)
    assert m[0][0] == 2 and abs(m[0][1] - np.mean([nll(1, 2), nll(2, 3)])) < 1e-12


def test_dense_and_sparse_models_agree(spark):
    rnd = random.Random(8)
    docs = [(i, [rnd.randrange(6) for _ in range(rnd.randrange(9))]) for i in range(30)]
    df = spark.createDataFrame(docs, "doc_id long, ids array<int>")
    counts = bigrams(df.filter("doc_id < 10"), "ids")
    dense, sparse = ({r.doc_id: (r.tokens, r.nll) for r in cross_entropy(
        df, counts, ["doc_id"], 6, 0.5, ids="ids", rows_bound=bound).collect()} for bound in (36, None))
    assert dense.keys() == sparse.keys() == {i for i, _ in docs}
    for k, (n, nll) in dense.items():
        assert n == sparse[k][0] and (nll is None) == (sparse[k][1] is None)
        assert nll is None or abs(nll - sparse[k][1]) < 1e-12
    losses = cross_entropy(df, counts, ["doc_id"], 6, 0.5, ids="ids", rows_bound=36)
    p = perplexity(losses).first()
    n = sum(v[0] for v in dense.values())
    mean = sum(v[0] * (v[1] or 0) for v in dense.values()) / n
    assert p.tokens == n and abs(p.nll - mean) < 1e-9 and abs(p.perplexity - math.exp(mean)) < 1e-9
    assert perplexity(losses.limit(0)).first().nll is None


def test_groups_are_required(spark):
    df = spark.createDataFrame([(0, 0, 1.0, 1.0)], "prev int, item int, score double, prob double")
    for call in (lambda: softmax(df, []), lambda: softmax(df, [], method="aggregate"), lambda: top_k(df, [], 2),
                 lambda: top_p(df, [], 0.5), lambda: draw_one(df, [], 1)):
        with pytest.raises(ValueError):
            call()


def test_softmax_methods_agree(spark):
    rnd = random.Random(3)
    rows = make_groups(rnd, 20) + [(99, i, float(i % 7)) for i in range(300)]  # one large group
    df = spark.createDataFrame(rows, "prev int, item int, score double")
    a = {(r.prev, r.item): r.prob for r in softmax(df, ["prev"], temperature=0.7).collect()}
    b = {(r.prev, r.item): r.prob for r in softmax(df, ["prev"], temperature=0.7, method="aggregate").collect()}
    assert a.keys() == b.keys()
    assert all(abs(a[k] - b[k]) < 1e-12 for k in a)


@pytest.mark.parametrize("p", [0.0, 0.3, 0.9, 1.0])
@pytest.mark.parametrize("bins, small", [(4, 3), (256, 10_000), (2, 1)])
def test_threshold_nucleus_equals_the_window(spark, p, bins, small):
    rng = random.Random(8)
    rows = [(g, i, rng.choice([0.0, 0.5, 1.5, -2.0]) if g % 2 else rng.gauss(0, 2)) for g in range(6) for i in range(1 + 40 * g)]
    rows += [(None, i, float(i % 3)) for i in range(20)] + [(99, 7, 1.0)]
    df = spark.createDataFrame(rows, "g int, item int, score double")
    want = sorted(map(tuple, scores.top_p(df, ["g"], p).select("g", "item").collect()), key=str)
    got = scores.top_p(df, ["g"], p, method="threshold", bins=bins, small=small)
    assert got.columns == df.columns and sorted(map(tuple, got.select("g", "item").collect()), key=str) == want


def test_threshold_nucleus_of_one_large_group(spark):
    """No task holds the group: its rows meet in histograms, and only the cut's bin is ordered."""
    df = spark.range(300_000).selectExpr("1 as g", "id as item", "cast(crc32(cast(id as string)) % 100003 as double) / 20000 as score")
    got = scores.top_p(df, ["g"], 0.7, method="threshold", small=500)
    want = scores.top_p(df, ["g"], 0.7)
    assert got.count() == want.count() and got.exceptAll(want).count() == 0
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "sum(_p#" not in plan and "Window" in plan  # prefix sums of parts, no running sum of a group


def test_rows_draw_apart_from_each_other(spark):
    probs = spark.createDataFrame([(1, k, 1.0 / 8, -float(k % 3)) for k in range(8)] + [(2, 5, 1.0, 0.0)], "prev int, item int, prob double, score double")
    table = scores.cumulative_table(probs, ["prev"])
    rows = spark.createDataFrame([(i, (1, 2, 3, None)[i % 4]) for i in range(400)], "id int, ctx int")
    got = {r.id: r.drawn for r in scores.draw_rows(rows, table, "ctx", ["id"], 42).collect()}
    order = sorted(range(8), key=lambda k: (k % 3, k))
    for i in range(400):
        u = int(hashlib.md5(f"42|{i}".encode()).hexdigest()[:8], 16) / 2**32
        want = {0: order[min(int(u * 8), 7)], 1: 5}.get(i % 4)
        assert got[i] == want
    assert len({got[i] for i in range(0, 400, 4)}) == 8


@pytest.mark.parametrize("cum", [[1.0], [0.5, 1.0], [0.1, 0.1, 0.4, 0.9], [k / 37 for k in range(1, 38)]])
def test_first_above_is_a_bisection(spark, cum):
    us = [0.0, 0.1, 0.35, 0.4, 0.89, 0.9, 0.99, 1.5]
    df = spark.createDataFrame([(u, cum) for u in us], "u double, cum array<double>")
    got = {r.u: r.at for r in df.select("u", scores.first_above(F.col("cum"), F.col("u")).alias("at")).collect()}
    assert got == {u: next((i for i, c in enumerate(cum) if c > u), len(cum) - 1) for u in us}
