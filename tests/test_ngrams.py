"""Kneser-Ney models against a plain version of the formula."""

import math
import random
from collections import Counter, defaultdict

import pytest

from tessera.operators import ngrams, scores, tokens

SF = "/root/testdata/sf0.001"


def plain_model(texts, order, V):
    tables = [Counter(((None,) * (order - 1) + tuple(t))[i:i + order] for t in texts for i in range(len(t)))]
    for _ in range(order - 1):
        tables.insert(0, Counter(g[1:] for g in tables[0]))
    levels = []
    for t in tables:
        n1, n2 = (sum(c == k for c in t.values()) for k in (1, 2))
        total, types = defaultdict(int), defaultdict(int)
        for g, c in t.items():
            total[g[:-1]] += c
            types[g[:-1]] += 1
        levels.append((t, total, types, n1 / (n1 + 2 * n2) if n1 else 0.5))

    def p(h, w, n=order):
        if not n:
            return 1 / V
        t, total, types, d = levels[n - 1]
        h = h[len(h) - n + 1:]
        low = p(h, w, n - 1)
        return low if not total[h] else max(t[(*h, w)] - d, 0) / total[h] + d * types[h] / total[h] * low
    return p


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, ids array<int>")


@pytest.mark.parametrize("order, V", [(1, 5), (2, 5), (3, 5), (4, 300)])
def test_losses_match_the_formula(spark, order, V):
    rng = random.Random(order)
    texts = [[min(V - 1, int(rng.expovariate(0.7))) for _ in range(rng.randrange(0, 40))] for _ in range(50)] + [[], None]
    train, test = texts[:40], texts[30:]
    p = plain_model([t for t in train if t], order, V)
    levels = ngrams.learn(frame(spark, train), order, V)
    got = {r.doc_id: r for r in ngrams.cross_entropy(frame(spark, test), levels, ["doc_id"], V).collect()}
    assert len(got) == len(test)
    for k, t in enumerate(test):
        padded = (None,) * (order - 1) + tuple(t or ())
        want = [math.log(p(padded[i:i + order - 1], padded[i + order - 1])) for i in range(len(t or ()))]
        assert got[k].tokens == len(want)
        assert got[k].nll is None if not want else math.isclose(got[k].nll, -sum(want) / len(want), rel_tol=1e-9)


def test_probabilities_of_a_context_sum_to_one(spark):
    rng = random.Random(3)
    levels = ngrams.learn(frame(spark, [[rng.randrange(6) for _ in range(30)] for _ in range(9)]), 3, 7)
    pairs = [(h, w) for h in (0, 9, 17, 63) for w in range(7)]
    rows = ngrams.probabilities(spark.createDataFrame(pairs, "h long, w int"), levels, 7).collect()
    for h in {h for h, _ in pairs}:
        assert math.isclose(sum(r.p for r in rows if r.h == h), 1, rel_tol=1e-9)


def test_longer_contexts_predict_held_out_texts_better(spark):
    docs = tokens.encode_bytes(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"))
    train, test = docs.filter("doc_id % 5 > 0"), docs.filter("doc_id % 5 = 0")
    total = {}
    for order in (2, 3, 4):
        r = scores.perplexity(ngrams.cross_entropy(test, ngrams.learn(train, order, 257), ["doc_id"], 257)).first()
        total[order] = r.perplexity
    bigram = scores.perplexity(scores.cross_entropy(test, scores.bigrams(train), ["doc_id"], 257, ids="ids", rows_bound=257 * 257)).first()
    assert total[4] < total[3] < total[2] < 1.05 * bigram.perplexity and total[3] < 0.8 * bigram.perplexity


def test_contexts_that_do_not_fit_are_refused(spark):
    with pytest.raises(ValueError, match="do not fit"):
        ngrams.learn(frame(spark, [[1]]), 6, 50_000)
