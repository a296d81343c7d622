"""Span agreement against plain alignment and planted spans."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.operators import agreement

WORD = re.compile(r"[^ \t\n\r\f\x0B]+")


def common(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t


def plain_spans(raw, red):
    if raw is None or red is None or raw == red:
        return []
    a, b = WORD.findall(raw), WORD.findall(red)
    t, i, j, pairs = common(a, b), len(a), len(b), []
    while i and j:
        if t[i][j] == t[i - 1][j]:
            i -= 1
        elif a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
            pairs.append((i, j))
        else:
            j -= 1
    ends = [(-1, -1), *reversed(pairs), (len(a), len(b))]
    return [(p[0] + 1, q[0], tag) for p, q in zip(ends, ends[1:], strict=False)
            for tag in sorted(set(re.findall(r"\[([A-Z]+)\]", " ".join(b[p[1] + 1:q[1]]))))]


@pytest.mark.parametrize("seed", [1, 2])
def test_spans_match_plain_alignment(spark, seed):
    rng = random.Random(seed)
    rows = [(None, "x"), ("x", None), ("", ""), ("a b", ""), ("", "[IP]"), ("a b a b", "[X] a [Y]"), ("same text", "same text")]
    for _ in range(60):
        a = rng.choices("abcd", k=rng.randrange(0, 12))
        b = [w if rng.random() < 0.6 else rng.choice(["[IP]", "([CARD])", "[IP][X]", "d"]) for w in a if rng.random() < 0.9]
        rows.append((" ".join(a), "  ".join(b)))
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, raw string, red string")
    got = {r.k: [tuple(s) for s in r.s] for r in df.select("k", agreement.redaction_spans("raw", "red").alias("s")).collect()}
    assert got == {k: plain_spans(*r) for k, r in enumerate(rows)}


def test_planted_spans_come_back(spark):
    rng = random.Random(5)
    rows = []
    for k in range(40):
        words = [f"w{rng.randrange(1000)}" for _ in range(20)]
        start = rng.randrange(0, 17)
        rows.append((k, " ".join(words), " ".join([*words[:start], "[NAME]", *words[start + 3:]]), start))
    df = spark.createDataFrame(rows, "k int, raw string, red string, start int")
    got = {r.k: [tuple(s) for s in r.s] for r in df.select("k", agreement.redaction_spans("raw", "red").alias("s")).collect()}
    assert got == {k: [(s, s + 3, "NAME")] for k, _, _, s in rows}


def test_agreement_by_tag(spark):
    rows = [("a 1 b", "a [IP] b", "a [IP] b"), ("a 1 b", "a [IP] b", "a 1 b"), ("a 1 2 b", "a [IP] 2 b", "a [IP] b"), ("a 1 b", "a 1 b", "a [CARD] b"),
            (None, None, None)]
    df = spark.createDataFrame([(1, *r) for r in rows], "g int, raw string, p string, t string")
    got = {r.tag: tuple(r)[2:] for r in agreement.span_agreement(df, "raw", "p", "t", ["g"]).collect()}
    assert got == {"IP": (3, 2, 1, 1 / 3, 0.5), "CARD": (0, 1, 0, None, 0.0)}
    assert agreement.span_agreement(df.limit(0), "raw", "p", "t").count() == 0


def test_long_texts_are_refused(spark):
    df = spark.createDataFrame([("x " * 600, "y")], "raw string, red string")
    with pytest.raises(Exception, match="cut the text"):
        df.select(agreement.redaction_spans("raw", F.col("red"))).collect()
