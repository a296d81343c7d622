"""Subword learning, encoding and decoding against plain Python."""

import re
from collections import Counter

import pytest

from tessera.operators import subwords

SF = "/root/testdata/sf0.001"
UNIT = re.compile(r" ?[^ \t\n\r\f\x0B]+|[ \t\n\r\f\x0B]+")


def merged(symbols, lo, hi, new):
    out, i = [], 0
    while i < len(symbols):
        if symbols[i:i + 2] == [lo, hi]:
            out.append(new)
            i += 2
        else:
            out.append(symbols[i])
            i += 1
    return out


def plain_learn(texts, n, least=2):
    words = Counter(u for t in texts for u in UNIT.findall(t or ""))
    words = [(list(u.encode()), c) for u, c in words.items()]
    out = []
    while len(out) < n:
        pairs = Counter()
        for s, c in words:
            for p in zip(s, s[1:], strict=False):
                pairs[p] += c
        best = min(((-c, *p) for p, c in pairs.items() if c >= least), default=None)
        if best is None:
            break
        lo, hi = best[1:]
        out.append((lo, hi, 257 + len(out)))
        words = [(merged(s, *out[-1]), c) for s, c in words]
    return out


def plain_encode(text, merges):
    rank = {(lo, hi): (k, new) for k, (lo, hi, new) in enumerate(merges)}
    out = []
    for u in UNIT.findall(text or ""):
        s = list(u.encode())
        while True:
            best = min((rank[p] + p for p in zip(s, s[1:], strict=False) if p in rank), default=None)
            if best is None:
                break
            s = merged(s, best[2], best[3], best[1])
        out += s
    return out


ODD = [None, "", " ", "aaaa aaaaa aaa", "abab baba abab", "é é 中文 中文 \U0001f600", "a\x00b a\x00b\x00", "  two  spaces\n\n\tand tabs ",
       "<|endoftext|> stays text <|endoftext|>", "x" * 700, "ties ab cd ef ab cd ef gh gh"]


def learnt(df, n, **options):
    return [(r.lo, r.hi, r.id) for r in sorted(subwords.learn_merges(df, n, **options).collect())]


@pytest.mark.parametrize("n", [1, 7, 60])
def test_merges_equal_plain_learning_with_ties(spark, n):
    df = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")
    assert learnt(df, n) == plain_learn(ODD, n)


def test_merges_of_documents(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(60).collect()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain_learn([r.text for r in rows], 90)
    assert learnt(df, 90) == want
    assert learnt(df, 30, head=2) == want[:30]  # a short head changes the rounds, not the merges


def test_learning_stops_without_frequent_pairs(spark):
    df = spark.createDataFrame([(1, "ab ab ac")], "doc_id long, text string")
    assert learnt(df, 50) == plain_learn(["ab ab ac"], 50) and len(learnt(df, 50)) < 5
    assert learnt(df.limit(0), 50) == []


def test_encoding_equals_lowest_rank_first_and_comes_back(spark):
    texts = ODD + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").limit(40).collect()]
    df = spark.createDataFrame([(k % 30, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, ids string")
    merges = subwords.learn_merges(df, 80)
    plain = plain_learn(texts, 80)
    enc = subwords.encode_subwords(df, merges)
    assert sorted((r.doc_id, r.ids) for r in enc.collect()) == sorted((k % 30, plain_encode(t, plain)) for k, t in enumerate(texts))
    back = subwords.decode_subwords(enc, merges)
    assert sorted(map(tuple, back.collect())) == sorted((k % 30, t or "") for k, t in enumerate(texts))


def test_a_few_merges_need_no_exchange(spark):
    texts = ODD + ["a" * 3, "\u0100 \u0100\u0100 \xc4\x80", "e\u0301 \xe9\xe9"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    merges = subwords.learn_merges(df, 40)
    enc = subwords.encode_subwords(df, merges)
    back = subwords.decode_subwords(enc, merges)
    for frame in (enc, back):
        assert "Exchange" not in frame._jdf.queryExecution().executedPlan().toString()
    joined = subwords._encode_joined(df, merges, "doc_id", "text", "ids")
    assert sorted(map(tuple, enc.collect())) == sorted(map(tuple, joined.collect()))
    assert dict(map(tuple, back.collect())) == {k: t or "" for k, t in enumerate(texts)}
    odd = spark.createDataFrame([(1, [104, -1, 105, 100_000, None]), (2, None), (3, [])], "doc_id long, ids array<int>")
    assert dict(map(tuple, subwords.decode_subwords(odd, merges).collect())) == {1: "hi", 2: "", 3: ""}


def test_codec_without_merges(spark):
    df = spark.createDataFrame([(1, "né"), (2, None)], "doc_id long, text string")
    none = subwords.learn_merges(df.limit(0), 5)
    enc = subwords.encode_subwords(df, none)
    assert {r.doc_id: r.ids for r in enc.collect()} == {1: list("né".encode()), 2: []}
    assert {r.doc_id: r.text for r in subwords.decode_subwords(enc, none).collect()} == {1: "né", 2: ""}


def test_signs_and_symbols_are_inverse(spark):
    from pyspark.sql import functions as F

    ids = [0, 255, 257, 0xD7FF, 0xD800, 0xE000, 100_000]
    signs = [subwords.sign_of(i) for i in ids]
    df = spark.createDataFrame(list(zip(ids, signs, strict=True)), "id int, sign string")
    got = df.select("id", subwords.symbol_of(F.col("sign")).alias("back"), (subwords._sign(F.col("id")) == F.col("sign")).alias("same"))
    assert all(r.id == r.back and r.same for r in got.collect())


@pytest.mark.parametrize("pairs, n", [([(1, 2), (3, 4)], 2), ([(1, 2), (2, 3)], 1), ([(1, 2), (3, 1)], 1), ([(1, 1), (2, 3)], 1),
                                      ([(2, 3), (1, 1)], 1), ([(1, 2), (1, 3), (4, 2)], 3), ([], 0)])
def test_independent_prefix(pairs, n):
    assert subwords.independent_prefix(pairs) == n
