"""K1-K5 against a direct list rendering of the windowing rule."""

import random

import pytest

from tessera.functions.bytes import EOS_ID
from tessera.operators.packing import corpus_summary, doc_offsets, pack


def reference_windows(docs, L):
    stream = []
    for _, ids in docs:
        stream += ids + [EOS_ID]
    W = max((len(stream) - 1) // L, 0)
    return {w: (stream[w * L:w * L + L], stream[w * L + 1:w * L + L + 1]) for w in range(W)}, len(stream)


@pytest.fixture(autouse=True)
def several_parts(spark):
    """Sorted tables of several parts, as large ones have."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def run(spark, docs, L):
    df = spark.createDataFrame(docs, "doc_id long, ids array<int>")
    return {r.window_id: (list(r.input), list(r.target)) for r in pack(df, L).collect()}


@pytest.mark.parametrize("L", [1, 2, 3, 8])
def test_pack_random(spark, L):
    rnd = random.Random(L)
    for _ in range(3):
        docs = [(i * 7 + rnd.randrange(3), [rnd.randrange(256) for _ in range(rnd.choice([0, 1, 2, 5, 17, 40]))])
                for i in range(rnd.randrange(1, 25))]
        docs = list({d[0]: d for d in docs}.values())
        docs.sort()
        exp, _ = reference_windows(docs, L)
        assert run(spark, docs, L) == exp


@pytest.mark.parametrize("N", [0, 1, 8, 9, 16, 17])
def test_pack_stream_lengths(spark, N):
    # one document whose stream (tokens + EOS) has exactly N tokens; N=0 means no documents
    L = 8
    docs = [] if N == 0 else [(1, list(range(N - 1)))]
    exp, n = reference_windows(docs, L)
    assert n == N
    got = run(spark, docs, L) if docs else {}
    assert got == exp
    assert len(got) == max((N - 1) // L, 0)


def test_long_doc_and_many_small(spark):
    L = 5
    docs = [(1, [1, 2]), (2, list(range(10, 30))), (3, [7]), (4, []), (5, [9, 9, 9]), (6, list(range(100, 117)))]
    exp, _ = reference_windows(docs, L)
    got = run(spark, docs, L)
    assert got == exp
    ws = sorted(got)
    for w in ws:
        inp, tgt = got[w]
        assert inp[1:] == tgt[:-1]           # shift by one inside a window
        if w + 1 in got:
            assert tgt[-1] == got[w + 1][0][0]  # neighbours share one token


def test_offsets_and_summary(spark):
    docs = [(3, [1, 2, 3]), (1, []), (2, [5] * 10)]
    df = spark.createDataFrame(docs, "doc_id long, ids array<int>")
    off = {r.doc_id: (r.n, r.start, r.total) for r in doc_offsets(df).collect()}
    assert off == {1: (1, 0, 16), 2: (11, 1, 16), 3: (4, 12, 16)}
    s = corpus_summary(df, 4).first()
    assert (s.docs, s.tokens, s.windows, s.tail) == (3, 16, 3, 3)
    empty = corpus_summary(spark.createDataFrame([], "doc_id long, ids array<int>"), 4).first()
    assert (empty.docs, empty.tokens, empty.windows, empty.tail) == (0, 0, 0, 0)


@pytest.mark.parametrize("L", [1, 3, 8])
def test_pack_text_path_with_eos_literals(spark, L):
    """Text shuffled and encoded after the exchange, boundary windows from a
    bounded prefix/suffix — including EOS literals cut at the prefix/suffix edge."""
    from tessera.operators.corpus import drop_blank  # noqa: F401
    from tessera.plans import pretrain

    rnd = random.Random(100 + L)
    pieces = ["a", "é", "<|endoftext|>", "xy", "€", " "]
    texts = ["".join(rnd.choice(pieces) for _ in range(rnd.choice([1, 2, 5, 14, 40]))) for _ in range(30)]
    docs = []
    for i, t in enumerate(texts):
        ids = []
        for j, part in enumerate(t.split("<|endoftext|>")):
            if j:
                ids.append(EOS_ID)
            ids.extend(part.encode("utf-8"))
        docs.append((i, ids))
    exp, _ = reference_windows(docs, L)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    from tessera.functions.bytes import encode_ids, encoded_length, head_text, tail_text
    w = pack(df.withColumn("n_ids", encoded_length("text")), L, ids=encode_ids("text"), n_ids="n_ids",
             head_ids=encode_ids(head_text("text", L + 1)), tail_ids=encode_ids(tail_text("text", L + 1)))
    got = {r.window_id: (list(r.input), list(r.target)) for r in w.collect()}
    assert got == exp


@pytest.mark.parametrize("L", [1, 3, 8])
def test_stream_bigrams_equal_window_pairs(spark, L):
    from collections import Counter

    from tessera.operators.packing import stream_bigrams
    rnd = random.Random(L * 7)
    docs = [(i, [rnd.randrange(5) for _ in range(rnd.choice([0, 1, 2, 6, 19]))]) for i in range(25)]
    exp, _ = reference_windows(docs, L)
    want = Counter()
    for inp, tgt in exp.values():
        want.update(zip(inp, tgt))
    df = spark.createDataFrame(docs, "doc_id long, ids array<int>")
    got = {(r.prev, r.next): r["count"] for r in stream_bigrams(df, L).collect()}
    assert got == dict(want)


def test_repeated_keys_raise(spark):
    df = spark.createDataFrame([(1, [1]), (2, [2]), (1, [3])], "doc_id long, ids array<int>")
    for call in (lambda: doc_offsets(df), lambda: pack(df, 2)):
        with pytest.raises(Exception, match="repeated key"):
            call().collect()


def test_text_is_scanned_twice_at_most(spark, monkeypatch):
    """One scan for the lengths, written once; one for the windows, whose two branches share its exchange."""
    from tessera.plans import pretrain
    from tessera.sources import tables

    from .conftest import SF0001
    monkeypatch.setattr(tables, "balance", lambda df, key: df)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as on large tables
    try:
        w = pretrain.windows(spark, SF0001, 64)
        w.collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    final = w._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert sum("documents.parquet" in line for line in final.splitlines() if "FileScan" in line) == 1


def test_bigrams_are_counted_without_a_row_for_each_pair(spark):
    from tessera.operators import packing

    rows = [(1, [5, 5, 5]), (2, []), (3, [7]), (4, [5, 7, 9, 9]), (5, list(range(200)) * 3)]
    df = spark.createDataFrame(rows, "doc_id long, ids array<int>").repartition(2)
    for L in (1, 4, 50, 10_000):
        stream = [x for _, ids in rows for x in [*ids, 256]]
        n = (len(stream) - 1) // L * L
        want = {}
        for pair in zip(stream[:n], stream[1:n + 1]):
            want[pair] = want.get(pair, 0) + 1
        out = packing.stream_bigrams(df, L)
        assert {(r["prev"], r["next"]): r["count"] for r in out.collect()} == want
        assert "Generate" not in out._jdf.queryExecution().optimizedPlan().toString()
