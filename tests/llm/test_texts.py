"""Fingerprints, packing, substring dedup and near-duplicates against plain Python."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import fingerprints, neardup, packing, substrings

from .conftest import frame, plain

EDGE = [(None, "null id " * 9), (900_001, None), (900_002, ""), (900_003, "   \t\n"), (900_004, "one"),
        (900_005, "word " * 4000), (900_006, "a b " * 50), (900_007, "É" * 3000), (900_008, "same text here ok"),
        (900_008, "same text here ok"), (900_008, "other text, same id")]


def test_fingerprints_match_brute_force(spark, documents):
    docs = documents[:80]
    got = {r.doc_id: r for r in fingerprints.document_fingerprints(frame(spark, docs)).collect()}
    docs = sorted(docs)
    assert len(got) == len(docs)
    texts = []
    for i, (doc_id, text) in enumerate(docs):
        n, after = len(text), docs[(i + 1) % len(docs)][1]
        edited = text[:n - n // 2] + after[:n // 2]
        assert got[doc_id].n_chars == n
        assert got[doc_id].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert got[doc_id].next_fp == got[docs[(i + 1) % len(docs)][0]].fp
        texts += [(text, got[doc_id].fp), (edited, got[doc_id].edited_fp)]
    shingles = sorted({s for t, _ in texts for s in shingle_list(t)})
    hashed = spark.createDataFrame([(i, " ".join(s), list(s)) for i, s in enumerate(shingles)], "i int, s string, w array<string>")
    h = [F.xxhash64(F.get("w", F.lit(k))) for k in range(5)]
    known = {tuple(r.w): r.h for r in hashed.select("w", F.xxhash64(
        *[F.when(F.size("w") > k, h[k]) for k in range(5)]).alias("h")).collect()}
    for text, fp in texts:
        terms = [known[s] & (2**64 - 1) for s in shingle_list(text)]
        bits = sum(1 << b for b in range(64) if 2 * sum(t >> b & 1 for t in terms) > len(terms))
        assert fp & (2**64 - 1) == bits


def shingle_list(text, size=5):
    ws = plain(text)
    return [tuple(ws[i:i + size]) for i in range(max(1, len(ws) - size + 1))] if ws else []


def test_fingerprints_of_edge_rows(spark):
    rows = fingerprints.document_fingerprints(frame(spark, EDGE)).collect()
    assert len(rows) == len(EDGE) - 1  # rows equal in id and text are one document
    by = {r.doc_id: r for r in rows}
    assert by[900_001].fp == by[900_002].fp == by[900_003].fp == 0 and by[900_001].n_chars == 0
    assert None in by and by[900_006].fp != 0
    assert fingerprints.document_fingerprints(frame(spark, EDGE).limit(0)).count() == 0
    one = fingerprints.document_fingerprints(frame(spark, [(1, "abcd")])).first()
    assert one.next_fp == one.fp and one.edited_sha256 == hashlib.sha256(b"abab").hexdigest()


def test_half_edited_texts_are_nearer_than_next_ones(spark, documents):
    rows = fingerprints.document_fingerprints(frame(spark, [d for d in documents if len(d[1]) > 200]))
    m = rows.agg(F.avg(fingerprints.likeness(F.col("fp"), F.col("edited_fp"))),
                 F.avg(fingerprints.likeness(F.col("fp"), F.col("next_fp")))).first()
    assert m[0] > m[1] + 0.1


@pytest.mark.parametrize(("radius", "blocks"), [(3, 6), (0, 1), (2, 3)])
def test_block_tables_find_every_near_pair(spark, radius, blocks):
    rng = random.Random(radius)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = {b for x in base for b in [x, *(x ^ sum(1 << k for k in rng.sample(range(64), d)) for d in range(1, 6))]}
    signed = [f - 2**64 if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed + signed[:10] + [None]], "fp long")
    want = {(a, b, bin((a ^ b) & (2**64 - 1)).count("1")) for a in signed for b in signed if a < b}
    want = {w for w in want if w[2] <= radius}
    got = [tuple(r) for r in fingerprints.near_fingerprints(df, radius, blocks).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    some = spark.createDataFrame([(f,) for f in signed[::7]], "fp long")
    asked = {tuple(r) for r in fingerprints.near_fingerprints(df, radius, blocks, some).collect()}
    assert asked == {(a, b, d) for x, y, d in want for a, b in ((x, y), (y, x)) if a in signed[::7]}


def test_pieces_are_a_round_trip(spark, documents):
    docs = [*documents, *EDGE, (900_009, "it's <|endoftext|> 数字 ­ x"), (900_010, "don't  stop\r\n\r\n now 'll 'S ½ ª")]
    json_path, rank_path = packing.tokenizer_paths()
    from tokenizers import Tokenizer

    plain_tokenizer = Tokenizer.from_file(json_path)
    rows = [tuple(r) for r in packing.pack_documents(frame(spark, docs)).collect()]
    want = []
    for doc_id, text in docs:
        ids = [*plain_tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        raw = np.array(ids, "<u4").tobytes()
        want += [(doc_id, s, n, zlib.crc32(raw[4 * s:4 * (s + n)]), len(ids)) for s, n in packing.pieces(len(ids))]
    assert sorted((r[:5] for r in rows), key=str) == sorted(want, key=str)
    assert sorted(r[5] for r in rows) == list(range(len(rows))) and all(r[6] == 0 for r in rows)
    lengths = [r[2] for r in sorted(rows, key=lambda r: r[5])]
    assert lengths == sorted(lengths, reverse=True) and all(n & (n - 1) == 0 and n <= 2048 for n in lengths)
    assert packing.pack_documents(frame(spark, docs).limit(0)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 2047, 2048, 2049, 10_000])
def test_pieces_cover_every_token_once(n):
    out = packing.pieces(n)
    assert [s for s, _ in out] == list(np.cumsum([0, *(k for _, k in out)])[:-1]) and sum(k for _, k in out) == n
    assert len(out) <= n // 2048 + 11


def brute_substrings(docs, window):
    rows = sorted({(d is not None, d or 0, d, (t or "").encode()) for d, t in docs}, key=lambda r: r[:2])
    first, out = {}, {}
    for _, _, d, t in rows:
        words = t.split()
        gone = set()
        for s in range(len(words) - window + 1):
            w = tuple(words[s:s + window])
            if w in first:
                gone.update(range(s, s + window))
            first.setdefault(w, 1)
        kept = [w for k, w in enumerate(words) if k not in gone]
        out[d, t] = (len(words), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest())
    return sorted(((d, *out[d, (t or "").encode()]) for d, t in docs), key=str)


@pytest.mark.parametrize(("window", "minimiser", "hot"), [(20, 5, 5000), (4, 2, 5000), (4, 2, 3), (3, 3, 0)])
def test_substrings_match_brute_force(spark, documents, window, minimiser, hot):
    rng = random.Random(window)
    words = [w for _, t in documents[:20] for w in t.split()]
    shared = [words[k:k + 60] for k in range(0, 600, 60)]
    docs = documents[:60] + [
        (500 + k, " ".join(rng.choices("abc", k=30) + rng.choice(shared)[rng.randrange(20):] + rng.choices(words, k=40)))
        for k in range(60)] + [(700 + k, " ".join(["x"] * k)) for k in range(0, 60, 7)] + [(800, "a b c " * 200)]
    docs += [(1, None), (2, ""), (None, " ".join(shared[0])), (3, "tiny"), (4, " ".join(["run"] * 700))]
    docs = [(d if d is None else d * 10 + i % 10, t) for i, (d, t) in enumerate(docs)]  # ids differ
    docs += [docs[70]]  # and one row repeats
    got = substrings.substring_digests(frame(spark, docs), window=window, minimiser=minimiser, hot=hot)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_substrings(docs, window)


def test_a_window_in_every_document_is_no_list(spark, monkeypatch):
    """One passage in all documents: buckets see none of its windows, and memory does not follow the number of places."""
    line = " ".join(f"common{k}" for k in range(24))
    docs = [(k, f"own{k} {line} tail{k} " + " ".join(f"w{k}x{j}" for j in range(30))) for k in range(400)]
    rows = frame(spark, docs).select("doc_id", F.lit(0).cast("long").alias("tie"), "text")
    sizes = []
    dealt = substrings.repeat_rows

    def seen(window):
        sizes.append(window)
        return dealt(window)
    monkeypatch.setattr(substrings, "repeat_rows", seen)
    got = substrings.repeated_ranges(rows, hot=100)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert sizes == [20] and "Join Inner" in plan and "min(struct" in plan
    assert sorted((tuple(r) for r in substrings.substring_digests(frame(spark, docs), hot=100).collect()), key=str) == \
        brute_substrings(docs, 20)
    packed = list(substrings.packed_rows(20)([pa.RecordBatch.from_pylist(
        [{"doc_id": 1, "tie": 0, "text": docs[0][1], "found": [{"mini": 1, "start": 0, "n": 3, "hot": False}]}])]))
    assert packed[0].num_rows == 1


def test_remove_repeats_keeps_rows_and_columns(spark):
    text = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(1, f"{text}  alone", "en", 0), (2, f"head {text} tail", "en", 0), (3, None, None, 0),
                                (4, "as  it\nis", "fr", 10)], "doc_id long, text string, ranges string, n_chars long")
    got = {r.doc_id: r for r in substrings.remove_repeats(df).collect()}
    assert substrings.remove_repeats(df).columns == df.columns and len(got) == 4
    assert got[1].text == f"{text}  alone" and got[2].text == "head tail" and got[2].n_chars == 9
    assert got[3].text is None and got[4].text == "as  it\nis"
    assert substrings.remove_repeats(df.limit(0)).count() == 0


def brute_similarity(x, y):
    """Probability Jaccard of two weighted sets, by its definition."""
    every = x.keys() | y.keys()
    return sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in every) for i in x.keys() & y.keys())


def brute_classes(docs, similarity=0.8):
    sets = {d: {g: 1 + math.log(n) for g, n in Counter(shingle_list(t)).items()} for d, t in docs}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            # a link has at least this share of either text's weight in common
            if any(sum(s[g] for g in sets[a].keys() & sets[b].keys()) < 0.79 * sum(s.values()) for s in (sets[a], sets[b])):
                continue
            if sets[a] and sets[b] and brute_similarity(sets[a], sets[b]) >= similarity - 1e-9:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d: root(d) for d in ids}


def near_copy_docs(documents):
    rng = random.Random(5)
    docs = list(documents[:70])
    for k, (d, t) in enumerate(documents[:40]):
        ws = t.split()
        for c in range(3):  # copies drift one after another, so some classes are chains
            for _ in range(1 + len(ws) // 60):
                ws[rng.randrange(len(ws))] = rng.choice(["alpha", "beta", "gamma"])
            docs.append((10_000 + 10 * k + c, " ".join(ws)))
        docs.append((20_000 + k, t.upper()))
    return docs


def test_near_copies_match_brute_force(spark, documents):
    docs = near_copy_docs(documents)
    got = {r.doc_id: r.class_id for r in neardup.near_copies(frame(spark, docs)).collect()}
    want = brute_classes(docs)
    assert got == want and len(set(want.values())) < len(docs) - 60
    kept = neardup.drop_near_copies(frame(spark, docs))
    assert kept.columns == frame(spark, docs).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def test_near_copies_that_repeat_shared_words_unequally(spark):
    """Repeats weigh: a text that says a line very often is like another only as far as their weights agree."""
    rng = random.Random(4)
    docs = []
    for k in range(24):
        once, line, own = ([f"w{rng.randrange(100_000)}" for _ in range(n)] for n in (45, 49, 18))
        docs += [(2 * k, " ".join(once + line)), (2 * k + 1, " ".join(once + line * (1, 2, 3, 5, 40, 300)[k % 6] + own[:2 * (k // 6)]))]
    want = brute_classes(docs)
    assert {k % 6 for k in range(24) if want[2 * k + 1] == 2 * k} >= {0, 1} and want[11] == 11
    assert {r.doc_id: r.class_id for r in neardup.near_copies(frame(spark, docs)).collect()} == want


@pytest.mark.parametrize("top", [1, 4])
def test_similarity_equals_its_definition(top):
    rng = np.random.default_rng(top)
    for _ in range(60):
        n = int(rng.integers(1, 40))
        keys = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        a, b = (rng.random(len(keys)) < 0.85 for _ in range(2))
        if not a.any() or not b.any():
            continue
        x, y = (neardup.weights(rng.integers(1, top + 1, len(keys))) for _ in range(2))
        want = brute_similarity(dict(zip(keys[a], x[a], strict=True)), dict(zip(keys[b], y[b], strict=True)))
        for least in (want - 1e-6, want + 1e-6):
            linked, lacking = neardup.probability_jaccard(keys[a], x[a], keys[b], y[b], least)
            assert linked == (want >= least and (a & b).any()) and set(keys[a][lacking]) == set(keys[a & ~b])
        assert not (a & b).any() or neardup.bound(x[a & ~b].sum() / x[a].sum(), y[b & ~a].sum() / y[b].sum()) >= want - 1e-9


def test_near_copies_of_edge_rows(spark):
    rows = neardup.near_copies(frame(spark, EDGE)).collect()
    assert len(rows) == len(EDGE) - 1
    assert sum(r.kept for r in rows) == len(rows)
    kept = neardup.drop_near_copies(frame(spark, EDGE)).collect()
    assert len(kept) == len(rows)
    same = [(1, "the very same few words"), (2, "The very, same few words."), (None, "the very same few words")]
    assert [(r.doc_id, r.class_id) for r in neardup.near_copies(frame(spark, same)).collect() if r.kept] == [(None, None)]
    assert neardup.near_copies(frame(spark, EDGE).limit(0)).count() == 0


def test_shingle_sets_are_joined_alike_at_every_size(spark):
    docs = spark.createDataFrame([(1, 0, "a b c d e f"), (None, 0, "a b"), (2, 0, "not asked for")],
                                 "doc_id long, tie long, text string")
    sets = neardup._shingle_sets(docs.filter("doc_id is null or doc_id = 1").select(F.struct("doc_id", "tie").alias("node")), docs, 5)
    assert {(r.node.doc_id, len(r.shingles)) for r in sets.collect()} == {(1, 2), (None, 1)}
    plan = sets._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_registers_agree_with_probability_jaccard():
    rng = np.random.default_rng(3)
    for share, scale in ((0.3, 1.0), (0.8, 1.0), (0.6, 4.0)):
        n, m = 400, 4096
        keys = rng.integers(0, 2**63, n, dtype=np.uint64)
        a, b = np.ones(n), np.ones(n)
        a[: int(n * (1 - share) / 2)] = 0
        b[int(n * (1 - share) / 2): int(n * (1 - share))] = 0
        a[-50:] *= scale
        both = np.flatnonzero((a > 0) & (b > 0))
        want = sum(1 / np.maximum(a / a[i], b / b[i]).sum() for i in both)
        sig = neardup.prob_minhash(np.repeat([0, 1], [(a > 0).sum(), (b > 0).sum()]), np.concatenate((keys[a > 0], keys[b > 0])),
                                   np.concatenate((a[a > 0], b[b > 0])), 2, m)
        assert (sig[0] == sig[1]).mean() == pytest.approx(want, abs=5 * math.sqrt(want * (1 - want) / m))


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 300), (500, 501), (501, 500)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.label for r in neardup.components(df).collect()}
    assert {n for n, x in got.items() if x == 0} == {*range(1, 41), 300}
    assert {n for n, x in got.items() if x == 100} == set(range(101, 160)) and got[501] == 500


def test_near_copies_of_a_large_drifting_group(spark):
    """Copies of one text with few to many edits: links to the first, between copies, and none at all."""
    rng = random.Random(9)
    vocabulary = [f"w{k}" for k in range(400)]
    base = [rng.choice(vocabulary) for _ in range(150)]
    docs = [(1, " ".join(base))]
    for k in range(160):
        ws = (base if k % 3 else docs[rng.randrange(len(docs))][1].split())[:]
        for _ in range(rng.randrange(1, 9)):
            ws[rng.randrange(len(ws))] = f"new{rng.randrange(10_000)}"
        docs.append((k + 2, " ".join(ws)))
    want = brute_classes(docs)
    assert 5 < len(set(want.values())) < 120
    assert {r.doc_id: r.class_id for r in neardup.near_copies(frame(spark, docs)).collect()} == want
