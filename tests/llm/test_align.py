"""Token alignment against union-find over token overlaps and plain counting."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from tessera.llm import align

from .conftest import frame


def spans(parts):
    at, out = 0, []
    for p in parts:
        out.append((at, at + len(p)))
        at += len(p)
    return out


def brute(docs):
    """``{position: row}`` with groups by union-find over all pairs of overlapping tokens."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a_json, _, b_model = align.tokenizer_files()
    ta, tb = Tokenizer.from_file(a_json), SentencePieceProcessor(model_file=b_model)
    ta.encode_special_tokens = True
    signs = align.byte_signs()
    rows, held = [], Counter()
    for doc_id, text in docs:
        ids = [ta.encode(" " + text, add_special_tokens=False).ids, tb.encode(text)] if text else [[], []]
        parts = [[bytes(signs[c] for c in ta.id_to_token(i)) for i in ids[0]],
                 [bytes([int(tb.id_to_piece(i)[3:-1], 16)]) if tb.is_byte(i) else tb.id_to_piece(i).replace("▁", " ").encode()
                  for i in ids[1]]]
        if not text or any(b"".join(p) != (" " + text).encode() for p in parts):
            rows.append((doc_id, [], [], [], []))
            continue
        sa, sb = map(spans, parts)
        links, first = [], 0
        for i, (lo, hi) in enumerate(sa):
            while sb[first][1] <= lo:
                first += 1
            j = first
            while j < len(sb) and sb[j][0] < hi:
                links.append((i, j))
                j += 1
        root = {}

        def find(x):
            while root.get(x, x) != x:
                x = root[x]
            return x
        for i, j in links:
            root[find(("b", j))] = find(("a", i))
        groups = {}
        for side, n in (("a", len(sa)), ("b", len(sb))):
            for k in range(n):
                groups.setdefault(find((side, k)), ([], []))[side == "b"].append(k)
        groups = sorted(groups.values())
        pairs = [(ids[0][i], ids[1][j]) for i, j in links]
        held.update(set(pairs))
        rows.append((doc_id, ids[0], ids[1], [([ids[0][i] for i in a], [ids[1][j] for j in b]) for a, b in groups], pairs))
    most = Counter()
    for (a, _), n in held.items():
        most[a] = max(most[a], n)
    out = []
    for doc_id, a, b, groups, pairs in rows:
        text = ";".join("|".join(",".join(map(str, s)) for s in g) for g in groups)
        out.append((doc_id, len(a), len(b), len(groups), len(pairs), sum(held[p] == most[p[0]] for p in pairs),
                    sum(held[p] for p in pairs), hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return out


def key(row):
    return tuple((x is not None, x) for x in row)


def collected(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"))
                   for r in df.collect()), key=key)


ODD = [(None, "null id and naïve words"), (1, None), (2, ""), (3, "twice the same"), (3, "twice the same"), (3, "another"),
       (4, " "), (5, "  two  spaces \n\t and\x00zero"), (6, "a▁b lower block"), (7, "<|endoftext|> </s><unk> <0x41>"),
       (8, "\U0001f600 emoji 中文 ไทย ﬁ é"), (9, "x" * 5000), (10, "long words here " * 3000)]


@pytest.mark.parametrize("frequent", [align.FREQUENT, 50, 0])
def test_alignment_matches_union_find(spark, documents, frequent):
    docs = documents[:60]
    got = align.alignment_digests(frame(spark, docs), frequent=frequent)
    assert collected(got) == sorted(brute(docs), key=key)


def test_alignment_of_odd_rows(spark):
    want = sorted(brute(ODD), key=key)
    df = frame(spark, ODD, extra="row string, n_a double, a int, groups int, key string")
    assert collected(align.alignment_digests(df)) == want
    assert collected(align.alignment_digests(df, frequent=7)) == want
    by_id = {r[0]: r for r in want}
    assert by_id[6][1:] == (0, 0, 0, 0, 0, 0, "") == by_id[2][1:]  # U+2581 comes back as a space
    assert align.alignment_digests(df.limit(0)).count() == 0


def test_groups_are_spelled_in_order(spark):
    row = align.align_tokens(frame(spark, [(1, "tokenizers differ")])).first()
    flat = [[], []]
    for group in row.groups.split(";"):
        for side, ids in zip(flat, group.split("|"), strict=True):
            side += map(int, ids.split(","))
    enc = align.encoders(*align.tokenizer_files())
    a, b = next(enc.tokens(["tokenizers differ"]))
    assert flat == [a, b] and row.n_links == sum(row.times) == row.n_a + row.n_b - row.n_groups


@pytest.mark.parametrize("n", [1, 2, 17, 400])
def test_pointers_reach_the_last_token_of_a_group(n):
    rng = np.random.default_rng(n)
    cuts = [np.append(np.sort(rng.choice(np.arange(1, 5 * n + 1), n, replace=False)), 5 * n + 1) for _ in range(2)]
    label_a, label_b = align.group_labels(*cuts)
    shared = np.intersect1d(*cuts)
    for ends, label in zip(cuts, (label_a, label_b), strict=True):
        assert (cuts[0][label] == shared[np.searchsorted(shared, ends)]).all()
