"""Properties of every position (lengths L-1 .. L+2, long prompt, empty answer), and arrays by hand."""

import pytest

from tessera.functions.bytes import EOS_ID
from tessera.operators.sft import scored_tokens, sft_audit, sft_examples

L = 32


def encode(s):
    out = []
    for j, part in enumerate(s.split("<|endoftext|>")):
        if j:
            out.append(EOS_ID)
        out.extend(part.encode("utf-8"))
    return out


#: raw, redacted, and what comes out with L = 32 (prompt tokens, all tokens, scored targets)
CASES = [
    # the prompt has 18 + len(raw) tokens, the answer len(red) + 1
    ("ab", "x" * (L - 1 - 20 - 1), 20, 31, 12),   # one token short of L
    ("ab", "x" * (L - 20 - 1), 20, 32, 13),       # exactly L
    ("ab", "x" * (L + 1 - 20 - 1), 20, 33, 14),   # L + 1: fits with its shift
    ("ab", "x" * (L + 2 - 20 - 1), 20, 34, 14),   # L + 2: cut
    ("y" * (L + 2 - 18), "z", 34, 36, 0),         # the prompt alone fills L + 2: all masked
    ("y" * 40, "z", 58, 60, 0),                   # a prompt beyond that
    ("abc", "", 21, 22, 2),                       # empty answer
    ("é€", "é<|endoftext|>x", 23, 28, 6),         # multibyte, and the literal end in the answer
]


def pairs(spark):
    return spark.createDataFrame([(i, c[0], c[1]) for i, c in enumerate(CASES)],
                                 "pair_id int, original_text string, redacted_text string")


@pytest.mark.parametrize("mode", ["uniform", "reference"])
def test_example_properties(spark, mode):
    out = {r.pair_id: r for r in sft_examples(pairs(spark), L, mode).withColumn("scored", scored_tokens()).collect()}
    for i, (raw, red, prompt, total, scored) in enumerate(CASES):
        r = out[i]
        tokens = encode(f"[RAW] {raw} [REDACTED] {red}<|endoftext|>")
        have = min(total, L + 1)
        size = max(L, have) if mode == "reference" else L
        assert (r.prompt_len, r.full_len, r.overflow) == (prompt, total, total > L + 1) and len(tokens) == total
        assert len(r.input) == len(r.target) == size
        assert list(r.input[:min(have, size)]) == tokens[:min(have, size)]
        assert set(r.input[have:]) <= {EOS_ID}
        # masked run, then the next token at each place, the end id after the last, then padding
        for k, t in enumerate(r.target):
            if k < prompt - 1 or k >= have:
                assert t == -100, (i, k)
            else:
                assert t == (tokens[k + 1] if k + 1 < have else EOS_ID), (i, k)
        if mode == "reference":
            assert r.scored == scored
        else:
            assert r.scored == sum(1 for k in range(L) if prompt - 1 <= k < have)


def test_example_arrays_by_hand(spark):
    df = spark.createDataFrame([(0, "a", "b"), (1, "a", "bcdef")], "pair_id int, original_text string, redacted_text string")
    head = list(b"[RAW] a [REDACTED] ")
    got = {r.pair_id: r for r in sft_examples(df, 22, "uniform").collect()}
    assert list(got[0].input) == [*head, 98, 256, 256]
    assert list(got[0].target) == [-100] * 18 + [98, 256, 256, -100]
    assert list(got[1].input) == [*head, 98, 99, 100]
    assert list(got[1].target) == [-100] * 18 + [98, 99, 100, 101] and got[1].overflow
    assert list(sft_examples(df, 22, "reference").filter("pair_id = 1").first().target) == [-100] * 18 + [98, 99, 100, 101, 256]


def test_audit(spark):
    rows = {r.overflow: r for r in sft_audit(sft_examples(pairs(spark), L)).collect()}
    assert rows[True].all_masked == 2
    assert rows[True].examples + rows[False].examples == len(CASES)
    assert rows[False].min_len == rows[False].max_len == L
