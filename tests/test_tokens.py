"""Vocabulary, and the lookup and join paths giving the same rows."""

import pytest

from tessera.operators import tokens
from tessera.operators.tokens import build_vocab, decode_vocab, encode_vocab, eos_id, vocab_size

TEXTS = [(0, "a b a c"), (1, "b\tb  d"), (2, ""), (3, "e"), (4, "a<|endoftext|> z"), (5, None), (6, "  "), (1, "a e"), (1, "a e"),
         (None, "b")]


def rows(df, col):
    return sorted(((r[0], list(r[1]) if col == "ids" else r[1]) for r in df.collect()), key=str)


def test_vocabulary_and_ids(spark):
    df = spark.createDataFrame([(0, "a b a c"), (1, "b\tb  d c a")], "doc_id long, text string")
    vocab = build_vocab(df, 5)  # three words, unknown and end
    assert [(r.token, r.id, r.freq) for r in vocab.orderBy("id").collect()] == [("a", 2, 3), ("b", 3, 3), ("c", 4, 2)]
    assert (eos_id(), vocab_size()) == (256, 257) and (eos_id(vocab), vocab_size(vocab)) == (1, 3)
    for size in (2, tokens.MAX_VOCAB + 1):
        with pytest.raises(ValueError):
            build_vocab(df, size)


def test_paths_agree_on_odd_rows(spark):
    df = spark.createDataFrame(TEXTS, "doc_id long, text string")
    vocab = build_vocab(spark.createDataFrame([(0, "a a a b b c")], "doc_id long, text string"), 5)
    want = sorted([(0, [2, 3, 2, 4]), (1, [3, 3, 0]), (2, []), (3, [0]), (4, [0, 0]), (5, []), (6, []), (1, [2, 0]), (1, [2, 0]),
                   (None, [3])], key=str)
    assert rows(encode_vocab(df, vocab, method="join"), "ids") == want
    assert rows(encode_vocab(df, vocab, method="lookup"), "ids") == want
    assert rows(encode_vocab(df, vocab), "ids") == want
    ids = spark.createDataFrame([(0, [2, 3, 1]), (0, [2, 3, 1]), (1, []), (2, None), (3, [99, 0, 4]), (None, [-5])],
                                "doc_id long, ids array<int>")
    want = sorted([(0, "a b <|endoftext|>"), (0, "a b <|endoftext|>"), (1, ""), (2, ""), (3, "<unk> <unk> c"), (None, "<unk>")],
                  key=str)
    for method in ("join", "lookup", "auto"):
        assert rows(decode_vocab(ids, vocab, method=method), "text") == want, method


def test_a_large_vocabulary_is_joined(spark, monkeypatch):
    df = spark.createDataFrame(TEXTS, "doc_id long, text string")
    vocab = build_vocab(df.filter("text is not null"), 6)
    small = rows(encode_vocab(df, vocab), "ids")
    monkeypatch.setattr(tokens, "LOOKUP_BYTES", 8)
    assert rows(encode_vocab(df, vocab), "ids") == small
    with pytest.raises(ValueError):
        encode_vocab(df, vocab, method="lookup")
