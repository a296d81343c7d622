"""Quality scores from weak labels.

Eight heuristic labellers look at simple shares of a text and vote good, bad or not at
all. The texts are counted by vote pattern (at most 3^8 rows), and expectation-
maximisation on those counts estimates how each labeller votes on good and on bad
texts and how common bad texts are, with votes independent given the class. The
posterior of a text's pattern is its soft label.

The labels train a linear scorer over hashed features (words, and word shapes: runs of
lower-case, upper-case, digit and other signs, and a mark for a repeated word), as
shares of the text's words. It is fitted on ``SAMPLE`` texts in order of a hash of the
id; pattern counts cover all texts. Scoring is one pass over whole texts without a
shuffle.

Null texts and texts without words get score 0 and are not kept. Repeated rows come
back repeated. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import sample_texts
from tessera.llm.wordarrays import Words, buffers, chunks, mix, seeded, spaced_table

#: (share, good up to, bad from): a share between the two gives no vote.
LABELLERS = (
    ("same_as_previous", 0.04, 0.20),
    ("symbols", 0.005, 0.03),
    ("upper_letters", 0.20, 0.60),
    ("exclamations", 0.004, 0.03),
    ("symbol_words", 0.02, 0.15),
    ("long_words", 0.05, 0.30),
    ("scarce_words", 0.30, 0.70),
    ("unlettered_words", 0.08, 0.30),
)
SYMBOLS = b"#$%&*+<=>@[]^_`{|}~\\"
ROUNDS = 200
SAMPLE = 10_000
#: Features of the linear scorer: the most frequent ones of the sample, in at least LEAST_TEXTS texts.
MOST_FEATURES, LEAST_TEXTS = 20_000, 5
BUCKETS = 1 << 18
FIT_ROUNDS = 200
RATE = 0.5
RIDGE = 1e-6
KEEP = 0.5


def _kinds() -> np.ndarray:
    """Sign of each byte for word shapes: one for each kind of letter and digit, others by themselves."""
    t = np.arange(256, dtype=np.uint8)
    t[97:123], t[65:91], t[48:58], t[128:] = 97, 65, 48, 97
    return t


def shares(w: Words) -> np.ndarray:
    """Texts x labellers, in the order of ``LABELLERS``; nan for a text without words."""
    raw, n_docs = w.raw, w.n_docs
    size = np.maximum(1, np.diff(w.offs)).astype(float)
    at = w.offs[:-1]

    def per_doc(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return total[w.offs[1:]] - total[at]

    def per_word(flags: np.ndarray) -> np.ndarray:
        return np.bincount(w.doc[flags], minlength=n_docs)

    words = np.where(w.per_doc > 0, w.per_doc, np.nan)
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    symbolic = symbol[raw]
    upper = per_doc((raw >= 65) & (raw <= 90))
    lower = per_doc(((raw >= 97) & (raw <= 122)) | (raw >= 0xC3))
    same = np.zeros(len(w.key), bool)
    same[1:] = (w.key[1:] == w.key[:-1]) & (w.doc[1:] == w.doc[:-1])
    in_word = np.concatenate(([0], np.cumsum(symbolic, dtype=np.int64)))
    letters = np.concatenate(([0], np.cumsum(((raw | 32) >= 97) & ((raw | 32) <= 122) | (raw >= 128), dtype=np.int64)))
    ends = w.start + w.length
    order = np.lexsort((w.key, w.doc))
    k, d = w.key[order], w.doc[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (d[1:] != d[:-1])
    distinct = np.bincount(d[new], minlength=n_docs)
    # distinct words against those that a text of its length usually has, about its length to the power 0.7
    scarce = 1 - np.minimum(1, distinct / np.maximum(1, np.nan_to_num(words, nan=1.0)) ** 0.7)
    out = np.stack([
        per_word(same) / words, per_doc(symbolic) / size, upper / np.maximum(1, upper + lower),
        per_doc(raw == 33) / size, per_word(in_word[ends] > in_word[w.start]) / words,
        per_word(w.length > 25) / words, scarce, per_word(letters[ends] == letters[w.start]) / words], axis=1)
    out[w.per_doc == 0] = np.nan
    return out


def votes(share: np.ndarray) -> np.ndarray:
    """0 for no vote, 1 good, 2 bad; a text without words gets no vote at all."""
    out = np.zeros(share.shape, np.int8)
    for j, (_, good, bad) in enumerate(LABELLERS):
        out[:, j] = np.where(share[:, j] >= bad, 2, np.where(share[:, j] <= good, 1, 0))
    return out


def patterns(vote: np.ndarray) -> np.ndarray:
    return vote.astype(np.int64) @ (3 ** np.arange(vote.shape[1], dtype=np.int64))


@dataclass(frozen=True)
class LabelModel:
    prior: float        # share of good texts
    tables: np.ndarray  # labellers x (good, bad) x (no vote, good, bad)

    def posterior(self, vote: np.ndarray) -> np.ndarray:
        """Probability that a text is good, given its votes."""
        logs = np.log([self.prior, 1 - self.prior])[None, :].repeat(len(vote), 0)
        for j in range(vote.shape[1]):
            logs += np.log(self.tables[j])[:, vote[:, j]].T
        return 1 / (1 + np.exp(np.clip(logs[:, 1] - logs[:, 0], -500, 500)))


def fit_labels(vote: np.ndarray, count: np.ndarray, rounds: int = ROUNDS) -> LabelModel:
    """Expectation-maximisation from vote patterns with their counts, started at the majority.

    The prior stays within 0.02 and 0.98, so one class cannot take all texts.
    """
    n = vote.shape[1]
    good, bad = (vote == 1).sum(1), (vote == 2).sum(1)
    q = np.where(bad > 0, 0.1 * (good > bad), 0.9) + 0.05
    model = None
    for _ in range(rounds):
        total = count.sum()
        weight = np.stack((q * count, (1 - q) * count))
        prior = float(np.clip(weight[0].sum() / total, 0.02, 0.98))
        tables = np.stack([np.stack([np.array([weight[c][vote[:, j] == v].sum() + 0.5 for v in range(3)])
                                     for c in range(2)]) for j in range(n)])
        tables /= tables.sum(axis=2, keepdims=True)
        model = LabelModel(prior, tables)
        new = model.posterior(vote)
        if np.abs(new - q).max() < 1e-9:
            break
        q = new
    return model


def hashed_features(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, bucket and share of each distinct feature: words, word shapes, repeated words."""
    if not len(w.key):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    kind = _kinds()[w.raw]
    head = np.zeros(len(w.raw) + 1, bool)
    head[w.start] = True
    change = np.ones(len(w.raw), bool)
    change[1:] = (kind[1:] != kind[:-1]) | head[1:-1]
    inside = spaced_table()[w.raw] != 0
    at = np.flatnonzero(change & inside)  # the first byte of each run of one kind
    first = np.searchsorted(at, w.start)
    place = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
    with np.errstate(over="ignore"):
        each = seeded(51, 256)[kind[at]] * seeded(52, int(place.max()) + 1)[place]
        shape = mix(np.add.reduceat(each, first))
    same = np.zeros(len(w.key), bool)
    same[1:] = (w.key[1:] == w.key[:-1]) & (w.doc[1:] == w.doc[:-1])
    doc = np.concatenate((w.doc, w.doc, w.doc[same]))
    bucket = np.concatenate((w.key % np.uint64(BUCKETS), shape % np.uint64(BUCKETS),
                             np.full(same.sum(), 7, np.uint64))).astype(np.int64)
    pair, n = np.unique(doc * BUCKETS + bucket, return_counts=True)
    doc = pair // BUCKETS
    return doc, pair % BUCKETS, n / w.per_doc[doc]


def fit_scorer(row: np.ndarray, col: np.ndarray, x: np.ndarray, q: np.ndarray, rounds: int = FIT_ROUNDS) -> np.ndarray:
    """Logistic regression on soft labels (AdaGrad over all rows); the last weight is the constant."""
    used, col = np.unique(col, return_inverse=True)
    w, g2 = np.zeros(len(used) + 1), np.full(len(used) + 1, 1e-8)
    # both classes weigh alike, however rare one is
    weight = q / max(q.sum(), 1e-9) + (1 - q) / max((1 - q).sum(), 1e-9)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, weights=w[:-1][col] * x, minlength=len(q)) + w[-1], -50, 50)))
        e = weight * (p - q)
        g = np.append(np.bincount(col, weights=e[row] * x, minlength=len(used)) + RIDGE * w[:-1], e.sum())
        g2 += g * g
        w -= RATE * g / np.sqrt(g2)
    out = np.zeros(BUCKETS + 1)
    out[used], out[-1] = w[:-1], w[-1]
    return out


def vote_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of vote patterns, summed over each batch."""
    for b in batches:
        raw, offs = buffers(b.column("text"))
        for lo, hi in chunks(offs):
            w = Words(raw, offs, lo, hi, spaced_table())
            pattern, n = np.unique(patterns(votes(shares(w)))[w.per_doc > 0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pattern), pa.array(n.astype(np.int64))], ["pattern", "n"])


def feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        raw, offs = buffers(b.column("text"))
        for lo, hi in chunks(offs):
            w = Words(raw, offs, lo, hi, spaced_table())
            doc, bucket, x = hashed_features(w)
            ends = np.searchsorted(doc, np.arange(w.n_docs + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(patterns(votes(shares(w)))), pa.ListArray.from_arrays(pa.array(ends), pa.array(bucket.astype(np.int32))),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.float32)))], ["pattern", "cols", "x"])


def _unpacked(pattern: np.ndarray) -> np.ndarray:
    return (pattern[:, None] // 3 ** np.arange(len(LABELLERS))[None, :] % 3).astype(np.int8)


def fit_quality(docs: DataFrame, sample: int = SAMPLE) -> tuple[LabelModel | None, np.ndarray | None]:
    counts = docs.select("text").mapInArrow(vote_rows, "pattern long, n long").groupBy("pattern").agg(
        F.sum("n").alias("n")).toPandas().sort_values("pattern")
    if not len(counts):
        return None, None
    labels = fit_labels(_unpacked(counts["pattern"].to_numpy()), counts["n"].to_numpy().astype(float))
    ids = docs.select("doc_id").filter("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = sample_texts(docs, ids, ["doc_id"]).select("text")
    rows = rows.mapInArrow(feature_rows, "pattern long, cols array<int>, x array<float>")
    # only features of several sample texts are fitted, so that the driver receives few of them
    known = (rows.select(F.explode("cols").alias("c")).groupBy("c").count()
             .filter(F.col("count") >= LEAST_TEXTS).orderBy(F.desc("count"), "c").limit(MOST_FEATURES))
    keep = np.zeros(BUCKETS, bool)
    keep[[r["c"] for r in known.collect()]] = True
    got = rows.mapInArrow(_only(keep), rows.schema).toArrow().combine_chunks()
    if not len(got):
        return labels, np.zeros(BUCKETS + 1)
    cols, x = got.column("cols").combine_chunks(), got.column("x").combine_chunks()
    row = np.repeat(np.arange(len(got)), pc.list_value_length(cols).to_numpy())
    q = labels.posterior(_unpacked(got.column("pattern").to_numpy()))
    return labels, fit_scorer(row, cols.flatten().to_numpy().astype(np.int64), x.flatten().to_numpy().astype(float), q)


def _only(keep: np.ndarray):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols, x = b.column("cols"), b.column("x")
            flat, value = cols.flatten().to_numpy(), x.flatten().to_numpy()
            ends = np.concatenate(([0], np.cumsum(np.diff(cols.offsets.to_numpy()))))
            inside = keep[flat]
            total = np.concatenate(([0], np.cumsum(inside)))[ends].astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [b.column("pattern"), pa.ListArray.from_arrays(pa.array(total), pa.array(flat[inside])),
                 pa.ListArray.from_arrays(pa.array(total), pa.array(value[inside]))], ["pattern", "cols", "x"])
    return rows


def quality(text: Column, labels: LabelModel | None, weights: np.ndarray | None) -> Column:
    """Struct of a text: ``score`` of the linear scorer and ``weak_label``, the posterior of its votes."""
    @F.pandas_udf("struct<score:double,weak_label:double>")
    def score(texts: pd.Series) -> pd.DataFrame:
        raw, offs = buffers(pa.array(texts, pa.string(), from_pandas=True))
        s, q = np.zeros(len(texts)), np.zeros(len(texts))
        for lo, hi in chunks(offs) if labels is not None else ():
            w = Words(raw, offs, lo, hi, spaced_table())
            doc, bucket, x = hashed_features(w)
            margin = np.bincount(doc, weights=weights[:-1][bucket] * x, minlength=hi - lo) + weights[-1]
            some = w.per_doc > 0
            s[lo:hi] = np.where(some, 1 / (1 + np.exp(-np.clip(margin, -50, 50))), 0.0)
            q[lo:hi] = np.where(some, labels.posterior(votes(shares(w))), 0.0)
        return pd.DataFrame({"score": s, "weak_label": q})
    return score(text)


def score_quality(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Per document: ``doc_id, score, weak_label, keep``."""
    labels, weights = fit_quality(docs, sample)
    out = docs.select("doc_id", quality(F.col("text"), labels, weights).alias("r"))
    return out.select("doc_id", "r.score", "r.weak_label", (F.col("r.score") >= KEEP).alias("keep"))
