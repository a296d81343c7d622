"""Toxicity grades by cumulative-link ordinal regression.

Features are hashed words and word beginnings (``PREFIXES`` bytes), valued by the log
of one plus their count. One weight vector is shared by all thresholds:
``P(grade <= k) = 1 / (1 + exp(w.x - theta_k))`` with rising thetas, and the expected
severity is the sum of ``P(grade >= k)`` over ``k >= 1``.

``labels`` knows toxic or not. The toxic rows are split into two ordered grades at
the median of their evidence (log counts of features that speak for toxicity), so
grades are 0 (clean), 1 and 2. Fitting uses a bounded sample of labelled rows,
at most ``MOST_TOXIC`` and ``MOST_CLEAN`` in order of a hash of the id. Features are chosen by their chi-square
against the label, at most ``MAX_FEATURES``; choice and fit see counts and chosen
features only, never texts on the driver. A text is rejected from the probability of a
grade above 0 that splits the sample's labels best. Scoring is one pass over whole texts
without a shuffle. Grade 2 is cut out of the toxic rows by this model's own evidence, as the
labels have no degrees: it orders texts, it is no label.

Null or empty texts have no features and get the severity of an empty text. Without
rows of both labels nothing is learnt: every severity is 0. Repeated label rows of a
document count once (toxic if any says so); repeated documents come back repeated, and teach once.
Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import sample_texts
from tessera.llm.wordarrays import BYTE_WEIGHTS, Words, buffers, chunks, mix, plain_table, seeded

BUCKETS = 1 << 20
PREFIXES = (4, 5, 6)
MOST_TOXIC, MOST_CLEAN = 5_000, 15_000
MAX_FEATURES = 4_000
LEAST_DOCS = 3
LEAST_CHI2 = 30.0
ROUNDS = 400
RATE = 0.1
RIDGE = 1e-4


def features(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Text and bucket of every feature occurrence."""
    doc, bucket = [w.doc], [w.key % np.uint64(BUCKETS)]
    sign = plain_table()[w.raw]
    for p in PREFIXES:
        long = np.flatnonzero(w.length >= p)
        factors = seeded(40 + p, p)
        with np.errstate(over="ignore"):
            total = np.zeros(len(long), np.uint64)
            for j in range(p):
                total += BYTE_WEIGHTS[sign[w.start[long] + j]] * factors[j]
        doc.append(w.doc[long])
        bucket.append(mix(total) % np.uint64(BUCKETS))
    return np.concatenate(doc), np.concatenate(bucket).astype(np.int64)


def counted(doc: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, bucket) with the number of occurrences."""
    pair, n = np.unique(doc * BUCKETS + bucket, return_counts=True)
    return pair // BUCKETS, pair % BUCKETS, n


@dataclass(frozen=True)
class OrdinalModel:
    buckets: np.ndarray  # sorted
    weights: np.ndarray
    thetas: np.ndarray   # rising; empty: nothing learnt
    reject: float = 2.0  # probability of a grade above 0 from which a text is rejected

    def exceeds(self, margin: np.ndarray) -> np.ndarray:
        """``P(grade >= k)`` for k = 1, 2, ... by row."""
        return 1 / (1 + np.exp(np.clip(self.thetas[None, :] - margin[:, None], -50, 50)))

    def margins(self, texts: pa.Array) -> np.ndarray:
        raw, offs = buffers(texts)
        out, table = np.zeros(len(offs) - 1), plain_table()
        known = np.zeros(BUCKETS, bool)
        known[self.buckets] = True
        value = np.zeros(BUCKETS)
        value[self.buckets] = self.weights
        for lo, hi in chunks(offs):
            doc, bucket = features(Words(raw, offs, lo, hi, table))
            hit = known[bucket]
            doc, bucket, n = counted(doc[hit], bucket[hit])
            out[lo:hi] = np.bincount(doc, weights=value[bucket] * np.log1p(n), minlength=hi - lo)
        return out


def fit_ordinal(row: np.ndarray, col: np.ndarray, x: np.ndarray, grade: np.ndarray, n_cols: int,
                rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Weights and rising thresholds of the proportional-odds model, by Adam on all rows.

    ``row, col, x`` are the non-zero feature values, ``grade`` runs from 0 to its maximum.
    """
    top = int(grade.max())
    n = len(grade)
    share = np.array([max((grade >= k).mean(), 0.5 / n) for k in range(1, top + 1)])
    start = -np.log(share / np.maximum(1 - share, 0.5 / n))
    # thresholds as a first value and positive steps, which keeps them in order
    gaps = np.log(np.maximum(np.diff(start), 1e-2))
    theta = np.concatenate((np.zeros(n_cols), start[:1], gaps))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        steps = np.exp(theta[n_cols + 1:])
        cuts = np.cumsum(np.concatenate((theta[n_cols:n_cols + 1], steps)))
        margin = np.bincount(row, weights=theta[:n_cols][col] * x, minlength=n)
        p = 1 / (1 + np.exp(np.clip(cuts[None, :] - margin[:, None], -50, 50)))  # P(grade > k)
        upper = np.concatenate((np.ones((n, 1)), p), axis=1)
        low = np.concatenate((p, np.zeros((n, 1))), axis=1)
        at = np.arange(n)
        mass = np.maximum(upper[at, grade] - low[at, grade], 1e-12)
        slope = p * (1 - p)
        # d log mass / d cut_k: the cut above the grade adds mass, the one below takes it away
        d = np.zeros((n, top))
        has_above, has_below = grade < top, grade > 0
        d[at[has_above], grade[has_above]] += slope[at[has_above], grade[has_above]] / mass[has_above]
        d[at[has_below], grade[has_below] - 1] -= slope[at[has_below], grade[has_below] - 1] / mass[has_below]
        g_cut = -d.sum(axis=0) / n
        g_margin = d.sum(axis=1) / n
        g = np.concatenate((np.bincount(col, weights=g_margin[row] * x, minlength=n_cols) + RIDGE * theta[:n_cols],
                            [g_cut.sum()], np.cumsum(g_cut[::-1])[::-1][1:] * steps))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    cuts = np.cumsum(np.concatenate((theta[n_cols:n_cols + 1], np.exp(theta[n_cols + 1:]))))
    return theta[:n_cols], cuts


def best_cut(margin: np.ndarray, toxic: np.ndarray) -> float:
    """Margin with the least sum of missed and falsely rejected shares; the middle of equally good ones.

    It is positive, so a text without any chosen feature is never rejected.
    """
    order = np.argsort(margin, kind="stable")
    value, hit = np.concatenate(([0.0], np.maximum(margin[order], 0.0))), toxic[order] == 1
    missed = np.concatenate(([0], np.cumsum(hit))) / max(1, hit.sum())
    false = (~hit).sum() - np.concatenate(([0], np.cumsum(~hit)))
    error = missed + false / max(1, (~hit).sum())
    above = np.append(value[1:], value[-1] + 1)  # a cut after place i lies between these two values
    error[above <= value] = np.inf
    best = int(error.argmin())
    return float(max((value[best] + above[best]) / 2, 1e-6))


def count_rows():
    """Per batch: how many toxic and clean sample documents hold each bucket."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = plain_table()
        for b in batches:
            raw, offs = buffers(b.column("text"))
            toxic = b.column("toxic").to_numpy(zero_copy_only=False).astype(bool)
            for lo, hi in chunks(offs):
                doc, bucket, _ = counted(*features(Words(raw, offs, lo, hi, table)))
                all_, tox = (np.bincount(bucket[pick]) if pick.any() else np.zeros(1, np.int64)
                             for pick in (np.ones(len(doc), bool), toxic[lo:hi][doc]))
                at = np.flatnonzero(all_)
                tox = np.pad(tox, (0, max(0, len(all_) - len(tox))))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(at.astype(np.int64)), pa.array(all_[at].astype(np.int64)), pa.array(tox[at].astype(np.int64))],
                    ["bucket", "n", "toxic"])
    return rows


def sample_rows(buckets: np.ndarray):
    """Chosen features of each sample document."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = plain_table()
        known = np.full(BUCKETS, -1, np.int32)
        known[buckets] = np.arange(len(buckets), dtype=np.int32)
        for b in batches:
            raw, offs = buffers(b.column("text"))
            for lo, hi in chunks(offs):
                doc, bucket = features(Words(raw, offs, lo, hi, table))
                hit = known[bucket] >= 0
                doc, bucket, n = counted(doc[hit], bucket[hit])
                ends = np.searchsorted(doc, np.arange(hi - lo + 1)).astype(np.int32)
                part = b.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [part.column("toxic"), pa.ListArray.from_arrays(pa.array(ends), pa.array(known[bucket])),
                     pa.ListArray.from_arrays(pa.array(ends), pa.array(n.astype(np.int32)))], ["toxic", "cols", "n"])
    return rows


def fit_severity(docs: DataFrame, labels: DataFrame, most_toxic: int = MOST_TOXIC, most_clean: int = MOST_CLEAN,
                 max_features: int = MAX_FEATURES) -> OrdinalModel:
    """Learns the model from labelled documents (``labels``: ``doc_id, toxic`` 0 or 1)."""
    nothing = OrdinalModel(np.empty(0, np.int64), np.empty(0), np.empty(0))
    one = (labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id")
           .agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic")))
    picked = [one.filter(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
              for k, most in enumerate((most_clean, most_toxic))]
    sample = sample_texts(docs, picked[0].union(picked[1]), ["doc_id"]).select("text", "toxic")
    total = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(total) < 2:
        return nothing
    n1, n = float(total[1]), float(sum(total.values()))
    counts = sample.mapInArrow(count_rows(), "bucket long, n long, toxic long").groupBy("bucket").agg(
        F.sum("n").alias("n"), F.sum("toxic").alias("t"))
    df, t = F.col("n").cast("double"), F.col("t").cast("double")
    expected = df * (n1 / n)
    spread = expected * (1 - n1 / n) * F.greatest(1 - df / n, F.lit(1.0 / n))
    chi2 = (F.abs(t - expected) - 0.5) * F.abs(F.abs(t - expected) - 0.5) / spread
    chosen = (counts.filter(F.col("n") >= LEAST_DOCS).select("bucket", chi2.alias("c"), (t - expected).alias("lift"))
              .filter(F.col("c") >= LEAST_CHI2).orderBy(F.desc("c"), "bucket").limit(max_features).collect())
    if not chosen:
        return nothing
    chosen.sort(key=lambda r: r["bucket"])
    buckets = np.array([r["bucket"] for r in chosen], np.int64)
    lift = np.array([r["lift"] > 0 for r in chosen])
    # a few numbers per sample text, received as flat Arrow arrays
    got = sample.mapInArrow(sample_rows(buckets), "toxic int, cols array<int>, n array<int>").toArrow().combine_chunks()
    cols, times = (got.column(c).combine_chunks() for c in ("cols", "n"))
    toxic = got.column("toxic").to_numpy().astype(int)
    row = np.repeat(np.arange(len(toxic)), pc.list_value_length(cols).to_numpy())
    col, x = cols.flatten().to_numpy().astype(np.int64), np.log1p(times.flatten().to_numpy().astype(float))
    evidence = np.bincount(row, weights=x * lift[col], minlength=len(toxic))
    middle = np.median(evidence[toxic == 1])
    grade = np.where(toxic == 0, 0, 1 + (evidence > middle))
    weights, thetas = fit_ordinal(row, col, x, grade, len(buckets))
    margin = np.bincount(row, weights=weights[col] * x, minlength=len(toxic))
    model = OrdinalModel(buckets, weights, thetas)
    cut = best_cut(margin, toxic)
    return replace(model, reject=float(model.exceeds(np.array([cut]))[0, 0]))


def severity(text: Column, model: OrdinalModel) -> Column:
    """Struct of a text: ``severity`` (expected grade) and ``p_toxic`` (grade 1 or more)."""
    @F.pandas_udf("struct<severity:double,p_toxic:double>")
    def score(texts: pd.Series) -> pd.DataFrame:
        if not len(model.thetas):
            return pd.DataFrame({"severity": np.zeros(len(texts)), "p_toxic": np.zeros(len(texts))})
        p = model.exceeds(model.margins(pa.array(texts, pa.string(), from_pandas=True)))
        return pd.DataFrame({"severity": p.sum(axis=1), "p_toxic": p[:, 0]})
    return score(text)


def grade_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Per document: ``doc_id, severity, p_toxic, rejected``."""
    model = fit_severity(docs, labels, **options)
    out = docs.select("doc_id", severity(F.col("text"), model).alias("r"))
    return out.select("doc_id", "r.severity", "r.p_toxic", (F.col("r.p_toxic") >= model.reject).alias("rejected"))


def drop_toxic(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``docs`` without its rejected rows; every column stays as it is."""
    model = fit_severity(docs, labels, **options)
    return docs.filter(severity(docs["text"], model)["p_toxic"] < model.reject)
