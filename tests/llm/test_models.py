"""Language, toxicity and quality models: held-out accuracy, and defined results on odd rows."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import language, quality, toxicity

from .conftest import frame

SF = "/root/testdata/sf0.01"
ODD = [(None, "null id text"), (1, None), (2, ""), (3, " \n\t"), (4, "12 34 !!"), (5, "x" * 60_000), (6, "a"), (6, "a"),
       (7, "É è ñ 数字")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_languages_on_held_out_documents(spark, docs):
    rows = language.identify_languages(docs).join(docs, "doc_id").select(
        "doc_id", "held_out", "lang_pred", "score", "lang").collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.97


def test_languages_of_odd_rows(spark, docs):
    odd = frame(spark, ODD, extra="source string, score double").withColumn("lang", F.lit(None).cast("string"))
    both = docs.select("doc_id", "text", "source", F.lit(0.0).alias("score"), "lang").union(odd)
    got = language.identify_languages(both).filter("lang_pred = 'und'").collect()
    assert len(got) >= 4 and all(r.score == 0 for r in got)
    alone = language.identify_languages(odd).collect()
    assert len(alone) == len(ODD) and {r.lang_pred for r in alone} == {"und"}
    assert language.identify_languages(odd.limit(0)).count() == 0


def test_kernel_model_equals_the_kernel_form():
    texts = ["the cat sat", "le chat est", "the dog ran", "la vie est", "une autre", "another one"]
    names = ["en", "fr", "en", "fr", "fr", "en"]
    sets = [np.unique(language.gram_codes(t)).astype(np.int64) for t in texts]
    model = language.fit_kernel(names, sets, landmarks=2, ridge=1e-2)
    chosen = [0, 2, 1, 3]
    kernel = lambda a, b: len(np.intersect1d(a, b)) / np.sqrt(len(a) * len(b))
    knm = np.array([[kernel(s, sets[c]) for c in chosen] for s in sets])
    kmm = np.array([[kernel(sets[a], sets[c]) for c in chosen] for a in chosen])
    y = np.array([[1.0 if n == x else -1.0 for x in ("en", "fr")] for n in names])
    alpha = np.linalg.lstsq(knm.T @ knm + 1e-2 * len(sets) * kmm + 1e-9 * np.eye(4), knm.T @ y, rcond=None)[0]
    import pandas as pd

    got, some = model.scores(pd.Series(texts))
    assert some.all() and np.allclose(got, knm @ alpha, atol=1e-3)


def test_toxicity_on_documents_without_their_label(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    learn = labels.filter("doc_id % 2 = 0")
    rows = toxicity.grade_documents(docs, learn).join(labels.filter("doc_id % 2 = 1"), "doc_id").collect()
    toxic, clean = [r for r in rows if r.toxic], [r for r in rows if not r.toxic]
    assert sum(r.rejected for r in clean) <= 0.01 * len(clean)
    assert sum(r.rejected for r in toxic) >= 0.6 * len(toxic)
    assert all(0 <= r.p_toxic <= r.severity <= 2 for r in rows)
    kept = toxicity.drop_toxic(docs, learn)
    gone = {r.doc_id for r in toxicity.grade_documents(docs, learn).filter("rejected").collect()}
    assert kept.columns == docs.columns and kept.count() == docs.count() - len(gone)


def test_toxicity_of_unseen_documents_at_a_larger_size(spark):
    big = SF.replace("sf0.01", "sf0.1")
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    rows = toxicity.grade_documents(docs, labels.filter("doc_id % 2 = 0")).join(labels.filter("doc_id % 2 = 1"), "doc_id").collect()
    toxic, clean = [r for r in rows if r.toxic], [r for r in rows if not r.toxic]
    assert sum(r.rejected for r in toxic) >= 0.94 * len(toxic) and sum(r.rejected for r in clean) <= 0.01 * len(clean)


def test_toxicity_of_odd_rows_and_labels(spark):
    rows = [*ODD, *[(100 + k, f"kind words here {k} idiot" if k % 2 else f"kind words here {k}") for k in range(60)]]
    labels = [(100 + k, k % 2) for k in range(60)] * 2 + [(None, 1), (101, None), (103, 0), (1, 0), (2, 0)]
    df, marks = frame(spark, rows, extra="toxic int, severity double"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.grade_documents(df, marks).collect()
    assert len(got) == len(rows)
    assert {r.doc_id for r in got if r.rejected} == {100 + k for k in range(1, 60, 2)}
    for none in (marks.limit(0), marks.filter("toxic = 0")):
        assert all(r.severity == 0 and not r.rejected for r in toxicity.grade_documents(df, none).collect())
        assert toxicity.drop_toxic(df, none).count() == len(rows)
    assert toxicity.grade_documents(df.limit(0), marks).count() == 0


def test_samples_hold_one_row_of_a_repeated_id(spark):
    """A document that repeats very often fills no sample, and brings one text of its id."""
    from tessera.llm.common import sample_texts

    rows = [(1, f"copy {k % 3}") for k in range(500)] + [(k, f"text {k}") for k in range(2, 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sample_texts(df, df.select("doc_id").distinct(), ["doc_id"]).collect()
    assert len(got) == 39 and {r.text for r in got if r.doc_id == 1} == {"copy 0"}
    labels, weights = quality.fit_quality(df, sample=30)
    assert labels is not None and weights is not None


def test_scores_equal_a_plain_sum(spark, docs):
    """Margins of the fitted model, feature by feature in plain Python."""
    from collections import Counter

    from tessera.llm.wordarrays import BYTE_WEIGHTS, mix, seeded

    from .conftest import plain

    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.fit_severity(docs, labels)
    rows = docs.select("doc_id", "text").limit(25).collect()
    weight = dict(zip(model.buckets.tolist(), model.weights.tolist(), strict=True))
    mask = 2**64 - 1

    def bucket(word):
        raw = word.encode()
        powers, p = seeded(2, len(raw)).tolist(), {n: seeded(40 + n, n).tolist() for n in toxicity.PREFIXES}
        total = sum(int(BYTE_WEIGHTS[b]) * powers[j] for j, b in enumerate(raw)) + len(raw) * 0xD6E8FEB86659FD93 & mask
        yield int(mix(np.array([total & mask], np.uint64))[0]) % toxicity.BUCKETS
        for n in toxicity.PREFIXES:
            if len(raw) >= n:
                begin = sum(int(BYTE_WEIGHTS[raw[j]]) * p[n][j] for j in range(n)) & mask
                yield int(mix(np.array([begin], np.uint64))[0]) % toxicity.BUCKETS
    import pyarrow as pa

    got = model.margins(pa.array([r.text for r in rows]))
    for r, margin in zip(rows, got, strict=True):
        counts = Counter(b for w in plain(r.text) for b in bucket(w))
        assert margin == pytest.approx(sum(weight[b] * np.log1p(n) for b, n in counts.items() if b in weight), abs=1e-9)


def test_ordinal_fit_orders_grades():
    rng = np.random.default_rng(1)
    n, k = 3000, 6
    x = rng.integers(0, 3, (n, k))
    margin = x @ np.array([2.0, 1.0, 0.5, 0, -1.0, -0.5])
    cuts = np.array([1.0, 3.0])
    grade = (margin[:, None] + rng.logistic(size=(n, 1)) > cuts).sum(1)
    row, col = np.nonzero(x)
    weights, thetas = toxicity.fit_ordinal(row, col, x[row, col].astype(float), grade, k, rounds=1500)
    assert np.allclose(weights, [2, 1, 0.5, 0, -1, -0.5], atol=0.25) and np.allclose(thetas, cuts, atol=0.35)
    p = toxicity.OrdinalModel(np.arange(k), weights, thetas).exceeds(margin)
    assert (p[:, 0] >= p[:, 1]).all()


def test_quality_against_labels(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet").filter("quality is not null")
    rows = quality.score_quality(docs).join(labels, "doc_id").collect()
    good, bad = [r for r in rows if r.quality], [r for r in rows if not r.quality]
    assert sum(r.keep for r in good) >= 0.98 * len(good)
    assert sum(r.keep for r in bad) <= 0.1 * len(bad)
    assert all(0 <= r.score <= 1 and 0 <= r.weak_label <= 1 for r in rows)


def test_quality_of_odd_rows(spark, docs):
    odd = frame(spark, ODD, extra="score double, pattern long")
    got = quality.score_quality(odd).collect()
    assert len(got) == len(ODD)
    assert all(r.score == 0 and not r.keep for r in got if r.doc_id in (1, 2, 3))
    assert quality.score_quality(odd.limit(0)).count() == 0


def test_em_recovers_labellers():
    rng = np.random.default_rng(2)
    n = 20_000
    good = rng.random(n) < 0.8
    says = np.array([0.9, 0.8, 0.85, 0.75, 0.95, 0.7, 0.8, 0.9])
    votes = np.where(rng.random((n, 8)) < 0.3, 0, np.where((rng.random((n, 8)) < says) == good[:, None], 1, 2)).astype(np.int8)
    pattern, count = np.unique(quality.patterns(votes), return_counts=True)
    model = quality.fit_labels(quality._unpacked(pattern), count.astype(float))
    assert abs(model.prior - good.mean()) < 0.02
    accuracy = model.tables[:, 0, 1] / model.tables[:, 0, 1:].sum(1)
    assert np.allclose(accuracy, says, atol=0.03)
    assert ((model.posterior(votes) > 0.5) == good).mean() > 0.97
