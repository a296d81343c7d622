"""Driver contract, streaming = batch, and every registered query against its DuckDB oracle."""

import math
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as E
from tessera.functions.rules import DEFAULT_RULES
from tessera.operators.redact import redact
from tessera.plans.catalog import QUERIES
from tessera.plans.oracle import ORACLE_SQL
from tessera.session import shared_dir
from tessera.sources.tables import load_corpus
from tessera.streaming.redact_stream import run_redaction_stream

from .conftest import SF0001

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def test_entry(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert sorted(df.columns) == ["docs", "hits", "residual", "tag"]
    assert len(rows) == len(DEFAULT_RULES) and all(r.residual == 0 for r in rows)


def test_contract_keys():
    assert set(QUERIES) == set(ORACLE_SQL)
    assert set(QUERIES) <= set(E.queries()) and set(E.oracle_sql()) <= set(E.queries())


def test_stream_equals_batch(spark):
    sink = shared_dir(spark, "test-stream")
    s = run_redaction_stream(spark, f"{SF0001}/documents*.parquet",
                             "doc_id bigint, text string, lang string, source string, n_chars bigint",
                             sink, sink + "-ckpt")
    b = redact(load_corpus(spark, SF0001)).select("doc_id", "text")
    assert s.exceptAll(b).count() == 0 and b.exceptAll(s).count() == 0


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF0001}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i].lower())
    return Counter(tuple(_norm(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, name):
    df = E.queries()[name](spark, SF0001)
    s_rows = [tuple(r) for r in df.collect()]
    cur = duck.execute(E.oracle_sql()[name])
    d_cols = [d[0] for d in cur.description]
    d_rows = cur.fetchall()
    assert sorted(c.lower() for c in df.columns) == sorted(c.lower() for c in d_cols)
    assert _rows(df.columns, s_rows) == _rows(d_cols, d_rows)


def test_stream_restart_exactly_once(spark):
    """Files arriving in two batches, the stream restarted from its checkpoint:
    every document comes out once."""
    from pyspark.sql import functions as F

    schema = "doc_id bigint, text string"
    docs = load_corpus(spark, SF0001)
    inbox = shared_dir(spark, "test-inbox")
    sink = shared_dir(spark, "test-sink")
    ckpt = sink + "-ckpt"
    docs.filter(F.col("doc_id") % 2 == 0).write.parquet(inbox + "/part=a")
    first = run_redaction_stream(spark, inbox + "/*", schema, sink, ckpt)
    n_first = first.count()
    docs.filter(F.col("doc_id") % 2 == 1).write.parquet(inbox + "/part=b")
    second = run_redaction_stream(spark, inbox + "/*", schema, sink, ckpt)
    b = redact(docs).select("doc_id", "text")
    assert 0 < n_first < second.count() == docs.count()
    assert second.exceptAll(b).count() == 0 and b.exceptAll(second).count() == 0


def test_stream_keeps_blank_and_null_rows(spark):
    inbox, sink = shared_dir(spark, "test-blank"), shared_dir(spark, "test-blank-sink")
    rows = [(1, "a.b@c.org"), (2, "  "), (3, None), (4, "")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(inbox)
    out = run_redaction_stream(spark, inbox, "doc_id bigint, text string", sink, sink + "-ckpt")
    assert sorted(tuple(r) for r in out.collect()) == [(1, "[EMAIL]"), (2, "  "), (3, None), (4, "")]


def test_full_schedule(spark):
    from tessera.plans import catalog

    w = E.queries()["corpus_summary"](spark, SF0001).first()["windows"]
    n = E.queries()["shuffle_batches"](spark, SF0001).count()
    assert n == catalog.EPOCHS * (w // catalog.BATCH) * catalog.BATCH
    pairs = E.queries()["weak_pairs"](spark, SF0001).count()
    assert E.queries()["shuffle_batches_keep_last"](spark, SF0001).count() == catalog.EPOCHS * pairs


def test_terms_are_hit(spark):
    before = {r.doc_id: r.text for r in load_corpus(spark, SF0001).collect()}
    after = {r.doc_id: r.text for r in E.queries()["redact_terms"](spark, SF0001).collect()}
    assert sum(after[k] != t for k, t in before.items()) > 50
    assert sum(t.count("[WORD]") + t.count("[PHRASE]") for t in after.values()) > 1000
