"""Loaders, schema checks, splits and the parquet sink."""

import pytest
from pyspark.sql import functions as F

from tessera.session import shared_dir
from tessera.sources.tables import (balance, id_bounds, load_corpus, load_pairs, rename_pairs, require_columns,
                                    write_windows)

from .conftest import SF0001


def test_require_columns(spark):
    df = spark.createDataFrame([(1, "a")], "source_text int, target_text string")
    assert require_columns(df, ["SOURCE_TEXT"]) is df
    with pytest.raises(ValueError):
        require_columns(df, ["missing"])


def test_pairs(spark):
    df = spark.createDataFrame([(7, "raw a", "red a", "x")], "id long, source_text string, target_text string, extra string")
    p = load_pairs(df, id_col="id").first()
    assert (p.pair_id, p.original_text, p.redacted_text) == (7, "raw a", "red a")
    r = rename_pairs(df)
    assert set(r.columns) == {"id", "original_text", "redacted_text", "extra"}
    with pytest.raises(ValueError):
        load_pairs(df.drop("target_text"))


def test_corpus_split_is_a_partition(spark):
    all_ids = {r.doc_id for r in load_corpus(spark, SF0001).collect()}
    train = {r.doc_id for r in load_corpus(spark, SF0001, split="train").collect()}
    hold = {r.doc_id for r in load_corpus(spark, SF0001, split="holdout").collect()}
    assert train | hold == all_ids and not (train & hold) and train and hold
    with pytest.raises(ValueError):
        load_corpus(spark, SF0001, split="dev")


def test_bounds_balance_and_sink(spark):
    lo, hi = id_bounds(spark, SF0001)
    ids = [r.doc_id for r in load_corpus(spark, SF0001).collect()]
    assert (lo, hi) == (min(ids), max(ids))
    df = spark.range(10).coalesce(1)
    assert balance(df, "id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    path = shared_dir(spark, "test-sink")
    write_windows(df.withColumn("p", F.col("id") % 2), path, partition_by=["p"])
    write_windows(df.withColumn("p", F.col("id") % 3), path, partition_by=["p"])  # whole-folder overwrite
    back = spark.read.parquet(path)
    assert back.count() == 10 and sorted(r.p for r in back.select("p").distinct().collect()) == [0, 1, 2]


def test_shared_folder_must_be_named_on_a_cluster(spark, monkeypatch):
    from types import SimpleNamespace

    from tessera import session

    def fake(master):
        conf = SimpleNamespace(get=lambda key, default=None: None, set=lambda *a: None)
        sc = SimpleNamespace(master=master, getCheckpointDir=lambda: None, getConf=lambda: conf, setCheckpointDir=lambda p: None)
        return SimpleNamespace(sparkContext=sc, conf=conf)
    for master in ("yarn", "spark://host:7077", "k8s://x", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            session.ensure_checkpoint_dir(fake(master))
    assert session.ensure_checkpoint_dir(fake("local[4]"))


def test_tables_are_released(spark, tmp_path):
    from tessera import session

    kept = list(session._TABLES)
    session._TABLES.clear()
    path = session.materialize(spark.range(3), "test-release").inputFiles()[0]
    assert session.release() == 1 and not __import__("os").path.exists(path.removeprefix("file:").removeprefix("//"))
    session._TABLES.extend(kept)


def test_sizes_decide_broadcasts(spark):
    from tessera.operators.sizes import broadcast_if_small, byte_size
    df = spark.createDataFrame([("a" * 100, [1.0] * 50, 1), (None, None, 2)], "s string, v array<double>, k long")
    assert byte_size(df) == (16 + 116 + 416 + 8) + (16 + 16 + 16 + 8)
    plan = lambda d: d._jdf.queryExecution().analyzed().toString()
    assert "broadcast" in plan(broadcast_if_small(df, 1000)) and "broadcast" not in plan(broadcast_if_small(df, 100))


def test_pooled_vectors_keep_rows(spark):
    from tessera.operators.vectors import lookup_vectors, pooled_vectors
    v = spark.createDataFrame([(1, [1.0, 3.0]), (2, [5.0, 7.0])], "vec_id int, embedding array<double>")
    df = spark.createDataFrame([(1, [1, 2, 2]), (2, []), (3, None), (4, [9]), (5, [1, 9]), (1, [1])], "k int, ids array<int>")
    got = sorted((r.k, r.tokens, r.missing, list(r.pooled) if r.pooled else None) for r in pooled_vectors(df, ["k"], v).collect())
    assert got == [(1, 1, 0, [1.0, 3.0]), (1, 3, 0, [11 / 3, 17 / 3]), (2, 0, 0, None), (3, 0, 0, None), (4, 0, 1, None),
                   (5, 1, 1, [1.0, 3.0])]
    gathered = sorted((r.k, r.vectors) for r in lookup_vectors(df, ["k"], v).collect())
    assert gathered[0] == (1, [[1.0, 3.0]]) and gathered[-1] == (5, [[1.0, 3.0], None]) and len(gathered) == 6
    with pytest.raises(ValueError):
        pooled_vectors(df, ["k"], v.union(spark.createDataFrame([(3, [1.0])], v.schema)))
    with pytest.raises(ValueError):
        pooled_vectors(df, ["k"], v.limit(0))
