"""The composed pre-training job: windows written to the shared folder, schedule read back."""

from pyspark.sql import functions as F

from tessera.plans import pretrain

from .conftest import SF0001


def test_prepare_writes_schedule(spark):
    cfg = pretrain.PackConfig(L=64, batch_size=4, accum=2, steps=5, seed=1)
    out = pretrain.prepare(spark, SF0001, cfg=cfg)
    s = spark.read.parquet(out)
    assert s.agg(F.max("update_id")).first()[0] == 5
    # each update has `accum` micro-batches of `batch_size` windows
    per = s.groupBy("update_id").agg(F.countDistinct("epoch", "batch_idx").alias("mb"), F.count("*").alias("n"))
    assert all(r.mb == 2 and r.n == 8 for r in per.collect())
    win = pretrain.windows(spark, SF0001, 64)
    assert s.join(win.select("window_id"), "window_id", "left_anti").count() == 0
    rows = pretrain.batch_rows(s, win)
    assert rows.count() == s.count() and rows.filter(F.size("input") != 64).count() == 0


def test_finetune_prepare(spark):
    from tessera.plans import finetune

    ex_path, sched_path = finetune.prepare(spark, SF0001, L=64, batch_size=8, epochs=2)
    ex = spark.read.parquet(ex_path)
    s = spark.read.parquet(sched_path)
    n = ex.count()
    assert n == finetune.document_pairs(spark, SF0001).count()
    assert s.count() == 2 * n
    nb = -(-n // 8)
    assert s.agg(F.max("update_id")).first()[0] == 2 * nb   # short batch kept, one update per batch
    assert ex.filter(F.size("input") != 64).count() == 0


def test_buckets_grow_with_the_windows(spark, tmp_path):
    assert pretrain.enough_buckets(0, 512, 8) == 8 and pretrain.enough_buckets(20_000_000, 512, 8) > 1000
    cfg = pretrain.PackConfig(L=64, batch_size=4, accum=2, seed=1)
    sched, win = pretrain.prepare_tables(spark, SF0001, str(tmp_path), "v1", cfg, 1, buckets=2, bucket_bytes=1 << 16)
    n = win.count()
    files = {r[0] for r in win.select(F.input_file_name()).distinct().collect()}
    assert len(files) >= n * 2 * 64 * 4 >> 16 > 2
    assert pretrain.batch_rows(sched, win).count() == sched.count()


def test_pieces_of_few_vectors_need_no_exchange_of_vectors(spark):
    from tessera.operators import vectors

    rows = [(1, list(range(20)) * 4), (1, [5, None, -1, 5, 10**6]), (2, []), (3, None), (4, [7])]
    vecs = [(i, [float(i), i / 3]) for i in range(20) if i != 7] + [(10**9, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "k long, ids array<int>").coalesce(1)
    v = spark.createDataFrame(vecs, "vec_id long, embedding array<double>")
    few = vectors.lookup_vector_pieces(df, ["k"], v, 16)
    assert "ObjectHashAggregate" not in few._jdf.queryExecution().optimizedPlan().toString() and "SortAggregate" not in str(
        few.filter("piece < 0")._jdf.queryExecution().executedPlan().toString().split("BroadcastExchange")[0])
    limit, vectors.ROW_TABLE_BYTES = vectors.ROW_TABLE_BYTES, 0
    try:
        joined = vectors.lookup_vector_pieces(df, ["k"], v, 16)
    finally:
        vectors.ROW_TABLE_BYTES = limit
    got, want = ([(r.k, r.row, r.piece, r.vectors) for r in x.collect()] for x in (few, joined))
    assert sorted(got, key=str) == sorted(want, key=str) and len(got) == 7
