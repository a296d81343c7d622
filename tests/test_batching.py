"""Shuffle order, batches, accumulation groups worked out by hand."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from tessera.operators import batching
from tessera.operators.batching import (batches, collate, cut_at, epochs_needed, last_tokens, limit_steps, shuffle,
                                        update_groups)
from tessera.operators.corpus import cap


#: (rows, batch size, accumulation, budget) -> update of each (epoch, batch), worked out by hand
UPDATES = {
    # 5 batches, 2 updates an epoch; the fifth batch joins the next epoch's first update
    (20, 4, 2, 7): {(0, 0): 1, (0, 1): 1, (0, 2): 2, (0, 3): 2, (0, 4): 3, (1, 0): 3, (1, 1): 3, (1, 2): 4, (1, 3): 4,
                    (1, 4): 5, (2, 0): 5, (2, 1): 5, (2, 2): 6, (2, 3): 6, (2, 4): 7, (3, 0): 7, (3, 1): 7},
    # 4 batches, 2 updates an epoch; the budget ends within the second epoch
    (16, 4, 2, 3): {(0, 0): 1, (0, 1): 1, (0, 2): 2, (0, 3): 2, (1, 0): 3, (1, 1): 3},
    # 2 batches, each its own update
    (9, 4, 1, 5): {(0, 0): 1, (0, 1): 2, (1, 0): 3, (1, 1): 4, (2, 0): 5},
    # 2 batches, 1 update an epoch
    (9, 4, 2, 3): {(0, 0): 1, (0, 1): 1, (1, 0): 2, (1, 1): 2, (2, 0): 3, (2, 1): 3},
    # 8 batches, 2 updates an epoch; two batches spill each time
    (33, 4, 3, 3): {(0, 0): 1, (0, 1): 1, (0, 2): 1, (0, 3): 2, (0, 4): 2, (0, 5): 2, (0, 6): 3, (0, 7): 3,
                    (1, 0): 3, (1, 1): 3, (1, 2): 3},
}


@pytest.mark.parametrize("case", UPDATES)
def test_updates_of_batches(spark, case):
    n, size, accum, steps = case
    df = spark.range(n).withColumnRenamed("id", "window_id")
    s = limit_steps(update_groups(batches(shuffle(df, 7, epochs_needed(n, size, accum, steps)), size, True), accum), steps)
    got = {}
    for r in s.collect():
        got.setdefault((r.epoch, r.batch_idx), set()).add(r.update_id)
    assert got == {k: {v} for k, v in UPDATES[case].items()}


def test_no_update_possible(spark):
    with pytest.raises(ValueError):
        epochs_needed(0, 4, 2, 5)
    with pytest.raises(ValueError):
        epochs_needed(5, 4, 2, 5)


def test_shuffle_is_md5_order(spark):
    n = 50
    df = spark.range(n).withColumnRenamed("id", "window_id")
    got = {(r.epoch, r.window_id): r.rank for r in shuffle(df, 3, 2).collect()}
    for e in range(2):
        order = sorted(range(n), key=lambda i: (hashlib.md5(f"3|{e}|{i}".encode()).hexdigest(), i))
        assert [got[(e, i)] for i in order] == list(range(1, n + 1))


@pytest.mark.parametrize("n", [0, 3, 4, 9])
def test_batches_drop_last(spark, n):
    df = spark.range(n).withColumnRenamed("id", "window_id")
    s = shuffle(df, 1, 1)
    kept = batches(s, 4, True).collect()
    assert len(kept) == (n // 4) * 4
    assert len({(r.batch_idx, r.slot) for r in kept}) == len(kept)
    allb = batches(s, 4, False).collect()
    assert len(allb) == n and max([r.batch_idx for r in allb], default=-1) == math.ceil(n / 4) - 1
    if n:
        c = collate(batches(s, 4, False), cols=("window_id",)).collect()
        assert sorted(len(r.window_id) for r in c) == sorted([4] * (n // 4) + ([n % 4] if n % 4 else []))


def test_cap_last_cut(spark):
    df = spark.createDataFrame([(i, [1, 2, 3, 4, 5][: i + 1]) for i in range(5)], "doc_id long, ids array<int>")
    assert [r.doc_id for r in cap(df, 2).collect()] == [0, 1]
    assert cap(df, 0).count() == 5 and cap(df, None).count() == 5
    t = {r.doc_id: list(r.ids) for r in last_tokens(df, 3).collect()}
    assert t[4] == [3, 4, 5] and t[0] == [1]
    g = spark.createDataFrame([([9, 9, 1, 256, 2], 2), ([9, 1, 2, 3], 1), ([9], 1)], "ids array<int>, prompt_len int")
    got = [list(r.ids_cut) for r in cut_at(g, 256, 2, "ids", "prompt_len").collect()]
    assert got == [[9, 9, 1, 256], [9, 1, 2], [9]]


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 63, 64, 65, 1000])
def test_permutation_is_a_bijection_with_an_inverse(spark, n):
    df = spark.range(n).withColumn("epoch", F.lit(3))
    out = df.select("id", batching.permuted("id", n, 9, "epoch").alias("at"))
    out = out.select("id", "at", batching.permuted("at", n, 9, F.lit(3), inverse=True).alias("back")).collect()
    assert sorted(r["at"] for r in out) == list(range(n)) and all(r["id"] == r["back"] for r in out)


def test_permutations_differ_by_epoch_and_seed(spark):
    ids = spark.range(500).withColumnRenamed("id", "window_id")
    s = batching.permuted_schedule(ids, 500, 1, epochs=2)
    got = {(r.epoch, r["rank"]): r.window_id for r in s.collect()}
    assert sorted(got) == [(e, k) for e in range(2) for k in range(1, 501)]
    orders = [[got[e, k] for k in range(1, 501)] for e in range(2)]
    other = {r["rank"]: r.window_id for r in batching.permuted_schedule(ids, 500, 2).collect()}
    orders.append([other[k] for k in range(1, 501)])
    for a in range(3):
        for b in range(a):
            assert sum(x == y for x, y in zip(orders[a], orders[b])) < 12
        moved = [abs(x - k) for k, x in enumerate(orders[a])]
        assert 130 < sum(moved) / 500 < 200  # a random order moves an id by a third of n on average
    plan = s._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan


def test_one_batch_of_one_epoch(spark):
    ids = spark.range(103).withColumnRenamed("id", "window_id")
    s = batching.batches(batching.permuted_schedule(ids, 103, 5, epochs=3), 10, drop_last=False)
    want = {(r.epoch, r.batch_idx, r.slot): r.window_id for r in s.collect()}
    for epoch, batch in ((0, 0), (2, 7), (1, 10), (1, 11)):
        got = {r.slot: r.id for r in batching.batch_ids(spark, 103, 10, 5, epoch, batch).collect()}
        assert got == {k[2]: v for k, v in want.items() if k[:2] == (epoch, batch)}


def test_collate_query_moves_each_window_once(spark, monkeypatch):
    from tessera.plans import catalog

    from .conftest import SF0001

    written, keep = {}, catalog.materialize
    monkeypatch.setattr(catalog, "materialize", lambda df, name: written.setdefault(name, keep(df, name)))
    rows = catalog.q_collate_batches(spark, SF0001).collect()
    assert written["windows"].columns == ["window_id", "ids"] and rows
    assert written["windows"].filter(f"size(ids) != {catalog.PACK_L + 1}").count() == 0


def test_collate_query_moves_a_byte_an_id_and_leaves_no_shuffle_files(spark, monkeypatch):
    import time

    from tessera.plans import catalog

    from .conftest import SF0001

    def shuffle_files():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {n for n in (files.apply(i).getName() for i in range(files.size())) if n.startswith("shuffle_")}

    moved, gather = [], batching.collate
    monkeypatch.setattr(batching, "collate", lambda df, cols: moved.append(dict(df.dtypes)["ids"]) or gather(df, cols))
    before, conf = shuffle_files(), spark.conf.getAll
    df = catalog.q_collate_batches(spark, SF0001)
    for _ in range(40):  # Spark removes them behind the scenes
        if not (left := shuffle_files() - before):
            break
        time.sleep(0.25)
    assert not left and spark.conf.getAll == conf
    assert moved and set(moved) == {"binary"}
    assert df.count() == df.select("epoch", "batch_idx").distinct().count() > 0


def test_collate_gathers_without_a_sort_before_the_exchange(spark):
    df = spark.range(64).select(F.shiftright("id", 6).alias("epoch"), (F.col("id") % 8).alias("batch_idx"),
                                (8 - (F.col("id") / 8).cast("int")).alias("slot"), F.col("id").alias("window_id"))
    c = collate(df, cols=("window_id",))
    got = {r.batch_idx: r.window_id for r in c.collect()}
    assert got == {b: [b + 8 * k for k in range(7, -1, -1)] for b in range(8)}
    plan = c._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange") == 1 and "Aggregate" not in plan[plan.index("Exchange"):]
