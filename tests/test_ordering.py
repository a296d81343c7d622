"""Two-level prefix sums and ranks against a direct sort, including a hot group."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators.corpus import sample_every
from tessera.operators.ordering import global_rank, prefix_sum


@pytest.fixture(autouse=True)
def several_parts(spark):
    """Sorted tables of several parts, as large ones have."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_prefix_sum_with_hot_group(spark):
    rnd = random.Random(5)
    # group "hot" holds most rows; ids are sparse and unordered
    rows = [("hot" if rnd.random() < 0.7 else f"g{rnd.randrange(5)}", rnd.randrange(10_000), rnd.randrange(1, 9))
            for _ in range(600)]
    rows = list({(g, i): (g, i, w) for g, i, w in rows}.values())
    df = spark.createDataFrame(rows, "g string, id long, w long")
    out = prefix_sum(df, ["id"], F.col("w"), by=["g"], before="b", total="t")
    got = {(r.g, r.id): (r.b, r.t) for r in out.collect()}
    for g in {r[0] for r in rows}:
        acc = 0
        tot = sum(w for gg, _, w in rows if gg == g)
        for _, i, w in sorted(r for r in rows if r[0] == g):
            assert got[(g, i)] == (acc, tot)
            acc += w


def test_global_rank_of_hash_order(spark):
    df = spark.range(300).withColumn("k", F.md5(F.col("id").cast("string")))
    got = {r.id: r.rank for r in global_rank(df, ["k", "id"]).collect()}
    order = sorted(range(300), key=lambda i: (__import__("hashlib").md5(str(i).encode()).hexdigest(), i))
    assert [got[i] for i in order] == list(range(1, 301))


def test_sample_every(spark):
    df = spark.createDataFrame([(i,) for i in range(1, 101)], "update_id long")
    s = sample_every(df, 10, "update_id")
    assert sorted(r.update_id for r in s.collect()) == [1] + list(range(10, 101, 10))
    s0 = sample_every(df, 10, "update_id", one_based=False, include_first=False)
    assert sorted(r.step for r in s0.collect()) == list(range(0, 100, 10))


def test_many_groups_and_null_groups(spark):
    rows = [(None if i % 50 == 0 else f"u{i % 700}", i) for i in range(3000)]
    df = spark.createDataFrame(rows, "user_id string, event_id long")
    got = {}
    for r in global_rank(df, ["event_id"], by=["user_id"], total="n").collect():
        got.setdefault(r.user_id, []).append((r.event_id, r["rank"], r.n))
    assert sum(map(len, got.values())) == 3000
    for events in got.values():
        assert [r for _, r, _ in sorted(events)] == list(range(1, len(events) + 1))
        assert {n for _, _, n in events} == {len(events)}


def test_parts_of_outlier_ids_are_even(spark):
    """One far id does not put all others into one part."""
    n = 20_000
    df = spark.range(n).select(F.when(F.col("id") == 7, F.lit(1 << 60)).otherwise(F.col("id")).alias("id"))
    parts = df.orderBy("id").groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(parts) > 4 and max(r["count"] for r in parts) < 4 * n / len(parts)
    got = {r.id: r.before for r in prefix_sum(df, ["id"], F.lit(2)).collect()}
    assert got[1 << 60] == 2 * (n - 1) and got[0] == 0 and got[8] == 14


def test_dropped_sort_columns_are_not_written(spark, monkeypatch):
    from tessera.operators import ordering

    written, keep = [], ordering.materialize
    monkeypatch.setattr(ordering, "materialize", lambda df, name: written.append(df.columns) or keep(df, name))
    df = spark.range(50).withColumn("k", F.md5(F.col("id").cast("string")))
    got = {r.id: r["rank"] for r in global_rank(df, ["k", "id"], drop=["k"]).collect()}
    assert got == {r.id: r["rank"] for r in global_rank(df, ["k", "id"]).collect()}
    assert "k" not in written[0] and "k" in written[1]
    with pytest.raises(ValueError):
        prefix_sum(df, ["k", "id"], unique=True, drop=["k"])
