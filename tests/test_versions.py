"""Versioned tables: replaced whole, resumed after a failure, joined as they lie."""

import os

import pytest
from pyspark.sql import functions as F

from tessera.session import scratch_dir
from tessera.sources import versions


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("options", [{}, {"key": "id", "buckets": 4}, {"key": "id", "parts": 3}, {"key": "id", "buckets": 3, "parts": 2}])
def test_versions_replace_each_other(spark, options):
    path = scratch_dir(spark, "versions")
    one, two = spark.range(50).withColumn("v", F.lit("a")), spark.range(20, 90).withColumn("v", F.lit("b"))
    with pytest.raises(FileNotFoundError):
        versions.open_version(spark, path)
    assert rows(versions.save_version(one, path, "v1", **options)) == rows(one)
    old = versions.open_version(spark, path)
    assert rows(versions.save_version(two, path, "v2", **options)) == rows(two)
    assert rows(old) == rows(one)  # a reader of the old version still has it
    assert rows(versions.open_version(spark, path)) == rows(two)
    with pytest.raises(ValueError, match="current version"):
        versions.save_version(two, path, "v2", **options)
    assert versions.drop_versions(spark, path) == 1 and rows(versions.open_version(spark, path)) == rows(two)


@pytest.mark.parametrize("buckets", [None, 2])
def test_a_failed_write_leaves_the_old_version_and_is_resumed(spark, buckets):
    path = scratch_dir(spark, "versions")
    good = spark.range(60).withColumn("v", F.col("id") * 2)
    versions.save_version(good, path, "v1", "id", buckets, parts=4)
    part = F.pmod(F.xxhash64("id"), F.lit(4))
    broken = good.withColumn("v", F.when(part == 2, F.raise_error(F.lit("lost")).cast("long")).otherwise(F.col("v") + 1))
    with pytest.raises(Exception, match="lost"):
        versions.save_version(broken, path, "v2", "id", buckets, parts=4)
    assert rows(versions.open_version(spark, path)) == rows(good)
    folder = path.removeprefix("file:")
    stamp = {k: os.path.getmtime(f"{folder}/v2/{k}/_SUCCESS") for k in (0, 1)}
    assert not os.path.exists(f"{folder}/v2/2/_SUCCESS")
    fixed = good.withColumn("v", F.col("v") + 1)
    assert rows(versions.save_version(fixed, path, "v2", "id", buckets, parts=4)) == rows(fixed)
    assert {k: os.path.getmtime(f"{folder}/v2/{k}/_SUCCESS") for k in (0, 1)} == stamp  # finished parts were not written again


def test_bucketed_tables_join_without_an_exchange(spark):
    one, two = (scratch_dir(spark, "versions") for _ in range(2))
    left = versions.save_version(spark.range(1000).withColumn("a", F.col("id") % 7), one, "v1", "id", 4)
    right = versions.save_version(spark.range(0, 2000, 2).withColumn("b", F.col("id") % 5), two, "v1", "id", 4)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = left.join(right, "id")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == 500 and "SortMergeJoin" in plan and "Exchange" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_names_and_keys_are_checked(spark):
    with pytest.raises(ValueError, match="need a key"):
        versions.save_version(spark.range(1), "/nowhere", "v1", buckets=2)
    with pytest.raises(ValueError, match="named by"):
        versions.save_version(spark.range(1), "/nowhere", "../v1")


def test_empty_tables(spark):
    path = scratch_dir(spark, "versions")
    assert rows(versions.save_version(spark.range(0), path, "v1", "id", 2)) == []
