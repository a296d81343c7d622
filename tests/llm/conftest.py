"""Small frames shared by the tests of the pipeline operators."""

import re

import pytest

SF = "/root/testdata/sf0.001"
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWERED = {i: i + 32 for i in range(65, 91)}


def plain(text):
    return PLAIN.findall((text or "").translate(LOWERED))


@pytest.fixture(scope="session")
def spark():
    import os
    import sys
    import tempfile

    from pyspark.sql import SparkSession

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
    s = (SparkSession.builder.master("local[*]").config("spark.sql.shuffle.partitions", "4")
         .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC")
         .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    if not s.conf.get("spark.checkpoint.dir", None):
        s.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="tessera-test-ckpt-"))
    from tessera.session import ensure_checkpoint_dir, ship_package

    ensure_checkpoint_dir(s)
    ship_package(s)
    return s


@pytest.fixture(scope="session")
def documents(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def frame(spark, rows, extra="row string, score double, n_words int, key int, text2 string"):
    """Documents with columns whose names clash with those that operators use inside."""
    names = [c.split()[0] for c in extra.split(",")]
    return spark.createDataFrame([(*r, *[None] * len(names)) for r in rows], f"doc_id long, text string, {extra}")
