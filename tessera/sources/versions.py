"""Prepared tables that are replaced whole or not at all, resumed, and joined without an exchange.

A table is a folder of versions and a file ``CURRENT`` that names one of them. A version is written to a folder of its
own, in parts that Spark commits one by one; a write that ends early can be repeated under the same version
name and goes on with the parts that are missing. Only when all parts are there is ``CURRENT`` replaced, by writing it
under a temporary name and renaming that over it, so readers see the old version or the new one.

With ``buckets`` the rows lie in as many files by a hash of ``key``, sorted by it, and ``CURRENT`` records that. Tables of the same
key and number of buckets are then joined by key as they lie: no exchange and no sort of either.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

CURRENT = "CURRENT"


def _files(spark: SparkSession, path: str):
    jvm = spark._jvm
    return jvm.org.apache.hadoop.fs.FileContext.getFileContext(jvm.org.apache.hadoop.fs.Path(path).toUri(), spark._jsc.hadoopConfiguration())


def _path(spark: SparkSession, *parts: str):
    return spark._jvm.org.apache.hadoop.fs.Path("/".join(parts))


def _exists(spark: SparkSession, *parts: str) -> bool:
    return _files(spark, parts[0]).util().exists(_path(spark, *parts))


def _switch(spark: SparkSession, path: str, state: dict) -> None:
    """Replaces ``CURRENT`` by one rename."""
    jvm, files = spark._jvm, _files(spark, path)
    temporary = _path(spark, path, f"_{CURRENT}.{state['version']}")
    flags = jvm.java.util.EnumSet.of(jvm.org.apache.hadoop.fs.CreateFlag.CREATE, jvm.org.apache.hadoop.fs.CreateFlag.OVERWRITE)
    none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.CreateOpts, 0)
    out = files.create(temporary, flags, none)
    out.write(bytearray(json.dumps(state).encode()))
    out.close()
    over = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    files.rename(temporary, _path(spark, path, CURRENT), over)


def _state(spark: SparkSession, path: str) -> dict:
    if not _exists(spark, path, CURRENT):
        raise FileNotFoundError(f"{path} has no finished version")
    return json.loads("".join(r["value"] for r in spark.read.text(f"{path}/{CURRENT}").collect()))


def _table_name(path: str, version: str, k: int) -> str:
    return re.sub(r"[^a-z0-9]+", "_", f"tessera {path} {version} {k}".lower())


def _declare(spark: SparkSession, name: str, schema: StructType, key: str, buckets: int, folder: str) -> None:
    """A table of the session's catalog over bucketed files that are there already."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet CLUSTERED BY (`{key}`) SORTED BY (`{key}`) "
              f"INTO {buckets} BUCKETS LOCATION '{folder}'")


def save_version(df: DataFrame, path: str, version: str, key: str | None = None, buckets: int | None = None, parts: int = 1) -> DataFrame:
    """Writes ``df`` as a version of the table at ``path``, makes it the current one, and reads it.

    ``parts`` cuts the rows by a hash of ``key`` into separately committed parts; a repeated call skips those that are
    finished. ``df`` must give the same rows when it is computed again. A finished version of that name is an error.
    """
    if (buckets or parts > 1) and not key:
        raise ValueError("buckets and parts need a key")
    if not re.fullmatch(r"[A-Za-z0-9_.-]+", version):
        raise ValueError("a version is named by letters, digits, dots, hyphens and underscores")
    spark = df.sparkSession
    if _exists(spark, path, CURRENT) and _state(spark, path)["version"] == version:
        raise ValueError(f"{version} is the current version of {path}")
    for k in range(parts):
        folder = f"{path}/{version}/{k}"
        if _exists(spark, folder, "_SUCCESS"):
            continue
        own = df if parts == 1 else df.filter(F.pmod(F.xxhash64(key), F.lit(parts)) == k)
        if buckets:
            # rows are dealt as the buckets are, so each bucket is one file
            name = _table_name(path, version, k) + "_w"
            spark.sql(f"DROP TABLE IF EXISTS {name}")
            (own.repartition(buckets, key).write.mode("overwrite").format("parquet").bucketBy(buckets, key).sortBy(key)
             .option("path", folder).saveAsTable(name))
            spark.sql(f"DROP TABLE IF EXISTS {name}")  # the files stay
        else:
            own.write.mode("overwrite").parquet(folder)
    _switch(spark, path, {"version": version, "key": key, "buckets": buckets, "parts": parts, "schema": json.loads(df.schema.json())})
    return open_version(spark, path)


def open_version(spark: SparkSession, path: str) -> DataFrame:
    """The current version of the table at ``path``."""
    s = _state(spark, path)
    schema = StructType.fromJson(s["schema"])
    out = None
    for k in range(s["parts"]):
        folder = f"{path}/{s['version']}/{k}"
        if s["buckets"]:
            name = _table_name(path, s["version"], k)
            _declare(spark, name, schema, s["key"], s["buckets"], folder)
            part = spark.table(name)
        else:
            part = spark.read.schema(schema).parquet(folder)
        out = part if out is None else out.union(part)
    return out


def drop_versions(spark: SparkSession, path: str) -> int:
    """Removes the folders of all versions but the current one; returns how many."""
    now, files, n = _state(spark, path)["version"], _files(spark, path), 0
    for f in files.util().listStatus(_path(spark, path)):
        name = f.getPath().getName()
        if f.isDirectory() and name != now and not name.startswith("_"):
            n += bool(files.delete(f.getPath(), True))
    return n
