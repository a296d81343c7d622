"""WARC writer and reader: plain rules, exact round trip, equal bytes of equal pages, broken writes."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from tessera.llm import warc
from tessera.session import scratch_dir

from .conftest import SF

BIG = "<p>" + "same payload " * 100 + "</p>"
ODD = [(1, "http://a.example/x", None), (2, None, ""), (3, "http://b.example/é path\r\nX: 1", "small"), (4, "u", "small"),
       (5, "u", BIG), (9, "v", BIG), (7, "w", BIG), (None, "n", BIG), (None, None, None), (8, "x" * 3000, "ü" * 60000),
       (6, "t", "t" * 999), (10, "t", "t" * 999), (11, "t", "t" * 1000), (12, "t", "t" * 1000),
       (20, "same", "again" * 300), (20, "same", "again" * 300), (20, "same", "again" * 300), (20, "other", "again" * 300),
       (21, "same", "tiny"), (21, "same", "tiny"), (-5, "neg", BIG)]


def pages(spark, rows):
    extra = "page string, known int, tie string, ord int, kind double, payload string"
    return spark.createDataFrame([(*r, None, 1, "t", 2, 0.5, "p") for r in rows], f"page_id long, url string, html string, {extra}")


def brute(rows):
    """Id, size, digest, type and target of each row, in no order."""
    last, out = {}, []
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0))
    for k in order:
        if len((rows[k][2] or "").encode()) >= 1000:
            last[rows[k][2]] = rows[k][0]
    held = {}
    for k in order:
        p = rows[k][2] or ""
        held.setdefault(p, []).append(rows[k][0])
    for p, ids in held.items():
        raw = p.encode()
        for i, page in enumerate(ids):
            revisit = len(raw) >= 1000 and i < len(ids) - 1
            out.append((page, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", last[p] if revisit else None))
    return sorted(out, key=repr)


def written(spark, rows, **options):
    path = scratch_dir(spark, "warc-test")
    manifest = warc.write_archives(pages(spark, rows) if isinstance(rows, list) else rows, path, **options)
    return path, sorted(map(tuple, manifest.select("name", "records", "bytes", "sha256").collect()))


def digests(spark, path):
    out = warc.read_archives(spark, path)
    return sorted(map(tuple, out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr)


@pytest.mark.parametrize("shard_bytes, roll_bytes", [(1 << 24, 1 << 26), (1500, 900), (1, 1)])
def test_odd_pages_match_plain_rules(spark, shard_bytes, roll_bytes):
    path, manifest = written(spark, ODD, shard_bytes=shard_bytes, roll_bytes=roll_bytes)
    assert digests(spark, path) == brute(ODD)
    assert sum(m[1] for m in manifest) == len(ODD) and (len(manifest) == 1) == (shard_bytes > 1500)
    folder = warc.file_system(path)[1]
    assert sorted(n for n in os.listdir(folder) if n != "manifest") == [m[0] for m in manifest]


def test_payloads_come_back(spark):
    path, _ = written(spark, spark.read.parquet(f"{SF}/pages.parquet"), shard_bytes=100_000, roll_bytes=30_000)
    rows = warc.read_archives(spark, path, payload=True)
    pages_ = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    by_id = {r.record_id: r for r in rows.collect()}
    assert len(by_id) == len(pages_)
    for r in by_id.values():
        source = by_id[r.refers_to_id] if r.record_type == "revisit" else r
        assert source.payload.decode() == (pages_[r.page_id].html or "") and source.record_type == "response"
        assert r.url == pages_[r.page_id].url


def test_equal_pages_give_equal_bytes(spark):
    df = spark.read.parquet(f"{SF}/pages.parquet")
    df = df.union(df.limit(20)).union(df.limit(20).withColumn("url", F.lit("twice")))
    one = written(spark, df, shard_bytes=100_000, roll_bytes=30_000)[1]
    two = written(spark, df.repartition(7).sortWithinPartitions("url"), shard_bytes=100_000, roll_bytes=30_000)[1]
    assert one == two and len(one) > 3


def test_files_are_sorted_and_rolled_by_size(spark):
    path, manifest = written(spark, spark.read.parquet(f"{SF}/pages.parquet"), shard_bytes=60_000, roll_bytes=5_000)
    rows = warc.read_archives(spark, path).groupBy("file").agg(F.min("page_id").alias("lo"), F.max("page_id").alias("hi"))
    rows = sorted((r.file, r.lo, r.hi) for r in rows.collect())
    assert all(a[2] < b[1] for a, b in zip(rows, rows[1:], strict=False))  # files follow each other in page order
    sizes = {m[0]: m[2] for m in manifest}
    shards = {n[:11] for n in sizes}
    assert all(5_000 <= sizes[n] < 40_000 for n in sizes if f"{n[:11]}-{int(n[12:17]) + 1:05d}.warc.gz" in sizes)
    assert len(shards) > 1 and len(sizes) > len(shards)


def test_standard_gzip_and_headers(spark):
    import gzip

    path, manifest = written(spark, ODD)
    raw = gzip.decompress(open(os.path.join(warc.file_system(path)[1], manifest[0][0]), "rb").read())
    assert raw.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo") and raw.count(b"\r\n\r\n\r\n\r\n") <= raw.count(b"WARC/1.1\r\n")
    assert raw.count(b"WARC-Type: ") == len(ODD) + 1 and b"\r\nX: 1" not in raw


def test_damage_is_an_error(spark):
    path, manifest = written(spark, ODD)
    file = os.path.join(warc.file_system(path)[1], manifest[0][0])
    raw = bytearray(open(file, "rb").read())
    raw[-9] ^= 1
    with open(file, "wb") as f:
        f.write(raw)
    with pytest.raises(Exception, match="damaged|incorrect|Error|invalid|differs"):
        warc.read_archives(spark, path).collect()


def test_a_broken_write_leaves_no_manifest(spark, monkeypatch):
    path = scratch_dir(spark, "warc-broken")

    def broken(uri):
        def rows(batches):
            raise OSError("lost")
            yield
        return rows
    monkeypatch.setattr(warc, "renamer", broken)
    with pytest.raises(Exception, match="lost"):
        warc.write_archives(pages(spark, ODD), path)
    with pytest.raises(Exception, match="manifest|PATH_NOT_FOUND|UNABLE_TO_INFER"):
        warc.read_archives(spark, path)
    monkeypatch.undo()
    import shutil

    shutil.rmtree(os.path.join(warc.file_system(path)[1], "manifest"), ignore_errors=True)
    warc.write_archives(pages(spark, ODD), path)
    assert digests(spark, path) == brute(ODD)


def test_renames_can_be_repeated(spark):
    path, manifest = written(spark, ODD)
    import pyarrow as pa

    listed = pa.RecordBatch.from_pylist([{"name": n, "temporary": f"_temporary/x/{n}", "records": r, "bytes": b, "sha256": s}
                                         for n, r, b, s in manifest])
    assert list(warc.renamer(path)([listed])) == [listed]


def test_empty_table(spark):
    path, manifest = written(spark, pages(spark, ODD).limit(0))
    assert manifest == [] and digests(spark, path) == []
