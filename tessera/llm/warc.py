"""WARC archives from a deterministic sharded writer, and their reader.

Writing. Every page becomes one record. Of pages with equal payloads of at least
``LEAST_REVISIT`` bytes the one with the largest ``page_id`` is a ``response``, the others
are ``revisit`` records that name it. Records are range-sorted by ``(page_id, hash of url
and payload)``: a running sum of their sizes over the sorted keys (narrow rows only)
cuts them into shards of about equal bytes, so the cuts depend on the data alone, not on
Spark's sampling. Payloads cross one exchange, to their shard; there they are sorted by
key, merged with the narrow rows that say what each record is, and streamed into files
of one gzip member per record. A file is closed when its compressed size reaches
``roll_bytes``. Headers, record ids and digests are made anew; dates are a parameter. The
same pages give the same bytes.

Committing. A task writes under a temporary name of its own attempt and returns one row
per finished file; Spark's own commit keeps the rows of one attempt. A second job renames
the files and its rows become the ``manifest`` table, whose commit comes last. A write that
ends early leaves no manifest and can be repeated; readers open only what it lists.

Reading. Files are dealt to tasks by name and read member by member; sizes and digests
of files and payloads are checked, a mismatch is an error.

Null ``html`` is an empty payload, a null ``url`` gives no target field, null ``page_id`` comes
first in order and never wins over a known one. Control signs and spaces in a URL are
percent-encoded. Rows equal in id, URL and payload are told apart by a running number, of
which the last counts as largest; they are counted, not moved, before they are numbered.
An empty table gives an empty manifest. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.ordering import prefix_sum
from tessera.operators.sizes import broadcast_if_small
from tessera.session import materialize

LEAST_REVISIT = 1000
SHARD_BYTES = 16 << 20
#: Shards at most; beyond it they grow with the input.
MOST_SHARDS = 50_000
ROLL_BYTES = 64 << 20
DATE = "2000-01-01T00:00:00Z"
#: Bytes that each record counts besides its payload, for its headers.
HEADER_BYTES = 512
READ_BYTES = 64 << 10
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
KEY = ["page", "known", "tie"]
FILES = "name string, temporary string, records long, bytes long, sha256 string"
RECORDS = ("page_id long, url string, record_type string, record_id string, refers_to_id string, refers_to long, "
           "payload_bytes long, payload_digest string, file string, payload binary")


def file_system(uri: str):
    """File system and path of a folder that all executors share."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", uri))


def record_id(page: int, known: int, tie: int, ord_: int) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(f'{known}|{page}|{tie}|{ord_}'.encode()).digest()[:16], version=5)}>"


def digest_field(raw: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(raw).digest()).decode()


def http_head(n: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()


def record(fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("WARC-Block-Digest", digest_field(block)),
                                               ("Content-Length", str(len(block)))] if v is not None)
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def page_record(key: tuple[int, int, int, int], role: dict, url: str | None, payload: bytes | None, date: str) -> bytes:
    """The response or revisit record of a page; the payload's digest is computed here, or known from its response's."""
    revisit = role["revisit"]
    page, known, _, _ = key
    if not revisit and hashlib.sha1(payload).hexdigest() != role["digest"]:
        raise ValueError(f"payload of page {page} differs from its digest")
    digest = "sha1:" + base64.b32encode(bytes.fromhex(role["digest"])).decode()
    target = None if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(*key)), ("WARC-Date", date),
              ("WARC-Target-URI", target), ("Content-Type", "application/http; msgtype=response"),
              ("WARC-Payload-Digest", digest), ("X-Page-ID", str(page) if known else None)]
    if revisit:
        refers = role["refers"]
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(*refers)),
                   ("X-Refers-To-Page-ID", str(refers[0]) if refers[1] else None)]
    return record(fields, http_head(role["n"]) + (b"" if revisit else payload))


class Archive:
    """One open archive file under its temporary name."""

    def __init__(self, fs, folder: str, attempt: str, name: str, level: int, date: str):
        self.name, self.temporary, self.level = name, f"_temporary/{attempt}/{name}", level
        fs.create_dir(f"{folder}/_temporary/{attempt}", recursive=True)
        self.out, self.sum = fs.open_output_stream(f"{folder}/{self.temporary}", compression=None), hashlib.sha256()
        self.bytes = self.records = 0
        self.add(record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"),
                         ("WARC-Date", date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")],
                        b"software: tessera\r\nformat: WARC File Format 1.1\r\n"))
        self.records = 0

    def add(self, raw: bytes) -> None:
        gz = zlib.compressobj(self.level, zlib.DEFLATED, 31)
        for part in (gz.compress(raw), gz.flush()):
            self.out.write(part)
            self.sum.update(part)
            self.bytes += len(part)
        self.records += 1

    def close(self) -> tuple:
        self.out.close()
        return self.name, self.temporary, self.records, self.bytes, self.sum.hexdigest()


def archive_writer(uri: str, roll_bytes: int, level: int, date: str):
    """Rows of a partition, sorted by key with the role before the payload, into archive files; one row per file."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = file_system(uri)
        attempt, file, shard, seq, role, done = uuid.uuid4().hex, None, None, 0, None, []
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                for r in batch.slice(lo, 64).to_pylist():
                    key = (r["page"], r["known"], r["tie"], r["ord"])
                    if r["kind"] == 0:
                        role = r | {"key": key, "refers": (r["to_page"], r["to_known"], r["to_tie"], r["to_ord"])}
                        continue
                    if role["key"] != key:
                        raise ValueError(f"no role for {key}")
                    if file and r["shard"] != shard:
                        done.append(file.close())
                        file, seq = None, 0
                    shard = r["shard"]
                    file = file or Archive(fs, folder, attempt, f"part-{shard:06d}-{seq:05d}.warc.gz", level, date)
                    file.add(page_record(key, role, r["url"], r["payload"], date))
                    if file.bytes >= roll_bytes:
                        done.append(file.close())
                        file, seq = None, seq + 1
        if file:
            done.append(file.close())
        names = [c.split()[0] for c in FILES.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names) if done else \
            pa.RecordBatch.from_pylist([], pa.schema([(n, pa.int64() if n in ("records", "bytes") else pa.string()) for n in names]))
    return rows


def renamer(uri: str):
    """Gives each listed file its final name; a file that has it already is left."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileType

        fs, folder = file_system(uri)
        for batch in batches:
            for r in batch.to_pylist():
                if fs.get_file_info(f"{folder}/{r['temporary']}").type != FileType.NotFound:
                    fs.move(f"{folder}/{r['temporary']}", f"{folder}/{r['name']}")
                if fs.get_file_info(f"{folder}/{r['name']}").size != r["bytes"]:
                    raise FileNotFoundError(f"{folder}/{r['name']} is not the file that was written")
            yield batch
    return rows


def _last_not_above(firsts: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """For each key of ``rows`` the place of the last of ``firsts`` that is not larger; both hold one key a row."""
    both = np.concatenate((firsts, rows))
    is_row = np.arange(len(both)) >= len(firsts)
    order = np.lexsort((is_row, *both.T[::-1]))
    out = np.empty(len(both), np.int64)
    out[order] = np.cumsum(~is_row[order]) - 1
    return out[len(firsts):]


def _shard_of(spark: SparkSession, firsts: list[tuple]):
    """The shard of a key, from the first key of every shard (at most ``MOST_SHARDS`` and one)."""
    held = spark.sparkContext.broadcast(np.array(firsts, np.int64).reshape(-1, 4))

    @F.pandas_udf("int")
    def shard(page: pd.Series, known: pd.Series, tie: pd.Series, ord_: pd.Series) -> pd.Series:
        return pd.Series(_last_not_above(held.value, np.stack((page, known, tie, ord_), axis=1)))
    return shard(*KEY, "ord")


def _keyed(pages: DataFrame) -> DataFrame:
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("id"), "url", payload.alias("payload"))
    return rows.select(F.coalesce("id", F.lit(-(1 << 63))).alias("page"), F.col("id").isNotNull().cast("long").alias("known"),
                       F.xxhash64("url", "payload").alias("tie"), "url", "payload")


def record_roles(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """Per record: its key ``page, known, tie, ord``, payload size and digest, and the key of the response that it revisits."""
    rows = _keyed(pages)
    same = F.unhex(F.sha2("payload", 256)).alias("same")
    kinds = rows.groupBy(*KEY, F.octet_length("payload").cast("long").alias("n"), F.sha1("payload").alias("digest"), same).agg(
        F.count("*").alias("copies"))
    kinds = materialize(kinds, "warc-keys")
    own = F.struct(*KEY, (F.col("copies") - 1).alias("ord"))
    last = kinds.filter(F.col("n") >= least).groupBy("same", "n").agg(F.max(own).alias("to"))
    records = kinds.withColumn("ord", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    records = records.join(last, ["same", "n"], "left")
    revisit = F.col("to").isNotNull() & (F.col("to") != F.struct(*KEY, "ord"))
    return records.select(*KEY, "ord", "n", "digest", "copies", revisit.alias("revisit"),
                          *(F.col(f"to.{c}").alias(f"to_{c}") for c in (*KEY, "ord")))


def _payloads(pages: DataFrame, roles: DataFrame, least: int) -> DataFrame:
    """``page, known, tie, ord, url, payload`` of every record; equal rows meet as one row and are numbered again."""
    rows = _keyed(pages)
    again = roles.filter("copies > 1 and ord = 0").select(*KEY, "copies")
    if not again.limit(1).count():
        return rows.select(*KEY, F.lit(0).cast("long").alias("ord"), "url", "payload")
    rows = rows.join(broadcast_if_small(again), KEY, "left")
    single = rows.filter("copies is null").select(*KEY, F.lit(0).cast("long").alias("ord"), "url", "payload")
    many = rows.filter("copies is not null").groupBy(*KEY, "copies").agg(
        F.first("url").alias("url"), F.first("payload").alias("payload"))
    many = many.withColumn("ord", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    # of large payloads the last copy alone can be a response
    needed = (F.octet_length("payload") < least) | (F.col("ord") == F.col("copies") - 1)
    return single.union(many.select(*KEY, "ord", "url", F.when(needed, F.col("payload")).alias("payload")))


def write_archives(pages: DataFrame, path: str, least_revisit: int = LEAST_REVISIT, shard_bytes: int = SHARD_BYTES,
                   roll_bytes: int = ROLL_BYTES, level: int = 6, date: str = DATE) -> DataFrame:
    """Writes the pages under ``path``; returns the manifest ``name, records, bytes, sha256``, one row per file."""
    spark = pages.sparkSession
    roles = materialize(record_roles(pages, least_revisit), "warc-roles")
    size = F.when(F.col("revisit"), 0).otherwise(F.col("n")) + HEADER_BYTES
    total = roles.agg(F.sum(size)).first()[0] or 0
    width = max(shard_bytes, -(-total // MOST_SHARDS))
    order = [*KEY, "ord"]
    placed = prefix_sum(roles.select(*order, size.alias("size")), order, F.col("size"))
    firsts = placed.groupBy(F.expr(f"before div {width}")).agg(F.min(F.struct(*order)).alias("first")).select("first.*")
    firsts = sorted(map(tuple, firsts.collect()))
    shard = _shard_of(spark, firsts).alias("shard")
    told = roles.select(*order, F.lit(0).alias("kind"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"),
                        "n", "digest", "revisit", *(f"to_{c}" for c in order))
    body = _payloads(pages, roles, least_revisit).withColumn("kind", F.lit(1))
    rows = told.unionByName(body, allowMissingColumns=True).select(shard, "*")
    rows = rows.repartitionById(max(1, len(firsts)), F.col("shard")).sortWithinPartitions(*order, "kind")
    staged = materialize(rows.mapInArrow(archive_writer(path, roll_bytes, level, date), FILES), "warc-staged")
    files = staged.repartition("name").mapInArrow(renamer(path), FILES).drop("temporary")
    files.write.parquet(f"{path}/manifest")
    fs, folder = file_system(path)
    if firsts:
        fs.delete_dir(f"{folder}/_temporary")
    return spark.read.parquet(f"{path}/manifest")


def members(stream) -> Iterator[bytes]:
    """The members of a gzip stream, one at a time."""
    unzip, parts = zlib.decompressobj(31), []
    while raw := stream.read(READ_BYTES):
        while raw:
            parts.append(unzip.decompress(raw))
            raw = unzip.unused_data
            if unzip.eof:
                yield b"".join(parts)
                unzip, parts = zlib.decompressobj(31), []
    if parts:
        raise ValueError("the archive ends inside a record")


def parse_record(raw: bytes, file: str, payload: bool) -> tuple | None:
    """Row of a response or revisit record; digests are computed from its bytes and compared with its headers."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[:-4]
    if lines[0] != "WARC/1.1" or len(block) != int(fields["Content-Length"]) or digest_field(block) != fields["WARC-Block-Digest"]:
        raise ValueError(f"damaged record in {file}")
    if fields["WARC-Type"] == "warcinfo":
        return None
    http, _, body = block.partition(b"\r\n\r\n")
    n = int(re.search(rb"Content-Length: (\d+)", http)[1])
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and (len(body) != n or digest_field(body) != fields["WARC-Payload-Digest"]):
        raise ValueError(f"damaged payload in {file}")
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    page, to = (int(fields[k]) if k in fields else None for k in ("X-Page-ID", "X-Refers-To-Page-ID"))
    return (page, fields.get("WARC-Target-URI"), fields["WARC-Type"], fields["WARC-Record-ID"], fields.get("WARC-Refers-To"), to,
            n, digest, file, body if payload and not revisit else None)


def archive_reader(uri: str, payload: bool):
    types = [pa.int64(), *[pa.string()] * 4, pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
    names = [c.split()[0] for c in RECORDS.split(", ")]

    def batch(held: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = file_system(uri)
        for listed in batches:
            for f in listed.to_pylist():
                seen, held, size, total = 0, [], 0, hashlib.sha256()

                class Counted:
                    def read(self, n: int) -> bytes:
                        raw = stream.read(n)
                        total.update(raw)
                        return raw

                with fs.open_input_stream(f"{folder}/{f['name']}", compression=None) as stream:
                    for raw in members(Counted()):
                        if row := parse_record(raw, f["name"], payload):
                            held.append(row)
                            seen, size = seen + 1, size + (len(raw) if payload else 0)
                        if len(held) >= 1000 or size >= 4 << 20:
                            yield batch(held)
                            held, size = [], 0
                if held:
                    yield batch(held)
                if seen != f["records"] or total.hexdigest() != f["sha256"]:
                    raise ValueError(f"{f['name']} differs from the manifest")
    return rows


def read_archives(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """Per record of the archives that the manifest under ``path`` lists; see ``RECORDS``. Revisits have no payload of their own."""
    files = spark.read.parquet(f"{path}/manifest")
    n = files.count()
    out = files.repartition(max(1, n), "name").mapInArrow(archive_reader(path, payload), RECORDS)
    return out if payload else out.drop("payload")
