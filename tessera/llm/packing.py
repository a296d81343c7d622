"""Sequence packing by power-of-two decomposition.

A document's token ids, closed by the end id, are cut into pieces whose lengths are
powers of two: whole blocks of ``LONGEST`` first, then the binary digits of the rest
from the largest down. Each piece is a sequence of its own length, so no sequence
crosses documents and none needs padding. Pieces of equal length form a bucket, and
sequence ids run through the buckets from the longest to the shortest.

Ids are those of the ``tokenizers`` file. Texts of plain Latin characters are encoded
with ``tiktoken`` and the rank file of the same vocabulary, several times faster with
equal ids (tested); any other text goes through ``tokenizers`` itself.

Numbering needs no global sort: rows are numbered inside (length, slice of a hash),
and a table of at most ``SLICES`` rows per length gives each slice its first id.

A null or empty text is the end id alone. Rows that repeat a ``doc_id`` are packed one
by one, repeated rows too. Extra columns are ignored; an empty table gives no piece.
"""

from __future__ import annotations

import base64
import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import materialize

LONGEST = 2048
END_ID = 1
SLICES = 1024
#: Characters on which both encoders split words alike; and the one special token.
OTHER_SIGNS = re.compile(r"[^\t\n\r\x20-\x7E¡-¬®-ɏ]|<\|endoftext\|>")
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def tokenizer_paths() -> tuple[str, str]:
    """Default files: the tokenizer and the rank file of its vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


@functools.cache
def encoders(json_path: str, rank_path: str):
    """Loaded once per Python worker."""
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(rank_path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return Tokenizer.from_file(json_path), fast


def token_ids(text: str | None, json_path: str, rank_path: str) -> list[int]:
    whole, fast = encoders(json_path, rank_path)
    if not text:
        return []
    if OTHER_SIGNS.search(text):
        return whole.encode(text, add_special_tokens=False).ids
    return fast.encode_ordinary(text)


def pieces(n: int, longest: int = LONGEST) -> list[tuple[int, int]]:
    """``(start, length)`` of the power-of-two pieces of ``n`` tokens."""
    out = [(at, longest) for at in range(0, n - n % longest, longest)]
    at, rest = n - n % longest, n % longest
    for bit in range(rest.bit_length() - 1, -1, -1):
        if rest >> bit & 1:
            out.append((at, 1 << bit))
            at += 1 << bit
    return out


def piece_rows(json_path: str, rank_path: str, longest: int, end_id: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in PIECES.split(", ")]
        for b in batches:
            cols: list[list] = [[] for _ in names]
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                ids = np.array([*token_ids(text, json_path, rank_path), end_id], "<u4")
                raw = memoryview(ids.tobytes())
                for start, length in pieces(len(ids), longest):
                    crc = zlib.crc32(raw[4 * start:4 * (start + length)])
                    for c, v in zip(cols, (doc_id, start, length, crc, len(ids)), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names)
    return rows


def token_pieces(docs: DataFrame, json_path: str | None = None, rank_path: str | None = None,
                 longest: int = LONGEST, end_id: int = END_ID) -> DataFrame:
    """Per piece: ``doc_id, start, length, ids_crc32, doc_tokens``."""
    if longest < 1 or longest & (longest - 1):
        raise ValueError("the longest sequence is a power of two")
    default = tokenizer_paths() if json_path is None or rank_path is None else (json_path, rank_path)
    return docs.select("doc_id", "text").mapInArrow(
        piece_rows(json_path or default[0], rank_path or default[1], longest, end_id), PIECES)


def pack_documents(docs: DataFrame, **options) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset`` (0: each piece is a whole sequence)."""
    rows = materialize(token_pieces(docs, **options), "pieces")
    rows = rows.withColumn("slice", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(SLICES)))
    before = Window.orderBy(F.desc("length"), "slice").rowsBetween(Window.unboundedPreceding, -1)
    # at most SLICES rows for each power of two up to the longest sequence
    first = (rows.groupBy("length", "slice").agg(F.count("*").alias("n"))
             .withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n"))
    order = Window.partitionBy("length", "slice").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    return (rows.withColumn("rank", F.row_number().over(order) - 1)
            .join(F.broadcast(first), ["length", "slice"])
            .select("doc_id", "start", "length", "ids_crc32", "doc_tokens",
                    (F.col("first") + F.col("rank")).cast("long").alias("sequence_id"),
                    F.lit(0).cast("long").alias("offset")))
