"""Lossless byte-level token ids: UTF-8 bytes are ids 0..255, EOS is 256."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType

from tessera.functions.text import EOS_TEXT, col_of

EOS_ID = 256
BYTE_VOCAB = 257
IGNORE_INDEX = -100


@lru_cache
def _id_arrays(special: bytes):
    """Arrow UDF: a column of texts as int arrays, NULL for NULL. The bytes of a batch are widened at once and ``special``
    becomes one id; nothing is done row by row."""
    def arrays(texts):
        import re

        import numpy as np
        import pyarrow as pa

        texts = texts.cast(pa.large_binary())
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        data = texts.buffers()[2] if len(texts) else None
        raw = np.frombuffer(data, np.uint8)[ends[0]:ends[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
        ends = ends - ends[0]
        ids = raw.astype(np.int32)
        if special:
            at = np.array([m.start() for m in re.finditer(re.escape(special), memoryview(np.ascontiguousarray(raw)))], np.int64)
            if len(at):  # not those that begin in one text and end in the next
                at = at[np.searchsorted(ends, at, "right") == np.searchsorted(ends, at + len(special) - 1, "right")]
            if len(at):
                ids[at] = EOS_ID
                ids = np.delete(ids, (at[:, None] + np.arange(1, len(special))).ravel())
                ends = ends - np.searchsorted(at, ends, "left") * (len(special) - 1)
        mask = pa.array(texts.is_null().to_numpy(zero_copy_only=False)) if texts.null_count else None
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids), mask=mask)
    return F.arrow_udf(arrays, ArrayType(IntegerType()))


def utf8_ids(c) -> Column:
    """UTF-8 bytes of a string as ``ARRAY<INT>`` (empty string -> empty array)."""
    return _id_arrays(b"")(col_of(c))


def encode_ids(c, allow_special: bool = True) -> Column:
    """Text -> ids. With ``allow_special`` a literal EOS string becomes id 256."""
    return _id_arrays(EOS_TEXT.encode() if allow_special else b"")(col_of(c))


@lru_cache
def _packing(kind: str):
    """Arrow UDFs between int arrays and packed ids: a byte an id, 0xFF for EOS, and 0xFE before 0 or 1 for the bytes 0xFE and
    0xFF, which no UTF-8 text has."""
    def bytes_of(blobs):
        import numpy as np
        import pyarrow as pa

        blobs = blobs.cast(pa.large_binary())
        ends = np.frombuffer(blobs.buffers()[1], np.int64)[blobs.offset:blobs.offset + len(blobs) + 1] if len(blobs) else np.zeros(1, np.int64)
        data = blobs.buffers()[2] if len(blobs) else None
        raw = np.frombuffer(data, np.uint8)[ends[0]:ends[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
        return raw, ends - ends[0]

    def ids_of(blobs):
        import numpy as np

        raw, ends = bytes_of(blobs)
        ids = raw.astype(np.int32)
        ids[raw == 0xFF] = EOS_ID
        at = np.flatnonzero(raw == 0xFE)
        if len(at):
            ids[at] = 0xFE + ids[at + 1]
            ids = np.delete(ids, at + 1)
            ends = ends - np.searchsorted(at, ends, "left")
        return ids, ends

    def nulls(column):
        import pyarrow as pa
        return pa.array(column.is_null().to_numpy(zero_copy_only=False)) if column.null_count else None

    def packed(lists):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        ends = np.append(lists.offsets.to_numpy(), 0)[:len(lists) + 1].astype(np.int64)
        values = lists.values[ends[0]:ends[-1]]
        if values.null_count:
            raise ValueError("an id is NULL")
        ids, ends = values.to_numpy(), ends - ends[0]
        if len(ids) and (ids.min() < 0 or ids.max() > EOS_ID):
            raise ValueError("only byte ids can be packed")
        raw = ids.astype(np.uint8)
        raw[ids == EOS_ID] = 0xFF
        at = np.flatnonzero((ids == 0xFE) | (ids == 0xFF))
        if len(at):
            raw[at] = 0xFE
            raw = np.insert(raw, at + 1, (ids[at] - 0xFE).astype(np.uint8))
            ends = ends + np.searchsorted(at, ends, "left")
        strings = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(ends), pa.py_buffer(raw)]).cast(pa.binary())
        return pc.if_else(lists.is_valid(), strings, None) if lists.null_count else strings

    def unpacked(blobs):
        import numpy as np
        import pyarrow as pa

        ids, ends = ids_of(blobs)
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids), mask=nulls(blobs))

    def joined(rows):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        ids, ends = ids_of(rows.flatten())
        full = ends[1:] > ends[:-1]
        keep = np.ones(len(ids), bool)
        keep[(ends[:-1] if kind == "without first" else ends[1:] - 1)[full]] = False
        ends = ends - np.append(0, np.cumsum(full))
        row_ends = np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False)))
        return pa.ListArray.from_arrays(pa.array(ends[row_ends].astype(np.int32)), pa.array(ids[keep]), mask=nulls(rows))

    if kind == "pack":
        return F.arrow_udf(packed, BinaryType())
    return F.arrow_udf(unpacked if kind == "unpack" else joined, ArrayType(IntegerType()))


def pack_ids(c) -> Column:
    """Byte ids (``ARRAY<INT>``) as a binary of about a byte an id, for tables and exchanges; other ids are an error."""
    return _packing("pack")(col_of(c))


def unpack_ids(c) -> Column:
    """The ids that ``pack_ids`` made a binary of."""
    return _packing("unpack")(col_of(c))


def join_packed(c, without: str) -> Column:
    """The ids of an array of packed arrays, one behind the other, each ``without`` its ``"first"`` or its ``"last"`` id."""
    if without not in ("first", "last"):
        raise ValueError("without must be 'first' or 'last'")
    return _packing(f"without {without}")(col_of(c))


def encoded_length(c, allow_special: bool = True) -> Column:
    """``size(encode_ids(c))`` without building the array: UTF-8 bytes, minus 12
    per EOS literal (13 bytes become one id). Used to size documents cheaply."""
    text = col_of(c)
    n = F.octet_length(text).cast("long")
    if not allow_special:
        return n
    eos_chars = len(EOS_TEXT)
    n_eos = ((F.length(text) - F.length(F.replace(text, F.lit(EOS_TEXT), F.lit("")))) / eos_chars).cast("long")
    return n - n_eos * (len(EOS_TEXT.encode("utf-8")) - 1)


def _span(text: Column, n: int) -> Column:
    """Characters that hold at least ``n`` whole tokens: a character is one token or more,
    but for the EOS literal, where 13 make one, and a cut may split one."""
    return F.when(F.instr(text, EOS_TEXT) > 0, F.lit(len(EOS_TEXT) * (n + 1))).otherwise(F.lit(n))


def head_text(c, n: int) -> Column:
    """The beginning of a text that holds its first ``n`` tokens (or all of it)."""
    return F.left(col_of(c), _span(col_of(c), n))


def tail_text(c, n: int) -> Column:
    """The end of a text that holds its last ``n`` tokens (or all of it)."""
    return F.right(col_of(c), _span(col_of(c), n))


def decode_ids(c) -> Column:
    """Ids -> text; 256 decodes to the EOS literal. Bytes go back through
    ISO-8859-1 characters, then the byte string is read as UTF-8."""
    chars = F.transform(col_of(c), lambda i: F.when(i == EOS_ID, F.lit(EOS_TEXT)).otherwise(F.chr(i)))
    return F.decode(F.encode(F.array_join(chars, ""), "ISO-8859-1"), "UTF-8")


def ids_fingerprint(c) -> Column:
    """md5 of the comma-joined ids: compact and engine-independent.

    JSON writes an array of whole numbers in one go, where ``array_join`` first makes a string of each; its brackets are cut off
    as bytes. Arrays that may hold a NULL, which ``array_join`` leaves out, take that way.
    """
    ids = col_of(c)
    bare = F.transform(F.array(F.to_json(ids).cast("binary")), lambda s: F.substring(s, F.lit(2), F.octet_length(s) - 2))
    # false only of an array without NULL
    return F.when(~F.array_contains(ids, F.lit(-1 << 31)), F.md5(F.element_at(bare, 1))).otherwise(F.md5(F.array_join(ids, ",")))
