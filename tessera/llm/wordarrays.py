"""Words of many texts as flat numpy arrays, straight from an Arrow string column.

The texts of a batch lie in one byte buffer. A table of 256 bytes says which bytes
belong to words (0: separator) and what they are hashed as, so all words of the
buffer are found and hashed with a few array passes and no loop over words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes worked on at a time; a longer text is worked on alone.
CHUNK_BYTES = 1_000_000


def plain_table() -> np.ndarray:
    """Words of a-z, digits and bytes beyond ASCII, with A-Z lower-cased."""
    t = np.zeros(256, np.uint8)
    for b in (*range(48, 58), *range(97, 123), *range(128, 256)):
        t[b] = b
    t[65:91] = t[97:123]
    return t


def spaced_table() -> np.ndarray:
    """Words between ASCII white space, unchanged."""
    t = np.arange(256, dtype=np.uint8)
    t[0] = 1  # a zero byte belongs to words; it shares a hash with byte 1, so hashes need a check
    t[[32, *range(9, 14)]] = 0
    return t


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offs[0]:offs[-1]], offs - offs[0]


def chunks(offs: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts with at most ``limit`` bytes, or one text."""
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of SplitMix64: a bijection of 64-bit words that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def seeded(seed: int, n: int) -> np.ndarray:
    """``n`` pseudo-random odd 64-bit words that depend on ``seed`` alone."""
    with np.errstate(over="ignore"):
        base = np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15)
        return mix(base + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


BYTE_WEIGHTS = seeded(1, 256)


class Words:
    """``start, length, doc`` (within the range) and 64-bit ``key`` of each word of a range of texts."""

    def __init__(self, raw: np.ndarray, offs: np.ndarray, lo: int, hi: int, table: np.ndarray):
        raw, offs = raw[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo]
        self.raw, self.offs, self.n_docs = raw, offs, hi - lo
        sign = table[raw]
        inside = sign != 0
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        heads = offs[:-1][offs[:-1] < len(raw)]
        first[heads] = inside[heads]
        last = inside.copy()
        last[:-1] &= ~inside[1:] | first[1:]
        self.start = np.flatnonzero(first)
        self.length = np.flatnonzero(last) + 1 - self.start
        self.doc = np.searchsorted(offs, self.start, "right") - 1
        self.per_doc = np.bincount(self.doc, minlength=self.n_docs).astype(np.int64)
        self.first = np.concatenate(([0], np.cumsum(self.per_doc)))  # word index where each text begins
        if not len(self.start):
            self.key = np.empty(0, np.uint64)
            return
        at = np.cumsum(self.length) - self.length
        place = np.arange(int(self.length.sum()), dtype=np.int32) - np.repeat(at, self.length).astype(np.int32)
        powers = seeded(2, int(self.length.max()))
        with np.errstate(over="ignore"):
            sums = np.add.reduceat(BYTE_WEIGHTS[sign[inside]] * powers[place], at)
            self.key = mix(sums + self.length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def runs(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each run of ``size`` words, and whether the run lies within one text."""
        n = len(self.key) - size + 1
        if n <= 0:
            return np.empty(0, np.uint64), np.empty(0, bool)
        factors = seeded(3 + size, size)
        with np.errstate(over="ignore"):
            total = np.zeros(n, np.uint64)
            for j in range(size):
                total += self.key[j:j + n] * factors[j]
        return mix(total), self.doc[:n] == self.doc[size - 1:size - 1 + n]


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each window of ``width`` values, by doubling."""
    out, have = x, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out
