"""Substring dedup by super-k-mers.

A window is ``WINDOW`` consecutive words of one text. Its minimiser is the smallest
hash among the runs of ``MINIMISER`` words inside it, so equal windows have equal
minimisers, and consecutive windows mostly share one. Such a stretch (a super-k-mer)
travels as one packed string of its words to the bucket of its minimiser, where
sorting brings equal windows together in corpus order: all but the first of a run
of equals repeat an earlier start.

Three steps keep the traffic low. A copy of an earlier text repeats it as a whole and
sends nothing. A census counts the minimisers of all super-k-mers
(numbers only, summed before the shuffle); a window whose minimiser occurs in one
super-k-mer alone, without a repeat inside it, cannot occur twice, so only the other
stretches travel. And equal strings of one task are folded into their first
occurrence, which carries the places of the others. Minimisers of more than
``HOT`` windows are split: their windows travel one by one as a 128-bit digest of their
words and a place; the first place of each digest is a partially aggregated minimum, joined
back to the places, so the places of a window that stands in a third of all documents are
never one task's list. Nothing is capped. Elsewhere equality is decided on the words.

Documents are keyed by ``doc_id`` and, where ids repeat, a hash of the text; the
order among equal ids is by that hash, null ids come first. Rows equal in both are
one document: each of them gets its result. Null and empty texts have no words.
Extra columns are ignored, or passed through unchanged by :func:`remove_repeats`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import tie_breaker
from tessera.llm.wordarrays import Words, buffers, chunks, sliding_min, spaced_table
from tessera.session import materialize

WINDOW = 20
MINIMISER = 5
#: Longest super-k-mer, in windows; a longer stretch is cut, which loses no window.
LONGEST = 256
#: Windows of one minimiser above which they travel one by one; a bucket holds no more.
HOT = 50_000

CENSUS = "mini long, doc_id long, tie long, start int, n int, moves boolean"
PACKED = ("bucket long, words binary, doc_id long, tie long, start int, n int, "
          "same array<struct<doc_id:long,tie:long,start:int>>")
RANGES = "doc_id long, tie long, lo int, hi int"


def _stretches(w: Words, window: int, minimiser: int) -> tuple[np.ndarray, ...]:
    """Minimiser, text, first window and number of windows of each super-k-mer, and whether
    the first place of the minimiser moves on within it.

    Equal windows have the minimiser at the same offset, so a stretch can repeat a
    window of its own only if that place moves.
    """
    hashes, _ = w.runs(minimiser)
    n = len(w.key) - window + 1
    none = np.empty(0, np.int64)
    if n <= 0:
        return none, none, none, none, np.empty(0, bool)
    least = sliding_min(hashes, window - minimiser + 1)
    valid = np.flatnonzero(w.doc[:n] == w.doc[window - 1:])
    if not len(valid):
        return none, none, none, none, np.empty(0, bool)
    least, doc, leaves = least[valid].view(np.int64), w.doc[valid], least[valid] == hashes[valid]
    new = np.ones(len(valid), bool)
    new[1:] = (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, len(valid)))
    leaves[at + size - 1] = False
    moves = np.logical_or.reduceat(leaves, at)
    cuts = -(-size // LONGEST)  # long stretches (repeated words) are cut into pieces
    if (cuts > 1).any():
        piece = np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        ends = np.repeat(at + size, cuts)
        at, moves = np.repeat(at, cuts) + piece * LONGEST, np.repeat(moves, cuts)
        size = np.minimum(LONGEST, ends - at)
    doc = doc[at]
    return least[at], doc, valid[at] - w.first[doc], size, moves


def census_rows(window: int, minimiser: int):
    table = spaced_table()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offs = buffers(b.column("text"))
            for lo, hi in chunks(offs):
                mini, doc, start, n, moves = _stretches(Words(raw, offs, lo, hi, table), window, minimiser)
                part = b.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([
                    pa.array(mini), part.column("doc_id").take(pa.array(doc)), part.column("tie").take(pa.array(doc)),
                    pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(moves)],
                    ["mini", "doc_id", "tie", "start", "n", "moves"])
    return rows


def _order(key: tuple) -> tuple:
    doc_id, tie, start = key
    return (doc_id is not None, doc_id or 0, tie, start)


def _spread(*key) -> int:
    """Bucket of a place."""
    return int.from_bytes(hashlib.blake2b(repr(key).encode(), digest_size=8).digest(), "little", signed=True)


def packed_rows(window: int):
    """Packs the stretches listed in ``found``; equal strings of a batch travel once."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: dict[tuple[int, bytes], list] = {}
            size = 0
            for doc_id, tie, text, found in zip(*(b.column(c).to_pylist() for c in ("doc_id", "tie", "text", "found")),
                                                strict=True):
                words = (text or "").encode().split()
                if any(s["mini"] is None for s in found):  # the text is a copy: all its windows start earlier
                    if len(words) >= window:
                        seen[(_spread(doc_id, tie, 0), b"", doc_id, tie)] = [-len(words), (doc_id, tie, 0)]
                    continue
                for s in found:
                    start, n = s["start"], s["n"]
                    packed = b" ".join(words[start:start + n + window - 1])
                    places = seen.setdefault((s["mini"], packed), [n])
                    size += len(packed) * (len(places) == 1) + 48
                    places.append((doc_id, tie, start))
                if size > 4_000_000:
                    yield _packed_batch(seen)
                    seen, size = {}, 0
            if seen:
                yield _packed_batch(seen)
    return rows


def hot_rows(window: int):
    """Digest and place of each window of the stretches listed in ``found``."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int32())

        def emit(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)],
                                              ["window", "doc_id", "tie", "start"])
        for b in batches:
            out: list[tuple] = []
            for doc_id, tie, text, found in zip(*(b.column(c).to_pylist() for c in ("doc_id", "tie", "text", "found")), strict=True):
                words = (text or "").encode().split()
                for s in found:
                    for start in range(s["start"], s["start"] + s["n"]):
                        digest = hashlib.blake2b(b" ".join(words[start:start + window]), digest_size=16).digest()
                        out.append((digest, doc_id, tie, start))
                    if len(out) > 20_000:
                        yield emit(out)
                        out = []
            if out:
                yield emit(out)
    return rows


def _packed_batch(seen: dict) -> pa.RecordBatch:
    cols: list[list] = [[] for _ in range(7)]
    for (bucket, packed, *_), (n, *places) in seen.items():
        places.sort(key=_order)
        same = [dict(zip(("doc_id", "tie", "start"), p, strict=True)) for p in places[1:]]
        for c, v in zip(cols, (bucket, packed, *places[0], n, same), strict=True):
            c.append(v)
    place = pa.struct([("doc_id", pa.int64()), ("tie", pa.int64()), ("start", pa.int32())])
    kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(place)]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)],
                                      ["bucket", "words", "doc_id", "tie", "start", "n", "same"])


def repeat_rows(window: int):
    """Sorts the windows of each bucket; gives the word ranges of windows with an earlier equal."""
    def ranges(flags: list[bool], start: int) -> list[tuple[int, int]]:
        out: list[tuple[int, int]] = []
        for j, flag in enumerate(flags):
            if flag:
                lo, hi = start + j, start + j + window
                if out and lo <= out[-1][1]:
                    out[-1] = (out[-1][0], hi)
                else:
                    out.append((lo, hi))
        return out

    def bucket_repeats(rows: list[tuple]) -> Iterator[tuple]:
        """``rows`` of one bucket in corpus order."""
        windows, at = [], []
        for i, (packed, _, _, _, n, _) in enumerate(rows):
            words = packed.split(b" ")
            at.append(len(windows))
            windows += [(b" ".join(words[j:j + window]), i) for j in range(n)]
        if len(windows) > len({w for w, _ in windows}):
            order = sorted(range(len(windows)), key=lambda k: windows[k][0])  # stable: equals stay in corpus order
            repeated = [False] * len(windows)
            for a, b in zip(order, order[1:], strict=False):
                repeated[b] = windows[a][0] == windows[b][0]
        else:
            repeated = [False] * len(windows)
        for i, (_, doc_id, tie, start, n, same) in enumerate(rows):
            if n < 0:
                yield doc_id, tie, 0, -n
            for lo, hi in ranges(repeated[at[i]:at[i] + max(n, 0)], start):
                yield doc_id, tie, lo, hi
            for p in same:
                yield p["doc_id"], p["tie"], p["start"], p["start"] + n + window - 1

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(out: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) if out else [[]] * 4
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)],
                                              ["doc_id", "tie", "lo", "hi"])
        bucket, held, out = None, [], []
        for b in batches:
            names = ("words", "doc_id", "tie", "start", "n", "same")
            for key, *row in zip(b.column("bucket").to_pylist(), *(b.column(c).to_pylist() for c in names), strict=True):
                if key != bucket:
                    out += bucket_repeats(held)
                    bucket, held = key, []
                held.append(tuple(row))
                if len(out) > 50_000:
                    yield emit(out)
                    out = []
        out += bucket_repeats(held)
        if out:
            yield emit(out)
    return rows


def repeated_ranges(docs: DataFrame, window: int = WINDOW, minimiser: int = MINIMISER, hot: int = HOT) -> DataFrame:
    """``(doc_id, tie, ranges)`` of the documents that repeat an earlier window, with word ranges to remove.

    ``docs`` has ``doc_id, tie, text``. Ranges may overlap.
    """
    stretches = docs.mapInArrow(census_rows(window, minimiser), CENSUS)
    counts = stretches.groupBy("mini").agg(F.count("*").alias("c"), F.sum("n").alias("windows"), F.max("moves").alias("moves"))
    again = counts.filter((F.col("c") > 1) | F.col("moves")).select("mini", "windows")
    found = stretches.drop("moves").join(again, "mini")
    found = found.unionByName(_copies(docs), allowMissingColumns=True).groupBy("doc_id", "tie").agg(F.collect_set(F.struct(
        "mini", "start", "n", (F.coalesce("windows", F.lit(0)) > hot).alias("hot"))).alias("found"))
    found = materialize(found, "stretches")
    left = found.select(F.col("doc_id").alias("_d"), F.col("tie").alias("_t"), "found")
    held = docs.join(left, docs["doc_id"].eqNullSafe(left["_d"]) & (docs["tie"] == left["_t"])).select("doc_id", "tie", "text", "found")

    def part(is_hot: bool) -> DataFrame:
        own = held.withColumn("found", F.filter("found", lambda s: s["hot"] == F.lit(is_hot)))
        return own.filter(F.size("found") > 0)
    dealt = part(False).mapInArrow(packed_rows(window), PACKED).repartition("bucket")
    ranges = dealt.sortWithinPartitions("bucket", "doc_id", "tie", "start").mapInArrow(repeat_rows(window), RANGES)
    if found.filter(F.exists("found", lambda s: s["hot"])).limit(1).count():
        places = part(True).mapInArrow(hot_rows(window), "window binary, doc_id long, tie long, start int")
        place = F.struct("doc_id", "tie", "start")
        # the minimum is dealt by another key than the join, so that Spark may split the join's side of a window that very many texts hold
        first = places.groupBy(F.concat("window", F.unhex(F.lit("00"))).alias("_w")).agg(F.min(place).alias("first"), F.count("*").alias("n"))
        first = first.filter("n > 1").select(F.substring("_w", 1, 16).alias("window"), "first")
        later = places.join(first.hint("merge"), "window").filter(place != F.col("first"))
        ranges = ranges.union(later.select("doc_id", "tie", F.col("start").alias("lo"), (F.col("start") + window).alias("hi")))
    return ranges.groupBy("doc_id", "tie").agg(F.collect_set(F.struct("lo", "hi")).alias("ranges"))


def _copies(docs: DataFrame) -> DataFrame:
    """Documents whose whole text is that of an earlier one, by a digest of the text."""
    each = docs.select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"), F.struct("doc_id", "tie").alias("node"))
    first = each.groupBy("digest").agg(F.min("node").alias("first"), F.count("*").alias("n")).filter("n > 1")
    later = each.join(first.select("digest", "first"), "digest").filter(F.col("node") != F.col("first"))
    return later.select("node.doc_id", "node.tie")


def _kept_words(text: str | None, ranges) -> tuple[list[bytes], int]:
    words = (text or "").encode().split()
    if ranges is None or not len(ranges):
        return words, len(words)
    gone = np.zeros(len(words) + 1, np.int32)
    for r in ranges:
        gone[r["lo"]] += 1
        gone[r["hi"]] -= 1
    gone = np.cumsum(gone[:-1]) > 0
    return [w for w, g in zip(words, gone.tolist(), strict=True) if not g], len(words)


def kept_text(text: Column, ranges: Column) -> Column:
    """The words of a text outside the ranges, joined by one space."""
    @F.pandas_udf("string")
    def kept(texts: pd.Series, gone: pd.Series) -> pd.Series:
        return pd.Series([b" ".join(_kept_words(t, r)[0]).decode() for t, r in zip(texts, gone, strict=True)], dtype=object)
    return kept(text, ranges)


def kept_digest(text: Column, ranges: Column) -> Column:
    """Struct of a text: ``n_words, n_removed, kept_sha256``."""
    @F.pandas_udf("struct<n_words:long,n_removed:long,kept_sha256:string>")
    def digest(texts: pd.Series, gone: pd.Series) -> pd.DataFrame:
        rows = []
        for t, r in zip(texts, gone, strict=True):
            words, n = _kept_words(t, r)
            rows.append((n, n - len(words), hashlib.sha256(b" ".join(words)).hexdigest()))
        return pd.DataFrame(rows, columns=["n_words", "n_removed", "kept_sha256"])
    return digest(text, ranges)


def _with_ranges(docs: DataFrame, **options) -> tuple[DataFrame, Column]:
    """``docs`` joined with its ranges to remove, null where there are none."""
    tie, repeated = tie_breaker(docs)
    one = docs.select("doc_id", tie.alias("tie"), "text")
    found = repeated_ranges(one.dropDuplicates(["doc_id", "tie"]) if repeated else one, **options)
    found = found.select(F.col("doc_id").alias("_d"), F.col("tie").alias("_t"), F.col("ranges").alias("_ranges"))
    joined = docs.join(found, docs["doc_id"].eqNullSafe(found["_d"]) & (tie == found["_t"]), "left")
    return joined, found["_ranges"]


def substring_digests(docs: DataFrame, **options) -> DataFrame:
    """Per document: ``doc_id, n_words, n_removed, kept_sha256``."""
    docs = docs.select("doc_id", "text")
    joined, ranges = _with_ranges(docs, **options)
    return joined.select("doc_id", kept_digest(docs["text"], ranges).alias("r")).select("doc_id", "r.*")


def remove_repeats(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with repeated passages cut from ``text``; a text that loses no word stays as it is.

    A changed text is its kept words joined by one space, and ``n_chars`` (if present) follows it.
    """
    joined, ranges = _with_ranges(docs, **options)
    text = F.when(ranges.isNull(), docs["text"]).otherwise(kept_text(docs["text"], ranges))
    out = joined.select(*[text.alias(c) if c == "text" else docs[c] for c in docs.columns])
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out
