"""Alignment of the tokens of two tokenizers by pointer jumping.

A text, with a space before it, is encoded by a byte-level BPE file (A) and by a
SentencePiece model (B, which adds that space itself). Both cut the same bytes, so a
token is a byte range, and tokens of A and B that share a byte are linked. Every token
points to its farthest-right overlapping token (itself where both tokenizers end
together); doubling all pointers of a chunk of texts at once until nothing changes
takes each token to the last A token of its group, which labels the group. Links are
the pieces between neighbouring ends of either side: each lies in one token of each.

Link counts are corpus-wide: how many documents hold an id pair linked. Pairs are counted by a
partially aggregated ``groupBy``. To bring counts back to documents, the pairs that
most documents hold (at most ``FREQUENT``, whole powers of two of the count) are looked
up where the document's pairs lie; the others are joined by pair. The two parts are
disjoint and together whole, at any size.

Every row is a document, repeated rows and ids too. A text that is null or empty, or
whose joined A or B bytes differ from space + text (a normalised or replaced sign), has
no tokens: zeros, and an empty ``groups``. Extra columns are ignored; an empty table
gives no row. Special-token strings in a text are plain text.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.packing import OTHER_SIGNS
from tessera.llm.wordarrays import buffers, chunks
from tessera.session import materialize

#: Id pairs whose counts are broadcast, at most (24 bytes each).
FREQUENT = 1 << 19
ALIGNED = ("row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, "
           "a array<int>, b array<int>, times array<int>")


def tokenizer_files() -> tuple[str, str, str]:
    """Default files: tokenizer A, the rank file of its vocabulary, and model B."""
    import public_tokenizers

    return tuple(public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"))


def byte_signs() -> dict[str, int]:
    """Byte of each sign of a byte-level vocabulary: printable Latin-1 signs stand for themselves, the other bytes follow from 256."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = (b for b in range(256) if b not in printable)
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


class Side:
    """Byte string, byte length and decimal forms of each id of one vocabulary."""

    def __init__(self, entries: list[bytes], last: str):
        self.bytes = entries
        self.length = np.array([len(e) for e in entries], np.int64)
        self.marked = [f"{i},".encode() for i in range(len(entries))] + [f"{i}{last}".encode() for i in range(len(entries))]


class Encoders:
    """Both tokenizers, loaded once per Python worker."""

    def __init__(self, a_json: str, a_ranks: str, b_model: str):
        import base64

        import public_tokenizers
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(a_json)
        self.whole.encode_special_tokens = True
        with open(a_ranks, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=b_model)
        signs, entries = byte_signs(), [b""] * self.whole.get_vocab_size()
        for entry, i in self.whole.get_vocab().items():
            entries[i] = bytes(signs[c] for c in entry) if all(c in signs for c in entry) else entry.encode()
        self.a = Side(entries, "|")
        sp = self.pieces
        self.b = Side([bytes([int(sp.id_to_piece(i)[3:-1], 16)]) if sp.is_byte(i)
                       else sp.id_to_piece(i).replace("▁", " ").encode() for i in range(sp.get_piece_size())], ";")

    def tokens(self, texts: list[str]) -> Iterator[tuple[list[int], list[int]]]:
        """Ids of A and B of each text; none where either side's bytes differ from space + text."""
        for text, b in zip(texts, self.pieces.encode(texts, num_threads=1), strict=True):
            spaced = " " + text
            if OTHER_SIGNS.search(text):
                a = self.whole.encode(spaced, add_special_tokens=False).ids
            else:
                a = self.fast.encode_ordinary(spaced)
            raw = spaced.encode()
            same = text and all(b"".join(map(side.bytes.__getitem__, ids)) == raw for side, ids in ((self.a, a), (self.b, b)))
            yield (a, b) if same else ([], [])


@functools.cache
def encoders(a_json: str, a_ranks: str, b_model: str) -> Encoders:
    return Encoders(a_json, a_ranks, b_model)


def ends_before(ends: np.ndarray, total: int) -> np.ndarray:
    """For each byte of ``total`` how many tokens end before or at its start: the place of the token that holds it."""
    mark = np.zeros(total + 1, np.int32)
    mark[ends] = 1
    return np.cumsum(mark[:-1], dtype=np.int32)


def group_labels(end_a: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each A and each B token the last A token of its group, by pointer jumping.

    ``end_a`` and ``end_b`` are the rising byte ends of both sides; the last ones are equal.
    """
    n, total = len(end_a), int(end_a[-1]) if len(end_a) else 0
    over_b = ends_before(end_b, total)[end_a - 1]  # the B token that holds an A token's last byte, and the reverse
    over_a = ends_before(end_a, total)[end_b - 1]
    to = np.concatenate((np.where(end_b[over_b] > end_a, n + over_b, np.arange(n)), over_a))
    while True:
        further = to[to]
        if np.array_equal(further, to):
            return to[:n], to[n:]
        to = further


def align(a: list[list[int]], b: list[list[int]], side_a: Side, side_b: Side) -> dict[str, list]:
    """Columns of a chunk of texts from their ids; see ``align_tokens``."""
    n_docs = len(a)
    n_a, n_b = (np.array([len(x) for x in s], np.int64) for s in (a, b))
    ids_a, ids_b = (np.fromiter(chain.from_iterable(s), np.int64, int(n.sum())) for s, n in ((a, n_a), (b, n_b)))
    end_a, end_b = np.cumsum(side_a.length[ids_a]), np.cumsum(side_b.length[ids_b])
    label_a, label_b = group_labels(end_a, end_b)
    doc_a, doc_b = np.repeat(np.arange(n_docs), n_a), np.repeat(np.arange(n_docs), n_b)
    last = label_a == np.arange(len(ids_a))
    n_groups = np.bincount(doc_a[last], minlength=n_docs)
    # text form: the tokens of A, then of B, group after group
    group = np.cumsum(last) - last
    of_a, of_b = group, group[label_b]
    many = int(last.sum())
    sizes_a, sizes_b = np.bincount(of_a, minlength=many), np.bincount(of_b, minlength=many)
    place_a = np.arange(len(ids_a)) + (np.cumsum(sizes_b) - sizes_b)[of_a]
    place_b = np.arange(len(ids_b)) + np.cumsum(sizes_a)[of_b]
    ends_b = np.append(of_b[1:] != of_b[:-1], True) if len(of_b) else np.empty(0, bool)
    codes = np.empty(len(ids_a) + len(ids_b), np.int64)
    codes[place_a] = ids_a + len(side_a.bytes) * last
    codes[place_b] = 2 * len(side_a.bytes) + ids_b + len(side_b.bytes) * ends_b
    marks, signs = side_a.marked + side_b.marked, codes.tolist()
    stops = np.cumsum(n_a + n_b)
    groups = [b"".join(map(marks.__getitem__, signs[s - n:s]))[:-1].decode()
              for s, n in zip(stops.tolist(), (n_a + n_b).tolist(), strict=True)]
    # links: between neighbouring ends of either side
    total = int(end_a[-1]) if len(end_a) else 0
    either = np.zeros(total + 1, bool)
    either[end_a] = either[end_b] = True
    cuts = np.flatnonzero(either) - 1  # last byte of each link
    at_a = ends_before(end_a, total)[cuts]
    link_doc = doc_a[at_a]
    width = len(side_b.bytes)
    pair = (link_doc * len(side_a.bytes) + ids_a[at_a]) * width + ids_b[ends_before(end_b, total)[cuts]]
    pair, times = np.unique(pair, return_counts=True)
    rest = pair // width
    return {"n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": np.bincount(link_doc, minlength=n_docs), "groups": groups,
            "offsets": np.searchsorted(rest // len(side_a.bytes), np.arange(n_docs + 1)),
            "a": rest % len(side_a.bytes), "b": pair % width, "times": times}


def aligned_rows(files: tuple[str, str, str]):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoders(*files)
        for batch in batches:
            _, offs = buffers(batch.column("text"))
            for lo, hi in chunks(offs):
                part = batch.slice(lo, hi - lo)
                a, b = zip(*enc.tokens([t or "" for t in part.column("text").to_pylist()]), strict=True)
                x = align(a, b, enc.a, enc.b)
                ends = pa.array(x["offsets"], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), part.column("doc_id"),
                     *(pa.array(x[c], pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")),
                     pa.array(x["groups"], pa.string()),
                     *(pa.ListArray.from_arrays(ends, pa.array(x[c], pa.int32())) for c in ("a", "b", "times"))],
                    [c.split()[0] for c in ALIGNED.split(", ")])
    return rows


def align_tokens(docs: DataFrame, files: tuple[str, str, str] | None = None) -> DataFrame:
    """Per row of ``docs``: ``row, doc_id, n_a, n_b, n_groups, n_links, groups, a, b, times``.

    ``groups`` spells the groups as ``a1,a2|b1;a3|b2,b3`` with decimal ids in order;
    ``a, b, times`` are the distinct linked id pairs and how many links each has.
    ``row`` numbers the rows of one run.
    """
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), "text")
    return numbered.mapInArrow(aligned_rows(tuple(files or tokenizer_files())), ALIGNED)


def pair_key(a: str = "a", b: str = "b") -> Column:
    return F.shiftleft(F.col(a).cast("long"), 32) + F.col(b)


def _links(aligned: DataFrame) -> DataFrame:
    return aligned.select("row", F.inline(F.arrays_zip("a", "b", "times")))


def link_counts(aligned: DataFrame) -> DataFrame:
    """``a, b, n, best``: documents that hold the pair linked, and whether no pair of that A id has more."""
    counts = materialize(_links(aligned).groupBy("a", "b").agg(F.count("*").alias("n")), "link-counts")
    most = counts.groupBy("a").agg(F.max("n").alias("most"))
    return counts.join(most, "a").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


def link_totals(aligned: DataFrame, counts: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """Per row with links: ``row, n_best, count_sum`` over its links, from the ``counts`` of their pairs."""
    counts = materialize(counts.select(pair_key().alias("key"), "n", "best"), "pair-counts")
    sizes = {r["power"]: r["pairs"] for r in counts.groupBy(F.floor(F.log2("n")).alias("power")).agg(F.count("*").alias("pairs")).collect()}
    least = max(sizes, default=0) + 1
    while least and sum(k for p, k in sizes.items() if p >= least - 1) <= frequent:
        least -= 1
    often = counts.filter(F.floor(F.log2("n")) >= least)
    links = _links(aligned).select("row", pair_key().alias("key"), "times")
    sums = [F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
            F.sum(F.col("times") * F.col("n")).alias("count_sum")]
    out = links.join(F.broadcast(often), "key").groupBy("row").agg(*sums)
    if least:  # the rest, met by pair: no pair of it is in as many documents as the frequent ones
        rare = links.join(F.broadcast(often.select("key")), "key", "left_anti")
        rest = rare.join(counts.filter(F.floor(F.log2("n")) < least).hint("merge"), "key").groupBy("row").agg(*sums)
        out = out.union(rest).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return out


def alignment_digests(docs: DataFrame, files: tuple[str, str, str] | None = None, frequent: int = FREQUENT) -> DataFrame:
    """Per document: token, group and link numbers, totals of the links' corpus-wide counts, and a digest of its groups."""
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)).alias("groups_sha256")
    own = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links"]
    aligned = materialize(align_tokens(docs, files).select(*own, digest, "a", "b", "times"), "aligned")
    totals = link_totals(aligned, link_counts(aligned), frequent)
    return aligned.select(*own, "groups_sha256").join(totals, "row", "left").select(
        *own[1:], *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")), "groups_sha256")
