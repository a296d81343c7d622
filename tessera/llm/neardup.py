"""Near-duplicates by ProbMinHash.

A text is its shingles (``SHINGLE`` consecutive plain words; a shorter text is one
shingle of all its words), each weighted ``1 + ln(occurrences)``. Each shingle starts a
Poisson process whose rate is its weight; every arrival picks one of ``REGISTERS``
registers, a register keeps the shingle of its earliest arrival, and a shingle stops as
soon as its time is beyond the latest register of its text. Two texts agree in a register
with their probability Jaccard similarity, the sum over shared shingles ``i`` of
``1 / sum_j max(x_j / x_i, y_j / y_i)`` for weights ``x`` and ``y``. Links are defined, searched and
verified by this one similarity; without repeated shingles it is the Jaccard similarity of the sets.

Texts with equal words are one node from the start. ``BANDS`` bands of registers
bring alike nodes together: with 24 bands of 5, a pair at 0.8 shares a bucket with
probability 0.9999. A bucket is not turned into pairs. Its nodes are compared with
its smallest node; accepted links give components; then nodes of a bucket outside its
largest component are compared with the nodes of other components in it, but for
pairs that exact bounds on their rare shingles rule out. So a link between two nodes
of a bucket is either verified or lies within one component already. A link needs an
exactly computed probability Jaccard similarity of at least ``SIMILARITY``. Components
come from alternating star steps, each written to the shared folder.

Documents are keyed by ``doc_id`` and, where ids repeat, a hash of the text; rows
equal in both are one document. Null texts and texts without words stand alone.
Extra columns are ignored, or passed through by :func:`drop_near_copies`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import keyed, tie_breaker
from tessera.llm.wordarrays import Words, buffers, chunks, mix, plain_table, seeded
from tessera.session import materialize

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 5
REGISTERS = BANDS * ROWS
#: Nodes among the compared ones up to which a shingle counts as rare.
RARE = 8


def shingles(w: Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, hash and count of each distinct shingle, ordered by text and hash."""
    runs, within = w.runs(size)
    doc, key = w.doc[:len(runs)][within], runs[within]
    short = np.flatnonzero((w.per_doc > 0) & (w.per_doc < size))
    if len(short):
        doc, key = np.concatenate((doc, short)), np.concatenate((key, sequence_hash(w, 11)[short]))
    order = np.lexsort((key, doc))
    doc, key = doc[order], key[order]
    new = np.ones(len(key), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])
    at = np.flatnonzero(new)
    return doc[at], key[at], np.diff(np.append(at, len(key)))


def weights(n: np.ndarray) -> np.ndarray:
    """Weight of a shingle that occurs ``n`` times."""
    return 1 + np.log(n)


def probability_jaccard(sa: np.ndarray, wa: np.ndarray, sb: np.ndarray, wb: np.ndarray, least: float) -> tuple[bool, np.ndarray]:
    """Whether two weighted sets (rising keys) reach the similarity ``least``, and which keys of the first the second lacks."""
    at = np.minimum(np.searchsorted(sb, sa), len(sb) - 1)
    shared = sb[at] == sa
    x, y, x_all, y_all = wa[shared], wb[at[shared]], wa.sum(), wb.sum()
    only_x, only_y = x_all - x.sum(), y_all - y.sum()
    if not len(x) or bound(only_x / x_all, only_y / y_all) < least:
        return False, ~shared
    order = np.argsort(y / x)
    x, y = x[order], y[order]
    # max(x_j / x_i, y_j / y_i) is the first up to the ratio of i, the second beyond it
    total = (only_x + np.cumsum(x)) / x + (only_y + y.sum() - np.cumsum(y)) / y
    return bool((1 / total).sum() >= least), ~shared


def bound(a, b):
    """Most that the similarity can be when shares ``a`` and ``b`` of the two texts' weight are not in the other text."""
    return (1 - a) * (1 - b) / (1 - a * b)


def sequence_hash(w: Words, seed: int) -> np.ndarray:
    """Hash of each text's whole word sequence; 0 without words."""
    out = np.zeros(w.n_docs, np.uint64)
    some = np.flatnonzero(w.per_doc)
    if len(some):
        place = np.arange(len(w.key)) - w.first[w.doc]
        with np.errstate(over="ignore"):
            each = mix(w.key + mix(place.astype(np.uint64) + seeded(seed, 1)))
            out[some] = mix(np.add.reduceat(each, w.first[some]) + w.per_doc[some].astype(np.uint64))
    return out


def prob_minhash(doc: np.ndarray, key: np.ndarray, weight: np.ndarray, n_docs: int,
                 registers: int = REGISTERS) -> np.ndarray:
    """Signatures, one row of ``registers`` shingle hashes per text (0 for a text without shingles)."""
    earliest = np.full(n_docs * registers, np.inf)
    chosen = np.zeros(n_docs * registers, np.uint64)
    time = np.zeros(len(key))
    steps = seeded(21, 1)[0]
    arrival = 0
    while len(key):
        arrival += 1
        with np.errstate(over="ignore"):
            draw = mix(key + np.uint64(arrival) * steps)
        time = time - np.log(((draw >> np.uint64(32)).astype(np.float64) + 0.5) / 2.0**32) / weight
        at = doc * registers + ((draw & np.uint64(0xFFFFFFFF)) * np.uint64(registers) >> np.uint64(32)).astype(np.int64)
        sooner = np.flatnonzero(time < earliest[at])
        np.minimum.at(earliest, at[sooner], time[sooner])
        won = sooner[time[sooner] == earliest[at[sooner]]]
        chosen[at[won]] = key[won]
        open_docs = np.flatnonzero(np.bincount(doc, minlength=n_docs))
        latest = np.zeros(n_docs)
        latest[open_docs] = earliest.reshape(n_docs, registers)[open_docs].max(1)
        going = time < latest[doc]  # a later arrival cannot win any register
        doc, key, weight, time = doc[going], key[going], weight[going], time[going]
    return chosen.reshape(n_docs, registers)


def band_hashes(signature: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    factors = seeded(31, bands * rows).reshape(bands, rows)
    with np.errstate(over="ignore"):
        return mix((mix(signature).reshape(-1, bands, rows) * factors).sum(axis=2, dtype=np.uint64))


def signature_rows(size: int):
    table = plain_table()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offs = buffers(b.column("text"))
            for lo, hi in chunks(offs):
                w = Words(raw, offs, lo, hi, table)
                doc, key, n = shingles(w, size)
                bands = band_hashes(prob_minhash(doc, key, weights(n), w.n_docs)).view(np.int64)
                some = w.per_doc > 0
                ends = np.concatenate(([0], np.cumsum(np.where(some, BANDS, 0)))).astype(np.int32)
                digest = [sequence_hash(w, seed).view(np.int64) for seed in (12, 13)]
                part = b.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("tie"), *(pa.array(d, mask=~some) for d in digest),
                     pa.ListArray.from_arrays(pa.array(ends), pa.array(bands[some].ravel()))],
                    ["doc_id", "tie", "h1", "h2", "bands"])
    return rows


def shingle_rows(size: int):
    table = plain_table()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offs = buffers(b.column("text"))
            for lo, hi in chunks(offs):
                w = Words(raw, offs, lo, hi, table)
                doc, key, n = shingles(w, size)
                ends = np.searchsorted(doc, np.arange(w.n_docs + 1)).astype(np.int32)
                part = b.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [part.column("node"), *(pa.ListArray.from_arrays(pa.array(ends), pa.array(v))
                                            for v in (key.view(np.int64), n.astype(np.int32)))],
                    ["node", "shingles", "times"])
    return rows


NODE = "struct<doc_id:bigint,tie:bigint>"


def _shingle_sets(nodes: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """``(node, shingles, times)`` of the given nodes.

    The join is the same at every size of the node list: both sides are shuffled, none is broadcast.
    """
    texts = docs.select(F.struct("doc_id", "tie").alias("node"), "text").join(nodes.hint("merge"), "node", "left_semi")
    return texts.mapInArrow(shingle_rows(size), f"node {NODE}, shingles array<long>, times array<int>")


def compare_rows(similarity: float):
    """Judges each pair of weighted shingle sets; ``own`` has the shingles that ``b`` lacks, ``lost`` their share of ``a``'s
    weight; ``n`` and ``x`` are the number and the weight of ``a``'s shingles."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flat(column: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
            return column.flatten().to_numpy().view(kind), np.append(0, np.cumsum(column.value_lengths().to_numpy()))

        for batch in batches:
            (ka, ea), (kb, eb) = flat(batch.column("sa"), np.uint64), flat(batch.column("sb"), np.uint64)
            wa, wb = (weights(batch.column(c).flatten().to_numpy()) for c in ("ta", "tb"))
            linked, lacking = np.zeros(batch.num_rows, bool), np.zeros(len(ka), bool)
            share, whole = np.zeros(len(ka)), np.zeros(batch.num_rows)
            for i in range(batch.num_rows):
                p, q = slice(ea[i], ea[i + 1]), slice(eb[i], eb[i + 1])
                linked[i], lacking[p] = probability_jaccard(ka[p], wa[p], kb[q], wb[q], similarity - 1e-9)
                whole[i] = wa[p].sum()
                share[p] = wa[p] / whole[i]
            ends = pa.array(np.append(0, np.cumsum(lacking))[ea], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b"), pa.array(linked),
                 pa.ListArray.from_arrays(ends, pa.array(ka[lacking].view(np.int64))),
                 pa.ListArray.from_arrays(ends, pa.array(share[lacking])), pa.array(np.diff(ea)), pa.array(whole)],
                ["a", "b", "linked", "own", "lost", "n", "x"])
    return rows


def _compared(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """``(a, b, linked, own, lost, n, x)`` of pairs: whether they are alike, and what of ``a`` its partner lacks."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"), F.col("times").alias("ta"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"), F.col("times").alias("tb"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "ta", "sb", "tb")
    return both.mapInArrow(compare_rows(similarity), f"a {NODE}, b {NODE}, linked boolean, own array<long>, lost array<double>, n long, x double")


def components(links: DataFrame) -> DataFrame:
    """``(node, label)`` for every node of ``links (a, b)``; the label is the smallest node of its component.

    Alternates the large-star and small-star steps: each node points its larger, then
    its not larger neighbours to its smallest one, until nothing changes.
    """
    def state(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.union(e.select("b", "a")) if large else e
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        near = both.join(least, "a")
        if large:
            return near.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        out = near.select(F.col("b").alias("a"), F.col("m").alias("b")).union(near.select("a", F.col("m").alias("b")))
        return out.filter(F.col("a") != F.col("b")).distinct()

    e = materialize(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    last = state(e)
    while True:
        e = materialize(star(star(e, True), False), "stars")
        now = state(e)
        if now == last:
            break
        last = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("label"))


def _pairs_between(rest: DataFrame, facts: DataFrame, similarity: float) -> DataFrame:
    """Pairs ``(a, b)`` of nodes of one bucket, in different components, that may be linked.

    ``rest`` has the nodes of mixed buckets (but the first of each) with their label and the
    bucket's major one; ``facts`` has, by node and first node, the shingles that the first one lacks
    (``own``) and their shares of the node's weight (``lost``). Shares p and q of two texts that the
    other lacks bound their similarity by ``bound(p, q)``. A share is at least that of the rare own shingles
    (in at most ``RARE`` nodes compared with that first node) if none of them is in both texts; and what
    the texts have in common weighs at most ``(1 - q) y`` in the other, and as each weight is 1 or more, at most the
    excess of the own weight over its number of shingles above that here. Pairs whose shares give a bound
    below ``similarity`` have a rare shingle in common or no link; they are met by that shingle, at
    most ``RARE`` times each. Only the other pairs are met by their bucket. Nothing is lost, and a
    group of near copies that differ from each other in their own edits does not turn into all its pairs.
    """
    once = rest.select("first", "node", "label").distinct().join(facts, ["first", "node"])
    tokens = once.select("first", "node", "label", F.inline(F.arrays_zip(F.col("own").alias("s"), F.col("lost").alias("w"))))
    rare = tokens.groupBy("first", "s").agg(F.count("*").alias("df")).filter(F.col("df") <= RARE)
    held = materialize(tokens.join(rare, ["first", "s"]), "rare")
    counts = held.groupBy("first", "node").agg(F.sum("w").alias("r"))
    counts = once.select("first", "node", "n", "x").join(counts, ["first", "node"], "left").fillna(0.0, ["r"])
    rest = rest.join(counts, ["first", "node"])

    def side(rows: DataFrame, name: str) -> DataFrame:
        return rows.select("band", "h", F.col("node").alias(name), *[
            F.col(c).alias(f"{c}_{name}") for c in ("label", "major", "r", "n", "x")])

    def apart(own: str, other: str) -> Column:
        """Least share of one text's weight that the other lacks, without a rare shingle in common."""
        x, n, r = (F.col(f"{c}_{own}") for c in ("x", "n", "r"))
        common = (1 - F.col(f"r_{other}")) * F.col(f"x_{other}") + x - n
        return F.greatest(r, 1 - common / x)

    # by bucket: both texts have so little rare weight of their own that the bound lets them be linked
    few = rest.filter(F.col("r") <= 1 - similarity + 1e-9)
    by_bucket = side(few.filter("label != major"), "a").join(side(few, "b"), ["band", "h"]).filter(
        (F.col("label_a") != F.col("label_b")) & (bound(apart("a", "b"), apart("b", "a")) >= similarity - 1e-9)
        & ((F.col("label_b") == F.col("major_b")) | (F.col("a") > F.col("b"))))
    shared = held.filter("df > 1")
    left = shared.select("first", "s", F.col("node").alias("a"), F.col("label").alias("la"))
    right = shared.select("first", "s", F.col("node").alias("b"), F.col("label").alias("lb"))
    by_shingle = left.join(right, ["first", "s"]).filter((F.col("la") != F.col("lb")) & (F.col("a") > F.col("b")))
    return by_bucket.select("a", "b").union(by_shingle.select("a", "b")).distinct()


def _labels(nodes: DataFrame, docs: DataFrame, size: int, similarity: float) -> DataFrame:
    """``(node, label)`` of the nodes with a link that the bands find; the label is the smallest node."""
    buckets = nodes.select("node", F.posexplode("bands").alias("band", "h"))
    shared = materialize(
        buckets.groupBy("band", "h").agg(F.min("node").alias("first"), F.count("*").alias("n")).filter("n > 1"), "buckets")
    members = materialize(buckets.join(shared.select("band", "h", "first"), ["band", "h"]), "members")
    sets = materialize(_shingle_sets(members.select("node").distinct(), docs, size), "shingles")
    tried = members.filter("node != first").select(F.col("node").alias("a"), F.col("first").alias("b")).distinct()
    tried = materialize(_compared(tried, sets, similarity), "tried")
    label = components(tried.filter("linked"))
    placed = members.join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = (placed.groupBy("band", "h", "label").agg(F.count("*").alias("n"))
             .groupBy("band", "h").agg(F.max_by("label", "n").alias("major"), F.count("*").alias("labels"))
             .filter("labels > 1").select("band", "h", "major"))
    facts = tried.select(F.col("a").alias("node"), F.col("b").alias("first"), "own", "lost", "n", "x")
    rest = materialize(placed.join(mixed, ["band", "h"]).filter("node != first"), "rest")
    pairs = _pairs_between(rest, facts, similarity)
    between = materialize(_compared(pairs, sets, similarity).filter("linked").select("a", "b"), "between")
    if not between.limit(1).count():
        return label
    # the few links between components join their labels
    for side in ("a", "b"):
        named = label.select(F.col("node").alias(side), F.col("label").alias(f"l{side}"))
        between = between.join(named, side, "left").withColumn(f"l{side}", F.coalesce(f"l{side}", side))
    joined = components(between.select(F.col("la").alias("a"), F.col("lb").alias("b")))
    joined = joined.select(F.col("node").alias("label"), F.col("label").alias("whole"))
    own = joined.select(F.col("label").alias("node"), "label")  # labels, and nodes that had no link before
    every = label.union(own.join(label, "node", "left_anti"))
    return every.join(joined, "label", "left").select("node", F.coalesce("whole", "label").alias("label"))


def near_copy_classes(docs: DataFrame, size: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """Per document: ``doc_id, tie, class_id, class_tie, kept``; the smallest document of a class is kept."""
    docs = keyed(docs)
    schema = "doc_id long, tie long, h1 long, h2 long, bands array<long>"
    signed = materialize(docs.mapInArrow(signature_rows(size), schema), "signatures")
    node = F.struct("doc_id", "tie")
    words = signed.filter("h1 is not null")
    # texts with equal words are one node, named by the smallest of its documents
    nodes = (words.groupBy("h1", "h2").agg(F.min(F.struct(node.alias("node"), F.col("bands"))).alias("m"))
             .select("h1", "h2", "m.node", "m.bands"))
    nodes = materialize(nodes, "nodes")
    label = _labels(nodes.select("node", "bands"), docs, size, similarity)
    named = nodes.select("h1", "h2", "node").join(label, "node", "left")
    named = named.select("h1", "h2", F.coalesce("label", "node").alias("class"))
    alone = F.coalesce(F.col("class"), F.struct("doc_id", "tie"))
    out = signed.select("doc_id", "tie", "h1", "h2").join(named, ["h1", "h2"], "left").withColumn("class", alone)
    return out.select("doc_id", "tie", F.col("class.doc_id").alias("class_id"), F.col("class.tie").alias("class_tie"),
                      (F.col("class") == F.struct("doc_id", "tie")).alias("kept"))


def near_copies(docs: DataFrame, **options) -> DataFrame:
    """Per document: ``doc_id, class_id`` (smallest ``doc_id`` of its class), ``kept``."""
    return near_copy_classes(docs, **options).select("doc_id", "class_id", "kept")


def drop_near_copies(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one document of each class: the smallest ``doc_id``."""
    tie, repeated = tie_breaker(docs)
    if repeated:  # rows equal in id and text first become one row
        docs = docs.withColumn("_own_tie", tie).dropDuplicates(["doc_id", "_own_tie"]).drop("_own_tie")
        tie, _ = tie_breaker(docs)
    gone = near_copy_classes(docs, **options).filter("not kept").select(F.col("doc_id").alias("_d"), F.col("tie").alias("_t"))
    gone = materialize(gone, "copies")
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["_d"]) & (tie == gone["_t"]), "left_anti")
