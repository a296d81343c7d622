"""SimHash document fingerprints and their search, in DataFrame operations only.

The terms of a text are its shingles of ``SHINGLE`` plain words (a shorter text is one
shingle), weighted by how often they occur. The 64 bits of a term's hash vote with
that weight, and a fingerprint bit is set where more weight votes for than against.
Votes of two bits share one long sum, 32 bits each, so a text is counted with 32 sums
in one aggregation and no array of votes.

``near_fingerprints`` finds all pairs of distinct fingerprints within a Hamming radius
by permuted block tables: of ``blocks`` blocks of bits, a pair within the radius agrees
on some ``blocks - radius`` of them, so it meets in the table keyed by those blocks. A
pair is reported by the first table in which it meets.

Documents come in ascending ``doc_id`` (null first; equal ids by a hash of the text;
rows equal in both are one document). Null texts are empty; a text without words has
the fingerprint 0. Extra columns are ignored. A single document is its own next one.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import keyed, let, plain_words
from tessera.session import materialize

SHINGLE = 5
RADIUS = 3
BLOCKS = 6
BITS = 64
LANE = 0xFFFFFFFF
PAIR = (1 << 32) | 1


def term_rows(text: Column, size: int = SHINGLE) -> Column:
    """Array of ``(h0, ..)``: each word's hash with those of the next ``size - 1`` words."""
    return let(F.transform(plain_words(text), lambda w: F.xxhash64(w)), lambda h: F.arrays_zip(
        *[F.slice(h, F.lit(k + 1), F.size(h)).alias(f"h{k}") for k in range(size)]))


def fingerprints(texts: DataFrame, keys: list[str], size: int = SHINGLE) -> DataFrame:
    """``keys`` and ``fp`` (long) of each row of ``texts (keys, text)``; keys are unique."""
    rows = texts.select(*keys, F.posexplode_outer(term_rows(F.col("text"), size)).alias("pos", "t"))
    h = [F.col("t")[f"h{k}"] for k in range(size)]
    # a text of at least ``size`` words drops its last, cut shingles; a shorter one is its first
    term = F.when(h[-1].isNotNull() | (F.col("pos") == 0), F.xxhash64(*h))
    rows = rows.select(*keys, term.alias("term"))
    lanes = [F.sum(F.coalesce(F.shiftrightunsigned("term", k).bitwiseAND(F.lit(PAIR)), F.lit(0))).alias(f"v{k}")
             for k in range(BITS // 2)]
    votes = rows.groupBy(*keys).agg(F.count("term").alias("n"), *lanes)
    fp = F.lit(0).cast("long")
    for k in range(BITS // 2):
        for bit, ones in ((k, F.col(f"v{k}").bitwiseAND(F.lit(LANE))), (k + 32, F.shiftrightunsigned(f"v{k}", 32))):
            fp = fp.bitwiseOR(F.shiftleft((2 * ones > F.col("n")).cast("long"), bit))
    return votes.select(*keys, fp.alias("fp"))


def next_documents(docs: DataFrame) -> DataFrame:
    """``(doc_id, tie, n, next_id, next_tie)`` in ascending order, the last one followed by the first.

    Only keys and lengths are sorted. Each sorted part is numbered as it is written;
    a part's last row takes its successor from a table with one row per part.
    """
    slim = docs.select("doc_id", "tie", F.length(F.coalesce("text", F.lit(""))).alias("n"))
    slim = slim.orderBy("doc_id", "tie").withColumn("at", F.monotonically_increasing_id())
    slim = materialize(slim, "order").withColumn("part", F.shiftright("at", 33))
    me = F.struct("doc_id", "tie")
    heads = slim.groupBy("part").agg(F.min_by(me, "at").alias("head"))
    over = Window.orderBy("part")
    heads = heads.select("part", F.coalesce(
        F.lead("head").over(over),
        F.first("head").over(over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("then"))
    rows = slim.withColumn("next", F.lead(me).over(Window.partitionBy("part").orderBy("at")))
    rows = rows.join(F.broadcast(heads), "part").withColumn("next", F.coalesce("next", "then"))
    return rows.select("doc_id", "tie", "n", F.col("next.doc_id").alias("next_id"), F.col("next.tie").alias("next_tie"))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits."""
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(float(BITS))


def hex_fingerprint(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def document_fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """Per document: ``doc_id, tie, n_chars, edited_sha256, fp, edited_fp, next_fp`` (fingerprints as longs).

    The edited text has its last ``n_chars div 2`` characters replaced by the first as
    many of the next document.
    """
    docs = keyed(docs).withColumn("text", F.coalesce("text", F.lit("")))
    order = materialize(next_documents(docs), "next")
    # the head of each text travels to the document before it, no longer than that one needs
    to = order.select(F.col("next_id").alias("_d"), F.col("next_tie").alias("_t"), F.col("doc_id").alias("to_id"),
                      F.col("tie").alias("to_tie"), F.shiftright("n", 1).alias("half"))
    heads = (docs.join(to, docs["doc_id"].eqNullSafe(to["_d"]) & (docs["tie"] == to["_t"]))
             .select("to_id", "to_tie", F.left("text", F.col("half")).alias("head")))
    both = docs.join(heads, docs["doc_id"].eqNullSafe(heads["to_id"]) & (docs["tie"] == heads["to_tie"]))
    n = F.length("text")
    edited = F.concat(F.left("text", n - F.shiftright(n, 1)), F.col("head"))
    both = both.select("doc_id", "tie", n.alias("n_chars"), F.col("text"), edited.alias("edited"))
    each = both.select("doc_id", "tie", "n_chars", F.unhex(F.sha2("edited", 256)).alias("sha"),
                       F.posexplode(F.array("text", "edited")).alias("edit", "text"))
    fps = fingerprints(each, ["doc_id", "tie", "n_chars", "sha", "edit"], size)
    fps = materialize(fps.groupBy("doc_id", "tie", "n_chars", "sha").agg(
        F.max(F.when(F.col("edit") == 0, F.col("fp"))).alias("fp"),
        F.max(F.when(F.col("edit") == 1, F.col("fp"))).alias("edited_fp")), "fingerprints")
    after = order.select(F.col("doc_id").alias("_d"), F.col("tie").alias("_t"), "next_id", "next_tie")
    there = fps.select(F.col("doc_id").alias("_nd"), F.col("tie").alias("_nt"), F.col("fp").alias("next_fp"))
    out = fps.join(after, fps["doc_id"].eqNullSafe(after["_d"]) & (fps["tie"] == after["_t"]))
    out = out.join(there, F.col("next_id").eqNullSafe(F.col("_nd")) & (F.col("next_tie") == F.col("_nt")))
    return out.select("doc_id", "tie", "n_chars", F.lower(F.hex("sha")).alias("edited_sha256"),
                      "fp", "edited_fp", "next_fp")


def near_fingerprints(fps: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS,
                      queries: DataFrame | None = None) -> DataFrame:
    """Pairs ``(a, b, distance)`` of distinct fingerprints within ``radius``.

    ``fps`` has the column ``fp``. Without ``queries``, each pair comes once, ``a < b``;
    with ``queries`` (a column ``fp``), ``a`` runs over those and ``b`` over ``fps``.
    """
    if not 0 <= radius < blocks:
        raise ValueError("more blocks than the radius are needed")
    edges = [round(k * BITS / blocks) for k in range(blocks + 1)]
    masks = []
    for kept in combinations(range(blocks), blocks - radius):
        mask = sum(((1 << (edges[k + 1] - edges[k])) - 1) << edges[k] for k in kept)
        masks.append(mask - (1 << BITS) if mask >> (BITS - 1) else mask)
    tables = F.posexplode(F.array(*[F.lit(m).cast("long") for m in masks]))

    def deal(rows: DataFrame, name: str) -> DataFrame:
        rows = rows.filter("fp is not null").select(F.col("fp").alias(name)).distinct()
        rows = rows.select(name, tables.alias("t", "mask"))
        return rows.select(name, "t", F.col(name).bitwiseAND(F.col("mask")).alias("key"))

    left, right = deal(fps if queries is None else queries, "a"), deal(fps, "b")
    apart = F.col("a").bitwiseXOR(F.col("b"))
    masked = F.array(*[F.lit(m).cast("long") for m in masks])
    met = F.exists(F.slice(masked, F.lit(1), F.col("t")), lambda m: apart.bitwiseAND(m) == 0)
    ordered = F.col("a") < F.col("b") if queries is None else F.col("a") != F.col("b")
    close = F.bit_count(apart) <= radius
    pairs = left.join(right, ["t", "key"]).filter(ordered & close).filter(~met)
    return pairs.select("a", "b", F.bit_count(apart).alias("distance"))
