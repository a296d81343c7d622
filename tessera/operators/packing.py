"""K1-K5: concatenate documents with EOS and cut fixed windows with shifted targets.

The token stream is never materialized. Each document knows its global
``start`` (K1, a two-level prefix sum) and its length ``n`` (tokens + EOS).
Window ``w`` covers stream positions ``[wL, wL+L]`` (L+1 tokens): input is
the first L, target the last L. A window lying inside one document is sliced
straight out of that document's array — no shuffle. Only windows that cross
a document boundary (at most two per document) are assembled by a
``groupBy(window_id)`` over pieces of at most L+1 tokens each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.bytes import EOS_ID
from tessera.operators.ordering import prefix_sum


def fdiv(x: Column, d: int) -> Column:
    """Floor division by a positive constant (``div`` truncates toward 0).

    ``x - pmod(x, d)`` is an exact multiple of d, so the quotient is exact for
    |x| < 2**53 stream positions.
    """
    return ((x - F.pmod(x, F.lit(d))) / F.lit(d)).cast("long")


def doc_offsets(df: DataFrame, ids: str | Column = "ids", key: str = "doc_id", eos: int = EOS_ID,
                n_ids: str | None = None) -> DataFrame:
    """K1: add ``n`` (tokens incl. trailing EOS), ``start`` (global offset) and ``total`` (N).

    The prefix sum runs on narrow ``(key, n)`` rows (16 bytes per document) that
    are sorted and written once, so the sizing pass is one scan and its sort never
    touches document bodies. The offsets are then joined back by ``key``; Spark
    chooses the join, which can spill. A repeated key raises.

    ``n_ids`` may name a column that already holds ``size(ids)`` computed
    cheaply (e.g. ``encoded_length`` of the text), so sizing never builds arrays.
    """
    return df.join(_offsets(df, ids, key, n_ids), key)


def _offsets(df: DataFrame, ids: str | Column, key: str, n_ids: str | None) -> DataFrame:
    if n_ids is None and not isinstance(ids, str):
        raise ValueError("an ids expression needs n_ids (its length per row)")
    size = F.col(n_ids) if n_ids else F.size(ids)
    narrow = df.select(key, (size + 1).cast("long").alias("n"))
    return prefix_sum(narrow, [key], weight=F.col("n"), before="start", total="total", unique=True)


def window_count(total: Column, L: int) -> Column:
    """K2: ``(N-1)//L`` with the N=0 case pinned to 0."""
    return F.greatest(F.lit(0).cast("long"), fdiv(total - 1, L))


def pack(df: DataFrame, L: int, ids: str | Column = "ids", key: str = "doc_id", eos: int = EOS_ID,
         n_ids: str | None = None,
         head_ids: Column | None = None, tail_ids: Column | None = None, whole: bool = False) -> DataFrame:
    """K3: ``(window_id, input, target)`` windows of length L over the EOS-joined stream; ``whole``: ``(window_id, ids)`` with
    the L+1 ids from which both are cut.

    ``ids`` is an array column, or an expression over the input's columns
    (e.g. ``encode_ids("text")``) that is then evaluated *after* the offsets
    shuffle: the rows travel as text (about one byte per byte token instead
    of four for an int array) and are encoded once. An expression needs
    ``n_ids`` (its length, computed without building the array).

    Boundary windows only ever touch a document's first or last L+1 stream
    tokens. ``head_ids``/``tail_ids`` may give expressions for at least the
    first/last L+1 ids (e.g. encoding a bounded prefix/suffix of the text),
    so that branch never encodes whole documents.
    """
    if L < 1:
        raise ValueError("L must be positive")
    off = doc_offsets(df, ids, key, eos, n_ids)
    ids_col = F.col(ids) if isinstance(ids, str) else ids
    stream = F.concat(ids_col, F.array(F.lit(eos)))
    W = window_count(F.col("total"), L)
    start, n = F.col("start"), F.col("n")
    end = start + n - 1                      # last stream position of this doc
    w_lo = fdiv(F.greatest(start - 1, F.lit(0)), L)
    w_hi = F.least(fdiv(end, L), W - 1)
    iw_lo = fdiv(start + (L - 1), L)         # first window starting inside the doc
    iw_hi = F.least(fdiv(end - L, L), W - 1)  # last window ending inside the doc
    # first and last min(n, L+1) stream tokens (the only ones boundary windows use)
    head_src = ids_col if head_ids is None else head_ids
    tail_src = ids_col if tail_ids is None else tail_ids
    hd = F.slice(F.concat(F.slice(head_src, 1, L + 1), F.array(F.lit(eos))), 1, L + 1)
    tl_ids = F.slice(tail_src, F.greatest(F.size(tail_src) - (L + 1), F.lit(0)) + 1, L + 1)
    tl_s = F.concat(tl_ids, F.array(F.lit(eos)))
    tl = F.slice(tl_s, F.greatest(F.size(tl_s) - (L + 1), F.lit(0)) + 1, L + 1)
    docs = off.select(key, stream.alias("s"), hd.alias("hd"), tl.alias("tl"), start.alias("start"), n.alias("n"),
                      w_lo.alias("w_lo"), w_hi.alias("w_hi"), iw_lo.alias("iw_lo"), iw_hi.alias("iw_hi"))

    def window(ids: str, at: Column) -> list[Column]:
        if whole:
            return [F.slice(ids, at + 1, L + 1).alias("ids")]
        return [F.slice(ids, at + 1, L).alias("input"), F.slice(ids, at + 2, L).alias("target")]

    empty = F.array().cast("array<long>")
    # Windows fully inside one document: slice directly (narrow).
    inner_ws = F.when(F.col("iw_lo") <= F.col("iw_hi"),
                      F.sequence(F.col("iw_lo"), F.col("iw_hi"))).otherwise(empty)
    inner = docs.select(F.explode(F.transform(
        inner_ws,
        lambda w: F.struct(
            w.alias("window_id"), *window("s", (w * L - F.col("start")).cast("int"))))).alias("x")
    ).select("x.*")

    # Windows crossing a boundary: emit this doc's piece, assemble by window id.
    all_ws = F.when(F.col("w_lo") <= F.col("w_hi"),
                    F.sequence(F.col("w_lo"), F.col("w_hi"))).otherwise(empty)
    edge_ws = F.filter(all_ws, lambda w: (w < F.col("iw_lo")) | (w > F.col("iw_hi")))

    def piece(w):
        lo = F.greatest(w * L, F.col("start"))
        hi = F.least(w * L + L, F.col("start") + F.col("n") - 1)
        rlo = lo - F.col("start")                      # doc-relative first position
        length = (hi - lo + 1).cast("int")
        # a window starting before the doc takes the doc's first tokens (head);
        # otherwise it runs past the doc's end and takes its last ones (tail)
        tail_at = rlo - (F.col("n") - F.size("tl")) + 1
        part = F.when(rlo == 0, F.slice("hd", 1, length)).otherwise(F.slice("tl", tail_at.cast("int"), length))
        return F.struct(w.alias("window_id"), lo.alias("lo"), part.alias("piece"))

    pieces = docs.select(F.explode(F.transform(edge_ws, piece)).alias("x")).select("x.*")
    seg = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("lo", "piece"))), lambda p: p["piece"]))
    edge = pieces.groupBy("window_id").agg(seg.alias("seg")).select("window_id", *window("seg", F.lit(0)))
    return inner.unionByName(edge)


def pack_tail(total: Column, L: int) -> Column:
    """K4: stream tokens never used as input or target: ``N - (W*L + 1)`` (0 when N=0)."""
    W = window_count(total, L)
    return F.greatest(F.lit(0).cast("long"), total - (W * L + 1))


def corpus_summary(df: DataFrame, L: int, ids: str = "ids", n_ids: str | None = None) -> DataFrame:
    """One row — docs, stream tokens N (incl. EOS per doc), windows W, unused tail.

    With ``n_ids`` (a cheap per-document token count) no array is built.
    """
    size = F.col(n_ids) if n_ids else F.size(ids)
    agg = df.agg(F.count(F.lit(1)).alias("docs"), F.sum(size + 1).cast("long").alias("tokens"))
    tokens = F.coalesce(F.col("tokens"), F.lit(0).cast("long"))
    return agg.select("docs", tokens.alias("tokens"), window_count(tokens, L).cast("long").alias("windows"),
                      pack_tail(tokens, L).cast("long").alias("tail"))


def window_ids(summary: DataFrame) -> DataFrame:
    """All window ids ``0..W-1`` as a distributed range (reads W from a K5 summary).

    Schedules (B2-B5) need only ids; this avoids packing to get them.
    """
    W = summary.first()["windows"]
    return summary.sparkSession.range(int(W or 0)).withColumnRenamed("id", "window_id")


def _pair_counts(df: DataFrame) -> DataFrame:
    """``prev, next, count`` of the neighbours in the arrays of the only column, counted batch by batch (pairs may come again)."""
    name = df.schema[0].dataType.elementType.simpleString()

    def counts(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            arrays = batch.column(0)
            flat = arrays.flatten()
            if len(flat) < 2:
                continue
            ends = np.cumsum(pc.fill_null(pc.list_value_length(arrays), 0).to_numpy(zero_copy_only=False))
            within = np.ones(len(flat) - 1, bool)
            within[ends[(ends > 0) & (ends < len(flat))] - 1] = False
            pairs = pa.table({"prev": flat[:-1], "next": flat[1:]}).filter(pa.array(within))
            found = pairs.group_by(["prev", "next"], use_threads=False).aggregate([([], "count_all")])
            yield from found.select(["prev", "next", "count_all"]).rename_columns(["prev", "next", "count"]).to_batches()
    return df.mapInArrow(counts, f"prev {name}, next {name}, count long")


def stream_bigrams(df: DataFrame, L: int, ids: str | Column = "ids", key: str = "doc_id", eos: int = EOS_ID,
                   n_ids: str | None = None, first_id: Column | None = None) -> DataFrame:
    """E6 over packed windows without packing: ``(prev, next, count)`` of the
    (input[i], target[i]) pairs of all windows of length L.

    Those pairs are the adjacent stream pairs at positions ``[0, W*L)``: the
    pairs inside each document's stream (tokens + EOS), plus one pair per
    document boundary (EOS -> next document's first token), cut at ``W*L``.
    Boundary pairs come from a narrow join of per-document ``(start, first)``
    rows; the others are counted by Arrow batch, and the batches' counts summed. ``first_id`` may give each document's
    first token without encoding the document (an empty one starts with EOS).
    """
    off = _offsets(df, ids, key, n_ids)
    limit = window_count(F.col("total"), L) * L          # pair positions [0, W*L)
    ids_col = F.col(ids) if isinstance(ids, str) else ids
    docs = df.join(off, key)
    s = F.concat(ids_col, F.array(F.lit(eos)))
    m = F.least(F.col("n") - 1, limit - F.col("start")).cast("int")   # pairs of this doc inside the cut
    inner = _pair_counts(docs.select(s.alias("s"), m.alias("m")).select(F.when(F.col("m") > 0, F.slice("s", 1, F.col("m") + 1)).alias("s")))
    # boundary pairs: EOS at position start+n-1 followed by the next doc's first token
    first = F.try_element_at(s, F.lit(1)) if first_id is None else F.coalesce(first_id, F.lit(eos))
    firsts = docs.select(F.col("start").alias("_pos"), first.alias("next"))
    ends = off.select((F.col("start") + F.col("n")).alias("_pos"),
                      (F.col("start") + F.col("n") - 1 < limit).alias("_keep"))
    cross = (ends.filter("_keep").join(firsts, "_pos")
             .select(F.lit(eos).alias("prev"), "next", F.lit(1).cast("long").alias("count")))
    return inner.unionByName(cross).groupBy("prev", "next").agg(F.sum("count").alias("count"))
