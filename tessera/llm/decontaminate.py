"""Benchmark decontamination: a hash set of benchmark word windows against every training window.

A benchmark item gives its windows of ``size`` consecutive words; an item with
fewer words (but at least one) is one window. The windows of a training text are
hashed by doubling (runs of 2, 4 and 8 words are hashed once and combined), looked
up in the set of benchmark hashes and, on a hit, compared word for word. All of it
is one expression over the text, so the scan has no shuffle; only the small result
rows are regrouped to name the items.

The set travels inside the plan and is refused beyond ``max_windows`` distinct
windows; then the windows are joined on their words instead, with equal results.

Null or empty texts have no words and are never hit. Rows with the same
``doc_id`` are judged one by one, and repeated rows come back repeated. An empty
benchmark hits nothing. An item without an id hits like any other, on every path; only the
list and number of items leave it out. Extra columns of either table are ignored.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import let, plain_words

WINDOW = 13
MAX_WINDOWS = 50_000
RUNS = (8, 4, 2, 1)


def _pair_up(runs: Column, other: Column, shift: int) -> Column:
    """Hash of each run with the run that starts ``shift`` words later."""
    later = F.slice(other, F.lit(shift + 1), F.size(other))
    return F.zip_with(runs, later, lambda a, b: F.xxhash64(a, b))


def _run_hash(by_run: dict[int, Column], length: int) -> Column:
    """Hashes of all windows of ``length`` words; the last ``length - 1`` entries are void."""
    out, done = None, 0
    while done < length:
        run = next(r for r in RUNS if r <= length - done)
        out = by_run[run] if out is None else _pair_up(out, by_run[run], done)
        done += run
    return out


def _with_hashes(words: Column, longest: int, body) -> Column:
    """``body`` over the hash arrays of runs of 1, 2, 4 and 8 words, each computed once."""
    def grow(known: dict[int, Column], run: int) -> Column:
        if run > min(longest, 8):
            return body(known)
        return let(_pair_up(known[run // 2], known[run // 2], run // 2),
                   lambda h: grow({**known, run: h}, run * 2))
    return let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: grow({1: h}, 2))


def benchmark_windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """Distinct ``(item_id, length, window_hash, window)`` of all benchmark items."""
    words = plain_words(F.col("text"))

    def windows(ws: Column) -> Column:
        n = F.size(ws)
        length = F.least(F.lit(size), n)

        def rows(h: dict[int, Column]) -> Column:
            def of(k: int) -> Column:
                def row(x: Column, i: Column) -> Column:
                    text = F.array_join(F.slice(ws, i + 1, F.lit(k)), " ")
                    return F.when(i <= n - k, F.struct(
                        F.lit(k).alias("length"), x.alias("window_hash"), text.alias("window")))
                return F.transform(_run_hash(h, k), row)
            out = of(size)
            for k in range(size - 1, 0, -1):
                out = F.when(length == k, of(k)).otherwise(out)
            return F.filter(out, lambda x: x.isNotNull())
        return _with_hashes(ws, size, rows)

    return (benchmark.select("item_id", let(words, windows).alias("w")).filter(F.size("w") > 0)
            .select("item_id", F.inline("w")).distinct())


def _covered(hits: Column) -> Column:
    """Number of words in the union of the hit windows."""
    start = F.struct(F.lit(0).alias("stop"), F.lit(0).alias("n"))

    def add(a: Column, x: Column) -> Column:
        stop = x["start"] + x["length"]
        return F.struct(F.greatest(a["stop"], stop).alias("stop"),
                        (a["n"] + F.greatest(F.lit(0), stop - F.greatest(a["stop"], x["start"]))).alias("n"))
    return F.aggregate(F.array_sort(hits), start, add, lambda a: a["n"])


def _hits_of(words: Column, hashes: Column, length: int, wanted: tuple[list[int], list[str]] | None) -> Column:
    """Hit windows of one length; all windows of that length without a set."""
    valid = F.size(words) - length

    def start(x: Column, i: Column) -> Column:
        return F.when((i <= valid) & x.isin(wanted[0]) if wanted else i <= valid, i)

    def row(i: Column) -> Column:
        return F.struct(i.alias("start"), F.lit(length).alias("length"),
                        F.array_join(F.slice(words, i + 1, F.lit(length)), " ").alias("window"))
    rows = F.transform(F.filter(F.transform(hashes, start), lambda i: i.isNotNull()), row)
    return F.filter(rows, lambda x: x["window"].isin(wanted[1])) if wanted else rows


def _judged(words: Column, by_length: dict[int, tuple[list[int], list[str]]] | None,
            lengths: list[int]) -> Column:
    """Struct of a text: its number of words and its hit windows (or all windows without a set)."""
    def scan(ws: Column) -> Column:
        def found(h: dict[int, Column]) -> Column:
            return F.concat(*[_hits_of(ws, _run_hash(h, k), k, by_length[k] if by_length else None) for k in lengths])
        none = F.from_json(F.lit("[]"), "array<struct<start:int,length:int,window:string>>")
        hits = _with_hashes(ws, max(lengths), found) if lengths else none
        return F.struct(F.size(ws).alias("n_words"), hits.alias("hits"))
    return let(words, scan)


def _prepared(windows: DataFrame, max_windows: int):
    """Lengths present and, if few enough, the set by length: hashes and words."""
    rows = windows.select("length", "window_hash", "window").distinct().limit(max_windows + 1).collect()
    if len(rows) > max_windows:
        return sorted(r[0] for r in windows.select("length").distinct().collect()), None
    by = defaultdict(lambda: ([], []))
    for r in rows:
        by[r["length"]][0].append(r["window_hash"])
        by[r["length"]][1].append(r["window"])
    return sorted(by), dict(by)


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW,
                  max_windows: int = MAX_WINDOWS) -> DataFrame:
    """Per document: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated, hits``.

    ``hits`` lists the hit windows ``(start, length, window)``. A document is
    contaminated when hit words make up at least a twentieth of its words.
    """
    windows = benchmark_windows(benchmark, size)
    lengths, by_length = _prepared(windows, max_windows)
    named = windows.select("window", "length", "item_id", F.lit(True).alias("known"))
    judged = docs.select("doc_id", F.monotonically_increasing_id().alias("row"),
                         _judged(plain_words(F.col("text")), by_length, lengths).alias("r"))
    rows = judged.select("doc_id", "row", F.col("r.n_words").alias("n_words"),
                         F.explode_outer("r.hits").alias("h"))
    rows = rows.select("doc_id", "row", "n_words", "h",
                       F.col("h.window").alias("window"), F.col("h.length").alias("length"))
    rows = rows.join(F.broadcast(named) if by_length is not None else named, ["window", "length"], "left")
    real = F.when(F.col("known"), F.col("h"))
    out = (rows.groupBy("doc_id", "row", "n_words")
           .agg(F.collect_set(real).alias("hits"), F.collect_set(F.col("item_id").cast("string")).alias("items")))
    out = out.withColumn("n_hit", _covered(F.col("hits")).cast("long"))
    return out.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), "hits")


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW,
                  max_windows: int = MAX_WINDOWS) -> DataFrame:
    """``docs`` without its contaminated rows; every column stays as it is.

    With the set inside the plan this is a filter on the scan. Beyond
    ``max_windows`` the rows to drop come from :func:`contamination`, keyed by
    ``doc_id`` and text, since equal texts get equal verdicts.
    """
    windows = benchmark_windows(benchmark, size)
    lengths, by_length = _prepared(windows, max_windows)
    if by_length is not None:
        if not lengths:
            return docs
        bad = let(_judged(plain_words(docs["text"]), by_length, lengths), lambda r: let(
            _covered(r["hits"]), lambda hit: (hit > 0) & (20 * hit >= r["n_words"])))
        return docs.filter(~bad)
    key = F.sha2(F.coalesce(docs["text"], F.lit("")), 256)
    slim = docs.select(key.alias("doc_id"), "text").distinct()
    bad = contamination(slim, benchmark, size, max_windows).filter("contaminated").select(F.col("doc_id").alias("_bad"))
    return docs.join(bad, key == bad["_bad"], "left_anti")


def remove_spans(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW,
                 max_windows: int = MAX_WINDOWS) -> DataFrame:
    """``(doc_id, kept)``: each text's words outside every hit window, joined by one space.

    Beyond ``max_windows`` the hits come from :func:`contamination`, by a digest of the text.
    """
    windows = benchmark_windows(benchmark, size)
    lengths, by_length = _prepared(windows, max_windows)

    def outside(ws: Column, hits: Column) -> Column:
        return F.array_join(F.filter(
            ws, lambda w, i: ~F.exists(hits, lambda x: (x["start"] <= i) & (i < x["start"] + x["length"]))), " ")

    if by_length is not None:
        return docs.select("doc_id", let(plain_words(docs["text"]), lambda ws: let(
            _judged(ws, by_length, lengths)["hits"], lambda hits: outside(ws, hits))).alias("kept"))
    key = F.sha2(F.coalesce(docs["text"], F.lit("")), 256)
    found = contamination(docs.select(key.alias("doc_id"), "text").distinct(), benchmark, size, max_windows)
    found = found.filter(F.size("hits") > 0).select(F.col("doc_id").alias("_key"), F.col("hits").alias("_hits"))
    joined = docs.select("doc_id", "text", key.alias("_own")).join(found, F.col("_own") == F.col("_key"), "left")
    hits = F.coalesce("_hits", F.array().cast("array<struct<start:int,length:int,window:string>>"))
    return joined.select("doc_id", let(hits, lambda h: let(plain_words(F.col("text")), lambda ws: outside(ws, h))).alias("kept"))
