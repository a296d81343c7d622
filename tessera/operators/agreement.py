"""Agreement of two redactions by their spans.

A redacted text is its raw text with spans of words replaced by markers. Which words each marker stands for is found by aligning the
two word lists: a longest common subsequence, filled row by row as a fold over the raw words (each row a
fold over the redacted ones) and traced back as a fold over its steps. Between two words that are aligned, the raw
words that are not are one span, and the markers there are its tags. Spans of a prediction and a target over the same raw words are
then compared, by tag.

Rows are segments: the table of an alignment has (raw words + 1) x (redacted words + 1) numbers, so texts of more than
``MOST_WORDS`` words are an error (cut them with ``redact.segment``). NULL on either side gives no span.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import col_of, words

MARKER_RE = "\\[([A-Z]+)\\]"
MOST_WORDS = 512
SPAN = "array<struct<start:int,end:int,tag:string>>"


def _let(x: Column, body) -> Column:
    return F.element_at(F.transform(F.array(x), body), 1)


def common_table(a: Column, b: Column) -> Column:
    """Lengths of the longest common subsequences of all beginnings: row ``i`` has those of ``i`` words of ``a``."""
    def row(rows: Column, word: Column) -> Column:
        above = F.element_at(rows, -1)

        def cell(acc: Column, j: Column) -> Column:
            best = F.when(F.get(b, j) == word, F.get(above, j) + 1).otherwise(F.greatest(F.get(above, j + 1), F.element_at(acc, -1)))
            return F.concat(acc, F.array(best))
        places = F.when(F.size(b) > 0, F.sequence(F.lit(0), F.size(b) - 1)).otherwise(F.array().cast("array<int>"))
        return F.concat(rows, F.array(F.aggregate(places, F.array(F.lit(0)), cell)))
    return F.aggregate(a, F.array(F.array_repeat(F.lit(0), F.size(b) + 1)), row)


def aligned_pairs(a: Column, b: Column) -> Column:
    """``(i, j)`` of the aligned words of both lists, rising; the last way through the table that prefers earlier words of ``a``."""
    def traced(t: Column) -> Column:
        begin = F.struct(F.size(a).alias("i"), F.size(b).alias("j"), F.array().cast("array<struct<i:int,j:int>>").alias("out"))

        def step(s: Column, _: Column) -> Column:
            i, j = s["i"], s["j"]
            here = F.get(F.get(t, i), j)
            same = (F.get(a, i - 1) == F.get(b, j - 1)) & (here == F.get(F.get(t, i - 1), j - 1) + 1)
            done = (i == 0) | (j == 0)
            taken = F.struct((i - 1).alias("i"), (j - 1).alias("j"), F.concat(s["out"], F.array(F.struct((i - 1).alias("i"), (j - 1).alias("j")))).alias("out"))
            up = F.struct((i - 1).alias("i"), j.alias("j"), s["out"].alias("out"))
            left = F.struct(i.alias("i"), (j - 1).alias("j"), s["out"].alias("out"))
            return F.when(done, s).when(here == F.get(F.get(t, i - 1), j), up).when(same, taken).otherwise(left)
        steps = F.sequence(F.lit(1), F.size(a) + F.size(b) + 1)
        return F.reverse(F.aggregate(steps, begin, step, lambda s: s["out"]))
    return _let(common_table(a, b), traced)


def redaction_spans(raw, redacted) -> Column:
    """Spans ``(start, end, tag)`` of raw words (from 0, ``end`` excluded) that ``redacted`` shows as ``[TAG]``, one per tag of a gap.

    A gap without a marker (a changed word) is no span.
    """
    def of(a: Column, b: Column) -> Column:
        def gaps(pairs: Column) -> Column:
            ends = F.concat(F.array(F.struct(F.lit(-1).alias("i"), F.lit(-1).alias("j"))), pairs,
                            F.array(F.struct(F.size(a).alias("i"), F.size(b).alias("j"))))

            def between(bounds: Column) -> Column:
                def gap(k: Column) -> Column:
                    lo, hi = F.get(bounds, k), F.get(bounds, k + 1)
                    seen = F.array_join(F.slice(b, lo["j"] + 2, hi["j"] - lo["j"] - 1), " ")
                    tags = F.array_sort(F.array_distinct(F.regexp_extract_all(seen, F.lit(MARKER_RE), 1)))
                    return F.transform(tags, lambda t: F.struct((lo["i"] + 1).alias("start"), hi["i"].alias("end"), t.alias("tag")))
                return F.flatten(F.transform(F.sequence(F.lit(0), F.size(bounds) - 2), gap))
            return _let(ends, between)
        return _let(aligned_pairs(a, b), gaps)

    def checked(a: Column) -> Column:
        return F.when(F.size(a) <= MOST_WORDS, a).otherwise(F.raise_error(F.lit(f"more than {MOST_WORDS} words: cut the text into segments")).cast("array<string>"))
    x, y = col_of(raw), col_of(redacted)
    spans = _let(checked(words(x)), lambda a: _let(checked(words(y)), lambda b: of(a, b)))
    return F.when(x.isNull() | y.isNull() | (x == y), F.array().cast(SPAN)).otherwise(spans.cast(SPAN))


def span_agreement(df: DataFrame, raw: str, pred: str, target: str, by: Sequence[str] = ()) -> DataFrame:
    """Per tag (and ``by``): spans predicted, spans of the target, spans in both, and the shares of each that are."""
    rows = df.select(*by, redaction_spans(raw, pred).alias("_p"), redaction_spans(raw, target).alias("_t"))
    marked = F.concat(F.transform("_p", lambda s: F.struct(s["tag"].alias("tag"), F.lit(1).alias("p"), F.lit(0).alias("t"), F.array_contains("_t", s).cast("int").alias("m"))),
                      F.transform("_t", lambda s: F.struct(s["tag"].alias("tag"), F.lit(0).alias("p"), F.lit(1).alias("t"), F.lit(0).alias("m"))))
    each = rows.withColumn("_m", marked).select(*by, F.inline("_m"))
    out = each.groupBy(*by, "tag").agg(*[F.sum(c).alias(n) for c, n in (("p", "predicted"), ("t", "given"), ("m", "matched"))])
    return out.withColumn("precision", F.col("matched") / F.nullif("predicted", F.lit(0))).withColumn(
        "recall", F.col("matched") / F.nullif("given", F.lit(0)))
