"""PII redaction as expressions, joins and a model hook.

R1 is a chain of ``regexp_replace`` calls in one projection: narrow, no shuffle, any
text length. R5 joins the distinct words of each text with the first words of a term
dictionary and rebuilds only texts with hits, all in Spark expressions. R4 runs a
Python scrubber per partition (loaded once per task): the hook for a model.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tessera.functions.rules import DEFAULT_RULES, Rule, count_marker, count_pattern, with_rules
from tessera.functions.text import (BLANK_MESSAGE, EOS_TEXT, MARKER, WORD_RE, col_of, nonblank, py_strip)
from tessera.operators.sft import answer_text, prompt_text
from tessera.operators.sizes import broadcast_if_small
from tessera.session import materialize

# R5 splits a text into runs of letters and digits, and the runs between them.
# Words of a segment up to which one pattern matches it; Java steps into each repeat of a group.
SHORT_SEGMENT = 256
# Terms that a plan may carry as literals.
SCAN_TERMS = 20_000
TERM_PART_RE = "[\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+"


def redact(df: DataFrame, col: str = "text", rules: Sequence[Rule] = DEFAULT_RULES, out: str | None = None) -> DataFrame:
    """Replace every rule match by its ``[TAG]`` marker (narrow; no shuffle)."""
    return with_rules(df, col, out or col, rules)


def extract_redacted_col(c) -> Column:
    """R2 as a column: text after the last marker, EOS removed, stripped; unchanged without marker."""
    x = col_of(c)
    after = F.substring_index(x, MARKER, -1)
    cleaned = py_strip(F.replace(after, F.lit(EOS_TEXT), F.lit("")))
    return F.when(F.instr(x, MARKER) > 0, cleaned).otherwise(x)


def extract_redacted(df: DataFrame, col: str = "output", out: str = "redacted") -> DataFrame:
    """R2: pull the answer out of a decoded ``[RAW] .. [REDACTED] ..`` output."""
    return df.withColumn(out, extract_redacted_col(col))


# ---- R4: model hook -------------------------------------------------------

def rule_scrubber(rules: Sequence[Rule] = DEFAULT_RULES) -> Callable[[pd.Series], pd.Series]:
    """Default scrubbing "model": prompt in, decoded prompt + answer + EOS out.

    Same rules as R1, compiled with Python ``re`` once per task.
    """
    compiled = [(re.compile(r.pattern), re.sub(r"\$(\d)", r"\\\1", r.replacement), r.passes) for r in rules]

    def answer(s: str) -> str:
        for rx, rep, passes in compiled:
            for _ in range(passes):
                s = rx.sub(rep, s)
        return s

    def run(prompts: pd.Series) -> pd.Series:
        out = []
        for p in prompts:
            raw = p[len("[RAW] "):-len(" [REDACTED] ")]
            out.append(p + answer(raw) + EOS_TEXT)
        return pd.Series(out, dtype=object)

    return run


def redact_with(df: DataFrame, model_factory: Callable[[], Callable[[pd.Series], pd.Series]] = rule_scrubber,
                col: str = "text", out: str = "output", chunk_words: int | None = None) -> DataFrame:
    """``mapInPandas`` hook. ``model_factory()`` is called once per task (load once),
    then applied to Arrow batches of prompts; blank rows are passed through untouched.

    ``chunk_words`` bounds what the model sees at once: a text goes to it in segments
    of that many words (R6), and the answers are joined by one space again, so rows and
    their order stay as they are.
    """
    if chunk_words is not None and chunk_words < 1:
        raise ValueError("chunk_words must be positive")
    names = list(df.columns)
    schema = StructType(list(df.schema.fields) + [StructField(out, StringType(), True)])
    word = re.compile(WORD_RE)

    def chunks(text: str) -> list[str]:
        words = word.findall(text) if chunk_words else []
        if not words:
            return [text]
        return [" ".join(words[i:i + chunk_words]) for i in range(0, len(words), chunk_words)]

    def answer(output: str) -> str:
        return output.rsplit(MARKER, 1)[-1].replace(EOS_TEXT, "").strip()

    def per_partition(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for pdf in batches:
            if model is None:
                model = model_factory()
            text = pdf[col]
            ok = text.notna() & text.map(lambda s: isinstance(s, str) and s.strip() != "")
            res = pd.Series([None] * len(pdf), index=pdf.index, dtype=object)
            if ok.any():
                parts = text[ok].map(chunks)
                prompts = pd.Series([f"[RAW] {c} [REDACTED] " for p in parts for c in p], dtype=object)
                answers = list(model(prompts))
                if chunk_words:
                    at, whole = 0, []
                    for original, p in zip(text[ok], parts):
                        own = " ".join(answer(x) for x in answers[at:at + len(p)])
                        whole.append(f"[RAW] {original} [REDACTED] {own}{EOS_TEXT}")
                        at += len(p)
                    answers = whole
                res[ok] = answers
            pdf = pdf[names].copy()
            pdf[out] = res
            yield pdf

    return df.mapInPandas(per_partition, schema)


def scrub(df: DataFrame, col: str = "text", rules: Sequence[Rule] = DEFAULT_RULES, out: str = "scrubbed") -> DataFrame:
    """P5 -> R1 -> R2 in expressions: the status, and the extracted answer or the blank message."""
    status = F.when(nonblank(col), F.lit("ok")).otherwise(F.lit("blank"))
    red = with_rules(df.withColumn("status", status), col, "_red", rules)
    full = red.withColumn("_full", F.concat(prompt_text(col), answer_text("_red")))
    return (full.withColumn(out, F.when(F.col("status") == "ok", extract_redacted_col("_full"))
                            .otherwise(F.lit(BLANK_MESSAGE)))
            .drop("_red", "_full"))


# ---- R5: dictionary terms -------------------------------------------------

def _term_parts(c: Column) -> Column:
    """Word and gap runs of a text, white space in a gap as one space."""
    return F.transform(F.regexp_extract_all(c, F.lit(TERM_PART_RE), 0), lambda p: F.regexp_replace(p, "\\s+", " "))


def term_table(terms: DataFrame, term: str = "term", tag: str = "tag") -> DataFrame:
    """``(first, norm, n, tag)`` of each distinct term: its first word, its normal form and its number of runs.

    A term begins and ends with a word, whatever surrounds it; its normal form has white
    space as one space. Terms without a word are left out; of several tags the smallest stays.
    """
    parts = _term_parts(F.regexp_extract(F.col(term), "(?s)([\\p{L}\\p{N}].*[\\p{L}\\p{N}]|[\\p{L}\\p{N}])", 1))
    rows = terms.select(parts.alias("_p"), F.col(tag).alias("tag")).filter(F.size("_p") > 0)
    return rows.groupBy(F.element_at("_p", 1).alias("first"), F.array_join("_p", "").alias("norm"),
                        F.size("_p").alias("n")).agg(F.min("tag").alias("tag"))


def redact_terms(df: DataFrame, terms: DataFrame, key: str = "doc_id", col: str = "text",
                 term: str = "term", tag: str = "tag", out: str | None = None, method: str = "auto") -> DataFrame:
    """Replace the terms of a ``(term, tag)`` dictionary by ``[tag]``.

    A term matches at word boundaries (any character that is no letter or digit) and
    across several words; from left to right the longest term wins, and matches do not
    overlap. Methods give the same rows:

    * ``scan`` (a dictionary of at most ``SCAN_TERMS``, counted first): the terms travel inside the
      plan as hash sets by their number of runs; a text is cut into runs once, each place that begins like
      a term has its windows looked up, and hits are replaced, all in one projection without an exchange.
    * ``join``: the distinct words of each text are joined with the terms' first words, so only
      texts with a candidate are grouped, and only they are rebuilt. Rows are matched by ``key``
      and a hash of the text, so keys may repeat.

    ``auto`` scans if the dictionary fits, or what is left of it without the terms whose first or last word is in no text;
    a longer one is joined without those terms. NULL and empty texts stay.
    """
    if method not in ("auto", "scan", "join"):
        raise ValueError(f"unknown method {method!r}")
    names = df.columns
    t = term_table(terms, term, tag)
    if method != "join":
        rows = t.limit(SCAN_TERMS + 1).collect()
        if len(rows) <= SCAN_TERMS:
            return _scanned(df, col, out or col, rows)
        if method == "scan":
            raise ValueError(f"the dictionary has more than {SCAN_TERMS} terms")
        t = materialize(_spoken_terms(df, col, t), "spoken-terms")
        rows = t.limit(SCAN_TERMS + 1).collect()
        if len(rows) <= SCAN_TERMS:
            return _scanned(df, col, out or col, rows)
        t = broadcast_if_small(t)
    rows = df.withColumn("_hash", F.xxhash64(col_of(col)))
    words = F.array_distinct(F.regexp_extract_all(col_of(col), F.lit("[\\p{L}\\p{N}]+"), 0))
    found = rows.select(F.col(key).alias("_key"), "_hash", F.explode(words).alias("first")).join(t, "first")
    found = found.groupBy("_key", "_hash").agg(F.collect_set(F.struct("first", "norm", "n", "tag")).alias("_terms"))
    found = found.withColumnRenamed("_hash", "_fh")
    joined = rows.join(found, rows[key].eqNullSafe(found["_key"]) & (rows["_hash"] == found["_fh"]), "left")
    text = F.when(F.col("_terms").isNull(), col_of(col)).otherwise(_rebuilt(col_of(col), F.col("_terms")))
    return joined.withColumn(out or col, text).select(*names, *([out] if out and out not in names else []))


def _spoken_terms(df: DataFrame, col: str, terms: DataFrame) -> DataFrame:
    """The rows of ``term_table`` whose first and last words are words of some text."""
    found = df.select(F.explode(F.regexp_extract_all(F.col(col), F.lit("[\\p{L}\\p{N}]+"), 0)).alias("_word")).distinct()
    ends = terms.withColumn("_last", F.regexp_extract("norm", "[\\p{L}\\p{N}]+$", 0))
    words = ends.select(F.explode(F.array("first", "_last")).alias("_word")).distinct()
    held = materialize(found.join(words, "_word", "left_semi"), "term-words")
    for end in ("first", "_last"):
        ends = ends.join(held, ends[end] == held["_word"], "left_semi")
    return ends.drop("_last")


def _literals(values: Sequence[str]) -> str:
    """SQL list of strings; one text of SQL is parsed far faster than as many literals are made one by one."""
    return ", ".join("'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" for v in values)


def _scanned(df: DataFrame, col: str, out: str, terms: Sequence) -> DataFrame:
    """``df`` with the terms (rows of ``term_table``) in ``col`` replaced; texts without a hit come through as they are."""
    sets: dict[int, dict[str, list[str]]] = {}
    for r in terms:
        sets.setdefault(r["n"], {}).setdefault(r["tag"], []).append(r["norm"])
    if not sets:
        return df.withColumn(out, F.col(col))
    known = []
    for n in sorted(sets):
        # white space is made alike in the window only: most runs of a text are in none
        window = "get(_parts, i)" if n == 1 else f"regexp_replace(array_join(slice(_parts, i + 1, {n}), ''), r'\\s+', ' ')"
        cases = " ".join(f"when w in ({_literals(norms)}) then {_literals([tag])}" for tag, norms in sorted(sets[n].items()))
        known.append(f"named_struct('i', cast(i as int), 'n', {n}, 'tag', element_at(transform(array({window}), w -> case {cases} end), 1))")
    firsts = _literals(sorted({r["first"] for r in terms}))
    rows = df.withColumn("_parts", F.regexp_extract_all(F.col(col), F.lit(TERM_PART_RE), 0))
    rows = rows.withColumn("_at", F.expr(f"filter(transform(_parts, (w, i) -> if(w in ({firsts}), i, null)), i -> i is not null)"))
    # of the terms at a place the longest decides
    longest = f"try_element_at(filter(array({', '.join(known)}), x -> x.tag is not null), -1)"
    rows = rows.withColumn("_hits", F.expr(f"filter(transform(_at, i -> {longest}), h -> h is not null)"))
    text = F.when(F.size("_hits") > 0, _replaced(F.col("_parts"), F.col("_hits"))).otherwise(F.col(col))
    return rows.withColumn(out, text).drop("_parts", "_at", "_hits")


def _replaced(parts: Column, hits: Column) -> Column:
    """The runs of a text with the hits ``(i, n, tag)``, in order of ``i``, replaced from left to right where they do not overlap."""
    start = F.struct(F.lit(0).alias("end"), F.array().cast("array<string>").alias("out"))

    def take(a: Column, h: Column) -> Column:
        before = F.array_join(F.slice(parts, a["end"] + 1, F.greatest(h["i"] - a["end"], F.lit(0))), "")
        taken = F.struct((h["i"] + h["n"]).alias("end"), F.concat(
            a["out"], F.array(before, F.concat(F.lit("["), h["tag"], F.lit("]")))).alias("out"))
        return F.when(h["i"] >= a["end"], taken).otherwise(a)
    return F.aggregate(hits, start, take, lambda a: F.array_join(F.concat(a["out"], F.array(F.array_join(
        F.slice(parts, a["end"] + 1, F.size(parts)), ""))), ""))


def _rebuilt(text: Column, terms: Column) -> Column:
    """``text`` with the longest match at each place replaced by its tag, from left to right."""
    def matched(parts: Column) -> Column:
        def over(norm: Column) -> Column:
            # candidates by first word, so a text's places are compared with its own few terms only
            by_first = F.map_from_entries(F.transform(
                F.array_distinct(F.transform(terms, lambda t: t["first"])),
                lambda f: F.struct(f, F.filter(terms, lambda t: t["first"] == f))))
            return F.element_at(F.transform(F.array(by_first), lambda m: best(norm, m)), 1)

        def best(norm: Column, by_first: Column) -> Column:
            def at(p: Column, i: Column) -> Column:
                fits = F.filter(F.try_element_at(by_first, p),
                                lambda t: F.array_join(F.slice(norm, i + 1, t["n"]), "") == t["norm"])
                longest = F.try_element_at(F.reverse(F.array_sort(F.transform(
                    fits, lambda t: F.struct(t["n"].alias("n"), t["tag"].alias("tag"))))), F.lit(1))
                return F.struct(i.alias("i"), longest["n"].alias("n"), longest["tag"].alias("tag"))
            return F.filter(F.transform(norm, at), lambda h: h["n"].isNotNull())

        hits = F.element_at(F.transform(F.array(F.transform(parts, lambda p: F.regexp_replace(p, "\\s+", " "))), over), 1)
        return F.element_at(F.transform(F.array(hits), lambda h: _replaced(parts, h)), 1)
    return F.element_at(F.transform(F.array(F.regexp_extract_all(text, F.lit(TERM_PART_RE), 0)), matched), 1)


# ---- R6/R7: segments ------------------------------------------------------

def segment(df: DataFrame, n_words: int, key: str = "doc_id", col: str = "text",
            out: str = "segment") -> DataFrame:
    """Split text into segments of ``n_words`` words joined by one space."""
    if n_words < 1:
        raise ValueError("n_words must be positive")
    if n_words <= SHORT_SEGMENT:
        # white space as one space, then a segment is one match: no array of words, and no string of each
        flat = F.regexp_replace(col_of(col), WORD_RE.replace("[^", "[", 1), " ")
        run = F.regexp_extract_all(flat, F.lit(f"[^ ]++(?: [^ ]++){{0,{n_words - 1}}}+"), 0)
        return df.select(key, F.posexplode(run).alias("seg_idx", out))
    # The word array is its own column: a lambda that referenced the
    # extraction expression would re-run it once per segment.
    words_df = df.select(key, F.regexp_extract_all(col_of(col), F.lit(WORD_RE), 0).alias("_w"))
    w = F.col("_w")
    nseg = F.ceil(F.size(w) / n_words).cast("int")
    seq = F.when(nseg > 0, F.sequence(F.lit(0), nseg - 1)).otherwise(F.array().cast("array<int>"))
    segs = F.transform(seq, lambda i: F.struct(i.alias("seg_idx"),
                                               F.array_join(F.slice(w, i * n_words + 1, n_words), " ").alias(out)))
    return words_df.select(key, F.explode(segs).alias("_s")).select(key, "_s.seg_idx", f"_s.{out}")


def rejoin(df: DataFrame, key: str = "doc_id", col: str = "segment", out: str = "text") -> DataFrame:
    """Segments back to one text per key, in segment order."""
    parts = F.array_sort(F.collect_list(F.struct("seg_idx", col)))
    return df.groupBy(key).agg(F.array_join(F.transform(parts, lambda s: s[col]), " ").alias(out))


def weak_pairs(df: DataFrame, n_words: int, key: str = "doc_id", col: str = "text",
               rules: Sequence[Rule] = DEFAULT_RULES) -> DataFrame:
    """(raw, redacted) segment pairs for fine-tuning, keyed by (key, seg_idx)."""
    seg = segment(df, n_words, key, col, out="original_text")
    return with_rules(seg, "original_text", "redacted_text", rules)


# ---- R8/R9: reports -------------------------------------------------------

def pii_report(df: DataFrame, raw: str = "text", red: str = "redacted",
               rules: Sequence[Rule] = DEFAULT_RULES) -> DataFrame:
    """Per tag — markers added, rows touched, and residual raw matches left."""
    per_row = F.array(*[F.struct(F.lit(r.tag).alias("tag"),
                                 (count_marker(red, r.tag) - count_marker(raw, r.tag)).alias("hits"),
                                 count_pattern(red, r).alias("residual")) for r in rules])
    ex = df.select(F.explode(per_row).alias("t")).select("t.*")
    return ex.groupBy("tag").agg(F.sum("hits").cast("long").alias("hits"),
                                 F.sum(F.when(F.col("hits") > 0, 1).otherwise(0)).cast("long").alias("docs"),
                                 F.sum("residual").cast("long").alias("residual"))


def pair_agreement(df: DataFrame, pred: str, target: str, by: Sequence[str] = ()) -> DataFrame:
    """Exact-match rate between predicted and given redactions."""
    eq = (F.col(pred) == F.col(target)).cast("double")
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("pairs"), F.sum(eq).cast("long").alias("matches"),
                               F.avg(eq).alias("rate"))
