"""Supervised (raw -> redacted) training examples.

All steps are array expressions on one row (no shuffle). Two length modes:
``reference`` reproduces the source behaviour (examples with more than L
tokens come out L+1 long, others L); ``uniform`` (default) cuts both arrays
to L so every example stacks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.bytes import EOS_ID, IGNORE_INDEX, encode_ids, encoded_length, head_text
from tessera.functions.text import EOS_TEXT, RAW_TAG, REDACTED_TAG, col_of


def prompt_text(c) -> Column:
    """``[RAW] {x} [REDACTED] `` (trailing space kept)."""
    return F.concat(F.lit(RAW_TAG), col_of(c), F.lit(REDACTED_TAG))


def answer_text(c) -> Column:
    """``{y}<|endoftext|>``."""
    return F.concat(col_of(c), F.lit(EOS_TEXT))


def sft_prompt(df: DataFrame, col: str = "original_text", out: str = "prompt") -> DataFrame:
    return df.withColumn(out, prompt_text(col))


def sft_answer(df: DataFrame, col: str = "redacted_text", out: str = "answer") -> DataFrame:
    return df.withColumn(out, answer_text(col))


def sft_ids(df: DataFrame, raw: str = "original_text", red: str = "redacted_text", limit: int | None = None) -> DataFrame:
    """encode prompt and answer separately, keep the prompt length, concatenate.

    ``limit`` encodes only as much of both as the first ``limit`` tokens need; the
    lengths are those of the whole texts, counted without an array.
    """
    p, a = prompt_text(raw), answer_text(red)
    cut = (lambda t: head_text(t, limit)) if limit else (lambda t: t)
    return (df.withColumn("prompt_len", encoded_length(p).cast("int"))
            .withColumn("full_len", (encoded_length(p) + encoded_length(a)).cast("int"))
            .withColumn("full", F.concat(encode_ids(cut(p)), encode_ids(cut(a)))))


def sft_truncate(df: DataFrame, L: int) -> DataFrame:
    """keep at most L+1 tokens; flag the cut."""
    return (df.withColumn("overflow", F.col("full_len") > L + 1)
            .withColumn("full", F.slice("full", 1, L + 1)))


def sft_target(df: DataFrame, eos: int = EOS_ID) -> DataFrame:
    """target = full[1:] + [EOS] (EOS appended even after truncation)."""
    n = F.size("full")
    return df.withColumn("target", F.concat(F.slice("full", 2, F.greatest(n - 1, F.lit(0))),
                                            F.array(F.lit(eos))))


def sft_mask(df: DataFrame) -> DataFrame:
    """target positions before ``prompt_len - 1`` become -100.

    Written with whole-array functions (repeat + slice + concat), not a
    per-element lambda, so it runs in generated code.
    """
    n = F.size("target")
    m = F.least(F.greatest(F.col("prompt_len") - 1, F.lit(0)), n)
    return df.withColumn("target", F.concat(F.array_repeat(F.lit(IGNORE_INDEX), m),
                                            F.slice("target", m + 1, F.greatest(n - m, F.lit(0)))))


def sft_pad(df: DataFrame, L: int, eos: int = EOS_ID) -> DataFrame:
    """pad input with EOS and target with -100 up to L (longer rows untouched)."""
    pad = F.greatest(F.lit(L) - F.size("full"), F.lit(0))
    return (df.withColumn("input", F.concat("full", F.array_repeat(F.lit(eos), pad)))
            .withColumn("target", F.concat("target", F.array_repeat(F.lit(IGNORE_INDEX), pad)))
            .drop("full"))


def sft_examples(df: DataFrame, L: int, mode: str = "uniform", raw: str = "original_text",
                 red: str = "redacted_text", eos: int = EOS_ID) -> DataFrame:
    """F1-F5 in one projection; adds ``input``, ``target``, ``prompt_len``, ``full_len``, ``overflow``."""
    if mode not in ("uniform", "reference"):
        raise ValueError("mode must be 'uniform' or 'reference'")
    out = sft_pad(sft_mask(sft_target(sft_truncate(sft_ids(df, raw, red, L + 1), L), eos)), L, eos)
    if mode == "uniform":
        out = out.withColumn("input", F.slice("input", 1, L)).withColumn("target", F.slice("target", 1, L))
    return out


def scored_tokens(target: str = "target") -> Column:
    """Number of target positions that carry loss (not -100)."""
    return F.size(F.array_remove(target, IGNORE_INDEX))


def sft_audit(df: DataFrame) -> DataFrame:
    """per overflow flag — examples, all-masked examples, scored tokens, lengths."""
    s = scored_tokens()
    return (df.withColumn("_s", s).groupBy("overflow")
            .agg(F.count(F.lit(1)).alias("examples"),
                 F.sum(F.when(F.col("_s") == 0, 1).otherwise(0)).cast("long").alias("all_masked"),
                 F.sum("_s").cast("long").alias("scored"),
                 F.min(F.size("input")).cast("long").alias("min_len"),
                 F.max(F.size("input")).cast("long").alias("max_len")))
