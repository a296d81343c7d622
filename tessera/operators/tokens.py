"""Tokenization as column expressions, joins and aggregates.

Byte mode (T1/T2) is lossless and narrow: no shuffle at all. Word mode
(T6-T8) builds a capped vocabulary with a partial aggregate + TakeOrdered and
looks tokens up in each task (a dictionary of checked size) or by a join; both
give the same rows: one per input row, an empty result for NULL or no words, and
``<unk>`` for whatever the vocabulary lacks.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from tessera.functions.bytes import BYTE_VOCAB, EOS_ID, decode_ids, encode_ids
from tessera.functions.text import EOS_TEXT, WORD_RE, col_of
from tessera.operators.sizes import LOOKUP_BYTES, broadcast_if_small, byte_size

UNK_ID = 0
UNK_TEXT = "<unk>"
WORD_EOS_ID = 1
# T6 sends this many rows of each task to one merge at most.
MAX_VOCAB = 1_000_000


def encode_bytes(df: DataFrame, text: str = "text", out: str = "ids", allow_special: bool = True) -> DataFrame:
    """UTF-8 byte ids (0-255); literal EOS text -> 256 when allowed."""
    return df.withColumn(out, encode_ids(text, allow_special))


def decode_bytes(df: DataFrame, ids: str = "ids", out: str = "text") -> DataFrame:
    """Inverse of T1 (EOS id decodes to its literal)."""
    return df.withColumn(out, decode_ids(ids))


def eos_id(vocab: DataFrame | None = None) -> int:
    """The EOS id — 256 in byte mode, 1 in word mode."""
    return EOS_ID if vocab is None else WORD_EOS_ID


def vocab_size(vocab: DataFrame | None = None) -> int:
    """T4: 257 in byte mode; row count of the vocabulary in word mode."""
    return BYTE_VOCAB if vocab is None else vocab.count()


def count_special(df: DataFrame, text: str = "text", out: str = "n_special") -> DataFrame:
    """T5: how many literal EOS strings each text carries (each forges a boundary)."""
    return df.withColumn(out, F.size(F.split(col_of(text), "<\\|endoftext\\|>", -1)) - 1)


def token_stats(df: DataFrame, ids: str = "ids", by: list[str] | None = None, n: Column | None = None) -> DataFrame:
    """Documents and tokens per group (partial aggregation, one small shuffle).

    ``n`` may give the token count of a row, so that no array is built for its size.
    """
    n = F.size(ids) if n is None else n
    aggs = [F.count(F.lit(1)).alias("docs"), F.sum(n).cast("long").alias("tokens"),
            F.min(n).cast("long").alias("min_tokens"), F.max(n).cast("long").alias("max_tokens")]
    return df.groupBy(*(by or [])).agg(*aggs)


def word_tokens(df: DataFrame, text: str = "text", out: str = "tokens") -> DataFrame:
    return df.withColumn(out, F.regexp_extract_all(col_of(text), F.lit(WORD_RE), 0))


def build_vocab(df: DataFrame, size: int, text: str = "text") -> DataFrame:
    """``(token, id)`` for the ``size-2`` most frequent words; 0=UNK, 1=EOS reserved.

    Word counts use a partial (map-side) aggregate, so a hot word costs one row
    per partition before the shuffle. The cut is a TakeOrdered of ``size-2``
    rows, and ids are numbered inside that bounded set only.
    """
    if not 3 <= size <= MAX_VOCAB:
        raise ValueError(f"size must leave room for UNK and EOS, and be at most {MAX_VOCAB}")
    counts = (df.select(F.explode(F.regexp_extract_all(col_of(text), F.lit(WORD_RE), 0)).alias("token"))
              .groupBy("token").agg(F.count(F.lit(1)).alias("freq")))
    top = counts.orderBy(F.col("freq").desc(), F.col("token")).limit(size - 2)
    w = Window.partitionBy(F.lit(0)).orderBy(F.col("freq").desc(), F.col("token"))
    return top.select("token", (F.row_number().over(w) + 1).cast("int").alias("id"), "freq")


def _method(method: str, vocab: DataFrame) -> str:
    """``auto``: a lookup if the vocabulary is measured to fit Python workers, else a join."""
    if method not in ("auto", "lookup", "join"):
        raise ValueError(f"unknown method {method!r}")
    small = method != "join" and byte_size(vocab) <= LOOKUP_BYTES
    if method == "lookup" and not small:
        raise ValueError("the vocabulary is too large for a lookup in each task")
    return "lookup" if small else "join"


def encode_vocab(df: DataFrame, vocab: DataFrame, key: str = "doc_id", text: str = "text",
                 out: str = "ids", method: str = "auto") -> DataFrame:
    """Word ids by vocabulary lookup (unknown -> 0), order kept by position.

    * ``lookup`` (a vocabulary of at most ``LOOKUP_BYTES``, measured before it is
      collected): sent once as a dictionary; each task maps its rows' word arrays
      in Arrow batches, with no shuffle of tokens.
    * ``join``: words are exploded, equi-joined (broadcast only if measured small)
      and put together again per row.

    Returns ``(key, out)``, one row per input row even where keys repeat; NULL text
    and text without words give an empty array.
    """
    vocab = vocab.select("token", "id")
    if _method(method, vocab) == "lookup":
        table = df.sparkSession.sparkContext.broadcast({r["token"]: int(r["id"]) for r in vocab.collect()})

        @F.pandas_udf(ArrayType(IntegerType()))
        def lookup(words: pd.Series) -> pd.Series:
            get = table.value.get
            return pd.Series([[] if ws is None else [get(w, UNK_ID) for w in ws] for ws in words], dtype=object)

        # the split stays JVM-side; Python only maps strings to ints
        return df.select(key, lookup(F.regexp_extract_all(col_of(text), F.lit(WORD_RE), 0)).alias(out))
    # rows are numbered before they are exploded: in one projection the number would count exploded rows
    rows = df.select(key, F.monotonically_increasing_id().alias("_row"),
                     F.regexp_extract_all(col_of(text), F.lit(WORD_RE), 0).alias("_ws"))
    toks = rows.select(key, "_row", F.posexplode_outer("_ws").alias("pos", "token"))
    looked = toks.join(broadcast_if_small(vocab), "token", "left")
    item = F.when(F.col("pos").isNotNull(), F.struct("pos", F.coalesce("id", F.lit(UNK_ID)).cast("int").alias("id")))
    ids = looked.groupBy(key, "_row").agg(F.array_sort(F.collect_list(item)).alias("_p"))
    return ids.select(key, F.transform("_p", lambda s: s["id"]).alias(out))


def decode_vocab(df: DataFrame, vocab: DataFrame, key: str = "doc_id", ids: str = "ids",
                 out: str = "text", method: str = "auto") -> DataFrame:
    """Ids -> words joined by one space (lossy: rare words come back as ``<unk>``,
    white space runs as one space). Methods and rows as in ``encode_vocab``: NULL and
    empty arrays give the empty text, ids that the vocabulary lacks give ``<unk>``."""
    special = [(WORD_EOS_ID, EOS_TEXT), (UNK_ID, UNK_TEXT)]
    known = vocab.select(F.col("id").cast("int").alias("id"), "token").filter(
        ~F.col("id").isin([i for i, _ in special])).union(
        df.sparkSession.createDataFrame(special, "id int, token string"))
    if _method(method, known) == "lookup":
        table = df.sparkSession.sparkContext.broadcast({int(r["id"]): r["token"] for r in known.collect()})

        @F.pandas_udf("string")
        def lookup(arrs: pd.Series) -> pd.Series:
            get = table.value.get
            return pd.Series(["" if a is None else " ".join(get(int(i), UNK_TEXT) for i in a) for a in arrs], dtype=object)

        return df.select(key, lookup(F.col(ids)).alias(out))
    ex = (df.select(key, F.monotonically_increasing_id().alias("_row"), F.col(ids).alias("_ids"))
          .select(key, "_row", F.posexplode_outer("_ids").alias("pos", "id")))
    joined = ex.join(broadcast_if_small(known), "id", "left")
    item = F.when(F.col("pos").isNotNull(), F.struct("pos", F.coalesce("token", F.lit(UNK_TEXT)).alias("token")))
    rows = joined.groupBy(key, "_row").agg(F.array_sort(F.collect_list(item)).alias("_p"))
    return rows.select(key, F.array_join(F.transform("_p", lambda s: s["token"]), " ").alias(out))
