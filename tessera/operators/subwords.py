"""T1, T2, T6 with learned subwords: byte-pair merges, their encoder and decoder.

A text is cut into units (a word with the space before it, or a run of white space) whose
join is the text. A unit is a string with one sign per symbol, whose code point is the
symbol's id: its UTF-8 bytes at first (ids 0-255; 256 is the end id), then merged symbols.
In this form merging a pair is one literal ``replace``, which takes occurrences from
left to right without overlap.

Learning works on the table of distinct units and their counts. Each round takes the
most frequent pairs as far as merging one cannot change the count or the turn of the next, so the merges
equal those of one-at-a-time learning. Only units that hold a merged pair are counted again:
their old pairs are taken from the pair counts, their new ones added. The state is written to the
shared folder every few rounds; the driver sees a bounded head of the pair counts only.

A few merges are applied to each text in their order, and its ids decoded where they lie. With many merges
encoding happens once per distinct unit. A merge can apply to a unit only if its piece
occurs in it, so a unit's candidate merges come from a join of its substrings with the
pieces, and are applied in rank order. Ids come back to the texts by joining units.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.bytes import BYTE_VOCAB, EOS_ID
from tessera.functions.text import col_of
from tessera.operators.sizes import BROADCAST_BYTES, byte_size
from tessera.session import materialize

UNIT_RE = " ?[^ \\t\\n\\r\\f\\x0B]+|[ \\t\\n\\r\\f\\x0B]+"
#: Pairs that one round looks at; the merges of a round are a prefix of them.
HEAD = 512
#: Rounds between writes of the state.
ROUNDS_PER_WRITE = 8
#: Merges that a text takes as it lies; a pass over the text for each.
ROW_MERGES = 256
#: Bytes of the symbols that a plan may carry.
ROW_SYMBOL_BYTES = 1 << 20
SURROGATES = (0xD800, 0x800)
MERGES = "rank int, lo int, hi int, id int, piece binary"


def sign_of(symbol: int) -> str:
    """The sign of a symbol: its id as a code point, leaving out surrogates."""
    return chr(symbol if symbol < SURROGATES[0] else symbol + SURROGATES[1])


def symbol_of(sign: Column) -> Column:
    """Id of a one-sign string."""
    code = F.ascii(sign)
    return F.when(code >= SURROGATES[0], code - SURROGATES[1]).otherwise(code)


def _sign(symbol: Column) -> Column:
    """``sign_of`` as an expression."""
    code = F.when(symbol >= SURROGATES[0], symbol + SURROGATES[1]).otherwise(symbol)
    return F.decode(F.unhex(F.lpad(F.hex(code.cast("long")), 8, "0")), "UTF-32")


def units(text) -> Column:
    """Array of units of a text; NULL gives none."""
    return F.coalesce(F.regexp_extract_all(col_of(text), F.lit(UNIT_RE), 0), F.array().cast("array<string>"))


def byte_signs(unit: Column) -> Column:
    """A unit as its UTF-8 bytes, one sign each."""
    return F.decode(F.encode(unit, "UTF-8"), "ISO-8859-1")


def unit_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """``unit, n`` of all texts (partial aggregation before the shuffle)."""
    return df.select(F.explode(units(text)).alias("unit")).groupBy("unit").agg(F.count(F.lit(1)).alias("n"))


def _pairs(signs: Column) -> Column:
    """Adjacent pairs of signs as two-sign strings."""
    return F.transform(F.sequence(F.lit(1), F.char_length(signs) - 1), lambda i: F.substr(signs, i, F.lit(2)))


def _signed(signs: Column, n: Column) -> Column:
    """Array of ``(pair, n)`` of the adjacent pairs."""
    none = F.array().cast("array<string>")
    pairs = F.when(F.char_length(signs) > 1, _pairs(signs)).otherwise(none)
    return F.transform(pairs, lambda p: F.struct(p.alias("pair"), n.alias("n")))


def _pair_counts(words: DataFrame, signs: str, n: Column) -> DataFrame:
    held = words.filter(F.char_length(signs) > 1).select(F.explode(_pairs(F.col(signs))).alias("pair"), n.alias("n"))
    return held.groupBy("pair").agg(F.sum("n").alias("n"))


def independent_prefix(pairs: Sequence[tuple[int, int]]) -> int:
    """How many of the leading pairs can be merged at once with the result of merging them in turn.

    A merge changes counts next to it only. With no symbol both second in one pair and first in another,
    the pairs occur apart from each other, keep their counts, and a new pair is at most as
    frequent as one that comes later in the list (and loses a tie by its larger id).
    """
    firsts, seconds = set(), set()
    for k, (lo, hi) in enumerate(pairs):
        if k and (lo == hi or lo in seconds or hi in firsts):
            return k
        if lo == hi:
            return 1
        firsts.add(lo)
        seconds.add(hi)
    return len(pairs)


def _merge(signs: Column, merges: Sequence[tuple[int, int, int]]) -> Column:
    for lo, hi, new in merges:
        signs = F.replace(signs, F.lit(sign_of(lo) + sign_of(hi)), F.lit(sign_of(new)))
    return signs


def learn_merges(df: DataFrame, n_merges: int, text: str = "text", least: int = 2, head: int = HEAD) -> DataFrame:
    """``rank, lo, hi, id, piece``, at most ``n_merges`` byte-pair merges of the texts.

    Each is the most frequent pair of symbols at its turn, ties by the smaller ids; pairs that
    occur fewer than ``least`` times are left. Ids run on from 257; ``piece`` has the bytes.
    """
    spark = df.sparkSession
    words = materialize(unit_counts(df, text).select(byte_signs(F.col("unit")).alias("signs"), "n").filter(
        F.char_length("signs") > 1), "unit-counts")
    counts = materialize(_pair_counts(words, "signs", F.col("n")), "pair-counts")
    pieces = {i: bytes([i]) for i in range(256)}
    done: list[tuple[int, int, int]] = []
    held: list[DataFrame] = []
    rounds = 0
    order = [F.desc("n"), *(symbol_of(F.substr("pair", F.lit(k), F.lit(1))) for k in (1, 2))]
    while len(done) < n_merges:
        top = counts.filter(F.col("n") >= least).orderBy(*order).limit(head).select("pair").collect()
        for old in held[:-2]:
            old.unpersist()
        held = held[-2:]
        top = [tuple(map(_symbol, r["pair"])) for r in top]
        take = min(independent_prefix(top), n_merges - len(done))
        if not take:
            break
        new = [(lo, hi, BYTE_VOCAB + len(done) + k) for k, (lo, hi) in enumerate(top[:take])]
        done += new
        rounds += 1
        for lo, hi, i in new:
            pieces[i] = pieces[lo] + pieces[hi]
        # recount the units that hold a merged pair
        after = _merge(F.col("signs"), new)
        words = words.withColumn("after", after).filter(F.char_length("signs") > 1)
        touched = words.filter("after != signs")
        change = touched.select(F.inline(F.concat(_signed(F.col("signs"), -F.col("n")), _signed(F.col("after"), F.col("n")))))
        counts = counts.union(change).groupBy("pair").agg(F.sum("n").alias("n")).filter("n > 0")
        words = words.select(F.col("after").alias("signs"), "n")
        if rounds % ROUNDS_PER_WRITE == 0:
            counts, words = materialize(counts, "pair-counts"), materialize(words, "unit-counts")
        else:
            counts, words = counts.persist(), words.persist()
            held += [counts, words]
    for old in held:
        old.unpersist()
    rows = [(k, lo, hi, i, bytearray(pieces[i])) for k, (lo, hi, i) in enumerate(done)]
    return materialize(spark.createDataFrame(rows, MERGES), "merges")


def _symbol(sign: str) -> int:
    code = ord(sign)
    return code if code < SURROGATES[0] else code - SURROGATES[1]


def subword_vocab(spark: SparkSession, merges: DataFrame) -> DataFrame:
    """``id, piece`` of all symbols: bytes, the end sign (its literal) and the merged pieces."""
    base = spark.range(256).select(F.col("id").cast("int").alias("id"),
                                   F.unhex(F.lpad(F.hex("id"), 2, "0")).alias("piece"))
    end = spark.range(1).select(F.lit(EOS_ID).alias("id"), F.encode(F.lit("<|endoftext|>"), "UTF-8").alias("piece"))
    return base.union(end).union(merges.select("id", "piece"))


def encode_units(distinct: DataFrame, merges: DataFrame) -> DataFrame:
    """``unit, ids`` of each row of ``distinct (unit)``: all merges in rank order, found by the unit's substrings."""
    latin = F.decode("piece", "ISO-8859-1")
    known = merges.select(latin.alias("part"), "rank", F.concat(_sign(F.col("lo")), _sign(F.col("hi"))).alias("pair"),
                          _sign(F.col("id")).alias("sign"))
    longest = merges.agg(F.max(F.octet_length("piece"))).first()[0] or 0
    rows = distinct.select("unit", byte_signs(F.col("unit")).alias("signs"))
    if longest:
        size = F.char_length("signs")
        spans = F.flatten(F.transform(F.sequence(F.lit(2), F.greatest(F.least(size, F.lit(longest)), F.lit(2))), lambda k: F.transform(
            F.sequence(F.lit(1), F.greatest(size - k + 1, F.lit(1))), lambda i: F.substr("signs", i, k))))
        parts = rows.filter(size > 1).select("unit", F.explode(F.array_distinct(spans)).alias("part"))
        small = byte_size(merges) <= BROADCAST_BYTES
        hits = parts.join(F.broadcast(known) if small else known, "part").groupBy("unit").agg(
            F.array_sort(F.collect_list(F.struct("rank", "pair", "sign"))).alias("steps"))
        rows = rows.join(hits, "unit", "left")
        none = F.array().cast("array<struct<rank:int,pair:string,sign:string>>")
        signs = F.aggregate(F.coalesce("steps", none), F.col("signs"), lambda s, m: F.replace(s, m["pair"], m["sign"]))
    else:
        signs = F.col("signs")
    each = rows.select("unit", signs.alias("_s")).select("unit", F.slice(F.split("_s", "", -1), 1, F.char_length("_s")).alias("_s"))
    return each.select("unit", F.transform("_s", symbol_of).alias("ids"))


def _encoded_in_row(text: Column, merges: Sequence[tuple[int, int, int]]) -> Column:
    """Ids of a text by all merges in their order, on the text as one string of signs.

    The end id's sign, which no merge holds, stands behind each unit, so no pair reaches into the next one.
    """
    apart = sign_of(EOS_ID)
    signs = F.regexp_replace(byte_signs(text), UNIT_RE, "$0" + apart)
    signs = F.replace(_merge(signs, merges), F.lit(apart), F.lit(""))
    return _ids(F.coalesce(signs, F.lit("")))


def _ids(signs: Column) -> Column:
    """Symbols of a string of signs, split once."""
    return F.transform(F.filter(F.split(signs, "", -1), lambda c: c != ""), symbol_of)


def encode_subwords(df: DataFrame, merges: DataFrame, key: str = "doc_id", text: str = "text", out: str = "ids") -> DataFrame:
    """Subword ids of each text, ``(key, out)``, one row per input row; NULL and empty texts give none.

    Up to ``ROW_MERGES`` merges are applied to each text as it lies, without an exchange. With more of them,
    distinct units are encoded once and joined back by unit (broadcast if their codes are measured to
    be small, else a shuffled join whose hot units Spark splits). Rows are then dealt by number before
    they are exploded, so that the units of a row meet again without a second exchange after a broadcast.
    """
    few = merges.orderBy("rank").limit(ROW_MERGES + 1).select("lo", "hi", "id").collect()
    if len(few) <= ROW_MERGES:
        return df.select(F.col(key), _encoded_in_row(F.col(text), [tuple(r) for r in few]).alias(out))
    return _encode_joined(df, merges, key, text, out)


def _encode_joined(df: DataFrame, merges: DataFrame, key: str, text: str, out: str) -> DataFrame:
    rows = df.select(F.col(key).alias("_key"), F.monotonically_increasing_id().alias("_row"), F.col(text).alias("_text"))
    rows = materialize(rows, "rows")
    codes = materialize(encode_units(rows.select(F.explode(units("_text")).alias("unit")).distinct(), merges), "unit-codes")
    small = byte_size(codes) <= BROADCAST_BYTES
    dealt = rows.repartition("_row") if small else rows
    each = dealt.select("_row", F.posexplode(units("_text")).alias("pos", "unit"))
    each = each.join(F.broadcast(codes) if small else codes, "unit")
    whole = each.groupBy("_row").agg(F.flatten(F.transform(
        F.array_sort(F.collect_list(F.struct("pos", "ids"))), lambda u: u["ids"])).alias(out))
    none = F.array().cast("array<int>")
    return rows.select("_row", F.col("_key").alias(key)).join(whole, "_row", "left").select(key, F.coalesce(out, none).alias(out))


def decode_subwords(df: DataFrame, merges: DataFrame, ids: str = "ids", out: str = "text", key: str = "doc_id") -> DataFrame:
    """The text of each id array, ``(key, out)``: pieces are joined as bytes, so any cut is lossless.

    Ids that are no symbol are left out. Symbols of at most ``ROW_SYMBOL_BYTES`` in all travel inside the plan and are
    looked up where the ids lie, without an exchange; more of them are joined.
    """
    vocab = subword_vocab(df.sparkSession, merges).select(F.col("id").alias("_id"), F.hex("piece").alias("_hex"))
    size = byte_size(vocab)
    if size <= ROW_SYMBOL_BYTES:
        known = {r["_id"]: r["_hex"] for r in vocab.collect()}
        if max(known) < 2 * len(known):  # a gap costs an empty entry
            pieces = F.split(F.lit(",".join(known.get(i, "") for i in range(max(known) + 1))), ",", -1)
            raw = F.unhex(F.array_join(F.transform(ids, lambda i: F.get(pieces, i)), ""))
            return df.select(F.col(key), F.coalesce(F.decode(raw, "UTF-8"), F.lit("")).alias(out))
    rows = df.select(F.col(key).alias("_key"), F.monotonically_increasing_id().alias("_row"), F.col(ids).alias("_ids"))
    each = rows.select("_key", "_row", F.posexplode_outer("_ids").alias("pos", "_id"))
    each = each.join(F.broadcast(vocab) if size <= BROADCAST_BYTES else vocab, "_id", "left")
    item = F.when(F.col("_hex").isNotNull(), F.struct("pos", "_hex"))
    whole = each.groupBy("_key", "_row").agg(F.array_sort(F.collect_list(item)).alias("_p"))
    raw = F.unhex(F.array_join(F.transform("_p", lambda p: p["_hex"]), ""))
    return whole.select(F.col("_key").alias(key), F.decode(raw, "UTF-8").alias(out))
