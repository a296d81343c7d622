"""R1, names in free text: a sequence tagger learnt from dictionary hits.

Words of a sentence are tagged OUT, CUE (the word before a name), FIRST or REST (of a
name). A hidden Markov model is counted in Spark from texts in which a dictionary finds
names: transitions between neighbouring tags, frequent words under OUT and CUE, and the shapes of
words (``Xx``, ``x``, ``9`` ...) under all four. So a name that no dictionary has is found by its
shape and by what stands before it, while frequent words that look like names stay.

    P(word | FIRST or REST) = P(shape | tag) / words of that shape
    P(word | OUT or CUE)    = count / total               for a frequent word
                            = P(rare and shape | tag) / rare words of that shape    else

Log-probabilities are whole millionths, so sums are exact and ties the same everywhere. The best
tags come from Viterbi decoding as one fold over a sentence's emissions, each state carrying its
score and its tags so far. Words meet the model's table by an equi-join; texts are dealt
by row before they are cut into words, which meet again without another exchange.

Sentences end at ``. ! ?``, line ends, or after ``LONGEST`` words; a name does not cross an end.
NULL and empty texts stay as they are. Repeated rows and keys are separate rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import col_of
from tessera.operators.sizes import BROADCAST_BYTES, LOOKUP_BYTES, broadcast_if_small, byte_size
from tessera.session import materialize

OUT, CUE, FIRST, REST = range(4)
CODES = "OCFR"
WORD = "[\\p{L}\\p{N}]+"
LONGEST = 200
SENTENCE_RE = f"(?:{WORD}[^\\p{{L}}\\p{{N}}.!?\\n]*){{1,{LONGEST}}}[^\\p{{L}}\\p{{N}}]*|[^\\p{{L}}\\p{{N}}]+"
#: The same for a sentence of no more words than that, in one pass over its signs.
SHORT_RE = "[\\p{L}\\p{N}][^.!?\\n]*[^\\p{L}\\p{N}]*|[^\\p{L}\\p{N}]+"
PART_RE = f"{WORD}|[^\\p{{L}}\\p{{N}}]+"
#: Words of a dictionary name, at most.
LONGEST_NAME = 4
#: Occurrences from which a word counts by itself, and how many such words the model keeps.
FREQUENT, MOST_WORDS = 20, 50_000
#: First signs of dictionary names up to which places are chosen by them.
MOST_SIGNS = 1000
SMOOTHING = 0.5
MILLION = 1_000_000


def sentences(text) -> Column:
    """Array of sentences whose join is the text."""
    text = col_of(text)
    short = F.regexp_extract_all(text, F.lit(SHORT_RE), 0)

    def few(x: Column) -> Column:
        return F.char_length(x) <= 2 * LONGEST  # a word and the gap behind it have two signs at least
    each = F.transform(short, lambda s: F.when(few(s), F.array(s)).otherwise(F.regexp_extract_all(s, F.lit(SENTENCE_RE), 0)))
    return F.when(few(text), short).otherwise(F.flatten(each))


def sentence_words(sentence) -> Column:
    return F.regexp_extract_all(col_of(sentence), F.lit(WORD), 0)


def shape(word: Column) -> Column:
    """Runs of capitals, other letters and digits as ``X``, ``x`` and ``9``; the first three runs."""
    return F.substring(_signs(word), 1, 3)


def _signs(text: Column) -> Column:
    """A text with each run of capitals, other letters and digits as one sign; gaps between words stay."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "\\p{Lu}+", "X"), "\\p{N}+", "9"), "[\\p{L}&&[^X]]+", "x")


@dataclass(frozen=True)
class NameModel:
    """``words (word, e)`` and shape -> emissions by tag, start and transition log-probabilities in millionths."""

    words: DataFrame
    shapes: dict[str, list[int]]
    other: list[int]
    start: list[int]
    moves: list[list[int]]


def _spoken(df: DataFrame, text: str) -> DataFrame:
    """``_row, sent, pos, word`` of every word."""
    rows = df.select(F.monotonically_increasing_id().alias("_row"), col_of(text).alias("_text"))
    each = rows.select("_row", F.posexplode(sentences("_text")).alias("sent", "_s"))
    return each.select("_row", "sent", F.posexplode(sentence_words("_s")).alias("pos", "word"))


def name_table(names: DataFrame, name: str = "name") -> DataFrame:
    """``full, n`` of each distinct name: its words joined by one space, and their number (1 to ``LONGEST_NAME``)."""
    words = sentence_words(name)
    return names.select(F.array_join(words, " ").alias("full"), F.size(words).alias("n")).filter(
        F.col("n").between(1, LONGEST_NAME)).distinct()


def tagged_words(df: DataFrame, names: DataFrame, text: str = "text", name: str = "name") -> DataFrame:
    """``_row, sent, pos, word, tag, next`` of the words of ``df``, tagged by the dictionary's hits.

    Of hits that overlap, the one that starts first gives the tag. ``next`` is the tag of the next word.
    """
    table = materialize(name_table(names, name), "name-table")
    known = table.agg(F.sort_array(F.collect_set("n")).alias("n"), F.slice(F.collect_set(F.substring("full", 1, 1)), 1, MOST_SIGNS + 1).alias("signs")).first()
    rows = df.select(F.monotonically_increasing_id().alias("_row"), col_of(text).alias("_text"))
    spoken = rows.select("_row", F.posexplode(sentences("_text")).alias("sent", "_s")).select("_row", "sent", sentence_words("_s").alias("_w"))
    spoken = materialize(spoken.filter(F.size("_w") > 0), "sentences")
    w = F.col("_w")
    if not known["n"]:
        hits = F.lit(None).cast("array<struct<at:int,n:int>>")
        every = spoken.withColumn("hits", hits)
    else:
        # each word with those that follow it; few begin like a name
        most = max(known["n"])
        ahead = F.arrays_zip(*[F.slice("_w", k + 1, F.size("_w")).alias(f"w{k}") for k in range(most)])
        found = spoken.select("_row", "sent", F.posexplode(ahead).alias("at", "_z")).select("_row", "sent", "at", "_z.*")
        if len(known["signs"]) <= MOST_SIGNS:
            found = found.filter(F.substring("w0", 1, 1).isin(known["signs"]))
        runs = [F.when(F.col(f"w{k - 1}").isNotNull(), F.struct(F.lit(k).alias("n"), F.concat_ws(" ", *[f"w{j}" for j in range(k)]).alias("full"))) for k in known["n"]]
        found = found.select("_row", "sent", "at", F.explode(F.array(*runs)).alias("_f")).filter("_f is not null").select("_row", "sent", "at", "_f.*")
        found = found.join(broadcast_if_small(table), ["full", "n"])
        held = found.groupBy("_row", "sent").agg(F.collect_set(F.struct("at", "n")).alias("hits"))
        every = spoken.join(held, ["_row", "sent"], "left")
    starts = F.transform(F.sequence(F.lit(0), F.size(w) - 1), lambda i: F.array_min(F.transform(
        F.filter("hits", lambda h: (h["at"] <= i) & (i < h["at"] + h["n"])), lambda h: h["at"])))
    # most sentences have no hit: all of their words are OUT
    every = every.withColumn("_at", F.when(F.col("hits").isNotNull(), starts))
    first = F.transform("_at", lambda s, i: F.when(s.isNull(), F.lit(OUT)).when(s == i, F.lit(FIRST)).otherwise(F.lit(REST)))
    every = every.withColumn("_first", F.when(F.col("hits").isNotNull(), first))
    tags = F.transform("_first", lambda t, i: F.when((t == OUT) & (F.get("_first", i + 1) == FIRST), F.lit(CUE)).otherwise(t))
    every = every.withColumn("_tags", F.when(F.col("hits").isNotNull(), tags).otherwise(F.array_repeat(F.lit(OUT), F.size(w))))
    cells = F.arrays_zip(w.alias("word"), F.col("_tags").alias("tag"), F.slice("_tags", 2, F.size(w)).alias("next"))
    return every.select("_row", "sent", F.posexplode(cells).alias("pos", "_c")).select("_row", "sent", "pos", "_c.*")


def learn_names(df: DataFrame, names: DataFrame, text: str = "text", name: str = "name", frequent: int = FREQUENT,
                most_words: int = MOST_WORDS) -> NameModel:
    """Counts the model over all texts of ``df`` with the names of a dictionary."""
    words = materialize(tagged_words(df, names, text, name).groupBy("word", "tag").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("pos") == 0, 1).otherwise(0)).alias("starts"),
        *[F.sum(F.when(F.col("next") == t, 1).otherwise(0)).alias(f"to{t}") for t in range(4)]), "tagged-words")
    sums = {r["tag"]: r for r in words.groupBy("tag").agg(
        F.sum("n").alias("n"), F.sum("starts").alias("starts"), *[F.sum(f"to{t}").alias(f"to{t}") for t in range(4)]).collect()}
    number = lambda t, c: float(sums[t][c] or 0) if t in sums else 0.0

    import math

    def logs(counts: list[float]) -> list[int]:
        total = sum(counts) + SMOOTHING * len(counts)
        return [round(MILLION * math.log((c + SMOOTHING) / total)) for c in counts]
    start = logs([number(t, "starts") for t in range(4)])
    moves = [logs([number(t, f"to{u}") for u in range(4)]) for t in range(4)]
    # what tags forbid: REST only within a name, FIRST right after CUE
    never = -1000 * MILLION
    start[REST] = moves[OUT][REST] = moves[CUE][REST] = moves[CUE][OUT] = moves[CUE][CUE] = never

    types = materialize(words.groupBy("word").agg(*[F.sum(F.when(F.col("tag") == t, F.col("n")).otherwise(0)).alias(f"n{t}") for t in range(4)]).withColumn(
        "plain", F.col(f"n{OUT}") + F.col(f"n{CUE}")).withColumn("shape", shape(F.col("word"))), "word-types")
    often = types.filter(F.col("plain") >= frequent).orderBy(F.desc("plain"), "word").limit(most_words).select("word", F.lit(True).alias("often"))
    marked = types.join(broadcast_if_small(materialize(often, "frequent-words")), "word", "left")
    by_shape = marked.groupBy("shape").agg(
        F.count(F.lit(1)).alias("types"), F.count(F.when(F.col("often").isNull(), 1)).alias("rare"),
        *[F.sum(F.when(F.col("often").isNull() if t <= CUE else F.lit(True), F.col(f"n{t}")).otherwise(0)).alias(f"c{t}") for t in range(4)])
    by_shape = {r["shape"]: r for r in by_shape.collect()}  # shapes are strings of at most three of three signs and marks
    kinds = len(by_shape) + 1
    n_often = marked.filter("often").count()

    def shape_logs(r) -> list[int]:
        out = []
        for t in range(4):
            c, distinct = (r[f"c{t}"], r["rare"] if t <= CUE else r["types"]) if r else (0, 1)
            cells = kinds + (n_often if t <= CUE else 0)
            out.append(round(MILLION * (math.log((c + SMOOTHING) / (number(t, "n") + SMOOTHING * cells)) - math.log(max(1, distinct)))))
        return out
    shapes = {s: shape_logs(r) for s, r in by_shape.items()}
    other = shape_logs(None)
    named = F.create_map(*[x for s, e in shapes.items() for x in (F.lit(s), F.array(F.lit(e[FIRST]), F.lit(e[REST])))]) if shapes else None

    def word_log(t: int) -> Column:
        c = F.coalesce(F.col(f"n{t}"), F.lit(0)) + SMOOTHING
        return F.round(MILLION * F.log(c / (number(t, "n") + SMOOTHING * (kinds + n_often)))).cast("long")
    table = marked.filter("often")
    if named is None:
        e = F.array(*[F.lit(0).cast("long")] * 4)
    else:
        e = F.concat(F.array(word_log(OUT), word_log(CUE)), F.element_at(named, F.col("shape")).cast("array<long>"))
    return NameModel(materialize(table.select("word", e.alias("e")), "name-words"), shapes, other, start, moves)


def _decoder(start: Sequence[int], moves: Sequence[Sequence[int]]):
    """Function of emissions by word ``(n, 4)`` and words a sentence: all tags as bytes. Sentences are decoded side by side, word by word."""
    def decode(emissions, lengths):
        import numpy as np

        signs = np.frombuffer(CODES.encode(), np.uint8)
        alphabet = signs.argsort().argsort()  # tags of one length are ordered by their last sign if equal before
        order = np.argsort(-lengths, kind="stable")
        first, sizes = (np.cumsum(lengths) - lengths)[order], lengths[order]
        longest = int(sizes[0]) if len(sizes) else 0
        alive = np.searchsorted(-sizes, -np.arange(longest), "left")  # sentences with more than k words
        out = np.zeros(int(lengths.sum()), np.uint8)
        if not longest:
            return out
        # a state in one number: its score, the rank of its tags among the four states, the state
        opening = emissions[first[:alive[0]]].T
        state = [(opening[t] + start[t]) * 16 + int(alphabet[t]) * 4 + t for t in range(4)]
        back = []
        for k in range(1, longest):
            n = alive[k]
            e = emissions[first[:n] + k].T
            best = []
            for t in range(4):
                top = state[0][:n] + 16 * moves[0][t]
                for p in range(1, 4):
                    np.maximum(top, state[p][:n] + 16 * moves[p][t], out=top)
                best.append(top)
            tie = [(best[t] & 12) + int(alphabet[t]) for t in range(4)]
            for t in range(4):
                rank = sum((tie[t] > tie[u]).astype(np.int64) for u in range(4) if u != t)
                state[t][:n] = ((best[t] >> 4) + e[t]) * 16 + rank * 4 + t
            back.append(np.stack([(top & 3).astype(np.uint8) for top in best]))
        at = np.maximum(np.maximum(state[0], state[1]), np.maximum(state[2], state[3])) & 3
        for k in range(longest - 1, -1, -1):
            n = alive[k]
            out[first[:n] + k] = signs[at[:n]]
            if k:
                at[:n] = back[k - 1][at[:n], np.arange(n)]
        return out
    return decode


def viterbi(emissions: Column, start: Sequence[int], moves: Sequence[Sequence[int]]) -> Column:
    """The best tags, one sign of ``CODES`` each, for an array of emissions by tag; of equal scores the larger tags."""
    decode = _decoder(start, moves)

    def tags(rows):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        lengths = pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        each = rows.flatten().flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, 4)
        ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        held = pa.StringArray.from_buffers(len(rows), pa.py_buffer(ends), pa.py_buffer(decode(each, lengths)))
        return pc.if_else(rows.is_valid(), held, None)
    return F.arrow_udf(tags, "string")(emissions)


def _looked_up(model: NameModel, words: Column, shapes: Column) -> Column:
    """The tags of each sentence of a text, for its words by sentence and, if it has signs beyond ASCII, their shapes; the model's words are held by each task."""
    import numpy as np
    import pyarrow as pa

    known = model.words.select("word", "e").collect()
    words_of, kinds = pa.array([r["word"] for r in known], pa.string()), pa.array(list(model.shapes), pa.string())
    table = np.array([list(r["e"]) for r in known] + [*model.shapes.values(), model.other], np.int64)
    decode = _decoder(model.start, model.moves)
    kind_of = {k: i for i, k in enumerate(model.shapes)}

    def ascii_shape(word: str) -> str:
        import re

        return re.sub("[a-z]+", "x", re.sub("[0-9]+", "9", re.sub("[A-Z]+", "X", word)))[:3]

    def tags(texts, signs):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        said = texts.flatten()
        lengths = pc.list_value_length(said).to_numpy(zero_copy_only=False).astype(np.int64)
        sizes = pc.fill_null(pc.list_value_length(texts), 0).to_numpy(zero_copy_only=False)
        held = said.flatten().dictionary_encode()
        own = pc.fill_null(pc.index_in(held.dictionary, value_set=words_of), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        of_word = np.full(len(own), len(kinds), np.int64)
        new = np.flatnonzero(own < 0)
        of_word[new] = [kind_of.get(ascii_shape(w), len(kinds)) for w in held.dictionary.take(pa.array(new)).to_pylist()]
        at = held.indices.to_numpy(zero_copy_only=False)
        own, kind = own[at], of_word[at]
        told = np.repeat(signs.is_valid().to_numpy(zero_copy_only=False), np.add.reduceat(np.append(lengths, 0), np.cumsum(sizes) - sizes) * (sizes > 0))
        shown = pc.index_in(pc.utf8_slice_codeunits(signs.flatten().flatten(), 0, 3), value_set=kinds)
        kind[told] = pc.fill_null(shown, len(kinds)).to_numpy(zero_copy_only=False)
        kind += len(words_of)
        found = decode(table[np.where(own >= 0, own, kind)], lengths)
        ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        each = pa.StringArray.from_buffers(len(said), pa.py_buffer(ends), pa.py_buffer(found))
        ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        mask = pa.array(texts.is_null().to_numpy(zero_copy_only=False)) if texts.null_count else None
        return pa.ListArray.from_arrays(pa.array(ends), each, mask=mask)
    return F.arrow_udf(tags, "array<string>")(words, shapes)


def name_tags(df: DataFrame, model: NameModel, text: str = "text") -> DataFrame:
    """``_row, sent, tags`` of every sentence of ``df (_row, text)`` that has words."""
    each = df.select("_row", F.posexplode(sentences(text)).alias("sent", "_s"))
    each = each.select("_row", "sent", F.posexplode(sentence_words("_s")).alias("pos", "word"))
    small = byte_size(model.words) <= BROADCAST_BYTES
    each = each.join(F.broadcast(model.words) if small else model.words, "word", "left")
    other = F.array(*[F.lit(x).cast("long") for x in model.other])
    by_shape = other
    if model.shapes:
        known = F.create_map(*[x for s, e in model.shapes.items() for x in (F.lit(s), F.array(*[F.lit(v).cast("long") for v in e]))])
        by_shape = F.coalesce(F.try_element_at(known, shape(F.col("word"))), other)
    e = F.when(F.col("e").isNotNull(), F.col("e")).otherwise(by_shape)
    held = each.select("_row", "sent", "pos", e.alias("e")).groupBy("_row", "sent").agg(
        F.array_sort(F.collect_list(F.struct("pos", "e"))).alias("_p"))
    held = held.select("_row", "sent", F.transform("_p", lambda p: p["e"]).alias("_e"))
    return held.select("_row", "sent", viterbi(F.col("_e"), model.start, model.moves).alias("tags"))


def _without_names(sentence: Column, tags: Column, marker: str) -> Column:
    """A sentence with each run of FIRST, REST ... as the marker. Words and the gaps after them alternate."""
    def by_word(parts: Column) -> Column:
        def word(k: Column) -> Column:
            tag, later = F.substr(tags, k + 1, F.lit(1)), F.substr(tags, k + 2, F.lit(1))
            own = F.when(tag == CODES[FIRST], F.lit(marker)).when(tag == CODES[REST], F.lit("")).otherwise(F.get(parts, 2 * k))
            return F.concat(own, F.when(later == CODES[REST], F.lit("")).otherwise(F.coalesce(F.get(parts, 2 * k + 1), F.lit(""))))
        return F.array_join(F.transform(F.sequence(F.lit(0), F.char_length(tags) - 1), word), "")

    def by_run(parts: Column) -> Column:
        def take(acc: Column, run: Column) -> Column:
            n = F.char_length(run)
            gap = F.coalesce(F.get(parts, 2 * (acc["at"] + n) - 1), F.lit(""))
            own = F.when(F.startswith(run, F.lit(CODES[FIRST])), F.concat(F.lit(marker), gap)).otherwise(
                F.array_join(F.slice(parts, 2 * acc["at"] + 1, 2 * n), ""))
            return F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], own).alias("out"))
        runs = F.regexp_extract_all(tags, F.lit(f"{CODES[FIRST]}{CODES[REST]}*|[^{CODES[FIRST]}]+"), 0)
        return F.aggregate(runs, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), take, lambda acc: acc["out"])

    def rebuilt(parts: Column) -> Column:  # a model may allow REST without FIRST
        return F.when(tags.rlike(f"(^|[^{CODES[FIRST]}{CODES[REST]}]){CODES[REST]}"), by_word(parts)).otherwise(by_run(parts))
    whole = F.element_at(F.transform(F.array(F.regexp_extract_all(sentence, F.lit(PART_RE), 0)), rebuilt), 1)
    return F.when(F.instr(tags, CODES[FIRST]) > 0, whole).otherwise(sentence)


def redact_names(df: DataFrame, model: NameModel, col: str = "text", out: str | None = None, marker: str = "[NAME]", method: str = "auto") -> DataFrame:
    """``df`` with the names that the model finds in ``col`` replaced by ``marker``; every other sign stays.

    Methods give the same rows: ``lookup`` (a model whose words are measured to fit Python workers) tags and rewrites each text
    where it lies; ``join`` meets the model's words by an equi-join. ``auto`` looks up if the words fit.
    """
    if method not in ("auto", "lookup", "join"):
        raise ValueError(f"unknown method {method!r}")
    small = method != "join" and byte_size(model.words) <= LOOKUP_BYTES
    if method == "lookup" and not small:
        raise ValueError("the model has too many words for a lookup in each task")
    if small:
        words = F.transform("_said", sentence_words)
        shapes = F.when(F.octet_length(col) > F.char_length(col), F.transform("_said", lambda s: sentence_words(_signs(s))))
        joined = df.withColumn("_said", sentences(col)).withColumn("_tags", _looked_up(model, words, shapes))
        joined = joined.withColumn("_named", F.instr(F.array_join("_tags", " "), CODES[FIRST]) > 0)
        tag, said = (lambda i: F.get("_tags", i)), F.col("_said")
    else:
        rows = materialize(df.withColumn("_row", F.monotonically_increasing_id()), "rows")
        tags = name_tags(rows.select("_row", F.col(col).alias("_text")).repartition("_row"), model, "_text")
        tags = tags.filter(F.instr("tags", CODES[FIRST]) > 0).groupBy("_row").agg(
            F.map_from_entries(F.collect_list(F.struct("sent", "tags"))).alias("_tags"))
        joined = rows.join(tags, "_row", "left").withColumn("_named", F.col("_tags").isNotNull())
        tag, said = (lambda i: F.try_element_at("_tags", i)), sentences(col)
    told = F.array_join(F.transform(said, lambda s, i: F.coalesce(_without_names(s, tag(i), marker), s)), "")
    text = F.when(F.col("_named"), told).otherwise(F.col(col))
    return joined.withColumn(out or col, text).select(*df.columns, *([out] if out and out not in df.columns else []))
