"""Registered queries: each takes (spark, table_dir) and returns a DataFrame.

Output conventions shared with ``oracle.py`` so both engines hash alike:
integer outputs are BIGINT, doubles are rounded to 6 places, arrays travel
as ``md5(array_join(ids, ','))`` plus their length.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import checked
from tessera.functions.bytes import BYTE_VOCAB, EOS_ID, encoded_length, ids_fingerprint, join_packed, pack_ids
from tessera.functions.text import EOS_TEXT, words
from tessera.operators import agreement, batching, corpus, names, ngrams, packing, redact, scores, sft, subwords, tokens, vectors
from tessera.plans import finetune, pretrain
from tessera.session import materialize, scratch_dir, shared_dir, shuffles_freed, stored_packed
from tessera.sources.tables import balance, load_corpus, load_pairs, read_table, rename_pairs, split_bucket
from tessera.streaming.conversations import redact_conversations
from tessera.streaming.redact_stream import read_text_stream, run_redaction_stream

# Fixed parameters of the registered queries.
PACK_L = 512
SMALL_L = 7
SFT_L = 256
SEGMENT_WORDS = 16
VOCAB_SIZE = 5000
BATCH = 8
ACCUM = 8
STEP_BUDGET = pretrain.PackConfig.steps
EPOCHS = 2
SUBWORD_MERGES = 64
NGRAM_ORDER = 4
NAME_EVERY = 3
PIECE = 64
FREQUENT_TERMS = 30
SEED = 42
TEMPERATURE = 0.8
TOP_K = 50
TOP_P = 0.9
CHAT_TEMPERATURE = 0.7
CHAT_TOP_K = 40
CHAT_SEED = 7
CAP_N = 100
HOLDOUT = 26
LOG_EVERY = 50
MAX_NEW = 100


def _long(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")


def _r6(c) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def _docs(spark, base) -> DataFrame:
    return load_corpus(spark, base)


def _nb(spark, base) -> DataFrame:
    return corpus.drop_blank(_docs(spark, base))


def _windows(spark, base, L=PACK_L) -> DataFrame:
    return pretrain.windows(spark, base, L)


# ---- redaction --------------------------------------------------------------

def q_pii_tag_counts(spark, base):
    docs = redact.redact(_nb(spark, base), "text", out="redacted")
    return redact.pii_report(docs, "text", "redacted")


def q_redact_documents(spark, base):
    return redact.redact(_docs(spark, base)).select("doc_id", "text")


def q_redact_checked(spark, base):
    """R1 with tests of the values: documents, each with numbers from a hash of its id behind it, some of them valid."""
    d = F.translate(F.md5(F.col("doc_id").cast("string")), "abcdef", "012345")
    octets = F.concat_ws(".", *[(F.substring(d, k, 3).cast("int") % 300).cast("string") for k in (1, 4, 7, 10)])
    planted = F.concat(F.col("text"), F.lit(" pay "), F.substring(d, 1, 16), F.lit(", "), F.substring(d, 17, 3), F.lit("-"),
                       F.substring(d, 20, 2), F.lit("-"), F.substring(d, 22, 4), F.lit(" from "), octets, F.lit(". password: "), F.substring(d, 26, 7))
    return checked.redact_checked(_nb(spark, base).select("doc_id", planted.alias("text")))


def q_scrub_documents(spark, base):
    return redact.scrub(_docs(spark, base)).select("doc_id", "status", "scrubbed")


def q_scrub_hook(spark, base):
    out = redact.redact_with(_docs(spark, base))
    return redact.extract_redacted(out, "output", "scrubbed").select("doc_id", "scrubbed")


def q_scrub_hook_chunked(spark, base):
    out = redact.redact_with(_docs(spark, base), chunk_words=SEGMENT_WORDS)
    return redact.extract_redacted(out, "output", "scrubbed").select("doc_id", "scrubbed")


def q_redact_stream(spark, base):
    sink = shared_dir(spark, "redacted-stream")
    return run_redaction_stream(spark, f"{base.rstrip('/')}/documents*.parquet",
                                "doc_id bigint, text string, lang string, source string, n_chars bigint",
                                sink, sink + "-checkpoint")


def q_conversation_stream(spark, base):
    """S5, R3 across messages: numbers that begin in one message and end in the next, as a stream.

    Each message is extended by the first half of a number and, after the first one, begins with the second half of the
    last; a NULL message ends each conversation. The pieces of a conversation are joined again.
    """
    conv = read_table(spark, base, "conversations", ["conv_id", "turn", "text"])
    said = conv.select("conv_id", "turn", F.concat(
        F.when(F.col("turn") > 0, F.concat(F.lit("555-"), F.lpad((F.col("conv_id") % 10_000).cast("string"), 4, "0"), F.lit(" "))).otherwise(""),
        F.coalesce("text", F.lit("")), F.lit(" call +1 ("), (F.col("turn") + 200).cast("string"), F.lit(")")).alias("text"))
    end = conv.groupBy("conv_id").agg((F.max("turn") + 1).alias("turn")).withColumn("text", F.lit(None).cast("string"))
    source, sink = scratch_dir(spark, "messages"), scratch_dir(spark, "pieces")
    said.union(end).repartitionByRange(4, "turn").sortWithinPartitions("turn").write.parquet(source)
    stream = read_text_stream(spark, source, "conv_id long, turn long, text string")
    q = (redact_conversations(stream).writeStream.format("parquet").outputMode("append").option("path", sink)
         .option("checkpointLocation", f"{sink}-state").trigger(availableNow=True).start())
    q.awaitTermination()
    pieces = spark.read.schema("conv_id long, piece long, text string").parquet(sink)
    whole = pieces.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("piece", "text"))).alias("p"))
    return whole.select("conv_id", F.array_join(F.transform("p", lambda x: x["text"]), "").alias("text"))


def _frequent(texts: DataFrame, pattern: str, tag: str) -> DataFrame:
    """The most frequent matches of a pattern, as dictionary terms."""
    found = texts.select(F.explode(F.regexp_extract_all("text", F.lit(pattern), 0)).alias("term"))
    top = found.groupBy("term").count().orderBy(F.desc("count"), "term").limit(FREQUENT_TERMS)
    return top.select("term", F.lit(tag).alias("tag"))


def _terms(spark, base) -> DataFrame:
    """Terms to redact: customer and nation names, and frequent words and two-word phrases of the corpus."""
    docs = _nb(spark, base)
    names = read_table(spark, base, "customer", ["c_name"]).select(F.col("c_name").alias("term"),
                                                                   F.lit("NAME").alias("tag"))
    places = read_table(spark, base, "nation", ["n_name"]).select(F.col("n_name").alias("term"),
                                                                  F.lit("PLACE").alias("tag"))
    own = _frequent(docs, "[A-Za-z]{6,}", "WORD").union(_frequent(docs, "[A-Za-z]{3,} [A-Za-z]{3,}", "PHRASE"))
    return materialize(names.unionByName(places).unionByName(own), "terms")


def q_redact_terms(spark, base):
    return redact.redact_terms(_docs(spark, base), _terms(spark, base)).select("doc_id", "text")


def q_redact_terms_join(spark, base):
    return redact.redact_terms(_docs(spark, base), _terms(spark, base), method="join").select("doc_id", "text")


def _named_segments(spark, base) -> DataFrame:
    """Segments of the documents; every ``NAME_EVERY``-th has a customer's name behind a cue word. ``name`` is NULL for the others.

    Names are spelled from the customer's key, so that they are words which no text has by itself.
    """
    seg = redact.segment(_nb(spark, base), SEGMENT_WORDS)
    people = read_table(spark, base, "customer", ["c_custkey"])
    n = people.count()
    letters = ("0123456789abcdef", "aeioubdklmnrstvz")

    def spelled(part: str, size: int) -> Column:
        return F.initcap(F.translate(F.substring(F.md5(F.concat(F.lit(part), F.col("c_custkey").cast("string"))), 1, size), *letters))
    people = people.select(F.col("c_custkey").alias("_key"), F.concat(spelled("g", 5), F.lit(" "), spelled("f", 7)).alias("name"))
    own = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("seg_idx").cast("string"))), 1, 8), 16, 10).cast("long")
    cue = F.element_at(F.array(*[F.lit(c) for c in ("from", "by", "Dear", "Mr")]), (F.floor(own / 1009) % 4 + 1).cast("int"))  # apart from the key's parity
    seg = seg.withColumn("_key", F.when(own % NAME_EVERY == 0, F.floor(own / NAME_EVERY) % max(n, 1))).withColumn("_cue", cue)
    w = F.split("segment", " ")
    rows = seg.join(people, "_key", "left").withColumn("_w", w)
    text = F.concat_ws(" ", F.array_join(F.slice("_w", 1, 8), " "), "_cue", "name", F.array_join(F.slice("_w", 9, SEGMENT_WORDS), " "))
    return rows.select("doc_id", "seg_idx", "_key", "name", F.when(F.col("name").isNull(), F.col("segment")).otherwise(text).alias("text"))


def q_redact_names(spark, base):
    """Names found by a tagger that learnt from those of every other customer."""
    rows = materialize(_named_segments(spark, base), "named-segments")
    known = rows.filter("_key % 2 = 0").select("name").distinct()
    model = names.learn_names(rows, known)
    out = names.redact_names(rows, model, out="redacted")
    return out.select("doc_id", _long("seg_idx").alias("seg_idx"), (F.col("_key") % 2 == 0).alias("known"), "name", "redacted")


def q_weak_pairs(spark, base):
    return finetune.document_pairs(spark, base, SEGMENT_WORDS).select(
        "doc_id", _long("seg_idx").alias("seg_idx"), "original_text", "redacted_text")


def q_segment_agreement(spark, base):
    pairs = finetune.document_pairs(spark, base, SEGMENT_WORDS)
    pred = redact.rejoin(pairs, "doc_id", "redacted_text", "pred")
    whole = _nb(spark, base).select("doc_id", F.array_join(words("text"), " ").alias("t"))
    target = redact.redact(whole, "t", out="target").select("doc_id", "target")
    agree = redact.pair_agreement(pred.join(target, "doc_id"), "pred", "target")
    return agree.select(_long("pairs").alias("pairs"), _long("matches").alias("matches"), _r6("rate").alias("rate"))


def q_span_agreement(spark, base):
    """R9 by spans: what the rules find against what the checked rules find, segment by segment."""
    seg = redact.segment(_nb(spark, base), SEGMENT_WORDS)
    both = checked.redact_checked(redact.redact(seg, "segment", out="pred"), "segment", "target")
    out = agreement.span_agreement(both, "segment", "pred", "target")
    return out.select("tag", *[_long(c).alias(c) for c in ("predicted", "given", "matched")], _r6("precision").alias("precision"), _r6("recall").alias("recall"))


def q_conversation_pairs(spark, base):
    return finetune.conversation_pairs(spark, base).select("conv_id", "turn", "original_text", "redacted_text")


def q_pair_load(spark, base):
    """S2 + P2: a table of (source_text, target_text) pairs loaded and renamed, both ways."""
    table = materialize(finetune.conversation_pairs(spark, base).select(
        F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"),
        F.col("original_text").alias("source_text"), F.col("redacted_text").alias("target_text")), "pair-table")
    loaded = load_pairs(table, id_col="id")
    renamed = rename_pairs(table).select(F.col("id").alias("pair_id"), F.md5("original_text").alias("renamed_md5"))
    return loaded.join(renamed, "pair_id")


# ---- tokens -----------------------------------------------------------------

def _edge_docs(spark, base) -> DataFrame:
    """Documents where some texts carry the end literal, are blank, or are NULL, by their id."""
    k = F.col("doc_id")
    text = (F.when(k % 11 == 0, F.lit(" \t\n\x1c")).when(k % 13 == 0, F.lit(None).cast("string"))
            .when(k % 7 == 0, F.concat(F.lit(EOS_TEXT), F.substring("text", 1, 40), F.lit(EOS_TEXT), F.col("text")))
            .otherwise(F.col("text")))
    return _docs(spark, base).withColumn("text", text)


def q_edge_rows(spark, base):
    """P5 and T5 on rows that exercise them: blank and NULL texts, texts with the end literal."""
    d = corpus.scrub_status(_edge_docs(spark, base))
    d = tokens.count_special(tokens.encode_bytes(d))
    return d.select("doc_id", F.coalesce("status", F.lit("blank")).alias("status"), _long("n_special").alias("n_special"),
                    ids_fingerprint("ids").alias("ids_md5"))


def q_encode_bytes(spark, base):
    d = tokens.count_special(tokens.encode_bytes(_nb(spark, base)))
    return d.select("doc_id", _long(F.size("ids")).alias("n_tokens"), _long("n_special").alias("n_special"),
                    ids_fingerprint("ids").alias("ids_md5"))


def q_decode_roundtrip(spark, base):
    d = tokens.decode_bytes(tokens.encode_bytes(_nb(spark, base)), "ids", "decoded")
    return d.select("doc_id", F.col("decoded").alias("text"))


def q_token_stats(spark, base):
    d = corpus.drop_blank(balance(read_table(spark, base, "documents", ["doc_id", "text", "lang"]), "doc_id"))
    return tokens.token_stats(d, by=["lang"], n=encoded_length("text"))


def _vocab(spark, base):
    """The capped vocabulary, built once (it is measured, looked up and joined)."""
    return materialize(tokens.build_vocab(_nb(spark, base), VOCAB_SIZE), "vocabulary")


def q_vocab_summary(spark, base):
    """End id and size in byte mode and in word mode."""
    vocab = _vocab(spark, base)
    return vocab.agg(F.count(F.lit(1)).alias("word_size")).select(
        F.lit(tokens.eos_id()).cast("long").alias("byte_eos"), F.lit(tokens.vocab_size()).cast("long").alias("byte_size"),
        F.lit(tokens.eos_id(vocab)).cast("long").alias("word_eos"), "word_size")


def q_build_vocab(spark, base):
    return _vocab(spark, base).select("token", _long("id").alias("id"), _long("freq").alias("freq"))


def _encoded(spark, base, vocab, method):
    return tokens.encode_vocab(_nb(spark, base), vocab, method=method)


def _encode_vocab_out(enc: DataFrame) -> DataFrame:
    return enc.select("doc_id", _long(F.size("ids")).alias("n_tokens"),
                      _long(F.size(F.filter("ids", lambda x: x == tokens.UNK_ID))).alias("n_unk"),
                      ids_fingerprint("ids").alias("ids_md5"))


def q_encode_vocab(spark, base):
    return _encode_vocab_out(_encoded(spark, base, _vocab(spark, base), "auto"))


def q_encode_vocab_join(spark, base):
    return _encode_vocab_out(_encoded(spark, base, _vocab(spark, base), "join"))


def q_decode_vocab(spark, base):
    vocab = _vocab(spark, base)
    return tokens.decode_vocab(_encoded(spark, base, vocab, "auto"), vocab).select("doc_id", "text")


def q_decode_vocab_join(spark, base):
    vocab = _vocab(spark, base)
    return tokens.decode_vocab(_encoded(spark, base, vocab, "auto"), vocab, method="join").select("doc_id", "text")


def _merges(spark, base, n: int) -> DataFrame:
    return subwords.learn_merges(_nb(spark, base), n)


def q_subword_vocab(spark, base):
    """Byte-pair merges of the corpus in the order in which they were learnt."""
    return _merges(spark, base, SUBWORD_MERGES).select(
        *[_long(c).alias(c) for c in ("rank", "lo", "hi", "id")], F.lower(F.hex("piece")).alias("piece"))


def q_subword_roundtrip(spark, base):
    """T1, T2 with learned subwords: every text encoded and decoded."""
    merges = _merges(spark, base, SUBWORD_MERGES)
    enc = materialize(subwords.encode_subwords(_docs(spark, base), merges), "subword-ids")
    return subwords.decode_subwords(enc, merges)


# ---- packing ----------------------------------------------------------------

def q_doc_offsets(spark, base):
    ids = pretrain.corpus_ids(spark, base)
    return packing.doc_offsets(ids, n_ids="n_ids").select("doc_id", _long("n").alias("n"), _long("start").alias("start"))


def _window_out(w: DataFrame) -> DataFrame:
    return w.select(_long("window_id").alias("window_id"), ids_fingerprint("input").alias("input_md5"),
                    ids_fingerprint("target").alias("target_md5"), _long(F.size("input")).alias("n"))


def q_pack_windows(spark, base):
    return _window_out(_windows(spark, base, PACK_L))


def q_pack_benchmark(spark, base):
    docs = corpus.drop_blank(load_corpus(spark, base, table="benchmark", id_col="item_id"))
    return _window_out(packing.pack(tokens.encode_bytes(docs).select("doc_id", "ids"), SMALL_L))


def q_corpus_summary(spark, base):
    return packing.corpus_summary(pretrain.corpus_ids(spark, base), PACK_L, n_ids="n_ids")


def q_corpus_split(spark, base):
    d = _nb(spark, base).withColumn(
        "split", F.when(split_bucket("doc_id") < 256 - HOLDOUT, "train").otherwise("holdout"))
    return d.groupBy("split").agg(F.count(F.lit(1)).alias("docs"))


def q_cap_corpus(spark, base):
    d = corpus.cap(corpus.drop_blank(read_table(spark, base, "documents", ["doc_id", "text", "n_chars"])), CAP_N)
    return d.select("doc_id", "n_chars")


# ---- batching ---------------------------------------------------------------

def _summary(spark, base) -> DataFrame:
    return packing.corpus_summary(pretrain.corpus_ids(spark, base), PACK_L, n_ids="n_ids")


def _schedule(spark, base, epochs: int = EPOCHS):
    """The full schedule: every window of every epoch (but for the short last batch)."""
    ids = packing.window_ids(_summary(spark, base))
    return batching.update_groups(batching.batches(batching.shuffle(ids, SEED, epochs), BATCH, drop_last=True), ACCUM)


def _schedule_out(s: DataFrame, key: str = "window_id") -> DataFrame:
    return s.select(_long("epoch").alias("epoch"), key, _long("rank").alias("rank"),
                    "batch_idx", _long("slot").alias("slot"), "update_id")


def q_shuffle_batches(spark, base):
    return _schedule_out(_schedule(spark, base))


def q_step_budget(spark, base):
    """The part of the schedule that the job's budget of updates reaches, in as many epochs as it takes."""
    epochs = batching.epochs_needed(_summary(spark, base).first()["windows"], BATCH, ACCUM, STEP_BUDGET)
    return _schedule_out(batching.limit_steps(_schedule(spark, base, epochs), STEP_BUDGET))


def q_permuted_batches(spark, base):
    """B2-B4 without a sort: the schedule from a keyed permutation of the window ids."""
    summary = materialize(_summary(spark, base), "summary")
    ids = packing.window_ids(summary)
    s = batching.permuted_schedule(ids, max(1, summary.first()["windows"]), SEED, EPOCHS)
    return _schedule_out(batching.update_groups(batching.batches(s, BATCH, drop_last=True), ACCUM))


def q_shuffle_batches_keep_last(spark, base):
    """B3 with the short last batch kept: fine-tuning pairs, one update per batch."""
    ids = finetune.document_pairs(spark, base, SEGMENT_WORDS).select(
        F.concat_ws(":", F.col("doc_id").cast("string"), F.col("seg_idx").cast("string")).alias("example_id"))
    s = batching.batches(batching.shuffle(ids, SEED, EPOCHS, id_col="example_id"), BATCH, drop_last=False)
    return _schedule_out(batching.update_groups(s, 1), "example_id")


def q_collate_batches(spark, base):
    """Whole batches of the schedule with their token windows, epoch by epoch."""
    # a window lies and travels as its L + 1 ids, a byte each, from which input and target are cut again;
    # an epoch's exchanges are gone before those of the next one
    with shuffles_freed(spark):
        windows = pretrain.windows(spark, base, PACK_L, whole=True).select("window_id", stored_packed("ids"))
        win = materialize(windows, "windows").select("window_id", pack_ids("ids").alias("ids"))
        s = _schedule(spark, base).select("epoch", "batch_idx", "slot", "window_id")

        def collated(epoch: int) -> DataFrame:
            c = batching.collate(s.filter(F.col("epoch") == epoch).join(win, "window_id"), ("window_id", "ids"))
            c = c.withColumn("input", join_packed("ids", without="last")).withColumn("target", join_packed("ids", without="first"))
            return c.select(_long("epoch").alias("epoch"), "batch_idx", _long(F.size("window_id")).alias("n"),
                            ids_fingerprint("window_id").alias("ids_md5"), ids_fingerprint("input").alias("input_md5"),
                            ids_fingerprint("target").alias("target_md5"))
        done = [materialize(collated(e), f"batches-{e}") for e in range(EPOCHS)]
    return reduce(DataFrame.unionByName, done)


def q_batch_rows(spark, base):
    """Windows and schedule as versioned tables, joined bucket by bucket."""
    cfg = pretrain.PackConfig(L=PACK_L, batch_size=BATCH, accum=ACCUM, seed=SEED)
    sched, win = pretrain.prepare_tables(spark, base, scratch_dir(spark, "prepared"), "v1", cfg, EPOCHS, buckets=8)  # or more, by size
    rows = pretrain.batch_rows(sched, win)
    return rows.select(_long("epoch").alias("epoch"), "batch_idx", _long("slot").alias("slot"), "update_id", "window_id",
                       ids_fingerprint("input").alias("input_md5"), ids_fingerprint("target").alias("target_md5"))


def q_last_tokens(spark, base):
    d = batching.last_tokens(pretrain.corpus_ids(spark, base), PACK_L, out="tail")
    return d.select("doc_id", _long(F.size("tail")).alias("n"), ids_fingerprint("tail").alias("ids_md5"))


def q_cut_generated(spark, base):
    full = sft.sft_ids(finetune.document_pairs(spark, base, SEGMENT_WORDS))
    cut = batching.cut_at(full, EOS_ID, MAX_NEW, ids="full", prompt_len="prompt_len", out="cut")
    return cut.select("doc_id", _long("seg_idx").alias("seg_idx"), _long(F.size("cut")).alias("n"),
                      ids_fingerprint("cut").alias("ids_md5"))


# ---- supervised examples ----------------------------------------------------

def _sft_out(e: DataFrame) -> DataFrame:
    return e.select("doc_id", _long("seg_idx").alias("seg_idx"), _long("prompt_len").alias("prompt_len"),
                    _long("full_len").alias("full_len"), "overflow",
                    ids_fingerprint("input").alias("input_md5"), ids_fingerprint("target").alias("target_md5"),
                    _long(F.size("input")).alias("input_len"), _long(sft.scored_tokens()).alias("scored"))


def q_sft_examples(spark, base):
    return _sft_out(finetune.examples(spark, base, SFT_L, "uniform"))


def q_sft_examples_reference(spark, base):
    return _sft_out(finetune.examples(spark, base, SFT_L, "reference"))


def q_conversation_examples(spark, base):
    """S2/P2 pairs (user turn -> next assistant turn) through F1-F6 (long texts: overflow, all-masked)."""
    ex = sft.sft_examples(finetune.conversation_pairs(spark, base), SFT_L, "uniform")
    return ex.select("conv_id", "turn", _long("prompt_len").alias("prompt_len"), _long("full_len").alias("full_len"),
                     "overflow", ids_fingerprint("input").alias("input_md5"),
                     ids_fingerprint("target").alias("target_md5"), _long(sft.scored_tokens()).alias("scored"))


def q_sft_audit(spark, base):
    return sft.sft_audit(finetune.examples(spark, base, SFT_L, "uniform"))


# ---- score tables -----------------------------------------------------------

def _byte_counts(spark, base):
    """(input, target) pair counts of the L=512 windows, counted from the stream."""
    return pretrain.window_bigrams(spark, base, PACK_L)


def q_byte_bigrams(spark, base):
    return _byte_counts(spark, base).select(_long("prev").alias("prev"), _long("next").alias("next"), "count")


def _word_candidates(spark, base):
    """Next-word scores over the capped vocabulary, so a group has at most its size."""
    enc = tokens.encode_vocab(_nb(spark, base), _vocab(spark, base))
    return scores.candidates(scores.bigrams(enc, ids="ids"))


def _filtered(cands: DataFrame, temperature: float, k: int, p: float | None) -> DataFrame:
    c = scores.with_temperature(cands, temperature)
    c = scores.top_k(c, ["prev"], k)
    if p is not None:
        c = scores.top_p(c, ["prev"], p)
    return scores.softmax(c, ["prev"])


def q_next_token_probs(spark, base):
    f = _filtered(_word_candidates(spark, base), TEMPERATURE, TOP_K, TOP_P)
    return f.select(_long("prev").alias("prev"), _long("item").alias("item"), _r6("prob").alias("prob"))


def q_next_token_nucleus(spark, base):
    """E1, E4 on untrimmed groups: the nucleus by threshold search, softmax by aggregates."""
    c = scores.top_p(scores.with_temperature(_word_candidates(spark, base), TEMPERATURE), ["prev"], TOP_P, method="threshold")
    f = scores.softmax(c, ["prev"], method="aggregate")
    return f.select(_long("prev").alias("prev"), _long("item").alias("item"), _r6("prob").alias("prob"))


def q_ngram_loss(spark, base):
    """Held-out loss of a Kneser-Ney model of the training split."""
    train, test = (pretrain.corpus_ids(spark, base, split=s).select("doc_id", "ids") for s in ("train", "holdout"))
    loss = ngrams.cross_entropy(test, ngrams.learn(train, NGRAM_ORDER, BYTE_VOCAB), ["doc_id"], BYTE_VOCAB)
    return loss.select("doc_id", "tokens", _r6("nll").alias("nll"))


def q_next_token_sample(spark, base):
    f = _filtered(_word_candidates(spark, base), TEMPERATURE, TOP_K, TOP_P)
    return scores.draw_one(f, ["prev"], SEED).select(_long("prev").alias("prev"), _long("drawn").alias("drawn"))


def _window_loss(spark, base):
    # the count table (<= 257*257 rows) is written once
    counts = materialize(_byte_counts(spark, base), "byte-counts")
    return scores.cross_entropy(_windows(spark, base), counts, ["window_id"], BYTE_VOCAB, 1.0, prev="input",
                                nxt="target", rows_bound=BYTE_VOCAB * BYTE_VOCAB)


def q_window_loss(spark, base):
    return _window_loss(spark, base).select("window_id", _long("tokens").alias("tokens"), _r6("nll").alias("nll"))


def q_corpus_loss(spark, base):
    """E7 over the corpus: token-weighted mean cross-entropy and perplexity."""
    p = scores.perplexity(_window_loss(spark, base))
    return p.select("tokens", _r6("nll").alias("nll"), F.round("perplexity", 4).alias("perplexity"))


def q_sft_loss(spark, base):
    counts = materialize(_byte_counts(spark, base), "byte-counts")
    ex = finetune.examples(spark, base, SFT_L, "uniform")
    # token-weighted over all scored targets of a group
    loss = scores.masked_cross_entropy(ex, counts, ["overflow"], BYTE_VOCAB, 1.0, rows_bound=BYTE_VOCAB * BYTE_VOCAB)
    return loss.select("overflow", _long("tokens").alias("tokens"), _r6("nll").alias("nll"))


def q_event_log_sample(spark, base):
    ev = read_table(spark, base, "events", ["event_id", "event_type", "value"])
    s = corpus.sample_every(ev, LOG_EVERY, "event_id", by=["event_type"])
    return s.select("event_type", "event_id", _long("step").alias("step"), "value")


def q_event_log_sample_zero(spark, base):
    """P6 as the fine-tuning log counts: from 0, every n-th step of each type."""
    ev = read_table(spark, base, "events", ["event_id", "event_type", "value"])
    s = corpus.sample_every(ev, LOG_EVERY, "event_id", by=["event_type"], one_based=False)
    return s.select("event_type", "event_id", _long("step").alias("step"), "value")


# ---- vectors ----------------------------------------------------------------

def _whole(c) -> Column:
    """Fingerprint of a whole vector: its values in ten-thousandths, as integers."""
    return F.md5(_numbers(c))


def _numbers(c) -> Column:
    """The values of a vector in ten-thousandths, as one text."""
    return F.array_join(F.transform(c, lambda x: F.round(x * 10_000).cast("long")), ",")


def _unit_vectors(spark, base):
    return vectors.rms_normalize(read_table(spark, base, "embeddings", ["vec_id", "embedding", "label"]))


def q_rms_vectors(spark, base):
    v = _unit_vectors(spark, base)
    return v.select("vec_id", F.col("label").cast("long").alias("label"),
                    _r6(F.col("embedding")[0]).alias("first"),
                    _r6(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + F.abs(x))).alias("abs_sum"),
                    _whole("embedding").alias("vector_md5"))


def q_doc_vectors(spark, base):
    conv = balance(read_table(spark, base, "conversations", ["conv_id", "turn", "text"]), "conv_id")
    ids = tokens.encode_bytes(conv)
    pooled = vectors.pooled_vectors(ids, ["conv_id", "turn"], _unit_vectors(spark, base))
    return pooled.select("conv_id", "turn", _long("tokens").alias("tokens"), _long("missing").alias("missing"),
                         _r6(F.col("pooled")[0]).alias("first"),
                         _r6(F.aggregate("pooled", F.lit(0.0), lambda a, x: a + x)).alias("total"),
                         _whole("pooled").alias("pooled_md5"))


def q_gather_vectors(spark, base):
    b = tokens.encode_bytes(load_corpus(spark, base, table="benchmark", id_col="item_id"))
    g = vectors.lookup_vectors(b, ["doc_id"], _unit_vectors(spark, base))
    return g.select(F.col("doc_id").alias("item_id"), _long(F.size("vectors")).alias("n"),
                    _r6(F.try_element_at(F.try_element_at("vectors", F.lit(1)), F.lit(1))).alias("first"),
                    _r6(F.try_element_at(F.try_element_at("vectors", F.lit(-1)), F.lit(1))).alias("last"),
                    _whole(F.flatten("vectors")).alias("vectors_md5"))


def q_gather_pieces(spark, base):
    """J2 in pieces of a fixed number of vectors: the bytes of the conversations."""
    conv = balance(read_table(spark, base, "conversations", ["conv_id", "turn", "text"]), "conv_id")
    # each vector is gathered with its numbers as a text, made once a vector and not once an occurrence
    unit = _unit_vectors(spark, base).select("vec_id", F.struct("embedding", F.nullif(_numbers("embedding"), F.lit("")).alias("numbers")).alias("embedding"))
    g = vectors.lookup_vector_pieces(tokens.encode_bytes(conv), ["conv_id", "turn"], unit, PIECE)
    whole = F.forall("vectors", lambda v: v["embedding"].isNotNull())
    return g.select("conv_id", "turn", "piece", _long(F.size("vectors")).alias("n"),
                    F.when(whole, F.md5(F.array_join(F.transform("vectors", lambda v: v["numbers"]), ","))).alias("vectors_md5"))


def q_append_drawn(spark, base):
    cands = scores.candidates(_byte_counts(spark, base))
    table = materialize(scores.cumulative_table(_filtered(cands, CHAT_TEMPERATURE, CHAT_TOP_K, None), ["prev"]), "draws")
    out = vectors.append_drawn(pretrain.corpus_ids(spark, base), table, ["doc_id"], CHAT_SEED)
    return out.select("doc_id", _long(F.size("ids")).alias("n"),
                      _long(F.try_element_at("ids", F.lit(-1))).alias("last"), ids_fingerprint("ids").alias("ids_md5"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "pii_tag_counts": q_pii_tag_counts,
    "redact_documents": q_redact_documents,
    "redact_checked": q_redact_checked,
    "scrub_documents": q_scrub_documents,
    "scrub_hook": q_scrub_hook,
    "scrub_hook_chunked": q_scrub_hook_chunked,
    "redact_stream": q_redact_stream,
    "conversation_stream": q_conversation_stream,
    "redact_terms": q_redact_terms,
    "redact_terms_join": q_redact_terms_join,
    "redact_names": q_redact_names,
    "weak_pairs": q_weak_pairs,
    "segment_agreement": q_segment_agreement,
    "span_agreement": q_span_agreement,
    "conversation_pairs": q_conversation_pairs,
    "pair_load": q_pair_load,
    "edge_rows": q_edge_rows,
    "encode_bytes": q_encode_bytes,
    "decode_roundtrip": q_decode_roundtrip,
    "token_stats": q_token_stats,
    "build_vocab": q_build_vocab,
    "vocab_summary": q_vocab_summary,
    "encode_vocab": q_encode_vocab,
    "encode_vocab_join": q_encode_vocab_join,
    "decode_vocab": q_decode_vocab,
    "decode_vocab_join": q_decode_vocab_join,
    "subword_vocab": q_subword_vocab,
    "subword_roundtrip": q_subword_roundtrip,
    "doc_offsets": q_doc_offsets,
    "pack_windows": q_pack_windows,
    "pack_benchmark": q_pack_benchmark,
    "corpus_summary": q_corpus_summary,
    "corpus_split": q_corpus_split,
    "cap_corpus": q_cap_corpus,
    "shuffle_batches": q_shuffle_batches,
    "shuffle_batches_keep_last": q_shuffle_batches_keep_last,
    "step_budget": q_step_budget,
    "permuted_batches": q_permuted_batches,
    "collate_batches": q_collate_batches,
    "batch_rows": q_batch_rows,
    "last_tokens": q_last_tokens,
    "cut_generated": q_cut_generated,
    "sft_examples": q_sft_examples,
    "sft_examples_reference": q_sft_examples_reference,
    "sft_audit": q_sft_audit,
    "conversation_examples": q_conversation_examples,
    "byte_bigrams": q_byte_bigrams,
    "next_token_probs": q_next_token_probs,
    "next_token_nucleus": q_next_token_nucleus,
    "next_token_sample": q_next_token_sample,
    "ngram_loss": q_ngram_loss,
    "window_loss": q_window_loss,
    "sft_loss": q_sft_loss,
    "corpus_loss": q_corpus_loss,
    "event_log_sample": q_event_log_sample,
    "event_log_sample_zero": q_event_log_sample_zero,
    "rms_vectors": q_rms_vectors,
    "doc_vectors": q_doc_vectors,
    "gather_vectors": q_gather_vectors,
    "gather_pieces": q_gather_pieces,
    "append_drawn": q_append_drawn,
}
