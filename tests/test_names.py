"""The name tagger: sentences, weak tags, Viterbi against all tag sequences, planted names."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.operators import names

TEXTS = ["Dear Ann Lee, see Bob. No one else\nAnn", "", None, "... 12!", "mail from Ann  Lee Kim and Bob today; from Bob", "é Ann-Lee x"]
NAMES = ["Ann Lee", "Bob", "Lee  Kim", "Ann", "one two three four five", "...", None]


def plain_sentences(text):
    """Runs of words up to a terminator; a match takes all signs that follow."""
    return re.findall(r"(?:[^\W_]+(?:[^\w.!?\n]|_)*){1,200}(?:\W|_)*|(?:\W|_)+", text or "")


def plain_tags(words, known):
    hits = [(i, i + n) for n in {len(k) for k in known} for i in range(len(words) - n + 1) if tuple(words[i:i + n]) in known]
    out = []
    for i in range(len(words)):
        at = min((a for a, b in hits if a <= i < b), default=None)
        out.append(names.OUT if at is None else names.FIRST if at == i else names.REST)
    return [names.CUE if t == names.OUT and out[i + 1:i + 2] == [names.FIRST] else t for i, t in enumerate(out)]


def frames(spark):
    docs = spark.createDataFrame([(k % 4, t, 1) for k, t in enumerate(TEXTS)], "doc_id long, text string, sent int")
    return docs, spark.createDataFrame([(n,) for n in NAMES], "name string")


def test_sentences_cover_the_text(spark):
    rows = [(t,) for t in TEXTS + ["word " * 450, "a_b. c", "\n\n x", "no end"]]
    df = spark.createDataFrame(rows, "text string").select("text", names.sentences("text").alias("s"))
    for r in df.collect():
        assert r.s is None and r.text is None or "".join(r.s) == r.text and r.s == plain_sentences(r.text)


def test_weak_tags_match_plain_rules(spark):
    docs, table = frames(spark)
    got = names.tagged_words(docs, table).collect()
    held = {}
    for r in got:
        held.setdefault((r._row, r.sent), []).append((r.pos, r.word, r.tag, r.next))
    known = {("Ann", "Lee"), ("Bob",), ("Lee", "Kim"), ("Ann",)}
    want = []
    for t in TEXTS:
        for s in plain_sentences(t):
            ws = re.findall(r"[^\W_]+", s)
            tags = plain_tags(ws, known)
            if ws:
                want.append([(i, w, t_, (tags + [None])[i + 1]) for i, (w, t_) in enumerate(zip(ws, tags, strict=True))])
    assert sorted(sorted(v) for v in held.values()) == sorted(want)


@pytest.mark.parametrize("seed", [1, 2])
def test_viterbi_finds_the_best_tags(spark, seed):
    rng = random.Random(seed)
    start = [rng.randrange(-9, 1) for _ in range(4)]
    moves = [[rng.randrange(-5, 1) for _ in range(4)] for _ in range(4)]
    rows = [(k, [[rng.randrange(-4, 1) for _ in range(4)] for _ in range(1 + k % 6)]) for k in range(40)]  # many equal scores
    df = spark.createDataFrame(rows, "k int, e array<array<long>>").select("k", names.viterbi(F.col("e"), start, moves).alias("tags"))
    got = {r.k: r.tags for r in df.collect()}
    for k, e in rows:
        def score(tags, e=e):
            return start[tags[0]] + sum(e[i][t] for i, t in enumerate(tags)) + sum(moves[a][b] for a, b in itertools.pairwise(tags))
        best = max(score(t) for t in itertools.product(range(4), repeat=len(e)))
        assert score([names.CODES.index(c) for c in got[k]]) == best
        # ties: the fold keeps the larger tags among equal scores at each state
        paths = [(start[t] + e[0][t], names.CODES[t]) for t in range(4)]
        for x in e[1:]:
            paths = [(b[0] + x[t], b[1] + names.CODES[t]) for t in range(4) for b in [max((s + moves[p][t], h) for p, (s, h) in enumerate(paths))]]
        assert got[k] == max(paths)[1]


def planted(seed, n, known_share):
    """Sentences with names after cue words; only a share of the names is in the dictionary."""
    rng = random.Random(seed)
    syllables = ["ba", "ko", "ri", "ten", "mu", "sal", "vi", "dor", "el", "an"]
    people = list({f"{''.join(rng.choices(syllables, k=2)).title()} {''.join(rng.choices(syllables, k=3)).title()}" for _ in range(300)})
    known = people[:int(len(people) * known_share)]
    plain = ["the report was sent", "we met in town", "please keep the letter", "it was late and cold", "nothing more was said"]
    heads = ["The", "We", "Please", "Nothing", "Then"]
    rows, truth = [], []
    for k in range(n):
        name = rng.choice(people)
        head, tail = rng.choice(plain), rng.choice(plain)
        if k % 3:
            cue = rng.choice(["from", "Mr", "dear", "by"])
            rows.append((k, f"{rng.choice(heads)} {head} {cue} {name} and {tail}. {rng.choice(heads)} {tail}."))
            truth.append((k, name, name in known))
        else:
            rows.append((k, f"{rng.choice(heads)} {head}. {rng.choice(heads)} {tail}."))
            truth.append((k, None, None))
    return rows, truth, known


def test_planted_names_are_found_by_context_and_shape(spark):
    rows, _, known = planted(1, 900, 0.5)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = names.learn_names(df, spark.createDataFrame([(k,) for k in known], "name string"))
    fresh, truth, _ = planted(2, 600, 0.0)  # other people, none of them in the dictionary
    got = {r.doc_id: r.text for r in names.redact_names(spark.createDataFrame(fresh, "doc_id long, text string"), model).collect()}
    texts = dict(fresh)
    whole = sum(got[k] == texts[k].replace(n, "[NAME]") for k, n, _ in truth if n)
    clean = sum(got[k] == texts[k] for k, n, _ in truth if not n)
    assert whole >= 0.95 * sum(n is not None for _, n, _ in truth)
    assert clean >= 0.98 * sum(n is None for _, n, _ in truth)


def test_texts_without_names_and_odd_rows_stay(spark):
    docs, table = frames(spark)
    model = names.learn_names(docs, table, frequent=2)
    out = names.redact_names(docs.union(docs.limit(2)), model)
    assert out.columns == docs.columns and out.count() == len(TEXTS) + 2
    for r in out.collect():
        assert r.text is None or "[NAME]" in r.text or r.text in TEXTS
    assert names.redact_names(docs.limit(0), model).count() == 0
    untaught = names.learn_names(docs, table.limit(0))
    assert names.redact_names(docs, untaught, out="named").filter("named <=> text").count() == len(TEXTS)
    nothing = names.learn_names(docs.limit(0), table)
    assert names.redact_names(docs, nothing).filter("text like '%[NAME]%'").count() == 0


def test_runs_become_one_marker(spark):
    df = spark.createDataFrame([("Dear  Ann - Lee, and Bob!", "CFRCF"), ("Bob", "F"), ("x y", "OO")], "s string, tags string")
    got = [r[0] for r in df.select(names._without_names(F.col("s"), F.col("tags"), "[NAME]")).collect()]
    assert got == ["Dear  [NAME], and [NAME]!", "[NAME]", "x y"]


def test_lookup_and_join_find_the_same_names_and_lookup_needs_no_exchange(spark):
    rows, _, known = planted(3, 300, 0.5)
    rows += [(-k, t) for k, t in enumerate(TEXTS + ["Über from Émile Zola. " * 3, "so " * 450 + "from Ann Lee", "  ... from Ann Lee", "ΑΒΓ from Ann Lee"], 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = names.learn_names(df, spark.createDataFrame([(k,) for k in known + ["Ann Lee"]], "name string"), frequent=5)
    looked, joined = (names.redact_names(df, model, out="named", method=m) for m in ("lookup", "join"))
    got, want = (sorted((r.doc_id, r.named or "") for r in d.collect()) for d in (looked, joined))
    assert got == want and sum("[NAME]" in t for _, t in got) > 150
    plan = names.redact_names(df, model)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan and "Generate" not in plan


def test_stray_rest_is_left_out(spark):
    df = spark.createDataFrame([("a - Bob Lee, c Ann!", "RFROF"), ("x y z Bob", "OROF")], "s string, tags string")
    got = [r[0] for r in df.select(names._without_names(F.col("s"), F.col("tags"), "[NAME]")).collect()]
    assert got == [" - [NAME], c [NAME]!", "x z [NAME]"]
