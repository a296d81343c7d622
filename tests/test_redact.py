"""R1-R9 on edge rows and on the generated documents."""

import pytest
from pyspark.sql import functions as F

from tessera.operators.corpus import drop_blank
from tessera.operators.redact import (extract_redacted, pii_report, redact, redact_terms, redact_with, rejoin, scrub,
                                      segment)
from tessera.sources.tables import load_corpus

from .conftest import SF0001


def red(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    return [r.text for r in redact(df).orderBy("doc_id").collect()]


def test_pii_edge_rows(spark):
    got = red(spark, [
        "ips 1.1.1.1 2.2.2.2 3.3.3.3 end",
        "card x4111111111111111 y",
        "mail:john.doe@example.com now",
        "token = 'abcdef'",
        'api_key: "sk-123" and password="p w"',
        "call +1 (555) 555-1234 or +44(020) 555-0000",
        "no pii here",
    ])
    assert got[0] == "ips [IP] [IP] [IP] end"
    assert got[1] == "card x[CARD] y"
    assert got[2] == "mail:[EMAIL] now"
    assert got[3] == "token = 'abcdef'"
    assert got[4] == 'api_key: "[SECRET]" and password="[SECRET]"'
    assert got[5] == "call [PHONE] or [PHONE]"
    assert got[6] == "no pii here"


def test_redaction_idempotent_and_clean(spark):
    docs = drop_blank(load_corpus(spark, SF0001))
    once = redact(docs, out="r1")
    twice = redact(once, "r1", out="r2")
    assert twice.filter(F.col("r1") != F.col("r2")).count() == 0
    rep = {r.tag: r for r in pii_report(once, "text", "r1").collect()}
    assert all(r.residual == 0 for r in rep.values())
    assert sum(r.hits for r in rep.values()) > 0


@pytest.mark.parametrize("out,exp", [
    ("no marker at all  ", "no marker at all  "),
    ("[RAW] a [REDACTED] b c ", "b c"),
    ("[RAW] a [REDACTED] x [REDACTED]  y<|endoftext|>", "y"),
    ("[REDACTED] z<|endoftext|><|endoftext|>\n", "z"),
    ("   leading spaces", "   leading spaces"),
])
def test_extract(spark, out, exp):
    df = spark.createDataFrame([(out,)], "output string")
    assert extract_redacted(df).first().redacted == exp


def test_scrub_and_hook_agree(spark):
    texts = ["Reach me at a.b@c.org", "   ", "", "plain", "ip 10.0.0.1"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    s = {r.doc_id: (r.status, r.scrubbed) for r in scrub(df).collect()}
    assert s[0] == ("ok", "Reach me at [EMAIL]")
    assert s[1] == ("blank", "Please enter text to redact.") and s[2][0] == "blank"
    h = {r.doc_id: r.redacted for r in extract_redacted(redact_with(df)).collect()}
    for i, (status, text) in s.items():
        assert h[i] == (text if status == "ok" else None)


TERMS = [("Smith", "NAME"), ("SAUDI ARABIA", "PLACE"), ("SAUDI", "NAME"), ("Anne-Marie", "NAME"), ("  O'Neil! ", "NAME"),
         ("New York City", "PLACE"), ("York", "NAME"), ("Smith", "ZNAME"), ("...", "X"), (None, "Y"), ("a b", "P"), ("b c", "P")]
SENTENCES = [
    (1, "Smith said: Smith, go to SAUDI ARABIA. (Smith)", "[NAME] said: [NAME], go to [PLACE]. ([NAME])"),
    (2, "SAUDI  \nARABIA, SAUDI-ARABIA", "[PLACE], [NAME]-ARABIA"),           # white space may vary, other gaps may not
    (3, "Smithson Smith2 _Smith_ Smith's", "Smithson Smith2 _[NAME]_ [NAME]'s"),
    (4, "Anne-Marie O'Neil Anne Marie", "[NAME] [NAME] Anne Marie"),
    (5, "New York City, New York, York", "[PLACE], New [NAME], [NAME]"),     # the longest wins
    (6, "a b c a b  c b c", "[P] c [P]  c [P]"),                             # from the left, no overlap
    (7, "", ""), (8, None, None), (9, "no hit", "no hit"),
    (10, "a b", "[P]"), (10, "b a a b", "b a [P]"), (10, "a b", "[P]"),      # one key, several rows
    (None, "Smith", "[NAME]"),
]


@pytest.mark.parametrize("method", ["auto", "scan", "join"])
def test_terms(spark, method):
    df = spark.createDataFrame([(k, t, 0) for k, t, _ in SENTENCES], "doc_id int, text string, first int")
    terms = spark.createDataFrame(TERMS, "term string, tag string")
    got = redact_terms(df, terms, method=method)
    assert got.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(((k, w) for k, _, w in SENTENCES), key=str)
    assert redact_terms(df, terms.limit(0), method=method).exceptAll(df).count() == 0
    assert redact_terms(df, terms, method=method, out="clean").columns == [*df.columns, "clean"]


def test_a_scan_moves_no_text(spark):
    df = spark.createDataFrame([(k, t) for k, t, _ in SENTENCES], "doc_id int, text string")
    plan = redact_terms(df, spark.createDataFrame(TERMS, "term string, tag string"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Join" not in plan


def test_a_dictionary_beyond_the_plan_is_joined(spark, monkeypatch):
    from tessera.operators import redact as module

    monkeypatch.setattr(module, "SCAN_TERMS", 2)
    df = spark.createDataFrame([(k, t) for k, t, _ in SENTENCES], "doc_id int, text string")
    terms = spark.createDataFrame(TERMS, "term string, tag string")
    got = redact_terms(df, terms)
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(((k, w) for k, _, w in SENTENCES), key=str)
    with pytest.raises(ValueError, match="more than 2"):
        redact_terms(df, terms, method="scan")


def test_hook_in_chunks(spark):
    long = " ".join(f"w{i} me{i}@x.org" for i in range(50))
    df = spark.createDataFrame([(1, long), (2, "  "), (3, None), (4, "one  a.b@c.org\n two")], "doc_id int, text string")
    seen = []

    def factory():
        model = __import__("tessera.operators.redact", fromlist=["x"]).rule_scrubber()

        def run(prompts):
            assert all(len(p.split()) <= 7 + 2 for p in prompts)  # chunk words and the two marks
            return model(prompts)
        return run
    out = extract_redacted(redact_with(df, factory, chunk_words=7))
    got = {r.doc_id: r.redacted for r in out.collect()}
    assert got[1] == " ".join(f"w{i} [EMAIL]" for i in range(50)) and got[4] == "one [EMAIL] two"
    assert got[2] is None and got[3] is None and out.count() == 4 and not seen


def test_phones_and_addresses(spark):
    got = red(spark, ["555-123-4567", "(555) 123-4567", "+44 20 7946 0958", "+1 (555) 555-1234;+33 1 42 68 53 00",
                      "at 12 Main Street, or 7 Old Mill Rd.", "555-12-4567 2001-02-03 12 main street", "in 1999 Court"])
    assert got == ["[PHONE]", "[PHONE]", "[PHONE]", "[PHONE];[PHONE]", "at [ADDRESS], or [ADDRESS].",
                   "555-12-4567 2001-02-03 12 main street", "in 1999 Court"]


def test_segment_rejoin(spark):
    df = spark.createDataFrame([(1, " a b  c\nd e "), (2, "x"), (3, "  ")], "doc_id int, text string")
    seg = segment(df, 2)
    assert {(r.doc_id, r.seg_idx, r.segment) for r in seg.collect()} == {(1, 0, "a b"), (1, 1, "c d"), (1, 2, "e"),
                                                                       (2, 0, "x")}
    back = {r.doc_id: r.text for r in rejoin(seg).collect()}
    assert back == {1: "a b c d e", 2: "x"}


@pytest.mark.parametrize("method", ["scan", "join"])
def test_terms_with_quotes_and_backslashes(spark, method):
    df = spark.createDataFrame([(1, "by O'Brien \\ x\\y 'q' now"), (2, "a\\'b \\n c")], "doc_id int, text string")
    terms = spark.createDataFrame([("O'Brien", "N"), ("x\\y", "P"), ("a\\'b", "Q's"), ("n c", "R")], "term string, tag string")
    got = {r.doc_id: r.text for r in redact_terms(df, terms, method=method).collect()}
    assert got == {1: "by [N] \\ [P] 'q' now", 2: "[Q's] \\[R]"}


def test_long_dictionary_is_scanned_for_the_terms_that_texts_can_hold(spark, monkeypatch):
    from tessera.operators import redact as operator

    df = spark.createDataFrame([(1, "Customer#7 met Ann  Lee in New York."), (2, None), (3, ""), (4, "Ann, Lee; York New"), (4, "no one#12")],
                               "doc_id long, text string")
    rows = [(f"Customer#{k}", "NAME") for k in range(100)] + [("Ann Lee", "NAME"), ("New York", "PLACE"), ("York", "PLACE"), ("...", "NONE"), (None, "NONE")]
    terms = spark.createDataFrame(rows, "term string, tag string")
    want = sorted((r.doc_id, str(r.text)) for r in redact_terms(df, terms, method="join").collect())
    assert (1, "[NAME] met [NAME] in [PLACE].") in want
    for limit, scanned in ((50, True), (2, False)):
        monkeypatch.setattr(operator, "SCAN_TERMS", limit)
        out = redact_terms(df, terms)
        assert ("Join" not in out._jdf.queryExecution().optimizedPlan().toString()) == scanned
        assert sorted((r.doc_id, str(r.text)) for r in out.collect()) == want


def test_segments_of_few_words_match_those_by_word(spark, monkeypatch):
    from tessera.operators import redact as operator

    texts = ["", "   ", None, " a\tb\n\nc  ", "x\x1cy z w q\x0br", " ".join(map(str, range(40))), "é " * 33, "\U0001f600 b c d e"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for n in (1, 4, 16):
        monkeypatch.setattr(operator, "SHORT_SEGMENT", 256)
        plan = operator.segment(df, n)
        assert "array_join" not in plan._jdf.queryExecution().optimizedPlan().toString()
        short = sorted(plan.collect())
        monkeypatch.setattr(operator, "SHORT_SEGMENT", 0)
        assert short == sorted(operator.segment(df, n).collect()) and len(short) > 5
