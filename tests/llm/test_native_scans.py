"""Decontamination, license scans and the URL filter against plain Python."""

import hashlib
import math
import re

import pytest

from tessera.llm import decontaminate, licenses, urls

from .conftest import SF, frame, plain


def brute_contamination(docs, items, size=13):
    windows = {}
    for item, body in items:
        b = plain(body)
        k = min(size, len(b))
        for j in range(len(b) - k + 1 if k else 0):
            windows.setdefault(k, {}).setdefault(tuple(b[j:j + k]), set()).add(str(item))
    out = []
    for doc_id, text in docs:
        ws, hit, found = plain(text), set(), set()
        for k, known in windows.items():
            for p in range(len(ws) - k + 1):
                if (items_here := known.get(tuple(ws[p:p + k]))):
                    found |= items_here
                    hit.update(range(p, p + k))
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc_id, len(ws), len(hit), len(found), sha, bool(hit) and 20 * len(hit) >= len(ws)))
    return sorted(out, key=str)


EDGE = [(1, None), (2, ""), (3, "one two three"), (3, "One, TWO three four"), (None, "alpha beta gamma"),
        (4, "x " * 5000 + "alpha beta gamma delta"), (4, "x " * 5000 + "alpha beta gamma delta"),
        (5, " ".join(f"w{i}" for i in range(13)) + " tail"), (6, "É é ß w0 w1"), (7, "one two three one two three")]
ITEMS = [(10, "alpha beta gamma"), (9, "Alpha BETA gamma"), (11, None), (12, "..."),
         (100, " ".join(f"W{i}" for i in range(15))), (13, "one two three"), (13, "one two three")]


@pytest.mark.parametrize("limit", [50_000, 0])
def test_contamination_matches_brute_force(spark, limit):
    docs = frame(spark, EDGE)
    items = spark.createDataFrame([(*i, 1) for i in ITEMS], "item_id long, text string, window int")
    got = decontaminate.contamination(docs, items, max_windows=limit)
    rows = sorted((tuple(r) for r in got.drop("hits").collect()), key=str)
    assert rows == brute_contamination(EDGE, ITEMS)
    kept = decontaminate.decontaminate(docs, items, max_windows=limit)
    assert kept.columns == docs.columns
    clean = [r[0] for r in brute_contamination(EDGE, ITEMS) if not r[5]]
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted(clean, key=str)


@pytest.mark.parametrize("limit", [50_000, 0])
def test_items_without_an_id_hit_like_others(spark, limit):
    """Words under them are hit and documents go, on either path; only the list of items leaves them out."""
    items = spark.createDataFrame([(None, "alpha beta gamma"), (None, "one two three"), (8, "one two three")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "see alpha beta gamma"), (2, "one two three"), (3, "alpha beta")], "doc_id long, text string")
    got = decontaminate.contamination(docs, items, max_windows=limit).orderBy("doc_id").collect()
    assert [(r.n_hit, r.n_items, r.contaminated) for r in got] == [(3, 0, True), (3, 1, True), (0, 0, False)]
    assert got[0].items_sha256 == hashlib.sha256(b"").hexdigest() != got[1].items_sha256
    assert [r.doc_id for r in decontaminate.decontaminate(docs, items, max_windows=limit).collect()] == [3]


def test_contamination_of_planted_passages(spark, documents):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    planted = documents[:60] + [(10_000 + i, f"head {t} tail") for i, t in items[:5]]
    got = decontaminate.contamination(spark.createDataFrame(planted, "doc_id long, text string"),
                                      spark.createDataFrame(items, "item_id long, text string")).drop("hits")
    rows = sorted((tuple(r) for r in got.collect()), key=str)
    assert rows == brute_contamination(planted, items)
    assert sum(r[5] for r in rows) >= 5


def test_contamination_of_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = frame(spark, EDGE)
    assert decontaminate.contamination(docs, none).filter("contaminated or n_hit > 0").count() == 0
    assert decontaminate.decontaminate(docs, none).count() == len(EDGE)
    assert decontaminate.contamination(docs.limit(0), none).count() == 0


@pytest.mark.parametrize("limit", [50_000, 0])
def test_spans_are_removed(spark, limit):
    docs = spark.createDataFrame([(1, "keep alpha beta gamma this"), (2, None), (2, "alpha beta gamma"), (3, "as it is"), (3, "as it is")],
                                 "doc_id long, text string")
    items = spark.createDataFrame([(1, "alpha beta gamma"), (None, "gamma this")], "item_id long, text string")
    kept = sorted(map(tuple, decontaminate.remove_spans(docs, items, max_windows=limit).collect()))
    assert kept == [(1, "keep"), (2, ""), (2, ""), (3, "as it is"), (3, "as it is")]


def brute_licenses(docs):
    out = []
    for doc_id, text in docs:
        ws, places, labels = plain(text), [], set()
        for phrase, label in licenses.PHRASES.items():
            p = phrase.split()
            at = [i for i in range(len(ws)) if ws[i:i + len(p)] == p]
            places += at
            labels |= {label} if at else set()
        out.append((doc_id, len(ws), len(places), min(places, default=None), max(places, default=None),
                    ",".join(sorted(labels))))
    return sorted(out, key=str)


def test_license_base_matches_brute_force(spark, documents):
    extra = [(1, None), (2, ""), (3, "cc by"), (3, "CC BY-NC. cc by nc"), (None, "Under the MIT License"),
             (4, "apache license version 2 " * 3000), (4, "apache license version 2 " * 3000),
             (5, "under the under the mit license under the mit"), (6, "apache license, VERSION 2.0")]
    rows = documents + extra
    got = licenses.license_labels(frame(spark, rows))
    assert sorted((tuple(r)[:6] for r in got.collect()), key=str) == brute_licenses(rows)
    for r in got.collect():
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert (r.score == 0) == (r.labels == "") and (r.score == 1 or not r.base_labels) and (r.score == 0 or 0.8 <= r.score <= 1)
    assert licenses.license_labels(frame(spark, rows).limit(0)).count() == 0


def test_license_spans_bridge_inserted_words(spark):
    full = "redistribution and use in source and binary forms with or without modification are permitted"
    gap = full.replace("source and binary", "source code and binary")
    rows = [(1, gap), (2, full), (3, "redistribution and use in source"), (4, "nothing of the kind"),
            (5, "This work is licensed under the GNU General Public License, version 3.")]
    got = {r.doc_id: (r.labels, r.base_labels, round(r.score, 2)) for r in
           licenses.license_labels(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1][0] == got[2][0] == "bsd" and got[2][2] == 1.0 and 0.8 <= got[1][2] < 1.0
    assert got[3] == got[4] == ("", "", 0.0)
    assert got[5] == ("gpl-3", "", 1.0)


def brute_spans(docs, phrases, templates, coverage=0.8):
    """Votes, merged diagonals and accepted labels in plain Python: ``{row: (labels, score)}``."""
    out = []
    known = [(t.split(), x, True) for t, x in phrases.items()] + [(t.split(), x, False) for t, x in templates.items()]
    for _, text in docs:
        ws, spans = plain(text), []
        for words, label, base in known:
            votes = {}
            for t in range(len(words) - 2):
                for p in range(len(ws) - 2):
                    if ws[p:p + 3] == words[t:t + 3]:
                        votes.setdefault(p - t, []).append((p, t))
            runs = []
            for d, hit in sorted(votes.items(), key=lambda v: (min(v[1])[0], v[0])):
                first, last = min(p for p, _ in hit), max(p for p, _ in hit)
                if runs and abs(d - runs[-1]["d"]) <= licenses.MERGE_DIAGONALS and first - runs[-1]["l"] <= licenses.MERGE_WORDS:
                    runs[-1].update(d=d, l=last, last=max(runs[-1]["last"], last))
                else:
                    runs.append({"d": d, "l": last, "last": last, "first": first, "t": set(), "places": 0})
                runs[-1]["t"] |= {t for _, t in hit}
                runs[-1]["places"] += base and len(hit) == len(words) - 2
            for r in runs:
                covered = len({t + k for t in r["t"] for k in range(3)})
                spans.append((r["first"], r["last"] + 3, label, base, r["places"], covered / max(len(words), r["last"] + 3 - r["first"])))
        labels = {x for _, _, x, base, n, _ in spans if base and n}
        score = 1.0 if labels else 0.0
        near = sorted(s for s in spans if not s[3] and s[5] >= coverage)
        place, reach = [], None
        for s in near:
            if reach is None or s[0] >= reach:
                place.append([])
            place[-1].append(s)
            reach = max(reach or 0, s[1])
        for group in place:
            best = max(s[5] for s in group)
            labels |= {s[2] for s in group if s[5] == best}
            score = max(score, best)
        out.append((",".join(sorted(labels)), round(score, 9)))
    return out


def test_spans_match_plain_voting(spark):
    """License bodies with words left out, put in and changed, next to each other and cut short."""
    import random

    rng = random.Random(11)
    bodies, rows = list(licenses.TEMPLATES), [(0, None), (1, ""), (1, "the software")]
    for k in range(2, 60):
        words = " and then ".join(rng.sample(bodies, rng.randrange(1, 3))).split()
        for _ in range(rng.randrange(0, 1 + len(words) // rng.choice([6, 20]))):
            at = rng.randrange(len(words))
            words[at:at + 1] = rng.choice([[], ["other"], [words[at], "more"], [words[at], words[at]]])
        cut = rng.randrange(len(words) // 2) if k % 4 == 0 else 0
        rows.append((k, " ".join(["Head,", *words[cut:], "tail."]).upper() if k % 3 else " ".join(words[cut:])))
    rows += [(99, "under the mit license " + b) for b in bodies[-3:]]
    got = licenses.license_labels(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = sorted((d, *w) for (d, _), w in zip(rows, brute_spans(rows, licenses.PHRASES, licenses.TEMPLATES), strict=True))
    assert sorted((r.doc_id, r.labels, round(r.score, 9)) for r in got) == want
    assert sum(0.8 <= s < 1 for _, _, s in want) >= 10 and len({x for _, x, _ in want}) >= 8


def brute_urls(rows):
    def parts(u):
        if u is None or "://" not in u:
            return "", ""
        rest = u.split("://", 1)[1]
        host = re.match(r"(?s)[^/?#]*", rest)[0]
        return host.translate({i: i + 32 for i in range(65, 91)}), re.match(r"(?s)[^?#]*", rest[len(host):])[0]

    def rule(h, p):
        fit = [(rh + rp, v) for v, rh, rp in urls.RULES if (h == rh or h.endswith("." + rh)) and p.startswith(rp)]
        return max(fit, key=lambda x: len(x[0]), default=(None, None))

    def text(u):
        body = re.sub(r"(?s)^.*?://", "", u or "", count=1).translate({i: i + 32 for i in range(65, 91)})
        body = "".join(c if c in urls.SYMBOLS and c not in "^$" else "~" for c in re.sub(r"[0-9]+", "0", body))
        return body and "^" * urls.ORDER + body + "$"

    seen = [(i, *parts(u), *rule(*parts(u)), text(u)) for i, u in rows]
    counts = {"allow": {}, "block": {}}
    for _, _, _, _, v, s in seen:
        for i in range(urls.ORDER, len(s) if v else 0):
            for k in range(urls.ORDER + 1):
                one = counts[v].setdefault(s[i - k:i], {})
                one[s[i]] = one.get(s[i], 0) + 1

    def prob(v, ctx, c):
        p = 1 / (len(urls.SYMBOLS) + 1)
        for k in range(urls.ORDER + 1):
            one = counts[v].get(ctx[len(ctx) - k:])
            if one:
                n, t = sum(one.values()), len(one)
                p = (one.get(c, 0) + t * p) / (n + t)
        return p

    def score(s):
        if not s or not all(counts.values()):
            return 0.0
        each = [round((math.log(prob("allow", s[i - 3:i], s[i])) - math.log(prob("block", s[i - 3:i], s[i]))) * 1e6)
                for i in range(3, len(s))]
        return sum(each) / len(each) / 1e6
    return [(i, h, p, r, v, score(s)) for i, h, p, r, v, s in seen]


URLS = [(1, None), (2, ""), (3, "no scheme"), (4, "http://WWW.Example.com/en/x"), (5, "ftp://a.example.com/en/?q"),
        (6, "http://com"), (7, "http://com/"), (8, "x://net/fr/#top"), (9, "http://sub.net/fr/a"), (10, "http://sub.net/fra"),
        (11, "http://a.org/://b.com/"), (11, "http://a.org/://b.com/"), (None, "http://é.net/es/ñ"),
        (12, "http://" + "a" * 3000 + ".org/"), (13, "http://example.com:80/en/"), (14, "http://xcom/en/"), (15, "://")]


def test_urls_match_brute_force(spark):
    pages = [tuple(r) for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url").collect()]
    rows = pages + URLS
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, s string, gram int")
    got = sorted((tuple(r) for r in urls.judge_urls(df).collect()), key=str)
    want = sorted(brute_urls(rows), key=str)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    for g, w in zip(got, want, strict=True):
        assert g[5] == pytest.approx(w[5], abs=2e-6)
        assert g[4] == (w[4] or ("allow" if g[5] >= g[6] else "block"))
    ruled = [(w[4], w[5] >= got[0][6]) for w in want if w[4]]
    assert sum((v == "allow") == above for v, above in ruled) / len(ruled) > 0.9


def test_urls_without_classes_or_rows(spark):
    df = spark.createDataFrame([(1, "http://a.org/x"), (2, None)], "page_id long, url string")
    assert [(r.verdict, r.score) for r in urls.judge_urls(df).collect()] == [("allow", 0.0)] * 2
    assert urls.judge_urls(df.limit(0)).count() == 0
