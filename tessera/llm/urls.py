"""URL filter: explicit rules first, then a character language-model ratio.

Two variable-order Markov models are counted over the URLs that the rules accept
and reject. A character is predicted from up to ``ORDER`` characters before it;
each longer context is smoothed into the shorter one by Witten-Bell weights, down
to a uniform start, and a context that was never seen leaves the shorter estimate
as it is. A URL's score is the mean log-likelihood difference of its characters,
and the threshold between the classes is calibrated on the scores of the URLs that
the rules decide.

Counts come from all URLs, in one aggregation with map-side partial sums; the
table of character differences is bounded by the alphabet (``SYMBOLS`` and one
other sign, to the power ``ORDER + 1``) and is broadcast only after its rows are
counted. Differences are held in whole millionths, so sums do not depend on order.

A null URL, or one without ``://``, has an empty host and path and fits no rule; a
null or empty URL scores 0. Repeated rows come back repeated. With no accepted or
no rejected URL to learn from, all scores are 0 and the threshold is 0 (allow).
Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import ascii_lower
from tessera.session import materialize

#: (verdict, host, path prefix); the longest fitting rule wins.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
ORDER = 3
#: Characters told apart; digits count as one sign, all others as "~".
SYMBOLS = "abcdefghijklmnopqrstuvwxyz0./-_?=&#%:+@,;^$"
START, END, OTHER = "^", "$", "~"
MICRO = 1_000_000
MAX_BROADCAST = 500_000
BINS_PER_UNIT = 1000


def url_host(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, null without one."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def model_text(url: Column) -> Column:
    """The characters that the models read: no scheme, one sign for digits, start and end marks."""
    body = F.regexp_replace(F.coalesce(url, F.lit("")), r"(?s)^.*?://", "")
    body = F.regexp_replace(ascii_lower(body), r"[0-9]+", "0")
    known = "".join("\\" + c if not c.isalnum() else c for c in SYMBOLS if c not in (START, END))
    body = F.regexp_replace(body, f"[^{known}]", OTHER)
    return F.concat(F.lit(START * ORDER), body, F.when(body != "", F.lit(END)).otherwise(F.lit("")))


def grams(rows: DataFrame, *keep: str) -> DataFrame:
    """One row per character of column ``s``, as the gram of its context and itself."""
    n = F.length("s") - ORDER
    at = F.explode(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")))
    return rows.select(*keep, "s", at.alias("i")).select(*keep, F.expr(f"substring(s, i, {ORDER + 1})").alias("gram"))


def gram_counts(rows: DataFrame) -> DataFrame:
    """``(gram, allow, block, n)``: counts by rule verdict of every gram of the corpus."""
    one = lambda v: F.sum(F.when(F.col("verdict") == v, 1).otherwise(0)).alias(v)
    return grams(rows, "verdict").groupBy("gram").agg(one("allow"), one("block"), F.count("*").alias("n"))


def gram_differences(counts: DataFrame) -> DataFrame:
    """``(gram, micro)``: log-likelihood difference of each gram's last character, in millionths."""
    out = counts
    for k in range(ORDER + 1):
        suffix = F.expr(f"right(gram, {k + 1})")
        seen = counts.groupBy(suffix.alias(f"g{k}")).agg(
            F.sum("allow").alias(f"allow{k}"), F.sum("block").alias(f"block{k}"))
        context = seen.groupBy(F.expr(f"left(g{k}, {k})").alias(f"c{k}")).agg(
            *[F.sum(f"{v}{k}").alias(f"{v}_n{k}") for v in ("allow", "block")],
            *[F.sum((F.col(f"{v}{k}") > 0).cast("long")).alias(f"{v}_t{k}") for v in ("allow", "block")])
        out = (out.withColumn(f"g{k}", suffix).join(seen, f"g{k}")
               .withColumn(f"c{k}", F.expr(f"left(g{k}, {k})")).join(context, f"c{k}"))
    logs = []
    for v in ("allow", "block"):
        p = F.lit(1.0 / (len(SYMBOLS) + 1))
        for k in range(ORDER + 1):
            n, t = F.col(f"{v}_n{k}"), F.col(f"{v}_t{k}")
            p = F.when(n > 0, (F.col(f"{v}{k}") + t * p) / (n + t)).otherwise(p)
        logs.append(F.log(p))
    learnt = (F.col("allow_n0") > 0) & (F.col("block_n0") > 0)
    micro = F.when(learnt, F.round((logs[0] - logs[1]) * MICRO)).otherwise(F.lit(0.0)).cast("long")
    return out.select("gram", micro.alias("micro"))


def calibrated_threshold(scored: DataFrame) -> float:
    """The score that splits the rule-decided URLs with the least balanced error.

    ``scored`` has a score, a verdict (or null) and the ``count`` of such URLs. Works on
    counts by score bin; scores are bounded by the smoothing, and so are the bins.
    """
    score = F.floor(F.col("score") * BINS_PER_UNIT)
    bins = (scored.filter("verdict is not null").groupBy(score.cast("long").alias("bin"))
            .agg(F.sum(F.when(F.col("verdict") == "allow", F.col("count")).otherwise(0)).alias("a"),
                 F.sum(F.when(F.col("verdict") == "block", F.col("count")).otherwise(0)).alias("b"))
            .orderBy("bin").collect())
    allow, block = sum(r["a"] for r in bins), sum(r["b"] for r in bins)
    if not allow or not block:
        return 0.0
    best, cut, a, b = None, 0, 0, 0
    for r in bins:  # cutting below this bin rejects what lies before it
        error = a / allow + (block - b) / block
        if best is None or error < best - 1e-12:
            best, cut = error, r["bin"]
        a, b = a + r["a"], b + r["b"]
    return cut / BINS_PER_UNIT


def judge_urls(pages: DataFrame) -> DataFrame:
    """Per page: ``page_id, host, path, rule, verdict, score, threshold``."""
    url = F.col("url")
    rows = pages.select("page_id", url_host(url).alias("host"), url_path(url).alias("path"), model_text(url).alias("s"))
    rule, verdict = fitting_rule(F.col("host"), F.col("path"))
    rows = rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), "s")
    table = materialize(gram_differences(gram_counts(rows)), "url-model")
    small = table.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST
    # equal URLs score alike: each distinct text is scored once, however many pages repeat it
    texts = rows.select("s").distinct()
    each = grams(texts.withColumn("t", F.col("s")), "t").join(F.broadcast(table) if small else table, "gram")
    sums = each.groupBy("t").agg(F.sum("micro").alias("m"), F.count("*").alias("n"))
    score = F.coalesce(F.col("m") / F.col("n") / MICRO, F.lit(0.0))
    scores = materialize(texts.join(sums, texts["s"] == sums["t"], "left").select("s", score.alias("score")), "url-scores")
    spread = rows.filter("verdict is not null").groupBy("s", "verdict").count()
    threshold = calibrated_threshold(spread.join(scores, "s"))
    own = F.when(F.col("score") >= threshold, "allow").otherwise("block")
    return (rows.join(scores, "s", "left")
            .select("page_id", "host", "path", "rule", F.coalesce("verdict", own).alias("verdict"),
                    "score", F.lit(threshold).alias("threshold")))
