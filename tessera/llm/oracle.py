"""DuckDB SQL of the queries that SQL can express.

Fingerprints and tokens need hashes and vocabularies that SQL lacks, the models are
fitted by iteration, and license spans merge by rules kept in Python; those queries
are tested against plain versions in tests/llm.
"""

from __future__ import annotations

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
PLAIN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _plain(column: str) -> str:
    return f"regexp_extract_all(translate(coalesce({column}, ''), '{UPPER}', '{UPPER.lower()}'), '{PLAIN}')"


CONTAMINATION = f"""
WITH d AS (SELECT doc_id, {_plain('text')} AS w FROM documents),
b AS (SELECT item_id, {_plain('text')} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(13, len(w)) AS k, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS win
       FROM b, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS t(i) WHERE len(w) > 0),
dw AS (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS win
       FROM d, (SELECT DISTINCT k FROM bw) AS ks, unnest(range(1, len(w) - k + 2)) AS t(i)),
hits AS (SELECT doc_id, i, dw.k, item_id FROM dw JOIN bw USING (k, win)),
covered AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM hits, unnest(range(i, i + k)) AS t(j) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) AS x GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * n_hit >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""

SUBSTRINGS = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS s FROM d, unnest(range(1, len(w) - 18)) AS t(i)),
again AS (SELECT doc_id, i FROM (
            SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS r FROM win) AS x WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, j FROM again, unnest(range(i, i + 20)) AS t(j)),
word AS (SELECT doc_id, j, w[j] AS word FROM d, unnest(range(1, len(w) + 1)) AS t(j)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS text, count(*) AS n
         FROM word ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

NEAR_COPIES = f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, {_plain('text')} AS w FROM documents),
s AS MATERIALIZED (SELECT doc_id, g, 1 + ln(count(*)) AS x FROM (
        SELECT doc_id, array_to_string(w[i:i + 4], ' ') AS g
        FROM d, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS t(i) WHERE len(w) > 0) AS every GROUP BY ALL),
n AS (SELECT doc_id, sum(x) AS whole FROM s GROUP BY doc_id),
c AS MATERIALIZED (SELECT p.doc_id AS a, q.doc_id AS b, sum(p.x) AS sx, sum(q.x) AS sy
      FROM s AS p JOIN s AS q USING (g) WHERE p.doc_id < q.doc_id GROUP BY ALL),
likely AS MATERIALIZED (SELECT a, b, p.whole - sx AS only_x, sy, q.whole - sy AS only_y FROM c
      JOIN n AS p ON p.doc_id = a JOIN n AS q ON q.doc_id = b WHERE sx > 0.79 * p.whole AND sy > 0.79 * q.whole),
terms AS (SELECT a, b, (only_x + sum(p.x) OVER up) / p.x + (only_y + sy - sum(q.x) OVER up) / q.x AS total
      FROM likely JOIN s AS p ON p.doc_id = a JOIN s AS q ON q.doc_id = b AND q.g = p.g
      WINDOW up AS (PARTITION BY a, b ORDER BY q.x / p.x)),
pair AS (SELECT a, b FROM terms GROUP BY a, b HAVING sum(1 / total) >= 0.8 - 1e-9),
link AS MATERIALIZED (SELECT a, b FROM pair UNION ALL SELECT b, a FROM pair),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM reach AS r JOIN link AS l ON r.b = l.a)
SELECT a AS doc_id, min(b) AS class_id, a = min(b) AS kept FROM reach GROUP BY a
"""


def _urls() -> str:
    from tessera.llm import urls

    size = len(urls.SYMBOLS) + 1
    known = "".join("\\" + c if not c.isalnum() else c for c in urls.SYMBOLS if c not in (urls.START, urls.END))
    rules = sorted(urls.RULES, key=lambda r: -len(r[1] + r[2]))

    def fits(h: str, p: str) -> str:
        return f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    rule = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for _, h, p in rules) + " END"
    ruled = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for v, h, p in rules) + " END"
    low = f"'{UPPER}', '{UPPER.lower()}'"
    counts, joins, logs = [], [], {v: f"(1.0 / {size})" for v in ("allow", "block")}
    for k in range(urls.ORDER + 1):
        counts.append(f"""
s{k} AS (SELECT right(gram, {k + 1}) AS g, CAST(sum(allow) AS BIGINT) AS allow, CAST(sum(block) AS BIGINT) AS block
         FROM counts GROUP BY 1),
x{k} AS (SELECT left(g, {k}) AS c, CAST(sum(allow) AS BIGINT) AS allow_n, CAST(sum(block) AS BIGINT) AS block_n,
                count(*) FILTER (allow > 0) AS allow_t, count(*) FILTER (block > 0) AS block_t FROM s{k} GROUP BY 1)""")
        joins.append(f"JOIN s{k} ON s{k}.g = right(gram, {k + 1}) JOIN x{k} ON x{k}.c = left(right(gram, {k + 1}), {k})")
        for v in logs:
            n, t = f"x{k}.{v}_n", f"x{k}.{v}_t"
            logs[v] = f"CASE WHEN {n} > 0 THEN (s{k}.{v} + {t} * {logs[v]}) / CAST({n} + {t} AS DOUBLE) ELSE {logs[v]} END"
    return f"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
p AS (SELECT page_id, url,
        translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), {low}) AS host,
        regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path,
        regexp_replace(regexp_replace(translate(regexp_replace(url, '(?s)^.*?://', ''), {low}), '[0-9]+', '0', 'g'),
                       '[^{known}]', '{urls.OTHER}', 'g') AS body FROM u),
r AS MATERIALIZED (SELECT page_id, host, path, {rule} AS rule, {ruled} AS v,
        '{urls.START * urls.ORDER}' || body || CASE WHEN body <> '' THEN '{urls.END}' ELSE '' END AS s FROM p),
g AS MATERIALIZED (SELECT page_id, v, substring(s, i, {urls.ORDER + 1}) AS gram
        FROM r, unnest(range(1, len(s) - {urls.ORDER} + 1)) AS t(i)),
counts AS MATERIALIZED (SELECT gram, count(*) FILTER (v = 'allow') AS allow, count(*) FILTER (v = 'block') AS block
        FROM g GROUP BY gram),{','.join(counts)},
m AS (SELECT gram, CASE WHEN x0.allow_n > 0 AND x0.block_n > 0
        THEN CAST(round((ln({logs['allow']}) - ln({logs['block']})) * {urls.MICRO}) AS BIGINT) ELSE 0 END AS micro
      FROM counts {' '.join(joins)}),
sc AS MATERIALIZED (SELECT r.page_id, any_value(r.v) AS v,
        coalesce(sum(micro) / CAST(count(micro) AS DOUBLE) / {urls.MICRO}, 0.0) AS score
      FROM r LEFT JOIN g USING (page_id) LEFT JOIN m USING (gram) GROUP BY r.page_id),
bins AS (SELECT CAST(floor(score * {urls.BINS_PER_UNIT}) AS BIGINT) AS bin, count(*) FILTER (v = 'allow') AS a,
        count(*) FILTER (v = 'block') AS b FROM sc WHERE v IS NOT NULL GROUP BY 1),
err AS (SELECT bin, coalesce(sum(a) OVER w, 0) / sum(a) OVER () + (sum(b) OVER () - coalesce(sum(b) OVER w, 0)) / sum(b) OVER ()
        AS e FROM bins WINDOW w AS (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
cut AS (SELECT coalesce((SELECT bin FROM err WHERE (SELECT sum(a) > 0 AND sum(b) > 0 FROM bins)
        ORDER BY round(e, 11), bin LIMIT 1), 0) / {float(urls.BINS_PER_UNIT)} AS threshold)
SELECT r.page_id, host, path, rule, coalesce(r.v, CASE WHEN score >= threshold THEN 'allow' ELSE 'block' END) AS verdict,
       round(score, 5) AS score, threshold
FROM r JOIN sc USING (page_id), cut
"""


ARCHIVES = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last FROM pages),
s AS (SELECT *, octet_length(encode(payload)) AS n FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(payload) AS payload_digest,
       CASE WHEN n >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id < last THEN last END AS refers_to
FROM s
"""

NEGATIVES = """
WITH v AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score
  FROM v AS a JOIN v AS b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
       s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
QUALIFY rank <= 3
"""

ORACLE_SQL: dict[str, str] = {
    "op4_decontamination": CONTAMINATION,
    "op6_substrings": SUBSTRINGS,
    "op9_urls": _urls(),
    "op10_near_copies": NEAR_COPIES,
    "op11_archives": ARCHIVES,
    "op12_negatives": NEGATIVES,
}
