"""Independent DuckDB SQL for every registered query (the correctness oracle).

Written from the rules, not from the Spark plans: packing explodes every token
and numbers it with ``row_number``; counts use byte lengths; the schedule
enumerates window ids directly. Regexes stay inside the Java/RE2 common subset.
"""

from __future__ import annotations

from tessera.functions import checked
from tessera.functions.rules import DEFAULT_RULES, duck_replacement
from tessera.plans import catalog as C

# Python's str.isspace() characters as an RE2 class body
# (tab, LF, VT, FF, CR, U+001C-U+001F, space, U+0085, U+00A0, U+1680,
# U+2000-U+200A, U+2028, U+2029, U+202F, U+205F, U+3000).
PY_WS = r"\t\n\x0B\f\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WORD_RE = r"[^ \t\n\r\f\x0B]+"
WORD_OR_GAP_RE = r"[^ \t\n\r\f\x0B]+|[ \t\n\r\f\x0B]+"
EOS = "<|endoftext|>"


def NB(c: str) -> str:
    return f"regexp_matches({c}, '[^{PY_WS}]')"


def STRIP(c: str) -> str:
    return f"regexp_replace({c}, '^[{PY_WS}]+|[{PY_WS}]+$', '', 'g')"


def B(t: str) -> str:
    return f"list_transform(regexp_extract_all(hex(encode({t})), '..'), lambda h: ('0x' || h)::INTEGER)"


def ENC(t: str) -> str:
    return (f"(CASE WHEN contains({t}, '{EOS}') THEN flatten(list_transform(string_split({t}, '{EOS}'), "
            f"lambda p, i: CASE WHEN i = 1 THEN {B('p')} ELSE list_concat([256], {B('p')}) END)) "
            f"ELSE {B(t)} END)")


def NTOK(t: str = "text") -> str:
    """Stream tokens of a document: UTF-8 bytes, each EOS literal counts once, plus the EOS."""
    return f"(strlen({t}) - 12 * (len(string_split({t}, '{EOS}')) - 1) + 1)"


def FP(ids: str) -> str:
    return f"md5(array_to_string({ids}, ','))"


def RULES(c: str) -> str:
    out = c
    for r in DEFAULT_RULES:
        for _ in range(r.passes):
            out = f"regexp_replace({out}, '{r.pattern}', '{duck_replacement(r)}', 'g')"
    return out


def EXTRACT(x: str) -> str:
    after = f"replace(string_split({x}, '[REDACTED]')[-1], '{EOS}', '')"
    return f"(CASE WHEN contains({x}, '[REDACTED]') THEN {STRIP(after)} ELSE {x} END)"


def FULL_OUTPUT(t: str = "text") -> str:
    return f"('[RAW] ' || {t} || ' [REDACTED] ' || {RULES(t)} || '{EOS}')"


def WEAK_PAIRS(n: int = C.SEGMENT_WORDS) -> str:
    return f"""wp_d AS (SELECT doc_id, regexp_extract_all(text, '{WORD_RE}') AS w FROM documents WHERE {NB('text')}),
wp_s AS (SELECT doc_id, w, unnest(range(CAST(ceil(len(w) / {n}) AS BIGINT))) AS seg_idx FROM wp_d),
wp_o AS (SELECT doc_id, seg_idx, array_to_string(list_slice(w, seg_idx * {n} + 1, seg_idx * {n} + {n}), ' ') AS original_text FROM wp_s),
wp AS (SELECT doc_id, seg_idx, original_text, {RULES('original_text')} AS redacted_text FROM wp_o)"""


def STREAM(table: str = "documents", key: str = "doc_id", L: int = C.PACK_L) -> str:
    """Every stream token with its global position ``gp``; ``W`` = window count."""
    return f"""st_d AS (SELECT {key} AS k, list_concat({ENC('text')}, [256]) AS s FROM {table} WHERE {NB('text')}),
st_t AS (SELECT k, unnest(s) AS tok, unnest(range(len(s))) AS pos FROM st_d),
g AS (SELECT tok, row_number() OVER (ORDER BY k, pos) - 1 AS gp FROM st_t),
m AS (SELECT greatest((count(*) - 1) // {L}, 0) AS W FROM g)"""


def PACK(table: str, key: str, L: int) -> str:
    return f"""WITH {STREAM(table, key, L)},
i AS (SELECT gp // {L} AS w, string_agg(CAST(tok AS VARCHAR), ',' ORDER BY gp) AS s, count(*) AS n FROM g GROUP BY 1),
o AS (SELECT (gp - 1) // {L} AS w, string_agg(CAST(tok AS VARCHAR), ',' ORDER BY gp) AS s FROM g WHERE gp >= 1 GROUP BY 1)
SELECT CAST(i.w AS BIGINT) AS window_id, md5(i.s) AS input_md5, md5(o.s) AS target_md5, CAST(i.n AS BIGINT) AS n
FROM i JOIN o ON i.w = o.w, m WHERE i.w < m.W"""


def PAIRS_MODEL(L: int = C.PACK_L) -> str:
    """Byte pairs the windows contain, their counts and the add-one log-probabilities."""
    return f"""{STREAM('documents', 'doc_id', L)},
pr AS (SELECT gp // {L} AS w, tok AS prev, lead(tok) OVER (ORDER BY gp) AS nxt, gp FROM g),
pp AS (SELECT pr.* FROM pr, m WHERE gp < m.W * {L}),
cnt AS (SELECT prev, nxt, count(*) AS c FROM pp GROUP BY 1, 2),
ct AS (SELECT prev, sum(c) AS cp FROM cnt GROUP BY prev),
lp AS (SELECT cnt.prev, cnt.nxt, ln((c + 1.0) / (cp + 257.0)) AS lp FROM cnt JOIN ct USING (prev)),
wl AS (SELECT w, count(*) AS tokens, avg(-lp) AS nll FROM pp JOIN lp USING (prev, nxt) GROUP BY w)"""


def SCHEDULE(steps: int | None = None) -> str:
    """Two epochs, or as many as ``steps`` updates take, as CTE ``sched``."""
    L, size, accum, seed = C.PACK_L, C.BATCH, C.ACCUM, C.SEED
    epochs = str(C.EPOCHS) if steps is None else f"CAST(ceil({steps} / CAST((W // {size}) // {accum} AS DOUBLE)) AS BIGINT)"
    return f"""nt AS (SELECT sum({NTOK()}) AS N FROM documents WHERE {NB('text')}),
ww AS (SELECT CAST(greatest((N - 1) // {L}, 0) AS BIGINT) AS W FROM nt),
sid AS (SELECT unnest(range(W)) AS window_id FROM ww),
sep AS (SELECT window_id, unnest(range({epochs})) AS epoch FROM sid, ww),
skey AS (SELECT window_id, epoch, md5('{seed}|' || epoch || '|' || window_id) AS key FROM sep),
srk AS (SELECT window_id, epoch, row_number() OVER (PARTITION BY epoch ORDER BY key, window_id) AS rank,
               count(*) OVER (PARTITION BY epoch) AS n_epoch FROM skey),
sb AS (SELECT *, (rank - 1) // {size} AS batch_idx, (rank - 1) % {size} AS slot, n_epoch // {size} AS nb FROM srk),
sched AS (SELECT *, epoch * (nb // {accum}) + batch_idx // {accum} + 1 AS update_id FROM sb WHERE batch_idx < nb)"""


def PERMUTED() -> str:
    """The schedule of a keyed permutation: four rounds on the halves of an id, again while the result is not below W."""
    size, accum = C.BATCH, C.ACCUM

    def rounds(source: str) -> str:
        out = f"SELECT *, x >> rb AS l, x % (CAST(1 AS BIGINT) << rb) AS r FROM ({source}) AS q"
        for k in range(4):
            to, of, bits = ("r", "l", "rb") if k % 2 else ("l", "r", "lb")
            h = f"('0x' || substr(md5('{C.SEED}|' || epoch || '|{k}|' || {of}), 1, 8))::BIGINT"
            out = f"SELECT * REPLACE (({to} + {h}) % (CAST(1 AS BIGINT) << {bits}) AS {to}) FROM ({out}) AS q"
        return f"SELECT id, epoch, W, lb, rb, (l << rb) + r AS x FROM ({out}) AS q"
    return f"""WITH RECURSIVE nt AS (SELECT sum({NTOK()}) AS N FROM documents WHERE {NB('text')}),
ww AS (SELECT CAST(greatest((N - 1) // {C.PACK_L}, 0) AS BIGINT) AS W FROM nt),
bb AS (SELECT W, greatest(2, length(bin(W - 1))) // 2 AS lb, greatest(2, length(bin(W - 1))) - greatest(2, length(bin(W - 1))) // 2 AS rb FROM ww),
ids AS (SELECT id, unnest(range({C.EPOCHS})) AS epoch, W, lb, rb, id AS x FROM (SELECT unnest(range(W)) AS id, * FROM bb) AS q),
walk AS ({rounds("SELECT * FROM ids")} UNION ALL {rounds("SELECT * FROM walk WHERE x >= W")}),
b AS (SELECT epoch, id AS window_id, x + 1 AS rank, x // {size} AS batch_idx, x % {size} AS slot, W // {size} AS nb FROM walk WHERE x < W),
sched AS (SELECT *, epoch * (nb // {accum}) + batch_idx // {accum} + 1 AS update_id FROM b WHERE batch_idx < nb)
{SCHEDULE_OUT}"""


def CHECKED(source: str, keys: str) -> str:
    """CTEs over ``source (keys, s)``: values with their own tests, kind after kind, as candidates and the parts between
    them that are put together again. The last one is ``checked (keys, s)``."""
    def quoted(p: str) -> str:
        return "'" + p.replace("'", "''") + "'"

    d = "regexp_replace(v, '[ -]', '', 'g')"
    luhn = (f"list_sum(list_transform(string_split(reverse({d}), ''), lambda c, i: "
            "CASE WHEN i % 2 = 0 THEN [0, 2, 4, 6, 8, 1, 3, 5, 7, 9][c::INTEGER + 1] ELSE c::INTEGER END)) % 10 = 0")
    turned = "(replace(v, ' ', '')[5:] || replace(v, ' ', '')[:4])"
    remainder = (f"list_reduce(list_concat([0], list_transform(string_split({turned}, ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' "
                 "THEN ascii(c) - 48 ELSE ascii(c) - 55 END)), lambda a, x: CASE WHEN x < 10 THEN (a * 10 + x) % 97 ELSE (a * 100 + x) % 97 END)")
    hexes, octet = checked.HEXES, checked.OCTET
    groups = "len(list_filter(string_split(v, ':'), lambda g: g <> ''))"
    valid = {
        "KEY": f"regexp_full_match(v, {quoted(checked.KEY_FORMS)})",
        "IBAN": f"length(replace(v, ' ', '')) BETWEEN 15 AND 34 AND regexp_full_match(v, {quoted(checked.IBAN_RUN)}) AND {remainder} = 1",
        "CARD": f"length({d}) BETWEEN 13 AND 19 AND regexp_full_match({d}, '[0-9]+') AND replace({d}, {d}[1], '') <> '' AND {luhn}",
        "SSN": f"regexp_full_match(v, {quoted(checked.SSN_FORM)})",
        "PHONE": f"regexp_full_match(v, {quoted(checked.PHONE_FORM)})",
        "IP": f"(regexp_full_match(v, '{octet}(?:\\.{octet}){{3}}') OR regexp_full_match(v, '{hexes}(?::{hexes}){{7}}') OR "
              f"(regexp_full_match(v, '(?:{hexes}(?::{hexes})*)?::(?:{hexes}(?::{hexes})*)?') AND {groups} BETWEEN 2 AND 7))",
    }
    secret = checked.SECRET_FORM
    out = f"s0 AS (SELECT {keys}, regexp_replace(s, {quoted(secret)}, '\\1[SECRET]', 'g') AS s FROM {source})"
    for k, c in enumerate(checked.CHECKED):
        ok, tag = valid[c.tag], f"'[{c.tag}]'"
        if c.tag == "IP":
            within = (f"list_transform([regexp_extract(v, '^(.*?)([.:]?)$', 1)], lambda w: CASE WHEN {ok.replace('(v,', '(w,')} "
                      f"THEN {tag} || substr(v, length(w) + 1) ELSE v END)[1]")
        else:
            within = f"array_to_string(list_transform(string_split(p, ' '), lambda v: CASE WHEN {ok} THEN {tag} ELSE v END), ' ')"
        out += f""",
c{k + 1} AS (SELECT {keys}, s, regexp_extract_all(s, {quoted(c.cut)}) AS parts FROM s{k}),
s{k + 1} AS (SELECT {keys}, CASE WHEN regexp_matches(s, {quoted(c.gate)}) THEN array_to_string(list_transform(parts, lambda p, i:
        CASE WHEN NOT regexp_full_match(p, {quoted(c.run)}) OR regexp_matches(coalesce(parts[i + 1], ''), '^[A-Za-z0-9]') THEN p
        ELSE list_transform([p], lambda v: CASE WHEN {ok} THEN {tag} ELSE {within} END)[1] END), '') ELSE s END AS s FROM c{k + 1})"""
    return f"{out},\nchecked AS (SELECT * FROM s{len(checked.CHECKED)})"


def REDACT_CHECKED() -> str:
    digits = "translate(md5(CAST(doc_id AS VARCHAR)), 'abcdef', '012345')"
    octets = " || '.' || ".join(f"(substr({digits}, {k}, 3)::INTEGER % 300)" for k in (1, 4, 7, 10))
    return f"""WITH t0 AS (SELECT doc_id, text || ' pay ' || substr({digits}, 1, 16) || ', ' || substr({digits}, 17, 3) || '-' || substr({digits}, 20, 2)
        || '-' || substr({digits}, 22, 4) || ' from ' || {octets} || '. password: ' || substr({digits}, 26, 7) AS s FROM documents WHERE {NB('text')}),
{CHECKED('t0', 'doc_id')}
SELECT doc_id, s AS text FROM checked"""


def NAMES() -> str:
    """Names planted into segments, a hidden Markov model counted from every other one, and the best tags by recursion over the words."""
    n_words, letters = C.SEGMENT_WORDS, "'0123456789abcdef', 'aeioubdklmnrstvz'"
    word, gap = r"[\p{L}\p{N}]+", r"[^\p{L}\p{N}]"
    sentence = rf"(?:{word}[^\p{{L}}\p{{N}}.!?\n]*)+{gap}*|{gap}+"

    def spelled(part: str, size: int) -> str:
        x = f"translate(substr(md5('{part}' || c_custkey), 1, {size}), {letters})"
        return f"upper({x}[1]) || {x}[2:]"

    def logs(c: str, cells: str, total: str) -> str:
        return f"({c} + 0.5) / ({total} + 0.5 * {cells})"

    moves = ", ".join(f"CASE WHEN {u} = 3 AND t IN (0, 1) OR t = 1 AND {u} IN (0, 1) THEN -1000000000 ELSE "
                      f"CAST(round(1000000 * ln({logs(f'to{u}', '4', '(to0 + to1 + to2 + to3)')})) AS BIGINT) END" for u in range(4))
    tos = ", ".join(f"count(*) FILTER (next = {u}) AS to{u}" for u in range(4))
    shape = rf"substr(regexp_replace(regexp_replace(regexp_replace(word, '\p{{Lu}}+', 'X', 'g'), '\p{{N}}+', '9', 'g'), '[\p{{Ll}}\p{{Lt}}\p{{Lm}}\p{{Lo}}]+', 'x', 'g'), 1, 3)"

    def shape_log(t: int) -> str:
        cells = "(kinds + n_often)" if t <= 1 else "kinds"
        return f"CAST(round(1000000 * (ln({logs(f'c{t}', cells, f'n{t}')}) - ln(greatest(1, {'rare' if t <= 1 else 'types'})))) AS BIGINT)"

    def word_log(t: int) -> str:
        return f"CAST(round(1000000 * ln({logs(f'w{t}', '(kinds + n_often)', f'n{t}')})) AS BIGINT)"

    codes = "['O', 'C', 'F', 'R']"
    return f"""WITH RECURSIVE {WEAK_PAIRS()},
people AS (SELECT c_custkey, {spelled('g', 5)} || ' ' || {spelled('f', 7)} AS name FROM customer),
np AS (SELECT greatest(count(*), 1) AS n FROM customer),
sg AS (SELECT doc_id, seg_idx, original_text AS s, string_split(original_text, ' ') AS w,
              ('0x' || substr(md5(doc_id || ':' || seg_idx), 1, 8))::BIGINT AS own FROM wp),
sk AS (SELECT sg.*, CASE WHEN own % {C.NAME_EVERY} = 0 THEN own // {C.NAME_EVERY} % n END AS k FROM sg, np),
rows AS MATERIALIZED (SELECT doc_id, seg_idx, k, name, CASE WHEN name IS NULL THEN s ELSE concat_ws(' ', array_to_string(w[1:8], ' '),
        ['from', 'by', 'Dear', 'Mr'][own // 1009 % 4 + 1], name, array_to_string(w[9:{n_words}], ' ')) END AS text FROM sk LEFT JOIN people ON c_custkey = k),
known AS (SELECT DISTINCT name FROM rows WHERE k % 2 = 0),
se AS MATERIALIZED (SELECT doc_id, seg_idx, j AS sent, ss[j] AS sentence, regexp_extract_all(ss[j], '{word}') AS ws
      FROM (SELECT doc_id, seg_idx, regexp_extract_all(text, '{sentence}') AS ss FROM rows) AS q, unnest(range(1, len(ss) + 1)) AS u(j)),
tk AS MATERIALIZED (SELECT doc_id, seg_idx, sent, p AS pos, ws[p] AS word, ws[p] || ' ' || ws[p + 1] AS pair FROM se, unnest(range(1, len(ws) + 1)) AS u(p)),
st AS (SELECT tk.*, name IS NOT NULL AS starts FROM tk LEFT JOIN known ON name = pair),
t1 AS (SELECT *, CASE WHEN lag(starts) OVER o THEN 3 WHEN starts THEN 2 ELSE 0 END AS raw FROM st
       WINDOW o AS (PARTITION BY doc_id, seg_idx, sent ORDER BY pos)),
t2 AS (SELECT *, CASE WHEN raw = 0 AND lead(raw) OVER o = 2 THEN 1 ELSE raw END AS t FROM t1 WINDOW o AS (PARTITION BY doc_id, seg_idx, sent ORDER BY pos)),
tw AS MATERIALIZED (SELECT *, lead(t) OVER (PARTITION BY doc_id, seg_idx, sent ORDER BY pos) AS next FROM t2),
tags AS (SELECT t FROM range(4) AS r(t)),
sums AS MATERIALIZED (SELECT tags.t, count(word) AS n, count(*) FILTER (pos = 1) AS starts, {tos} FROM tags LEFT JOIN tw USING (t) GROUP BY tags.t),
mv AS MATERIALIZED (SELECT t, [{moves}] AS m FROM sums),
s0 AS (SELECT t, CASE WHEN t = 3 THEN -1000000000 ELSE CAST(round(1000000 * ln({logs('starts', '4', '(SELECT sum(starts) FROM sums)')})) AS BIGINT) END AS s FROM sums),
wt AS (SELECT word, count(*) FILTER (t <= 1) AS plain, count(*) FILTER (t = 0) AS w0, count(*) FILTER (t = 1) AS w1,
              count(*) FILTER (t = 2) AS w2, count(*) FILTER (t = 3) AS w3 FROM tw GROUP BY word),
ft AS (SELECT word FROM wt WHERE plain >= 20 ORDER BY plain DESC, word LIMIT 50000),
ws_ AS MATERIALIZED (SELECT wt.*, ft.word IS NOT NULL AS often, {shape.replace('word', 'wt.word')} AS shape FROM wt LEFT JOIN ft USING (word)),
sh AS (SELECT shape, count(*) AS types, count(*) FILTER (NOT often) AS rare, coalesce(sum(w0) FILTER (NOT often), 0) AS c0, coalesce(sum(w1) FILTER (NOT often), 0) AS c1,
              sum(w2) AS c2, sum(w3) AS c3 FROM ws_ GROUP BY shape),
k_ AS (SELECT (SELECT count(*) + 1 FROM sh) AS kinds, (SELECT count(*) FROM ft) AS n_often, {', '.join(f'(SELECT n FROM sums WHERE t = {t}) AS n{t}' for t in range(4))}),
sl AS MATERIALIZED (SELECT shape, {', '.join(f'{shape_log(t)} AS e{t}' for t in range(4))} FROM sh, k_),
em AS MATERIALIZED (SELECT word, CASE WHEN ws_.often THEN {word_log(0)} ELSE e0 END AS e0, CASE WHEN ws_.often THEN {word_log(1)} ELSE e1 END AS e1, e2, e3
      FROM ws_ JOIN sl USING (shape), k_),
el AS MATERIALIZED (SELECT doc_id, seg_idx, sent, pos, [e0, e1, e2, e3] AS e FROM tk JOIN em USING (word)),
vt AS (SELECT doc_id, seg_idx, sent, 1 AS pos, t, s + e[t + 1] AS score, {codes}[t + 1] AS path FROM el, s0 WHERE pos = 1
       UNION ALL SELECT doc_id, seg_idx, sent, pos, t, b.s + e[t + 1], b.p || {codes}[t + 1] FROM (
         SELECT x.doc_id, x.seg_idx, x.sent, y.pos, u.t, any_value(y.e) AS e, max({{'s': x.score + mv.m[u.t + 1], 'p': x.path}}) AS b
         FROM vt AS x JOIN el AS y ON y.doc_id = x.doc_id AND y.seg_idx = x.seg_idx AND y.sent = x.sent AND y.pos = x.pos + 1
         JOIN mv ON mv.t = x.t, tags AS u GROUP BY x.doc_id, x.seg_idx, x.sent, y.pos, u.t) AS q),
best AS (SELECT doc_id, seg_idx, sent, max({{'s': score, 'p': path}}).p AS path FROM vt JOIN se USING (doc_id, seg_idx, sent) WHERE pos = len(ws) GROUP BY ALL),
told AS (SELECT doc_id, seg_idx, sent, CASE WHEN contains(path, 'F') THEN array_to_string(list_transform(range(1, len(ws) + 1), lambda i:
           CASE path[i] WHEN 'F' THEN '[NAME]' WHEN 'R' THEN '' ELSE ws[i] END
           || CASE WHEN path[i + 1] = 'R' THEN '' ELSE coalesce(regexp_extract_all(sentence, '{word}|{gap}+')[2 * i], '') END), '') ELSE sentence END AS s
         FROM se LEFT JOIN best USING (doc_id, seg_idx, sent)),
whole AS (SELECT doc_id, seg_idx, string_agg(s, '' ORDER BY sent) AS redacted FROM told GROUP BY ALL)
SELECT doc_id, CAST(seg_idx AS BIGINT) AS seg_idx, k % 2 = 0 AS known, name, coalesce(redacted, text) AS redacted FROM rows LEFT JOIN whole USING (doc_id, seg_idx)"""


def SPANS(source: str) -> str:
    """CTEs over ``source (k, side, raw, red)``: spans ``(k, side, lo, hi, tag)`` by the longest common subsequence of the words.

    One row of its table follows from the one above as a running maximum, since a match is never worse than its neighbours.
    """
    return f"""al AS (SELECT k, side, regexp_extract_all(raw, '{WORD_RE}') AS a, regexp_extract_all(red, '{WORD_RE}') AS b FROM {source} WHERE raw <> red),
lcs AS (SELECT k, side, a, b, 0 AS i, [list_transform(range(len(b) + 1), lambda x: 0)] AS t FROM al
        UNION ALL SELECT k, side, a, b, i + 1, list_append(t, list_concat([0], list_transform(range(1, len(b) + 1), lambda j: list_max(
            list_transform(range(1, j + 1), lambda h: CASE WHEN a[i + 1] = b[h] THEN t[i + 1][h] + 1 ELSE t[i + 1][h + 1] END)))))
        FROM lcs WHERE i < len(a)),
way AS (SELECT k, side, a, b, t, len(a) AS i, len(b) AS j, [{{'i': len(a), 'j': len(b)}}] AS p FROM lcs WHERE i = len(a)
        UNION ALL SELECT k, side, a, b, t, CASE WHEN t[i + 1][j + 1] = t[i][j + 1] OR a[i] = b[j] THEN i - 1 ELSE i END,
               CASE WHEN t[i + 1][j + 1] = t[i][j + 1] THEN j ELSE j - 1 END,
               CASE WHEN t[i + 1][j + 1] <> t[i][j + 1] AND a[i] = b[j] THEN list_prepend({{'i': i - 1, 'j': j - 1}}, p) ELSE p END
        FROM way WHERE i > 0 AND j > 0),
ends AS (SELECT k, side, b, list_prepend({{'i': -1, 'j': -1}}, p) AS p FROM way WHERE i = 0 OR j = 0),
gap AS (SELECT k, side, b, p[g] AS lo, p[g + 1] AS hi FROM ends, unnest(range(1, len(p))) AS u(g)),
spans AS (SELECT DISTINCT k, side, lo.i + 1 AS lo, hi.i AS hi, unnest(regexp_extract_all(array_to_string(b[lo.j + 2:hi.j], ' '), '\\[([A-Z]+)\\]', 1)) AS tag FROM gap)"""


def SPAN_AGREEMENT() -> str:
    return f"""WITH RECURSIVE {WEAK_PAIRS()},
raw AS (SELECT doc_id, seg_idx, original_text AS s FROM wp),
{CHECKED('raw', 'doc_id, seg_idx')},
both_sides AS (SELECT doc_id || ':' || seg_idx AS k, 'p' AS side, original_text AS raw, redacted_text AS red FROM wp
               UNION ALL SELECT wp.doc_id || ':' || wp.seg_idx, 't', original_text, s FROM wp JOIN checked USING (doc_id, seg_idx)),
{SPANS('both_sides')},
c AS (SELECT tag, side, count(*) AS n FROM spans GROUP BY ALL),
m AS (SELECT tag, count(*) AS n FROM spans AS x JOIN spans AS y USING (k, lo, hi, tag) WHERE x.side = 'p' AND y.side = 't' GROUP BY tag),
n AS (SELECT tag, CAST(coalesce(sum(n) FILTER (side = 'p'), 0) AS BIGINT) AS predicted, CAST(coalesce(sum(n) FILTER (side = 't'), 0) AS BIGINT) AS given
      FROM c GROUP BY tag)
SELECT tag, predicted, given, coalesce(m.n, 0) AS matched, round(coalesce(m.n, 0) / nullif(predicted, 0)::DOUBLE, 6) AS precision,
       round(coalesce(m.n, 0) / nullif(given, 0)::DOUBLE, 6) AS recall FROM n LEFT JOIN m USING (tag)"""


def SUBWORDS() -> str:
    """Byte-pair merges one at a time: the most frequent pair of the unit table, replaced in all units."""
    out = f"""w0 AS MATERIALIZED (SELECT array_to_string(list_transform(regexp_extract_all(hex(encode(unit)), '..'), lambda h: chr(('0x' || h)::INTEGER)), '') AS s,
        count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, ' ?{WORD_RE}|[ \\t\\n\\r\\f\\x0B]+')) AS unit FROM documents WHERE {NB('text')}) AS u GROUP BY ALL),
p0 AS (SELECT i AS id, printf('%02x', i) AS piece FROM range(256) AS r(i))"""
    for k in range(C.SUBWORD_MERGES):
        out += f""",
b{k} AS MATERIALIZED (SELECT pair, unicode(pair[1]) AS lo, unicode(pair[2]) AS hi FROM (
        SELECT substr(s, i, 2) AS pair, sum(n) AS n FROM w{k}, unnest(range(1, length(s))) AS t(i) GROUP BY 1) AS q
        WHERE n >= 2 ORDER BY n DESC, lo, hi LIMIT 1),
w{k + 1} AS MATERIALIZED (SELECT replace(s, pair, chr({257 + k})) AS s, n FROM w{k}, b{k} WHERE length(s) > 1),
p{k + 1} AS MATERIALIZED (SELECT * FROM p{k} UNION ALL SELECT {257 + k}, x.piece || y.piece FROM b{k} JOIN p{k} AS x ON x.id = lo JOIN p{k} AS y ON y.id = hi)"""
    rows = " UNION ALL ".join(f"SELECT {k} AS rank, lo, hi, {257 + k} AS id FROM b{k}" for k in range(C.SUBWORD_MERGES))
    return f"""WITH {out}
SELECT CAST(rank AS BIGINT) AS rank, CAST(lo AS BIGINT) AS lo, CAST(hi AS BIGINT) AS hi, CAST(m.id AS BIGINT) AS id, piece
FROM ({rows}) AS m JOIN p{C.SUBWORD_MERGES} USING (id)"""


def NGRAMS() -> str:
    """Held-out loss of the interpolated Kneser-Ney model of the training split."""
    order, base = C.NGRAM_ORDER, 258
    digits = " + ".join(f"coalesce(lag(w, {k}) OVER d + 1, 0) * {base ** (k - 1)}" for k in range(1, order)) or "0"
    out = f"""t AS (SELECT doc_id, ('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 2))::INTEGER < {256 - C.HOLDOUT} AS train, {ENC('text')} AS ids
      FROM documents WHERE {NB('text')}),
u AS (SELECT doc_id, train, unnest(ids) AS w, unnest(range(len(ids))) AS pos FROM t),
g AS (SELECT doc_id, train, w, CAST({digits} AS BIGINT) AS h FROM u WINDOW d AS (PARTITION BY doc_id ORDER BY pos)),
c{order} AS MATERIALIZED (SELECT h, w, count(*) AS c FROM g WHERE train GROUP BY ALL),
p0 AS (SELECT DISTINCT h, w, 1 / 257.0::DOUBLE AS p FROM g WHERE NOT train)"""
    for n in range(order - 1, 0, -1):
        out += f",\nc{n} AS MATERIALIZED (SELECT h % {base ** (n - 1)} AS h, w, count(*) AS c FROM c{n + 1} GROUP BY ALL)"
    for n in range(1, order + 1):
        out += f""",
x{n} AS (SELECT h, sum(c) AS total, count(*) AS types FROM c{n} GROUP BY h),
d{n} AS (SELECT count(*) FILTER (c = 1) / (count(*) FILTER (c = 1) + 2 * count(*) FILTER (c = 2))::DOUBLE AS d FROM c{n}),
p{n} AS MATERIALIZED (SELECT q.h, q.w, CASE WHEN total IS NULL THEN p ELSE greatest(coalesce(c, 0) - d, 0) / total + d * types / total * p END AS p
        FROM p{n - 1} AS q LEFT JOIN c{n} AS y ON y.h = q.h % {base ** (n - 1)} AND y.w = q.w LEFT JOIN x{n} AS x ON x.h = q.h % {base ** (n - 1)}, d{n})"""
    return f"""WITH {out}
SELECT doc_id, CAST(count(*) AS BIGINT) AS tokens, round(avg(-ln(p)), 6) AS nll
FROM g JOIN p{order} USING (h, w) WHERE NOT train GROUP BY doc_id"""


SCHEDULE_OUT = """SELECT CAST(epoch AS BIGINT) AS epoch, CAST(window_id AS BIGINT) AS window_id, CAST(rank AS BIGINT) AS rank,
       CAST(batch_idx AS BIGINT) AS batch_idx, CAST(slot AS BIGINT) AS slot, CAST(update_id AS BIGINT) AS update_id
FROM sched"""


CONV_PAIRS = """wp AS (SELECT u.conv_id AS doc_id, u.turn AS seg_idx, u.text AS original_text, a.text AS redacted_text
      FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
      WHERE u.role = 'user' AND a.role = 'assistant')"""


def SFT(L: int, uniform: bool, pairs: str | None = None) -> str:
    """Uniform or reference-length examples from a pairs CTE ``wp`` (default: weak pairs), as CTE ``sft``."""
    inp = f"list_slice(inp, 1, {L})" if uniform else "inp"
    tgt = f"list_slice(tgt, 1, {L})" if uniform else "tgt"
    return f"""{pairs or WEAK_PAIRS()},
se AS (SELECT doc_id, seg_idx, {ENC("'[RAW] ' || original_text || ' [REDACTED] '")} AS pi,
              {ENC(f"redacted_text || '{EOS}'")} AS ai FROM wp),
sf AS (SELECT doc_id, seg_idx, len(pi) AS prompt_len, list_concat(pi, ai) AS full0 FROM se),
sg AS (SELECT *, len(full0) AS full_len, len(full0) > {L + 1} AS overflow, list_slice(full0, 1, {L + 1}) AS fl FROM sf),
sh AS (SELECT *, list_concat(list_slice(fl, 2, len(fl)), [256]) AS t0 FROM sg),
si AS (SELECT *, list_transform(t0, lambda x, j: CASE WHEN j - 1 < prompt_len - 1 THEN -100 ELSE x END) AS t1 FROM sh),
sk AS (SELECT *, list_concat(fl, list_transform(range(greatest({L} - len(fl), 0)), lambda x: 256)) AS inp,
              list_concat(t1, list_transform(range(greatest({L} - len(fl), 0)), lambda x: -100)) AS tgt FROM si),
sft AS (SELECT doc_id, seg_idx, prompt_len, full_len, overflow, {inp} AS input, {tgt} AS target FROM sk)"""


def SFT_OUT() -> str:
    return """SELECT doc_id, CAST(seg_idx AS BIGINT) AS seg_idx, CAST(prompt_len AS BIGINT) AS prompt_len,
       CAST(full_len AS BIGINT) AS full_len, overflow, md5(array_to_string(input, ',')) AS input_md5,
       md5(array_to_string(target, ',')) AS target_md5, CAST(len(input) AS BIGINT) AS input_len,
       CAST(len(list_filter(target, lambda x: x <> -100)) AS BIGINT) AS scored FROM sft"""


def VOCAB() -> str:
    return f"""vw AS (SELECT unnest(regexp_extract_all(text, '{WORD_RE}')) AS token FROM documents WHERE {NB('text')}),
vc AS (SELECT token, count(*) AS freq FROM vw GROUP BY token),
vt AS (SELECT token, freq FROM vc ORDER BY freq DESC, token LIMIT {C.VOCAB_SIZE - 2}),
V AS (SELECT token, row_number() OVER (ORDER BY freq DESC, token) + 1 AS id, freq FROM vt)"""


def CANDIDATES_WORDS() -> str:
    return f"""{VOCAB()},
cw_p AS (SELECT doc_id, regexp_extract_all(text, '{WORD_RE}') AS w FROM documents WHERE {NB('text')}),
cw_u AS (SELECT doc_id, unnest(w) AS token, unnest(range(len(w))) AS pos FROM cw_p),
cw_i AS (SELECT doc_id, pos, coalesce(V.id, 0) AS id FROM cw_u LEFT JOIN V USING (token)),
cand AS (SELECT x.id AS prev, y.id AS item, ln(count(*)) AS score FROM cw_i x
         JOIN cw_i y ON x.doc_id = y.doc_id AND y.pos = x.pos + 1 GROUP BY 1, 2)"""


def FILTERED(T: float, k: int, p: float | None) -> str:
    """temperature -> top-k (ties kept) -> [top-p on re-normalized mass] -> softmax, as CTE ``fin``."""
    top_p = (f"""fp AS (SELECT * FROM (SELECT *, round(coalesce(sum(p0) OVER (PARTITION BY prev ORDER BY score DESC, item
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 9) AS before FROM fq2) WHERE before <= {p}),"""
             if p is not None else "fp AS (SELECT * FROM fq2),")
    return f"""ft AS (SELECT prev, item, score / {T} AS score FROM cand),
fk AS (SELECT * FROM (SELECT *, rank() OVER (PARTITION BY prev ORDER BY score DESC) AS rk FROM ft) WHERE rk <= {k}),
fq AS (SELECT *, exp(score - max(score) OVER (PARTITION BY prev)) AS e FROM fk),
fq2 AS (SELECT *, e / sum(e) OVER (PARTITION BY prev) AS p0 FROM fq),
{top_p}
ff AS (SELECT prev, item, score, exp(score - max(score) OVER (PARTITION BY prev)) AS e2 FROM fp),
fin AS (SELECT prev, item, score, e2 / sum(e2) OVER (PARTITION BY prev) AS prob FROM ff)"""


def DRAW(seed: int) -> str:
    return f"""dc AS (SELECT prev, item, round(sum(prob) OVER (PARTITION BY prev ORDER BY score DESC, item
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 9) AS cum,
              row_number() OVER (PARTITION BY prev ORDER BY score DESC, item) AS pos,
              ('0x' || substr(md5('{seed}|' || prev), 1, 8))::BIGINT / 4294967296.0 AS u FROM fin),
drawn AS (SELECT prev, coalesce(arg_min(CASE WHEN cum > u THEN item END, CASE WHEN cum > u THEN pos END),
                                arg_max(item, pos)) AS drawn FROM dc GROUP BY prev)"""


def WHOLE(c: str) -> str:
    """md5 of a vector's values in whole ten-thousandths."""
    return f"md5(array_to_string(list_transform({c}, lambda a: CAST(round(a * 10000) AS BIGINT)), ','))"


def UNIT_VECTORS() -> str:
    return """uv_x AS (SELECT vec_id, label, list_transform(embedding, lambda a: CAST(a AS DOUBLE)) AS x FROM embeddings),
uv_i AS (SELECT vec_id, label, x, 1.0 / sqrt(list_sum(list_transform(x, lambda a: a * a)) / len(x) + 1e-6) AS inv FROM uv_x),
uv AS (SELECT vec_id, label, list_transform(x, lambda a: a * inv) AS nx FROM uv_i)"""


def _q() -> dict[str, str]:
    nb = NB("text")
    q: dict[str, str] = {}
    tag_rows = " UNION ALL ".join(
        f"SELECT '{r.tag}' AS tag, len(regexp_extract_all(red, '\\[{r.tag}\\]')) - "
        f"len(regexp_extract_all(text, '\\[{r.tag}\\]')) AS hits, "
        f"len(regexp_extract_all(red, '{r.pattern}')) AS residual FROM d" for r in DEFAULT_RULES)
    q["pii_tag_counts"] = f"""WITH d AS (SELECT text, {RULES('text')} AS red FROM documents WHERE {nb}),
t AS ({tag_rows})
SELECT tag, CAST(sum(hits) AS BIGINT) AS hits, CAST(sum(CASE WHEN hits > 0 THEN 1 ELSE 0 END) AS BIGINT) AS docs,
       CAST(sum(residual) AS BIGINT) AS residual FROM t GROUP BY tag"""
    q["redact_documents"] = f"SELECT doc_id, {RULES('text')} AS text FROM documents"
    q["scrub_documents"] = f"""WITH f AS (SELECT doc_id, text, {FULL_OUTPUT()} AS o FROM documents)
SELECT doc_id, CASE WHEN {nb} THEN 'ok' ELSE 'blank' END AS status,
       CASE WHEN {nb} THEN {EXTRACT('o')} ELSE 'Please enter text to redact.' END AS scrubbed FROM f"""
    q["scrub_hook"] = f"""WITH f AS (SELECT doc_id, text, {FULL_OUTPUT()} AS o FROM documents)
SELECT doc_id, CASE WHEN {nb} THEN {EXTRACT('o')} END AS scrubbed FROM f"""
    q["scrub_hook_chunked"] = f"""WITH {WEAK_PAIRS()},
pred AS (SELECT doc_id, string_agg({STRIP('redacted_text')}, ' ' ORDER BY seg_idx) AS scrubbed FROM wp GROUP BY doc_id)
SELECT doc_id, {STRIP('scrubbed')} AS scrubbed FROM documents LEFT JOIN pred USING (doc_id)"""
    q["redact_stream"] = f"SELECT doc_id, {RULES('text')} AS text FROM documents"
    # list steps: runs, candidate places by first word, the longest at each place, a left-to-right choice, rebuilding
    def frequent(pattern: str, tag: str) -> str:
        return f"""SELECT term, '{tag}' AS tag FROM (SELECT unnest(regexp_extract_all(text, '{pattern}')) AS term
        FROM documents WHERE {nb}) AS f GROUP BY term ORDER BY count(*) DESC, term LIMIT {C.FREQUENT_TERMS}"""
    q["redact_terms"] = f"""WITH raw AS (SELECT c_name AS term, 'NAME' AS tag FROM customer UNION ALL SELECT n_name, 'PLACE' FROM nation
        UNION ALL (SELECT * FROM ({frequent('[A-Za-z]{6,}', 'WORD')}) AS a)
        UNION ALL (SELECT * FROM ({frequent('[A-Za-z]{3,} [A-Za-z]{3,}', 'PHRASE')}) AS b)),
tp AS (SELECT list_transform(regexp_extract_all(term, '[\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+'),
         lambda x: regexp_replace(x, '\\s+', ' ', 'g')) AS p, tag FROM raw),
tw AS (SELECT array_to_string(list_slice(p, CASE WHEN regexp_matches(p[1], '[\\p{{L}}\\p{{N}}]') THEN 1 ELSE 2 END,
         len(p) - CASE WHEN regexp_matches(p[-1], '[\\p{{L}}\\p{{N}}]') THEN 0 ELSE 1 END), '') AS norm, tag FROM tp),
terms AS MATERIALIZED (SELECT norm, regexp_extract(norm, '^[\\p{{L}}\\p{{N}}]+') AS first,
         len(regexp_extract_all(norm, '[\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+')) AS n, min(tag) AS tag
         FROM tw WHERE regexp_matches(norm, '[\\p{{L}}\\p{{N}}]') GROUP BY norm),
d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+') AS p FROM documents),
u AS MATERIALIZED (SELECT doc_id, unnest(p) AS part, unnest(range(1, len(p) + 1)) AS i FROM d),
c AS (SELECT u.doc_id, u.i, terms.n, terms.tag FROM u JOIN terms ON u.part = terms.first JOIN d ON d.doc_id = u.doc_id
      WHERE regexp_replace(array_to_string(d.p[u.i:u.i + terms.n - 1], ''), '\\s+', ' ', 'g') = terms.norm
        AND len(d.p) >= u.i + terms.n - 1),
best AS (SELECT doc_id, i, max(n) AS n, arg_max(tag, n) AS tag FROM c GROUP BY doc_id, i),
h AS (SELECT doc_id, list({{'i': i, 'n': n, 'tag': tag}} ORDER BY i) AS hits FROM best GROUP BY doc_id),
k AS (SELECT doc_id, unnest(list_reduce(list_transform(hits, lambda x: [x]),
        lambda a, x: CASE WHEN x[1].i >= a[-1].i + a[-1].n THEN list_concat(a, x) ELSE a END)) AS hit FROM h),
m AS (SELECT doc_id, hit.i AS i, hit.tag AS tag, unnest(range(hit.i, hit.i + hit.n)) AS j FROM k),
r AS (SELECT u.doc_id, string_agg(CASE WHEN m.j IS NULL THEN part WHEN m.j = m.i THEN '[' || tag || ']' ELSE '' END, '' ORDER BY u.i) AS text
      FROM u LEFT JOIN m ON m.doc_id = u.doc_id AND m.j = u.i GROUP BY u.doc_id)
SELECT d.doc_id, coalesce(r.text, d.text) AS text FROM documents d LEFT JOIN r USING (doc_id)"""
    q["redact_terms_join"] = q["redact_terms"]
    q["weak_pairs"] = f"""WITH {WEAK_PAIRS()}
SELECT doc_id, CAST(seg_idx AS BIGINT) AS seg_idx, original_text, redacted_text FROM wp"""
    q["segment_agreement"] = f"""WITH {WEAK_PAIRS()},
pred AS (SELECT doc_id, string_agg(redacted_text, ' ' ORDER BY seg_idx) AS pred FROM wp GROUP BY doc_id),
tw AS (SELECT doc_id, array_to_string(regexp_extract_all(text, '{WORD_RE}'), ' ') AS t FROM documents WHERE {nb}),
tgt AS (SELECT doc_id, {RULES('t')} AS target FROM tw),
j AS (SELECT CASE WHEN pred = target THEN 1.0 ELSE 0.0 END AS eq FROM pred JOIN tgt USING (doc_id))
SELECT CAST(count(*) AS BIGINT) AS pairs, CAST(sum(eq) AS BIGINT) AS matches, round(avg(eq), 6) AS rate FROM j"""
    q["conversation_pairs"] = """SELECT u.conv_id, u.turn, u.text AS original_text, a.text AS redacted_text
FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
WHERE u.role = 'user' AND a.role = 'assistant'"""
    q["pair_load"] = """SELECT u.conv_id || ':' || u.turn AS pair_id, u.text AS original_text, a.text AS redacted_text,
       md5(u.text) AS renamed_md5
FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
WHERE u.role = 'user' AND a.role = 'assistant'"""
    q["edge_rows"] = f"""WITH e AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN ' ' || chr(9) || chr(10) || chr(28)
         WHEN doc_id % 13 = 0 THEN NULL
         WHEN doc_id % 7 = 0 THEN '{EOS}' || left(text, 40) || '{EOS}' || text ELSE text END AS text FROM documents)
SELECT doc_id, CASE WHEN {nb} THEN 'ok' ELSE 'blank' END AS status,
       CAST(len(string_split(text, '{EOS}')) - 1 AS BIGINT) AS n_special, {FP(ENC('text'))} AS ids_md5 FROM e"""

    q["encode_bytes"] = f"""WITH d AS (SELECT doc_id, text, {ENC('text')} AS ids FROM documents WHERE {nb})
SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_tokens,
       CAST(len(string_split(text, '{EOS}')) - 1 AS BIGINT) AS n_special, {FP('ids')} AS ids_md5 FROM d"""
    q["decode_roundtrip"] = f"""SELECT doc_id, decode(unhex(array_to_string(list_transform({ENC('text')},
       lambda i: CASE WHEN i = 256 THEN hex('{EOS}') ELSE lpad(hex(i), 2, '0') END), ''))) AS text
FROM documents WHERE {nb}"""
    q["token_stats"] = f"""SELECT lang, count(*) AS docs, CAST(sum(n) AS BIGINT) AS tokens, CAST(min(n) AS BIGINT) AS min_tokens,
       CAST(max(n) AS BIGINT) AS max_tokens
FROM (SELECT lang, {NTOK()} - 1 AS n FROM documents WHERE {nb}) GROUP BY lang"""
    vocab = VOCAB()
    q["build_vocab"] = f"""WITH {vocab}
SELECT token, CAST(id AS BIGINT) AS id, CAST(freq AS BIGINT) AS freq FROM V"""
    q["vocab_summary"] = f"""WITH {vocab}
SELECT CAST(256 AS BIGINT) AS byte_eos, CAST(257 AS BIGINT) AS byte_size, CAST(1 AS BIGINT) AS word_eos,
       count(*) AS word_size FROM V"""
    words_pos = f"""p AS (SELECT doc_id, regexp_extract_all(text, '{WORD_RE}') AS w FROM documents WHERE {nb}),
u AS (SELECT doc_id, unnest(w) AS token, unnest(range(len(w))) AS pos FROM p)"""
    q["encode_vocab"] = f"""WITH {vocab}, {words_pos},
e AS (SELECT doc_id, string_agg(CAST(coalesce(V.id, 0) AS VARCHAR), ',' ORDER BY pos) AS s, count(*) AS n,
             sum(CASE WHEN V.id IS NULL THEN 1 ELSE 0 END) AS unk FROM u LEFT JOIN V USING (token) GROUP BY doc_id)
SELECT p.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_tokens, CAST(coalesce(unk, 0) AS BIGINT) AS n_unk,
       md5(coalesce(s, '')) AS ids_md5 FROM p LEFT JOIN e USING (doc_id)"""
    q["decode_vocab"] = f"""WITH {vocab}, {words_pos},
t AS (SELECT doc_id, string_agg(CASE WHEN V.id IS NULL THEN '<unk>' ELSE u.token END, ' ' ORDER BY pos) AS text
      FROM u LEFT JOIN V USING (token) GROUP BY doc_id)
SELECT doc_id, coalesce(t.text, '') AS text FROM p LEFT JOIN t USING (doc_id)"""
    q["encode_vocab_join"], q["decode_vocab_join"] = q["encode_vocab"], q["decode_vocab"]

    q["doc_offsets"] = f"""WITH d AS (SELECT doc_id, {NTOK()} AS n FROM documents WHERE {nb})
SELECT doc_id, CAST(n AS BIGINT) AS n,
       CAST(coalesce(sum(n) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
FROM d"""
    q["pack_windows"] = PACK("documents", "doc_id", C.PACK_L)
    q["pack_benchmark"] = PACK("benchmark", "item_id", C.SMALL_L)
    L = C.PACK_L
    q["corpus_summary"] = f"""WITH d AS (SELECT {NTOK()} AS n FROM documents WHERE {nb}),
s AS (SELECT count(*) AS docs, coalesce(sum(n), 0) AS N FROM d)
SELECT docs, CAST(N AS BIGINT) AS tokens, CAST(greatest((N - 1) // {L}, 0) AS BIGINT) AS windows,
       CAST(greatest(N - (greatest((N - 1) // {L}, 0) * {L} + 1), 0) AS BIGINT) AS tail FROM s"""
    q["corpus_split"] = f"""SELECT CASE WHEN ('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 2))::INTEGER < {256 - C.HOLDOUT}
       THEN 'train' ELSE 'holdout' END AS split, count(*) AS docs FROM documents WHERE {nb} GROUP BY 1"""
    q["cap_corpus"] = f"SELECT doc_id, n_chars FROM documents WHERE {nb} ORDER BY doc_id LIMIT {C.CAP_N}"

    q["shuffle_batches"] = f"WITH {SCHEDULE()}\n{SCHEDULE_OUT}"
    q["step_budget"] = f"WITH {SCHEDULE(C.STEP_BUDGET)}\n{SCHEDULE_OUT} WHERE update_id <= {C.STEP_BUDGET}"
    q["permuted_batches"] = PERMUTED()
    epochs = ", ".join(str(e) for e in range(C.EPOCHS))
    q["shuffle_batches_keep_last"] = f"""WITH {WEAK_PAIRS()},
x AS (SELECT doc_id || ':' || seg_idx AS example_id, unnest([{epochs}]) AS epoch FROM wp),
y AS (SELECT *, row_number() OVER (PARTITION BY epoch ORDER BY md5('{C.SEED}|' || epoch || '|' || example_id), example_id) AS rank,
             count(*) OVER (PARTITION BY epoch) AS n FROM x)
SELECT CAST(epoch AS BIGINT) AS epoch, example_id, rank, (rank - 1) // {C.BATCH} AS batch_idx, (rank - 1) % {C.BATCH} AS slot,
       CAST(epoch * ((n + {C.BATCH - 1}) // {C.BATCH}) + (rank - 1) // {C.BATCH} + 1 AS BIGINT) AS update_id FROM y"""
    q["collate_batches"] = f"""WITH {STREAM()}, {SCHEDULE()},
i AS (SELECT gp // {L} AS w, string_agg(CAST(tok AS VARCHAR), ',' ORDER BY gp) AS s FROM g GROUP BY 1),
o AS (SELECT (gp - 1) // {L} AS w, string_agg(CAST(tok AS VARCHAR), ',' ORDER BY gp) AS s FROM g WHERE gp >= 1 GROUP BY 1)
SELECT CAST(epoch AS BIGINT) AS epoch, CAST(batch_idx AS BIGINT) AS batch_idx, CAST(count(*) AS BIGINT) AS n,
       md5(string_agg(CAST(window_id AS VARCHAR), ',' ORDER BY slot)) AS ids_md5,
       md5(string_agg(i.s, ',' ORDER BY slot)) AS input_md5, md5(string_agg(o.s, ',' ORDER BY slot)) AS target_md5
FROM sched JOIN i ON i.w = window_id JOIN o ON o.w = window_id GROUP BY epoch, batch_idx"""
    q["last_tokens"] = f"""WITH d AS (SELECT doc_id, {ENC('text')} AS ids FROM documents WHERE {nb}),
t AS (SELECT doc_id, list_slice(ids, greatest(len(ids) - {L}, 0) + 1, len(ids)) AS t FROM d)
SELECT doc_id, CAST(len(t) AS BIGINT) AS n, {FP('t')} AS ids_md5 FROM t"""
    q["cut_generated"] = f"""WITH {WEAK_PAIRS()},
e AS (SELECT doc_id, seg_idx, {ENC("'[RAW] ' || original_text || ' [REDACTED] '")} AS pi,
             {ENC(f"redacted_text || '{EOS}'")} AS ai FROM wp),
f AS (SELECT doc_id, seg_idx, len(pi) AS pl, list_concat(pi, ai) AS fl FROM e),
gg AS (SELECT doc_id, seg_idx, pl, fl, list_slice(fl, pl + 1, len(fl)) AS gen FROM f),
h AS (SELECT doc_id, seg_idx, list_concat(list_slice(fl, 1, pl), list_slice(gen, 1,
        CASE WHEN coalesce(list_position(gen, 256), 0) > 0 THEN least(list_position(gen, 256), {C.MAX_NEW})
             ELSE {C.MAX_NEW} END)) AS cut FROM gg)
SELECT doc_id, CAST(seg_idx AS BIGINT) AS seg_idx, CAST(len(cut) AS BIGINT) AS n, {FP('cut')} AS ids_md5 FROM h"""

    q["sft_examples"] = f"WITH {SFT(C.SFT_L, True)}\n{SFT_OUT()}"
    q["sft_examples_reference"] = f"WITH {SFT(C.SFT_L, False)}\n{SFT_OUT()}"
    q["conversation_examples"] = f"""WITH {SFT(C.SFT_L, True, CONV_PAIRS)}
SELECT doc_id AS conv_id, seg_idx AS turn, CAST(prompt_len AS BIGINT) AS prompt_len, CAST(full_len AS BIGINT) AS full_len,
       overflow, md5(array_to_string(input, ',')) AS input_md5, md5(array_to_string(target, ',')) AS target_md5,
       CAST(len(list_filter(target, lambda x: x <> -100)) AS BIGINT) AS scored FROM sft"""
    q["sft_audit"] = f"""WITH {SFT(C.SFT_L, True)},
a AS (SELECT overflow, len(input) AS n, len(list_filter(target, lambda x: x <> -100)) AS s FROM sft)
SELECT overflow, CAST(count(*) AS BIGINT) AS examples, CAST(sum(CASE WHEN s = 0 THEN 1 ELSE 0 END) AS BIGINT) AS all_masked,
       CAST(sum(s) AS BIGINT) AS scored, CAST(min(n) AS BIGINT) AS min_len, CAST(max(n) AS BIGINT) AS max_len
FROM a GROUP BY overflow"""

    q["byte_bigrams"] = f"""WITH {PAIRS_MODEL()}
SELECT CAST(prev AS BIGINT) AS prev, CAST(nxt AS BIGINT) AS next, CAST(c AS BIGINT) AS count FROM cnt"""
    q["next_token_probs"] = f"""WITH {CANDIDATES_WORDS()}, {FILTERED(C.TEMPERATURE, C.TOP_K, C.TOP_P)}
SELECT CAST(prev AS BIGINT) AS prev, CAST(item AS BIGINT) AS item, round(prob, 6) AS prob FROM fin"""
    q["next_token_nucleus"] = f"""WITH {CANDIDATES_WORDS()}, {FILTERED(C.TEMPERATURE, 1_000_000_000, C.TOP_P)}
SELECT CAST(prev AS BIGINT) AS prev, CAST(item AS BIGINT) AS item, round(prob, 6) AS prob FROM fin"""
    q["conversation_stream"] = f"""WITH m AS (SELECT conv_id, string_agg(
        CASE WHEN turn > 0 THEN '555-' || lpad(CAST(conv_id % 10000 AS VARCHAR), 4, '0') || ' ' ELSE '' END || coalesce(text, '') || ' call +1 (' || (turn + 200) || ')',
        ' ' ORDER BY turn) AS text FROM conversations GROUP BY conv_id)
SELECT conv_id, {RULES('text')} AS text FROM m"""
    q["batch_rows"] = f"""WITH {STREAM()}, {SCHEDULE()},
i AS (SELECT gp // {C.PACK_L} AS w, string_agg(CAST(tok AS VARCHAR), ',' ORDER BY gp) AS s FROM g GROUP BY 1),
o AS (SELECT (gp - 1) // {C.PACK_L} AS w, string_agg(CAST(tok AS VARCHAR), ',' ORDER BY gp) AS s FROM g WHERE gp >= 1 GROUP BY 1)
SELECT CAST(epoch AS BIGINT) AS epoch, CAST(batch_idx AS BIGINT) AS batch_idx, CAST(slot AS BIGINT) AS slot, CAST(update_id AS BIGINT) AS update_id,
       CAST(window_id AS BIGINT) AS window_id, md5(i.s) AS input_md5, md5(o.s) AS target_md5
FROM sched JOIN i ON i.w = window_id JOIN o ON o.w = window_id"""
    q["ngram_loss"] = NGRAMS()
    q["redact_checked"] = REDACT_CHECKED()
    q["span_agreement"] = SPAN_AGREEMENT()
    q["redact_names"] = NAMES()
    q["subword_vocab"] = SUBWORDS()
    q["subword_roundtrip"] = "SELECT doc_id, coalesce(text, '') AS text FROM documents"
    q["next_token_sample"] = f"""WITH {CANDIDATES_WORDS()}, {FILTERED(C.TEMPERATURE, C.TOP_K, C.TOP_P)}, {DRAW(C.SEED)}
SELECT CAST(prev AS BIGINT) AS prev, CAST(drawn AS BIGINT) AS drawn FROM drawn"""
    q["window_loss"] = f"""WITH {PAIRS_MODEL()}
SELECT CAST(w AS BIGINT) AS window_id, CAST(tokens AS BIGINT) AS tokens, round(nll, 6) AS nll FROM wl"""
    q["corpus_loss"] = f"""WITH {PAIRS_MODEL()}
SELECT CAST(count(*) AS BIGINT) AS tokens, round(avg(-lp), 6) AS nll, round(exp(avg(-lp)), 4) AS perplexity
FROM pp JOIN lp USING (prev, nxt)"""
    q["sft_loss"] = f"""WITH {PAIRS_MODEL()}, {SFT(C.SFT_L, True)},
x AS (SELECT overflow, unnest(input) AS prev, unnest(target) AS nxt FROM sft),
y AS (SELECT overflow, prev, nxt FROM x WHERE nxt <> -100),
s AS (SELECT y.overflow, coalesce(lp.lp, ln(1.0 / (ct.cp + 257.0)), ln(1.0 / 257)) AS l
      FROM y LEFT JOIN lp ON y.prev = lp.prev AND y.nxt = lp.nxt LEFT JOIN ct ON y.prev = ct.prev),
agg AS (SELECT overflow, count(*) AS tokens, sum(-l) AS tot FROM s GROUP BY overflow),
grp AS (SELECT DISTINCT overflow FROM sft)
SELECT grp.overflow, CAST(coalesce(tokens, 0) AS BIGINT) AS tokens, round(tot / nullif(tokens, 0), 6) AS nll
FROM grp LEFT JOIN agg USING (overflow)"""
    q["event_log_sample"] = f"""SELECT event_type, event_id, CAST(step AS BIGINT) AS step, value FROM (
  SELECT event_type, event_id, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS step FROM events)
WHERE step % {C.LOG_EVERY} = 0 OR step = 1"""
    q["event_log_sample_zero"] = f"""SELECT event_type, event_id, CAST(step AS BIGINT) AS step, value FROM (
  SELECT event_type, event_id, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS step FROM events)
WHERE step % {C.LOG_EVERY} = 0"""

    q["rms_vectors"] = f"""WITH {UNIT_VECTORS()}
SELECT vec_id, CAST(label AS BIGINT) AS label, round(nx[1], 6) AS first,
       round(list_sum(list_transform(nx, lambda a: abs(a))), 6) AS abs_sum, {WHOLE('nx')} AS vector_md5 FROM uv"""
    q["doc_vectors"] = f"""WITH {UNIT_VECTORS()},
c AS (SELECT conv_id, turn, id, count(*) AS cnt FROM (SELECT conv_id, turn, unnest({ENC('text')}) AS id FROM conversations)
      GROUP BY 1, 2, 3),
cv AS (SELECT c.conv_id, c.turn, c.cnt, uv.nx FROM c LEFT JOIN uv ON c.id = uv.vec_id),
t AS (SELECT conv_id, turn, sum(CASE WHEN nx IS NULL THEN 0 ELSE cnt END) AS tokens,
             sum(CASE WHEN nx IS NULL THEN cnt ELSE 0 END) AS missing FROM cv GROUP BY 1, 2),
e AS (SELECT conv_id, turn, cnt, unnest(nx) AS val, unnest(range(1, len(nx) + 1)) AS dim FROM cv),
s AS (SELECT conv_id, turn, dim, sum(val * cnt) AS sv FROM e GROUP BY 1, 2, 3),
p AS (SELECT s.conv_id, s.turn, list(sv / tokens ORDER BY dim) AS pv FROM s JOIN t USING (conv_id, turn) GROUP BY 1, 2)
SELECT c.conv_id, c.turn, CAST(coalesce(tokens, 0) AS BIGINT) AS tokens, CAST(coalesce(missing, 0) AS BIGINT) AS missing,
       round(pv[1], 6) AS first, round(list_sum(pv), 6) AS total, {WHOLE('pv')} AS pooled_md5
FROM conversations c LEFT JOIN t USING (conv_id, turn) LEFT JOIN p USING (conv_id, turn)"""
    q["gather_vectors"] = f"""WITH {UNIT_VECTORS()},
b AS (SELECT item_id, {ENC('text')} AS ids FROM benchmark),
e AS (SELECT item_id, unnest(ids) AS id, unnest(range(1, len(ids) + 1)) AS pos FROM b),
v AS (SELECT item_id, flatten(list(nx ORDER BY pos)) AS nx, count(*) AS n, arg_min(nx[1], pos) AS first, arg_max(nx[1], pos) AS last
      FROM e LEFT JOIN uv ON uv.vec_id = e.id GROUP BY item_id)
SELECT b.item_id, CAST(coalesce(n, 0) AS BIGINT) AS n, round(first, 6) AS first, round(last, 6) AS last,
       {WHOLE('nx')} AS vectors_md5 FROM b LEFT JOIN v USING (item_id)"""
    q["gather_pieces"] = f"""WITH {UNIT_VECTORS()},
b AS (SELECT conv_id, turn, {ENC('text')} AS ids FROM conversations),
e AS (SELECT conv_id, turn, unnest(ids) AS id, unnest(range(len(ids))) AS pos FROM b),
v AS (SELECT conv_id, turn, pos // {C.PIECE} AS piece, flatten(list(nx ORDER BY pos)) AS nx, count(*) AS n
      FROM e LEFT JOIN uv ON uv.vec_id = e.id GROUP BY ALL)
SELECT conv_id, turn, CAST(piece AS BIGINT) AS piece, CAST(n AS BIGINT) AS n, {WHOLE('nx')} AS vectors_md5 FROM v"""
    q["append_drawn"] = f"""WITH {PAIRS_MODEL()},
cand AS (SELECT prev, nxt AS item, ln(c) AS score FROM cnt),
{FILTERED(C.CHAT_TEMPERATURE, C.CHAT_TOP_K, None)},
dc AS (SELECT prev, item, round(sum(prob) OVER (PARTITION BY prev ORDER BY score DESC, item), 9) AS cum,
              row_number() OVER (PARTITION BY prev ORDER BY score DESC, item) AS pos FROM fin),
d AS (SELECT doc_id, {ENC('text')} AS ids, ('0x' || substr(md5('{C.CHAT_SEED}|' || doc_id), 1, 8))::BIGINT / 4294967296.0 AS u
      FROM documents WHERE {nb}),
drawn AS (SELECT doc_id, coalesce(arg_min(CASE WHEN cum > u THEN item END, CASE WHEN cum > u THEN pos END), arg_max(item, pos)) AS drawn
          FROM d JOIN dc ON dc.prev = ids[-1] GROUP BY doc_id)
SELECT doc_id, CAST(len(ids) + CASE WHEN drawn IS NULL THEN 0 ELSE 1 END AS BIGINT) AS n, CAST(coalesce(drawn, ids[-1]) AS BIGINT) AS last,
       md5(array_to_string(CASE WHEN drawn IS NULL THEN ids ELSE list_append(ids, drawn) END, ',')) AS ids_md5
FROM d LEFT JOIN drawn USING (doc_id)"""
    return q


ORACLE_SQL: dict[str, str] = _q()
