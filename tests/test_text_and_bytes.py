"""P1/P5 blank semantics and T1/T2/T5 byte codec."""


import pytest
from pyspark.sql import functions as F

from tessera.functions.bytes import (EOS_ID, decode_ids, encode_ids, encoded_length, ids_fingerprint, join_packed,
                                     pack_ids, unpack_ids)
from tessera.functions.text import nonblank, py_strip
from tessera.operators.corpus import drop_blank, scrub_status
from tessera.operators.tokens import count_special


def test_nonblank_matches_python_isspace(spark):
    # every code point up to U+3000 as a one-character text
    chars = [chr(i) for i in range(1, 0x3001) if not (0xD800 <= i <= 0xDFFF)]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(chars)], "i int, t string")
    got = {r.i: r.nb for r in df.select("i", nonblank("t").alias("nb")).collect()}
    for i, c in enumerate(chars):
        assert got[i] == bool(c.strip()), hex(ord(c))


def test_drop_blank_edge_rows(spark):
    rows = ["", " ", "\n\t", " ", "\u001c", "　", None, " x "]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id int, text string")
    kept = drop_blank(df).collect()
    assert [(r.doc_id, r.text) for r in kept] == [(7, " x ")]  # kept verbatim, not stripped
    status = {r.doc_id: r.status for r in scrub_status(df).collect()}
    assert status[7] == "ok" and all(status[i] == "blank" for i in range(7))


def test_py_strip(spark):
    rows = ["  a b　\n", "\u001cx\u001f", "", "   "]
    df = spark.createDataFrame([(t,) for t in rows], "t string")
    got = [r[0] for r in df.select(py_strip("t")).collect()]
    assert got == [t.strip() for t in rows]


def test_encode_decode_roundtrip_and_special(spark):
    texts = ["a<|endoftext|>é", "<|endoftext|>", "", "plain ascii", "日本語 ✓ 𝄞", "x<|endoftext|><|endoftext|>y"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    out = df.select("i", "text", encode_ids("text").alias("ids"),
                    encoded_length("text").alias("n")).withColumn("back", decode_ids("ids"))
    rows = {r.i: r for r in out.collect()}
    assert rows[0].ids == [97, EOS_ID, 195, 169]
    assert rows[1].ids == [EOS_ID]
    assert rows[2].ids == []
    for i, t in enumerate(texts):
        r = rows[i]
        assert r.back == t
        assert r.n == len(r.ids)
        expected = []
        for j, part in enumerate(t.split("<|endoftext|>")):
            if j:
                expected.append(EOS_ID)
            expected.extend(part.encode("utf-8"))
        assert r.ids == expected
    no_special = df.select(encode_ids("text", allow_special=False).alias("ids")).collect()
    assert no_special[0].ids == list("a<|endoftext|>é".encode("utf-8"))


def test_count_special(spark):
    df = spark.createDataFrame([("a<|endoftext|>b",), ("<|endoftext|>",), ("",)], "text string")
    assert [r.n_special for r in count_special(df).collect()] == [1, 1, 0]


def test_ids_of_a_column_equal_those_of_each_text(spark):
    import re

    literal = "<|endoftext|>"
    texts = [None, "", "a", literal, f"{literal}x{literal}{literal}é", "ends <|endof", "text|> goes on", "中\x00", None, f"<{literal}>", "", literal[1:]]
    texts = texts * 40

    def plain(t, special):
        if t is None:
            return None
        parts = re.split(re.escape(literal), t) if special else [t]
        return [i for k, p in enumerate(parts) for i in ([256] if k else []) + list(p.encode())]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string").coalesce(1)
    for special in (True, False):
        got = {r.k: r.ids for r in df.select("k", encode_ids("t", special).alias("ids")).collect()}
        assert got == {k: plain(t, special) for k, t in enumerate(texts)}


def test_fingerprint_of_ids_leaves_nulls_out(spark):
    from hashlib import md5

    rows = [[], [1], [1, -100, 256], [None, 5, None], [None], None, [-1 << 31, 7], [-1 << 31, None, 7]]
    df = spark.createDataFrame(list(enumerate(rows)), "k int, ids array<int>")
    plan = df.select("k", ids_fingerprint("ids").alias("f"))
    want = {k: None if r is None else md5(",".join(str(i) for i in r if i is not None).encode()).hexdigest() for k, r in enumerate(rows)}
    assert {r.k: r.f for r in plan.collect()} == want
    assert "array_contains" in plan._jdf.queryExecution().optimizedPlan().toString()


def test_packed_ids_come_back(spark):
    rows = [list(range(257)), [], None, [255], [254, 0, 255, 1, 254], [0, 1], [256] * 3, [97, 256, 255, 254, 253], [255] * 50]
    df = spark.createDataFrame(list(enumerate(rows)), "k int, ids array<int>").repartition(2)
    out = df.select("k", "ids", pack_ids("ids").alias("b"), unpack_ids(pack_ids("ids")).alias("back")).collect()
    assert len(out) == len(rows) and all(r.back == r.ids for r in out)
    assert {r.k: r.b and len(r.b) for r in out} == {0: 259, 1: b"", 2: None, 3: 2, 4: 8, 5: 2, 6: 3, 7: 7, 8: 100}
    for bad in ([257], [-1], [1, None]):
        with pytest.raises(Exception, match="byte ids|an id is NULL"):
            spark.createDataFrame([(bad,)], "ids array<int>").select(pack_ids("ids")).collect()


def test_packed_ids_joined_without_an_end(spark):
    rows = [[[1, 2, 3], [4, 255, 256], [254, 254]], [], None, [[]], [[9], [], [256, 7]], [list(range(257)), [254]]]
    df = spark.createDataFrame(list(enumerate(rows)), "k int, w array<array<int>>")
    each = df.select("k", F.posexplode_outer("w").alias("i", "ids")).withColumn("b", pack_ids("ids"))
    df = df.join(each.filter("ids IS NOT NULL").groupBy("k").agg(F.array_sort(F.collect_list(F.struct("i", "b"))).alias("s")), "k", "left")
    df = df.withColumn("p", F.when(F.col("w").isNotNull(), F.coalesce(F.col("s.b"), F.array().cast("array<binary>"))))
    out = df.select("k", join_packed("p", without="first").alias("f"), join_packed("p", without="last").alias("l")).collect()
    for r in out:
        w = rows[r.k]
        assert r.f == (w if w is None else [x for a in w for x in a[1:]])
        assert r.l == (w if w is None else [x for a in w for x in a[:-1]])
    with pytest.raises(ValueError):
        join_packed("p", without="both")


def test_tables_of_packed_ids(spark):
    from tessera.session import materialize, stored_packed

    rows = [(1, [1, 256, 255]), (2, []), (3, None)]
    df = spark.createDataFrame(rows, "k int, ids array<int>")
    t = materialize(df.select("k", stored_packed("ids")), "packed")
    assert t.dtypes == df.dtypes and sorted((r.k, r.ids) for r in t.collect()) == rows
    stored = spark.read.parquet(t.inputFiles()[0].rsplit("/", 1)[0])
    assert dict(stored.dtypes)["ids"] == "binary"
