"""The pipeline against the stages' plain versions, and its stages on odd tables."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tessera.llm import packing, toxicity

from .conftest import SF, frame
from .test_native_scans import brute_contamination
from .test_texts import brute_classes


def cut_repeats(docs, window=20):
    seen, out = set(), []
    for doc_id, text in sorted(docs):
        words, gone = text.encode().split(), set()
        for s in range(len(words) - window + 1):
            w = tuple(words[s:s + window])
            if w in seen:
                gone.update(range(s, s + window))
            seen.add(w)
        out.append((doc_id, b" ".join(w for k, w in enumerate(words) if k not in gone).decode() if gone else text))
    return out


def test_pipeline_matches_plain_stages(spark):
    tables = {n: spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels", "benchmark")}
    gone = {r.doc_id for r in toxicity.grade_documents(tables["documents"], tables["labels"]).filter("rejected").collect()}
    docs = [(r.doc_id, r.text) for r in tables["documents"].collect() if r.doc_id not in gone]
    classes = brute_classes(docs)
    docs = cut_repeats([d for d in docs if classes[d[0]] == d[0]])
    items = [(r.item_id, r.text) for r in tables["benchmark"].collect()]
    clean = {r[0] for r in brute_contamination(docs, items) if not r[5]}
    want = sorted((d, s, n) for d, t in docs if d in clean
                  for s, n in packing.pieces(len(packing.token_ids(t, *packing.tokenizer_paths())) + 1))
    got = corpus_pipeline.run(spark, SF)
    assert sorted((r.doc_id, r.start, r.length) for r in got.collect()) == want


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_documents(spark, name):
    rows = [(None, "null id words"), (1, None), (2, ""), (3, "same words in here"), (3, "same words in here"),
            (3, "another text"), (4, "long " * 9000)]
    df = frame(spark, rows, extra="lang string, n_chars long, rank int, label string")
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, df, SF)
    if name != "packing":
        assert out.columns == df.columns and dict(out.dtypes) == dict(df.dtypes)
        assert {r.doc_id for r in out.collect()} == {None, 1, 2, 3, 4}
    assert stage(spark, df.limit(0), SF).count() == 0
    assert out.filter(F.col("doc_id").isNull()).count() > 0
