"""License scans by diagonal voting.

Every rolling three-word window of every text is joined by hash with the windows
of license templates. A match at text word ``p`` and template word ``t`` votes for
the offset diagonal ``p - t``. A diagonal with all windows of a template is a place
where the template stands word for word. Neighbouring diagonals of one template
(words inserted or left out) are merged into a span, and a span is accepted when
its verified words cover at least ``COVERAGE`` of the template. The join compares
the three words besides their hash, so every vote is verified.

Null texts count as empty; empty texts give no place and null positions. Rows
that repeat a ``doc_id`` are judged one by one. Extra columns are ignored. The
template table is a parameter of a few hundred windows, checked before it is
broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import plain_words

GRAM = 3
MAX_GRAMS = 20_000
COVERAGE = 0.8
MERGE_DIAGONALS = 3
MERGE_WORDS = 12

#: Phrases whose exact places are the base result, and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

#: Opening or naming sentences of common public licenses, matched with gaps.
TEMPLATES = {
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit",
    "licensed under the apache license version 2 0": "apache-2",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "this work is licensed under the gnu general public license version 3": "gpl-3",
    "this work is licensed under the gnu general public license version 2": "gpl-2",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license version 2 0": "mpl-2",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "licensed under a creative commons attribution 4 0 international license": "cc-by-4",
    "licensed under a creative commons attribution sharealike 4 0 international license": "cc-by-sa-4",
    "eclipse public license version 2 0": "epl-2",
    "this is free and unencumbered software released into the public domain": "unlicense",
}

#: Bodies and notices of common public licenses, as plain words.
BODIES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software "
    "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense "
    "and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions "
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
    "1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
    "2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the "
    "documentation and or other materials provided with the distribution": "bsd",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above "
    "copyright notice and this permission notice appear in all copies": "isc",
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a "
    "copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed "
    "under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for "
    "the specific language governing permissions and limitations under the license": "apache-2",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the "
    "free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it "
    "will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu "
    "general public license for more details": "gpl-3",
    "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you "
    "can obtain one at http mozilla org mpl 2 0": "mpl-2",
}
TEMPLATES |= BODIES


def template_grams(spark: SparkSession, phrases: dict[str, str], templates: dict[str, str]) -> DataFrame:
    """``(tid, label, base, size, tpos, g, t0, t1, t2)``: one row per template window."""
    rows = []
    for tid, (text, label, base) in enumerate([(t, x, True) for t, x in phrases.items()]
                                              + [(t, x, False) for t, x in templates.items()]):
        words = text.split(" ")
        if len(words) < GRAM:
            raise ValueError(f"a template needs {GRAM} words: {text!r}")
        rows += [(tid, label, base, len(words), i, *words[i:i + GRAM]) for i in range(len(words) - GRAM + 1)]
    if len(rows) > MAX_GRAMS:
        raise ValueError(f"{len(rows)} template windows; at most {MAX_GRAMS} are broadcast")
    frame = spark.createDataFrame(rows, "tid int, label string, base boolean, size int, tpos int, "
                                        "t0 string, t1 string, t2 string")
    return frame.withColumn("g", F.xxhash64("t0", "t1", "t2"))


def license_votes(docs: DataFrame, grams: DataFrame) -> DataFrame:
    """Votes by diagonal, and per text one row with null ``tid`` that carries ``n_words``."""
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("row"),
                       F.concat(plain_words(F.col("text")), F.array(F.lit(None).cast("string"))).alias("ws"))
    n = F.size("ws")
    rows = rows.select("doc_id", "row", F.posexplode(F.arrays_zip(
        F.col("ws").alias("w0"), F.slice("ws", F.lit(2), n).alias("w1"),
        F.slice("ws", F.lit(3), n).alias("w2"))).alias("pos", "w"))
    rows = rows.select("doc_id", "row", "pos", F.col("w.w0").alias("w0"), F.col("w.w1").alias("w1"),
                       F.col("w.w2").alias("w2"))
    g = F.broadcast(grams)
    same = ((F.xxhash64("w0", "w1", "w2") == g["g"]) & (F.col("w0") == g["t0"]) & (F.col("w1") == g["t1"])
            & (F.col("w2") == g["t2"]))
    hits = rows.join(g, same, "left").filter(F.col("tid").isNotNull() | F.col("w0").isNull())
    return (hits.groupBy("doc_id", "row", "tid", "label", "base", "size", (F.col("pos") - F.col("tpos")).alias("diagonal"))
            .agg(F.count("tpos").alias("votes"), F.min("pos").alias("first"), F.max("pos").alias("last"),
                 F.collect_set("tpos").alias("tpos")))


def license_spans(votes: DataFrame) -> DataFrame:
    """Diagonals merged into spans, with the exact places and a score of each span: its covered
    template words over the longer of template and span.

    The row with null ``tid`` of each text passes through with its ``n_words``.
    """
    order = Window.partitionBy("row", "tid").orderBy("first", "diagonal")
    before = votes.withColumn("_d", F.lag("diagonal").over(order)).withColumn("_l", F.lag("last").over(order))
    new = (F.col("_d").isNull() | (F.abs(F.col("diagonal") - F.col("_d")) > MERGE_DIAGONALS)
           | (F.col("first") - F.col("_l") > MERGE_WORDS))
    runs = before.withColumn("span", F.sum(new.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    place = F.when(F.col("base") & (F.col("votes") == F.col("size") - GRAM + 1), F.col("diagonal"))
    spans = (runs.groupBy("doc_id", "row", "tid", "label", "base", "size", "span")
             .agg(F.min("first").alias("first"), (F.max("last") + GRAM).alias("stop"),
                  F.count(place).alias("n_base"), F.min(place).alias("first_word"), F.max(place).alias("last_word"),
                  F.array_distinct(F.flatten(F.collect_list("tpos"))).alias("tpos")))
    words = F.size(F.array_distinct(F.flatten(F.transform("tpos", lambda t: F.sequence(t, t + GRAM - 1)))))
    return spans.withColumn("score", F.when(F.col("tid").isNotNull(), words / F.greatest(F.col("size"), F.col("stop") - F.col("first")))).drop("tpos")


def license_labels(docs: DataFrame, phrases: dict[str, str] | None = None,
                   templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """Per document: ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``.

    The base columns count the exact places of ``phrases``; ``labels`` adds those
    of template spans that score at least ``coverage`` (the best of overlapping ones); ``score`` is the best
    one of an accepted span (1 for an exact place), 0 without any.
    """
    grams = template_grams(docs.sparkSession, PHRASES if phrases is None else phrases,
                           TEMPLATES if templates is None else templates)
    spans = license_spans(license_votes(docs, grams))
    based = F.col("n_base") > 0
    near = ~F.col("base") & (F.col("score") >= coverage)
    # where accepted spans overlap, only the best of them gives its label
    order = Window.partitionBy("row", near).orderBy("first", "stop").rowsBetween(Window.unboundedPreceding, -1)
    apart = F.coalesce(F.col("first") >= F.max("stop").over(order), F.lit(True))
    place = Window.partitionBy("row", near).orderBy("first", "stop").rowsBetween(Window.unboundedPreceding, 0)
    spans = spans.withColumn("_apart", apart.cast("int")).withColumn("_place", F.sum("_apart").over(place))
    best = F.max("score").over(Window.partitionBy("row", near, "_place"))
    spans = spans.withColumn("_best", best)
    accepted = based | (near & (F.col("score") == F.col("_best")))
    out = spans.groupBy("doc_id", "row").agg(
        F.max(F.when(F.col("tid").isNull(), F.col("first"))).cast("long").alias("n_words"),
        F.sum("n_base").alias("n_base"), F.min("first_word").cast("long").alias("first_word"),
        F.max("last_word").cast("long").alias("last_word"),
        F.collect_set(F.when(based, F.col("label"))).alias("b"),
        F.collect_set(F.when(accepted, F.col("label"))).alias("m"),
        F.max(F.when(accepted, F.when(based, F.lit(1.0)).otherwise(F.col("score")))).alias("s"))
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.array_sort("b"), ",").alias("base_labels"),
        F.array_join(F.array_sort("m"), ",").alias("labels"),
        F.coalesce("s", F.lit(0.0)).alias("score"))
