"""Language identification by a string kernel.

A text is the set of its character n-grams of length 1 to 3 (blended spectrum,
presence only; letters are lower-cased, other characters count as one separator).
The kernel of two texts is the number of common n-grams over the root of the product
of their numbers. ``LANDMARKS`` training texts per language span the Nyström space,
and one-versus-rest kernel ridge regression is solved in it on ``PER_LANGUAGE``
training texts per language. The solution is linear in the landmark kernels, so
their n-gram matrix and the regression weights are multiplied once, and a batch of
texts is scored by one product of its presence matrix with that model.

Training rows are chosen in order of a hash of the id; the driver receives their
n-gram sets (bounded by the number of possible codes), never texts. Prediction reads
the text alone.

Null texts and texts without a letter are ``und`` with score 0; without a training
row every text is. Null ids are never learnt from and count as held out. Repeated
rows come back repeated. Extra columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import sample_texts
from tessera.llm.wordarrays import mix

SIGNS = 64
CODES = SIGNS + SIGNS**2 + SIGNS**3
PER_LANGUAGE = 300
LANDMARKS = 40
RIDGE = 1e-3
SHARPNESS = 6.0
BATCH = 256
UNKNOWN = "und"


@functools.cache
def sign_table() -> np.ndarray:
    """Sign of each code point: 0 for no letter, 1-26 for a-z, 27-63 for other letters by a hash."""
    table = np.zeros(0x110000, np.uint8)
    letters = np.array([c for c in range(0x110000) if chr(c).isalpha()], np.int64)
    table[letters] = 27 + (mix(letters.astype(np.uint64)) % np.uint64(SIGNS - 27)).astype(np.uint8)
    table[97:123] = table[65:91] = np.arange(1, 27)
    return table


def gram_codes(text: str) -> np.ndarray:
    """Codes of all n-grams of a text, with repeats; none without a letter."""
    signs = sign_table()[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
    keep = np.ones(len(signs), bool)
    keep[1:] = (signs[1:] != 0) | (signs[:-1] != 0)
    s = signs[keep].astype(np.int32)
    if not s.any():
        return np.empty(0, np.int32)
    s = np.concatenate(([0] * int(s[0] != 0), s, [0] * int(s[-1] != 0))).astype(np.int32)
    two = s[:-1] * SIGNS + s[1:]
    three = two[:-1] * SIGNS + s[2:]
    return np.concatenate((s[s > 0], SIGNS + two, SIGNS + SIGNS**2 + three))


@dataclass(frozen=True)
class KernelModel:
    languages: list[str]
    codes: np.ndarray   # n-grams of the landmarks
    values: np.ndarray  # codes x languages

    def scores(self, texts: pd.Series) -> tuple[np.ndarray, np.ndarray]:
        """One-versus-rest scores, and whether a text has a letter."""
        mark = np.zeros(CODES, bool)
        out, some = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), bool)
        batch = np.zeros((BATCH, len(self.codes)), np.float32)
        size = np.ones(BATCH)
        for lo in range(0, len(texts), BATCH):
            part = texts.iloc[lo:lo + BATCH]
            for i, t in enumerate(part):
                found = gram_codes(t) if t else np.empty(0, np.int32)
                mark[found] = True
                batch[i] = mark[self.codes]
                size[i] = max(1, np.count_nonzero(mark))
                some[lo + i] = len(found) > 0
                mark[found] = False
            n = len(part)
            out[lo:lo + n] = (batch[:n] @ self.values) / np.sqrt(size[:n])[:, None]
        return out, some


def fit_kernel(languages: list[str], sets: list[np.ndarray], landmarks: int = LANDMARKS,
               ridge: float = RIDGE) -> KernelModel:
    """Nyström kernel ridge regression; ``sets`` are the distinct codes of each training text."""
    names = sorted(set(languages))
    label = np.array([names.index(x) for x in languages])
    chosen = np.concatenate([np.flatnonzero(label == k)[:landmarks] for k in range(len(names))])
    codes = np.unique(np.concatenate([sets[i] for i in chosen]))
    place = np.full(CODES, -1, np.int64)
    place[codes] = np.arange(len(codes))
    x = np.zeros((len(sets), len(codes)), np.float32)
    for i, s in enumerate(sets):
        at = place[s]
        x[i, at[at >= 0]] = 1 / np.sqrt(len(s))
    z = x[chosen]
    near, among = x @ z.T, z @ z.T
    target = np.where(label[:, None] == np.arange(len(names))[None, :], 1.0, -1.0)
    system = (near.T @ near + ridge * len(sets) * among).astype(float) + 1e-9 * np.eye(len(chosen))
    alpha = np.linalg.lstsq(system, near.T.astype(float) @ target, rcond=None)[0]
    return KernelModel(names, codes, (z.T.astype(float) @ alpha).astype(np.float32))


def code_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets = [np.unique(gram_codes(t or "")).astype(np.int32) for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("rank"), b.column("lang"), pa.array(sets, pa.list_(pa.int32()))],
                                         ["rank", "lang", "codes"])


def held_out(doc_id: Column) -> Column:
    """True for a third of the documents, by a checksum of the id; true for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def fit_languages(docs: DataFrame, per_language: int = PER_LANGUAGE) -> KernelModel | None:
    rows = docs.select("doc_id", "lang", "text").filter(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    # ids first, so that the choice moves no texts; texts without a letter teach nothing
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = (rows.filter(F.col("text").rlike(r"\p{L}")).select("doc_id", "lang").distinct()
           .withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= per_language))
    sample = sample_texts(rows, ids, ["doc_id", "lang"])
    got = sample.select("rank", "lang", "text").mapInArrow(code_rows, "rank int, lang string, codes array<int>").toPandas()
    got = got[got["codes"].map(len) > 0]
    if not len(got):
        return None
    got = got.assign(first=[int(c[0]) * CODES + len(c) for c in got["codes"]]).sort_values(["lang", "rank", "first"])
    return fit_kernel(list(got["lang"]), [np.asarray(c, np.int64) for c in got["codes"]])


def predicted(text: Column, model: KernelModel | None) -> Column:
    """Struct of a text: ``lang_pred`` and ``score`` (0 to 1)."""
    @F.pandas_udf("struct<lang_pred:string,score:double>")
    def predict(texts: pd.Series) -> pd.DataFrame:
        if model is None:
            return pd.DataFrame({"lang_pred": [UNKNOWN] * len(texts), "score": np.zeros(len(texts))})
        f, some = model.scores(texts)
        e = np.exp(SHARPNESS * (f - f.max(axis=1, keepdims=True)))
        p = e / e.sum(axis=1, keepdims=True)
        best = f.argmax(axis=1)
        return pd.DataFrame({"lang_pred": [model.languages[b] if s else UNKNOWN for b, s in zip(best, some, strict=True)],
                             "score": np.where(some, p.max(axis=1), 0.0)})
    return predict(text)


def identify_languages(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """Per document: ``doc_id, held_out, lang_pred, score``."""
    model = fit_languages(docs, per_language)
    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), predicted(F.col("text"), model).alias("r"))
    return out.select("doc_id", "held_out", "r.lang_pred", "r.score")
