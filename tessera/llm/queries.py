"""Registered queries of this package: thin callables ``(spark, table_dir) -> DataFrame``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import (
    align,
    decontaminate,
    fingerprints,
    language,
    licenses,
    neardup,
    negatives,
    packing,
    quality,
    substrings,
    toxicity,
    urls,
    warc,
)
from tessera.llm.common import table
from tessera.session import materialize, scratch_dir


def op1_fingerprints(spark: SparkSession, base: str) -> DataFrame:
    """Fingerprints of every document and of its edited text.

    ``n_near`` is the search: for documents whose id is divisible by 20 (null for
    others), the number of other distinct fingerprints within the radius.
    """
    rows = materialize(fingerprints.document_fingerprints(table(spark, base, "documents")), "op1")
    asked = F.col("doc_id") % 20 == 0
    near = fingerprints.near_fingerprints(rows.select("fp"), queries=rows.filter(asked).select("fp"))
    near = near.groupBy(F.col("a").alias("_fp")).agg(F.count("*").alias("_near"))
    rows = rows.join(near, asked & (F.col("fp") == F.col("_fp")), "left")
    fp, edited, after = F.col("fp"), F.col("edited_fp"), F.col("next_fp")
    return rows.select(
        "doc_id", F.col("n_chars").cast("long").alias("n_chars"), "edited_sha256",
        fingerprints.hex_fingerprint(fp).alias("fingerprint"),
        fingerprints.hex_fingerprint(edited).alias("edited_fingerprint"),
        fingerprints.likeness(fp, edited).alias("near_edited"), fingerprints.likeness(fp, after).alias("near_next"),
        F.when(asked, F.coalesce("_near", F.lit(0))).alias("n_near"))


def op2_quality(spark: SparkSession, base: str) -> DataFrame:
    """Quality score of every document."""
    return quality.score_quality(table(spark, base, "documents"))


def op3_languages(spark: SparkSession, base: str) -> DataFrame:
    """Predicted language of every document."""
    return language.identify_languages(table(spark, base, "documents"))


def op4_decontamination(spark: SparkSession, base: str) -> DataFrame:
    """Hit words and items of every document, and whether it is contaminated."""
    return decontaminate.contamination(table(spark, base, "documents"), table(spark, base, "benchmark")).drop("hits")


def op5_packing(spark: SparkSession, base: str) -> DataFrame:
    """Power-of-two pieces of every document."""
    return packing.pack_documents(table(spark, base, "documents"))


def op6_substrings(spark: SparkSession, base: str) -> DataFrame:
    """Words of every document that repeat an earlier passage, and a digest of the rest."""
    return substrings.substring_digests(table(spark, base, "documents"))


def op7_licenses(spark: SparkSession, base: str) -> DataFrame:
    """License phrases and template spans of every document."""
    return licenses.license_labels(table(spark, base, "documents"))


def op8_toxicity(spark: SparkSession, base: str) -> DataFrame:
    """Expected severity of every document."""
    return toxicity.grade_documents(table(spark, base, "documents"), table(spark, base, "labels"))


def op9_urls(spark: SparkSession, base: str) -> DataFrame:
    """Rule and verdict of every page's URL."""
    return urls.judge_urls(table(spark, base, "pages")).withColumn("score", F.round("score", 5))


def op10_near_copies(spark: SparkSession, base: str) -> DataFrame:
    """Near-duplicate class of every document."""
    return neardup.near_copies(table(spark, base, "documents"))


def op11_archives(spark: SparkSession, base: str) -> DataFrame:
    """Every page's record, read back from the archives that were written for it."""
    path = scratch_dir(spark, "warc")
    warc.write_archives(table(spark, base, "pages"), path)
    return warc.read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op12_negatives(spark: SparkSession, base: str) -> DataFrame:
    """Hard negatives of every fiftieth vector, against all vectors."""
    label = F.col("label").cast("long")
    rows = table(spark, base, "embeddings").withColumn("label", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))
    return negatives.mine_negatives(negatives.whole_vectors(rows), F.col("vec_id") % 50 == 0)


def op13_alignment(spark: SparkSession, base: str) -> DataFrame:
    """Token groups and links of every document under two tokenizers."""
    return align.alignment_digests(table(spark, base, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_fingerprints, op2_quality, op3_languages, op4_decontamination, op5_packing, op6_substrings, op7_licenses,
    op8_toxicity, op9_urls, op10_near_copies,
    op11_archives, op12_negatives, op13_alignment)}
