"""The corpus pipeline: language ID, near-duplicate join, decontamination, secret scan, packing.

Every stage takes any rows: null or empty texts go in the first stage, and where a later one meets them they are kept and
packed as an end id; repeated rows are rows each, but of a group of near duplicates (rows with one doc_id count as one
document) the document with the smallest doc_id stays, with all its rows. Rows with a null doc_id are never dropped by id.
Extra columns pass through to the last stage. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quarry.llm import decontam, langid, packing, secretscan, simjoin
from quarry.llm._common import bounded, stored


#: Shorter benchmark items are no evidence against a document.
EVIDENCE = decontam.SHORT


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` whose doc_id is not in ``ids(gone)``; rows with a null doc_id stay."""
    ids = stored(ids.distinct(), "pipeline-gone")
    return docs.join(bounded(ids), docs["doc_id"] == ids["gone"], "left_anti")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or of no language the classifier knows, go."""
    return langid.keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, similarity 0.8: of each group the document with the smallest id stays."""
    found = simjoin.jaccard_components(docs, words=5, num=80, name="pipeline")
    return _without(docs, found.where("doc_id <> component_id").select(F.col("doc_id").alias("gone")))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap a benchmark item of ``EVIDENCE`` words or more go; those with a null doc_id are joined with
    no decision and stay."""
    leaks = decontam.find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(docs, leaks.where(F.col("item_words") >= EVIDENCE).select(F.col("doc_id").cast("long").alias("gone")))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; every document stays."""
    clean = secretscan.redact(docs)
    return clean.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else clean


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 4096 ids along a Hilbert curve."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("secret_scans", secrets),
    ("packing", packed),
]

#: Verification over shingle sets, n-gram models and tokenizers are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
