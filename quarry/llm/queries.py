"""The contract queries: each applies its operator to the whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import audit, codebooks, decontam, fingerprint, langid, mixing, packing, passages, secretscan, sharding, simjoin, tokens, urlfilter
from .oracles import ORACLES


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def queries() -> dict:
    docs = lambda s, d: _table(s, d, "documents")
    return {
        "op1_language_id": lambda s, d: langid.identify(docs(s, d)),
        "op2_url_filters": lambda s, d: urlfilter.judge(_table(s, d, "pages")),
        "op3_ngram_jaccard_join": lambda s, d: simjoin.jaccard_components(docs(s, d), words=3, num=90),
        "op4_document_fingerprints": lambda s, d: fingerprint.edited_likeness(docs(s, d)),
        "op5_token_files": lambda s, d: tokens.round_trip(docs(s, d), end_id=1),
        "op6_substring_dedup": lambda s, d: passages.repeated_passages(docs(s, d)),
        "op7_benchmark_decontamination": lambda s, d: decontam.find_leaks(docs(s, d), _table(s, d, "benchmark")),
        "op8_secret_scans": lambda s, d: secretscan.scan(docs(s, d)),
        "op9_packing": lambda s, d: packing.pack(docs(s, d), end_id=2),
        "op10_sharding": lambda s, d: sharding.shard_rows(docs(s, d)),
        "op11_filter_audit": lambda s, d: audit.interactions(docs(s, d), _table(s, d, "labels")),
        "op12_source_mixing": lambda s, d: mixing.mixed_shares(docs(s, d)),
        "op13_vector_codes": lambda s, d: codebooks.coded(_table(s, d, "embeddings")),
    }


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
