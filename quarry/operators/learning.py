"""Typed learnings: creation, ranking, moves, migration of untyped records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import lifecycle as life, scoring
from .retrieve import bounded


def rank(rows: DataFrame, channels: DataFrame, in_scope: Column, statuses: list[str], k: int, audit: bool = False) -> DataFrame:
    """Top ``k`` (q_id, id, score): the best channel score times the learning multipliers.

    ``rows``: (id, status, confidence, importance, valid); ``channels``: (q_id, id, score). With ``audit``, invalid rows
    take part with a score of at least 0.1."""
    best = channels.groupBy("q_id", "id").agg(F.max("score").alias("base"))
    ok = rows.where(F.col("status").isin(statuses) & (F.lit(audit) | F.col("valid")))
    both = best.join(bounded(ok), "id")
    base = F.when(F.lit(audit) & ~F.col("valid"), F.greatest(F.col("base"), F.lit(0.1))).otherwise(F.col("base"))
    scored = both.select("q_id", "id", "status", F.round(scoring.learning_score(base, F.col("status"), in_scope, F.col("confidence"), F.col("importance")), 6).alias("score"))
    w = Window.partitionBy("q_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def move(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, status, accepted): legal moves of status applied, others refused."""
    both = rows.join(wanted.select("id", F.col("status").alias("new")), "id")
    ok = life.legal_move(F.col("status"), F.col("new"))
    return both.select("id", F.when(ok, F.col("new")).otherwise(F.col("status")).alias("status"), ok.alias("accepted"))


def migration_plan(mem: DataFrame, existing: DataFrame, **rules) -> DataFrame:
    """(id, kind, status, outcome, reason, already): ``existing``: (source_id, content_hash, kind, scope) of typed rows.

    An eligible record is already migrated if a typed row names it as its source (primary), or has its content, kind and
    scope (fallback). ``rules``: see ``legacy_class``."""
    c = mem.withColumn("c", life.legacy_class(F.col("content"), F.col("metadata"), **rules))
    by_id = existing.select(F.col("source_id").alias("id")).where("id is not null").distinct().withColumn("m1", F.lit(True))
    by_hash = existing.where("content_hash is not null").select("content_hash", F.col("kind").alias("k"), F.col("scope").alias("s")).distinct().withColumn("m2", F.lit(True))
    both = c.join(by_id, "id", "left").join(by_hash.withColumnRenamed("content_hash", "h"), (F.col("content_hash") == F.col("h")) & (F.col("c.kind") == F.col("k")) & (F.col("namespace") == F.col("s")), "left")
    already = F.when(F.col("c.outcome") == "eligible", F.when(F.col("m1"), "primary").when(F.col("m2"), "fallback"))
    return both.select("id", "c.kind", "c.status", F.when(already.isNotNull(), "already_migrated").otherwise(F.col("c.outcome")).alias("outcome"), "c.reason", already.alias("already"))
