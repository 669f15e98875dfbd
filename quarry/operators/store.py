"""Record-store operators on snapshots: patch, delete, upsert, invalidate, JSONL import and export, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text
from ..workspace import stored


def patch(base: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """Non-null values of ``changes`` overwrite those of ``base``; a changed content_hash drops the embedding."""
    cols = [c for c in changes.columns if c != key]
    new = changes.select(F.col(key), *[F.col(c).alias(f"_new_{c}") for c in cols])
    both = base.join(new, key, "left")
    out = both.select(*[F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c) if c in cols else F.col(c) for c in base.columns], *([F.col("content_hash").alias("_old")] if "content_hash" in cols else []))
    if "content_hash" in cols and "embedding_state" in base.columns:
        out = out.withColumn("embedding_state", F.when(text.needs_reembed(F.col("_old"), F.col("content_hash")), "stale").otherwise(F.col("embedding_state")))
    return out.drop("_old")


def delete(base: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return base.join(ids.select(key).distinct(), key, "left_anti")


def upsert(base: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Newest row of each key; of equal times, the new side's."""
    both = base.withColumn("_side", F.lit(0)).unionByName(new.withColumn("_side", F.lit(1)))
    return latest(both, keys, [F.desc(order), F.desc("_side")]).drop("_side")


def latest(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def invalidate(base: DataFrame, ids: DataFrame, at: Column, reason: str, superseded_by: str | None = None) -> DataFrame:
    hit = base.join(ids.select("id").distinct().withColumn("_hit", F.lit(True)), "id", "left")
    on = F.col("_hit").isNotNull()
    sup = F.when(on, F.lit(superseded_by)).otherwise(F.col("superseded_by")) if superseded_by is not None else F.col("superseded_by")
    return hit.withColumn("valid_until", F.when(on, at).otherwise(F.col("valid_until"))).withColumn("invalidation_reason", F.when(on, reason).otherwise(F.col("invalidation_reason"))).withColumn("superseded_by", sup).select(*base.columns)


def page(rows: DataFrame, order: str, limit: int, offset: int = 0, tie: str = "id") -> DataFrame:
    return rows.orderBy(F.desc(order), F.asc(tie)).offset(offset).limit(limit)


def first_rows(rows: DataFrame, order: list[str], n: int, per_part: int = 100_000) -> DataFrame:
    """The first ``n`` rows in a total order, however many: ranges of the order are taken whole up to the one in which the
    ``n``-th row falls, and only that one is numbered."""
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // per_part))
    # stored: the borders of the ranges must not be drawn anew
    dealt = stored(rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "first-rows")
    cut, left = -1, n
    for r in sorted(dealt.groupBy("_part").agg(F.count("*").alias("c")).collect()):  # a row a range
        cut = r["_part"]
        if left <= r["c"]:
            break
        left -= r["c"]
    edge = dealt.where(F.col("_part") == cut).withColumn("_n", F.row_number().over(Window.partitionBy("_part").orderBy(*order))).where(F.col("_n") <= left)
    return dealt.where(F.col("_part") < cut).drop("_part").unionByName(edge.drop("_part", "_n"))


def truncated(rows: DataFrame, order: list, limit: int) -> DataFrame:
    """``limit`` rows, each with whether there were more."""
    w = Window.orderBy(*order)
    more = rows.orderBy(*order).limit(limit + 1).withColumn("_n", F.row_number().over(w))
    return more.withColumn("truncated", F.max("_n").over(Window.partitionBy(F.lit(1))) > limit).where(F.col("_n") <= limit).drop("_n")


def conditional_counts(df: DataFrame, by: list[str], **conditions: Column) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("total"), *[F.count_if(c).alias(k) for k, c in conditions.items()])


def insert(base: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """``base`` and new records (id, content, memory_type, importance_score, scopes): typed, hashed and stamped; a missing
    type is semantic, a missing importance 1, others are kept within 0.1 and 5. An unknown type is an error of the job."""
    kind = F.lower(F.trim("memory_type"))
    known = F.when(F.col("memory_type").isNull(), "semantic").when(kind.isin("episodic", "semantic", "procedural"), kind).otherwise(F.raise_error(F.concat(F.lit("unknown memory type: "), F.col("memory_type"))).cast("string"))
    row = new.withColumns({
        "memory_type": known, "importance_score": F.when(F.col("importance_score").isNull(), 1.0).otherwise(F.greatest(F.lit(0.1), F.least(F.lit(5.0), "importance_score"))), "content_hash": text.content_hash(F.col("content")),
        "embedding_state": F.lit("pending"), "event_time": now, "ingestion_time": now, "valid_from": now,
    })
    return base.unionByName(row.select(*[c for c in base.columns if c in row.columns]), allowMissingColumns=True)


def stale_embeddings(rows: DataFrame) -> DataFrame:
    """Records whose vector is stale or missing, without the vectors."""
    return without_vectors(rows.where((F.col("embedding_state") == "stale") | F.col("embedding").isNull()))


def without_vectors(rows: DataFrame) -> DataFrame:
    return rows.drop("embedding")


def reset(rows: DataFrame, project: str, column: str = "project_id") -> DataFrame:
    """Everything but one project's rows; rows of no project stay."""
    return rows.where(~F.col(column).eqNullSafe(F.lit(project)))


# ---------------------------------------------------------------- JSONL


def export_jsonl(rows: DataFrame, path: str, limit: int | None = None) -> DataFrame:
    """Write one JSON object a line; returns counters."""
    rows = rows if limit is None else truncated(rows, [F.asc("id")], limit)
    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.mode("overwrite").text(path)
    return rows.agg(F.count("*").alias("exported"))


def parse_jsonl(lines: DataFrame, schema: str, required: list[str]) -> DataFrame:
    """(line_no, error, row): ``lines`` is (line_no, raw); a bad line has an error and no row."""
    got = lines.where(F.trim("raw") != "").select("line_no", "raw", F.try_parse_json("raw").alias("v"), F.from_json("raw", schema).alias("row"))
    missing = F.filter(F.array(*[F.when(F.col("row")[c].isNull(), F.lit(c)) for c in required]), lambda x: x.isNotNull())
    error = F.when(F.col("v").isNull(), "malformed").when(F.size(missing) > 0, F.concat(F.lit("missing: "), F.array_join(missing, ",")))
    out = got.select("line_no", error.alias("error"), "row")
    # ids of sound lines that recur: counted, so neither bad lines nor the copies of an id are gathered
    again = out.where("error is null").groupBy(F.col("row.id").alias("_id")).agg(F.count("*").alias("_n")).where("_n > 1")
    out = out.join(again, F.col("error").isNull() & (F.col("row.id") == F.col("_id")), "left")
    out = out.withColumn("error", F.when(F.col("_n").isNotNull(), F.concat(F.lit("duplicate id: "), F.col("row.id").cast("string"))).otherwise(F.col("error"))).drop("_id", "_n")
    return out.withColumn("row", F.when(F.col("error").isNull(), F.col("row")))


def import_plan(payload: DataFrame, existing: DataFrame, mode: str = "remap") -> DataFrame:
    """What becomes of each payload row (id, superseded_by, payload): its new id, action, rewritten link.

    ``mode``: remap gives taken ids a new one, skip leaves them out, fail marks them as conflicts."""
    taken = existing.select("id").distinct().withColumn("_taken", F.lit(True))
    rows = payload.join(taken, "id", "left").withColumn("_taken", F.col("_taken").isNotNull())
    action = F.when(~F.col("_taken"), "insert").otherwise({"remap": "remap", "skip": "skip", "fail": "conflict"}[mode])
    new = F.when(F.col("_taken") & F.lit(mode == "remap"), text.import_id(F.col("id").cast("string"), F.col("payload"))).otherwise(F.col("id").cast("string"))
    rows = rows.select("id", "superseded_by", action.alias("action"), new.alias("new_id"))
    links = rows.select(F.col("id").alias("superseded_by"), F.col("new_id").alias("_link"))
    return rows.join(links, "superseded_by", "left").select("id", "new_id", "action", F.coalesce("_link", F.col("superseded_by").cast("string")).alias("new_superseded_by"))


def cached_embeddings(rows: DataFrame, cache: DataFrame) -> DataFrame:
    """Rows with vectors reused by content hash; a null vector is still to be made."""
    return rows.join(cache, "content_hash", "left")


def insert_entities(base: DataFrame, new: DataFrame) -> DataFrame:
    """``base`` and new entities (id, name, entity_type, description, user_id): a missing type is unknown; the hash is that
    of the name and description, which a vector is made of."""
    row = new.withColumn("entity_type", F.coalesce("entity_type", F.lit("unknown"))).withColumn("content_hash", text.content_hash(F.concat("name", F.lit(": "), F.coalesce("description", F.lit("")))))
    return base.unionByName(row.select(*[c for c in base.columns if c in row.columns]), allowMissingColumns=True)


def insert_relations(base: DataFrame, new: DataFrame, entities: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(``base`` and the new relations (src, dst, relation_type, weight) between known entities, the new ones without):
    observed by hand, valid from now on; a missing weight is 1, others are kept within 0 and 1."""
    known = lambda c: entities.select(F.col("id").alias(c)).distinct()
    met = new.join(known("src").withColumn("_a", F.lit(True)), "src", "left").join(known("dst").withColumn("_b", F.lit(True)), "dst", "left")
    ok = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    row = met.where(ok).withColumns({
        "weight": F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("weight", F.lit(1.0)))), "relation_class": F.lit("observed"), "provenance": F.lit("imported_manual"), "valid_from": now,
    })
    return base.unionByName(row.select(*[c for c in base.columns if c in row.columns]), allowMissingColumns=True), met.where(~ok).select(*new.columns)
