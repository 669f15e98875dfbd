"""The star-schema and corpus tables, and views of them as records, vectors and edges.

Each view has a DuckDB twin in ``SQL`` so that oracle queries read the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

AS_OF = "2024-09-01 00:00:00"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def as_of():
    return F.to_timestamp(F.lit(AS_OF))


def memories(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as bitemporal records."""
    d = table(spark, sf, "documents")
    return d.selectExpr(
        "doc_id as id", "text as content", "source as namespace", "lang as user_id",
        "element_at(array('episodic', 'semantic', 'procedural'), cast(doc_id % 3 + 1 as int)) as memory_type",
        "0.1D + (doc_id % 50) / 10D as importance_score", "doc_id % 17 as access_count",
        "timestamp '2024-01-01 00:00:00' + make_interval(0, 0, 0, cast(doc_id % 400 as int)) as ingestion_time",
        "timestamp '2024-01-01 00:00:00' + make_interval(0, 0, 0, cast(doc_id % 300 as int)) as event_time",
        "timestamp '2024-01-01 00:00:00' + make_interval(0, 0, 0, cast(doc_id % 400 as int)) as valid_from",
        "case when doc_id % 5 = 0 then timestamp '2024-01-01 00:00:00' + make_interval(0, 0, 0, cast(doc_id % 400 + doc_id % 90 + 1 as int)) end as valid_until",
        "case when doc_id % 5 = 0 then element_at(array('superseded', 'learning_archived', 'learning_rejected', 'manual'), cast(doc_id % 4 + 1 as int)) end as invalidation_reason",
        "case when doc_id % 15 = 0 then doc_id + 1 end as superseded_by",
        "case when doc_id % 7 <> 0 then md5(text) end as content_hash",
        "timestamp '2024-08-01 00:00:00' + make_interval(0, 0, 0, cast(doc_id % 31 as int), 0, cast(doc_id % 1440 as int)) as last_accessed_at",
        "case doc_id % 8 when 0 then concat('{\"learning\":{\"schema_version\":1,\"status\":\"', element_at(array('candidate', 'confirmed', 'rule', 'rejected', 'superseded', 'archived'), cast(doc_id % 6 + 1 as int)), '\"}}') when 1 then '{\"tags\":[\"Workflow_Rule\"]}' when 2 then '{\"kind\":\"preference\"}' when 3 then '{\"learning\":{\"status\":\"confirmed\"}}' when 4 then '{}' end as metadata",
    )


def records(spark: SparkSession, sf: str) -> DataFrame:
    """Events as validity intervals: each holds until the user's next event of its type."""
    return table(spark, sf, "events").selectExpr(
        "event_id as id", "user_id", "event_type", "value", "props", "cast(ts as timestamp) as valid_from",
        "lead(cast(ts as timestamp)) over (partition by user_id, event_type order by ts, event_id) as valid_until",
    )


def transitions(spark: SparkSession, sf: str) -> DataFrame:
    """(src, dst, weight): event types and the next of the same user."""
    e = table(spark, sf, "events").selectExpr("concat(event_type, '_', user_id % 40) as src", "lead(concat(event_type, '_', user_id % 40)) over (partition by user_id order by ts, event_id) as dst")
    return e.where("dst is not null").groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))


def supply(spark: SparkSession, sf: str) -> DataFrame:
    """(src, dst, weight): supplier to part by quantity; node ids as text."""
    li = table(spark, sf, "lineitem")
    return li.groupBy(F.concat(F.lit("s"), F.col("l_suppkey")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey")).alias("dst")).agg(F.sum("l_quantity").alias("weight"))


SQL = {
    "memories": """memories as (select doc_id as id, text as content, source as namespace, lang as user_id,
 (['episodic','semantic','procedural'])[cast(doc_id % 3 + 1 as int)] as memory_type,
 0.1::double + (doc_id % 50) / 10.0::double as importance_score, doc_id % 17 as access_count,
 timestamp '2024-01-01' + to_days(cast(doc_id % 400 as int)) as ingestion_time,
 timestamp '2024-01-01' + to_days(cast(doc_id % 300 as int)) as event_time,
 timestamp '2024-01-01' + to_days(cast(doc_id % 400 as int)) as valid_from,
 case when doc_id % 5 = 0 then timestamp '2024-01-01' + to_days(cast(doc_id % 400 + doc_id % 90 + 1 as int)) end as valid_until,
 case when doc_id % 5 = 0 then (['superseded','learning_archived','learning_rejected','manual'])[cast(doc_id % 4 + 1 as int)] end as invalidation_reason,
 case when doc_id % 15 = 0 then doc_id + 1 end as superseded_by,
 case when doc_id % 7 <> 0 then md5(text) end as content_hash,
 timestamp '2024-08-01' + to_days(cast(doc_id % 31 as int)) + to_minutes(doc_id % 1440) as last_accessed_at,
 case doc_id % 8 when 0 then '{"learning":{"schema_version":1,"status":"' || (['candidate','confirmed','rule','rejected','superseded','archived'])[cast(doc_id % 6 + 1 as int)] || '"}}' when 1 then '{"tags":["Workflow_Rule"]}' when 2 then '{"kind":"preference"}' when 3 then '{"learning":{"status":"confirmed"}}' when 4 then '{}' end as metadata
 from documents)""",
    "records": """records as (select event_id as id, user_id, event_type, value, props, ts as valid_from,
 lead(ts) over (partition by user_id, event_type order by ts, event_id) as valid_until from events)""",
    "transitions": """edges as (select src, dst, cast(count(*) as double) as weight from (
 select event_type || '_' || (user_id % 40) as src, lead(event_type || '_' || (user_id % 40)) over (partition by user_id order by ts, event_id) as dst from events)
 where dst is not null group by src, dst)""",
    "supply": "edges as (select 's' || l_suppkey as src, 'p' || l_partkey as dst, sum(l_quantity) as weight from lineitem group by 1, 2)",
}


def with_views(*names: str) -> str:
    return "with " + ",\n".join(SQL[n] for n in names) + "\n"
