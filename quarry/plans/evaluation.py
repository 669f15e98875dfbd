"""Evaluation queries: relevance of BM25 results to the benchmark items, latencies, deltas, thresholds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation as E
from ..sources.tables import table
from . import retrieval


def _labels(s, d):
    """Documents that hold an item verbatim."""
    from ..operators.retrieve import holding_documents

    docs = table(s, d, "documents").select(F.col("doc_id").alias("id"), "text")
    items = table(s, d, "benchmark").select(F.col("item_id").alias("q_id"), F.col("text").alias("passage"))
    return holding_documents(retrieval._index(s, d), docs, items)


def _metrics(s, d):
    q = table(s, d, "benchmark").select(F.col("item_id").alias("q_id"))
    return E.per_query(retrieval.bm25_topk(s, d), _labels(s, d), q, 5)


def ir_metrics(s, d):
    return _metrics(s, d)


def ir_aggregate(s, d):
    return E.aggregate(_metrics(s, d))


def failure_taxonomy(s, d):
    return E.failure_class(_metrics(s, d))


def latency_p95(s, d):
    return E.nearest_rank(table(s, d, "events").select("event_type", "value"), ["event_type"], "value", 0.95, "p95")


def latency_p50_index(s, d):
    return E.index_rank(table(s, d, "events").select("event_type", "value"), ["event_type"], "value", 0.5, "p50")


def metric_deltas(s, d):
    e = table(s, d, "events")
    m = lambda c: e.where(c).groupBy(F.col("event_type").alias("metric")).agg(F.round(F.avg("value"), 6).alias("value"))
    return E.deltas(m("event_id % 2 = 0"), m("event_id % 3 = 0"))


def threshold_policy(s, d):
    e = table(s, d, "events").where("event_type <> 'view'").groupBy(F.col("event_type").alias("metric")).agg(F.round(F.avg("value"), 6).alias("value"))
    return E.thresholds(e, table(s, d, "events").select(F.col("event_type").alias("metric")).distinct().withColumn("least", F.lit(50.0)))


_LAB = "lab as (select item_id as q_id, doc_id as id from documents d, benchmark b where contains(d.text, b.text))"
_BASE = f"""with {retrieval.bm25_sql()}, rn as ({retrieval._TOP} bm), {_LAB}, h as (select rn.q_id, rn.rank, case when lab.id is not null then 1 else 0 end as rel from rn left join lab using (q_id, id) where rank <= 10),
 g as (select q_id, sum(case when rank <= 5 then rel else 0 end) as found, sum(case when rank <= 5 then rel / log2(rank + 1.0) else 0 end) as dcg, min(case when rel = 1 then rank end) as first, count(*) as returned from h group by 1), ex as (select q_id, count(*) as expected from lab group by 1),
 m as (select b.item_id as q_id, coalesce(expected, 0) as expected, coalesce(returned, 0) as returned, round(coalesce(found, 0) / 5.0::double, 6) as precision, case when expected > 0 then round(coalesce(found, 0) / expected::double, 6) else 0.0 end as recall,
 case when expected > 0 then round(coalesce(dcg, 0.0) / list_sum(list_transform(range(1, 1 + least(5, expected)), lambda i: 1.0 / log2(i + 1.0))), 6) else 0.0 end as ndcg, round(coalesce(1.0 / first, 0.0)::double, 6) as rr, first as expected_rank from benchmark b left join g on g.q_id = b.item_id left join ex on ex.q_id = b.item_id)"""
CATALOG = {
    "ir_metrics": (ir_metrics, f"{_BASE} select * from m"),
    "ir_aggregate": (ir_aggregate, f"{_BASE} select count(*) as n, round(avg(precision), 6) as mean_precision, round(avg(recall), 6) as mean_recall, round(avg(ndcg), 6) as mean_ndcg, round(avg(rr), 6) as mean_rr, round(avg(case when rr > 0 then 1.0 else 0.0 end), 6) as hit_rate, round(avg(expected_rank), 6) as mean_rank from m"),
    "failure_taxonomy": (failure_taxonomy, f"{_BASE} select q_id, case when expected = 0 then (case when returned = 0 then 'none' else 'unexpected_rows' end) when returned = 0 then 'empty' when expected_rank is null then 'true_miss' when expected_rank > 1 then 'wrong_rank' else 'none' end as failure from m"),
    "latency_p95": (latency_p95, "select event_type, value as p95, n from (select event_type, value, row_number() over (partition by event_type order by value) as r, count(*) over (partition by event_type) as n from events) where r = ceil(0.95 * n)"),
    "latency_p50_index": (latency_p50_index, "select event_type, value as p50, n from (select event_type, value, row_number() over (partition by event_type order by value) as r, count(*) over (partition by event_type) as n from events) where r = round_even((n - 1) * 0.5, 0) + 1"),
    "metric_deltas": (metric_deltas, """with a as (select event_type as metric, round(avg(value), 6) as before from events where event_id % 2 = 0 group by 1), b as (select event_type as metric, round(avg(value), 6) as after from events where event_id % 3 = 0 group by 1)
 select metric, before, after, round(after - before, 6) as delta, case when abs(after - before) <= 1e-12 then 'unchanged' when after > before then 'improved' else 'regressed' end as verdict from a join b using (metric)"""),
    "threshold_policy": (threshold_policy, """select p.metric, v.value, 50.0::double as least, case when v.value is null then 'deferred' when v.value >= 50 then 'pass' else 'fail' end as verdict from (select distinct event_type as metric from events) p
 left join (select event_type as metric, round(avg(value), 6) as value from events where event_type <> 'view' group by 1) v using (metric)"""),
}
