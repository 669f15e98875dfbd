"""Retrieval quality: per-query metrics, aggregates, percentiles, deltas, failure classes, thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def per_query(runs: DataFrame, labels: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """P@k, R@k, nDCG@k, reciprocal rank and hit of each query. ``runs``: (q_id, id, rank); ``labels``: (q_id, id)."""
    lab = labels.select("q_id", "id").distinct().withColumn("rel", F.lit(1))
    hits = runs.join(lab, ["q_id", "id"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))
    got = hits.groupBy("q_id").agg(
        F.sum(F.when(F.col("rank") <= k, F.col("rel")).otherwise(0)).alias("found"),
        F.sum(F.when(F.col("rank") <= k, F.col("rel") / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("dcg"),
        F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("first"), F.count("*").alias("returned"),
    )
    want = lab.groupBy("q_id").agg(F.count("*").alias("expected"))
    both = queries.select("q_id").join(got, "q_id", "left").join(want, "q_id", "left").na.fill(0, ["found", "dcg", "expected", "returned"])
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.lit(k), F.col("expected").cast("int")))), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))
    return both.select(
        "q_id", "expected", "returned", F.round(F.col("found") / k, 6).alias("precision"), F.when(F.col("expected") > 0, F.round(F.col("found") / F.col("expected"), 6)).otherwise(0.0).alias("recall"),
        F.when(F.col("expected") > 0, F.round(F.col("dcg") / ideal, 6)).otherwise(0.0).alias("ndcg"), F.round(F.coalesce(1.0 / F.col("first"), F.lit(0.0)), 6).alias("rr"), F.col("first").alias("expected_rank"),
    )


def aggregate(metrics: DataFrame) -> DataFrame:
    m = metrics
    return m.agg(
        F.count("*").alias("n"), *[F.round(F.avg(c), 6).alias(f"mean_{c}") for c in ("precision", "recall", "ndcg", "rr")],
        F.round(F.avg(F.when(F.col("rr") > 0, 1.0).otherwise(0.0)), 6).alias("hit_rate"), F.round(F.avg("expected_rank"), 6).alias("mean_rank"),
    )


def nearest_rank(values: DataFrame, by: list[str], value: str, q: float, out: str = "p") -> DataFrame:
    """The value at position ceil(q n) of the order, without interpolation."""
    return _at(values, by, value, F.ceil(F.col("_n") * q), out)


def index_rank(values: DataFrame, by: list[str], value: str, q: float, out: str = "p") -> DataFrame:
    """The value at index round((n - 1) q), half to even, of the order."""
    return _at(values, by, value, F.bround((F.col("_n") - 1) * q) + 1, out)


def _at(values: DataFrame, by: list[str], value: str, pos: Column, out: str) -> DataFrame:
    """Counts of each value are summed first, so a group's rows are never gathered: the position is found in running counts."""
    counts = values.groupBy(*by, value).agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*by)
    run = counts.withColumn("_n", F.sum("_c").over(w)).withColumn("_to", F.sum("_c").over(w.orderBy(value)))
    hit = run.where((F.col("_to") >= pos) & (F.col("_to") - F.col("_c") < pos))
    return hit.select(*by, F.col(value).alias(out), F.col("_n").alias("n"))


def deltas(before: DataFrame, after: DataFrame, higher_is_better: bool = True, eps: float = 1e-12) -> DataFrame:
    """(metric, before, after, delta, verdict) of two tables (metric, value)."""
    both = before.select("metric", F.col("value").alias("before")).join(after.select("metric", F.col("value").alias("after")), "metric", "full")
    d = F.col("after") - F.col("before")
    up = d > eps if higher_is_better else d < -eps
    verdict = F.when(d.isNull(), "missing").when(F.abs(d) <= eps, "unchanged").when(up, "improved").otherwise("regressed")
    return both.select("metric", "before", "after", F.round(d, 6).alias("delta"), verdict.alias("verdict"))


def failure_class(metrics: DataFrame, ready: Column | None = None) -> DataFrame:
    unexpected = F.when(F.col("returned") == 0, "none").otherwise("unexpected_rows")
    out = F.when(~ready if ready is not None else F.lit(False), "not_ready").when(F.col("expected") == 0, unexpected)
    out = out.when(F.col("returned") == 0, "empty").when(F.col("expected_rank").isNull(), "true_miss").when(F.col("expected_rank") > 1, "wrong_rank").otherwise("none")
    return metrics.select("q_id", out.alias("failure"))


def thresholds(values: DataFrame, policy: DataFrame) -> DataFrame:
    """(metric, value, least, verdict): pass, fail, or deferred where there is no value."""
    both = policy.join(values, "metric", "left")
    return both.select("metric", "value", "least", F.when(F.col("value").isNull(), "deferred").when(F.col("value") >= F.col("least"), "pass").otherwise("fail").alias("verdict"))
