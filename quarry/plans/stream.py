"""Streaming queries, drained to the end of their input, with batch SQL as their check."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.tables import table
from ..streaming import streams as S
from ..workspace import fresh_path


def _stream(s, d):
    return s.readStream.schema(table(s, d, "events").schema).option("pathGlobFilter", "events.parquet").parquet(f"{d}/events.parquet" if _is_dir(s, f"{d}/events.parquet") else d)


def _is_dir(s, path):
    p = s.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(s._jsparkSession.sessionState().newHadoopConf()).getFileStatus(p).isDirectory()


def _drain(s, stream, mode):
    base = fresh_path(s, "stream")
    S.run_to_end(stream, lambda df, n: df.withColumn("_batch", F.lit(n)).write.mode("append").parquet(f"{base}/out"), mode, f"{base}/state")
    return s.read.parquet(f"{base}/out")


def access_counts_stream(s, d):
    e = _stream(s, d).where("event_type in ('view', 'click')").select("event_id", F.col("user_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"))
    got = _drain(s, S.access_counts(e), "update")
    return got.groupBy("id").agg(F.max_by("accesses", "_batch").alias("accesses"), F.unix_micros(F.max("last_accessed_at")).alias("last_us"))


def coalesce_last_op(s, d):
    e = _stream(s, d).select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("path"), F.col("event_type").alias("op"), F.col("event_id").alias("seq"))
    got = _drain(s, S.coalesce_changes(e, "1 day", "1 hour"), "update")
    return got.groupBy("started", "path").agg(F.max_by("op", "_batch").alias("op")).select(F.unix_micros("started").alias("started_us"), "path", "op")


def debounce_sessions(s, d):
    """The streaming debounce, drained: a marker far behind the last event moves the watermark past every session."""
    gap, late = "10 minutes", "10 seconds"
    e = _stream(s, d).select(F.col("ts").cast("timestamp").alias("ts"), (F.col("user_id") % 10).alias("project"), F.col("event_type").alias("path"))
    mark = fresh_path(s, "marker")
    table(s, d, "events").agg((F.max("ts").cast("timestamp") + F.expr("interval 1 day")).alias("ts")).select("ts", F.lit(None).cast("long").alias("project"), F.lit("marker").alias("path")).write.parquet(mark)
    marked = s.readStream.schema("ts timestamp, project long, path string").parquet(mark)
    # the marker is left out of the drained rows: a filter in the stream would be pushed before the watermark
    got = _drain(s, S.debounce(e.unionByName(marked), gap, late), "append").where("project is not null")
    return got.select("project", F.unix_micros("started").alias("started_us"), F.unix_micros("ended").alias("ended_us"), F.size("paths").alias("n_paths"), "n")


def merge_access(s, d):
    from ..sources.tables import memories

    c = table(s, d, "events").where("event_type = 'view'").groupBy(F.col("user_id").alias("id")).agg(F.count("*").alias("accesses"), F.max(F.col("ts").cast("timestamp")).alias("last_accessed_at"))
    return S.merge_access(memories(s, d).select("id", "access_count", "last_accessed_at"), c).select("id", "access_count", F.unix_micros("last_accessed_at").alias("last_us"))


CATALOG = {
    "access_counts_stream": (access_counts_stream, "select user_id as id, count(distinct event_id) as accesses, epoch_us(max(ts)) as last_us from events where event_type in ('view', 'click') group by 1"),
    "coalesce_last_op": (coalesce_last_op, "select epoch_us(date_trunc('day', ts)) as started_us, user_id as path, arg_max(event_type, event_id) as op from events group by 1, 2"),
    "debounce_sessions": (debounce_sessions, """with g as (select user_id % 10 as project, ts, event_type, case when ts >= lag(ts) over (partition by user_id % 10 order by ts) + interval 10 minute or lag(ts) over (partition by user_id % 10 order by ts) is null then 1 else 0 end as b from events),
 h as (select *, sum(b) over (partition by project order by ts rows unbounded preceding) as k from g)
 select project, epoch_us(min(ts)) as started_us, epoch_us(max(ts) + interval 10 minute) as ended_us, cast(count(distinct event_type) as int) as n_paths, count(*) as n from h group by project, k"""),
    "merge_access": (merge_access, """select doc_id as id, doc_id % 17 + coalesce(n, 0) as access_count, epoch_us(greatest(timestamp '2024-08-01' + to_days(cast(doc_id % 31 as int)) + to_minutes(doc_id % 1440), t)) as last_us
 from documents left join (select user_id, count(*) as n, max(ts) as t from events where event_type = 'view' group by 1) on user_id = doc_id"""),
}
