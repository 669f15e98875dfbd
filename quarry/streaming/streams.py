"""Structured Streaming: access counters, debounce, coalescing, continuous capacity control.

Event-time operators take a watermark; rows later than it are dropped (the engine's own policy)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def access_counts(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """(id, accesses, last_accessed_at): each event id counts once within the watermark."""
    once = events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    return once.groupBy("id").agg(F.count("*").alias("accesses"), F.max("ts").alias("last_accessed_at"))


def merge_access(records: DataFrame, counts: DataFrame) -> DataFrame:
    """Counts of one micro-batch added to the records' snapshot."""
    c = counts.select("id", F.col("accesses").alias("_n"), F.col("last_accessed_at").alias("_t"))
    both = records.join(c, "id", "left")
    return both.select(*[
        (F.col("access_count") + F.coalesce("_n", F.lit(0))).alias(x) if x == "access_count" else F.greatest("last_accessed_at", "_t").alias(x) if x == "last_accessed_at" else F.col(x)
        for x in records.columns
    ])


def debounce(changes: DataFrame, gap: str = "500 milliseconds", late: str = "10 seconds") -> DataFrame:
    """(project, started, ended, paths, n): the changed paths of a project once it has been quiet for ``gap``, and the
    number of changes."""
    s = changes.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "project")
    both = s.agg(F.sort_array(F.collect_set("path")).alias("paths"), F.count("*").alias("n"))
    return both.select("project", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "paths", "n")


def coalesce_changes(changes: DataFrame, window: str = "5 seconds", late: str = "10 seconds") -> DataFrame:
    """(started, path, op): the last operation on each path of a window."""
    g = changes.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "path")
    return g.agg(F.max_by("op", "seq").alias("op")).select(F.col("w.start").alias("started"), "path", "op")


def flush_batches(changes: DataFrame, batch_size: int, debounce_ms: int) -> DataFrame:
    """(project, n, paths, reason): a project's first change opens a batch, flushed at ``batch_size`` paths or after
    ``debounce_ms``; state is at most one open batch a project."""

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        out = []
        if state.hasTimedOut:
            out.append((held, "debounce"))
            state.remove()
        else:
            for f in frames:
                for p in f.sort_values("seq")["path"]:
                    if p not in held:
                        held.append(p)
                    if len(held) >= batch_size:
                        out.append((held, "size"))
                        held = []
            if held:
                state.update((held,))
                state.setTimeoutDuration(debounce_ms)
            elif state.exists:
                state.remove()
        yield pd.DataFrame({"project": [key[0]] * len(out), "n": [len(h) for h, _ in out], "paths": [sorted(h) for h, _ in out], "reason": [r for _, r in out]})

    return changes.groupBy("project").applyInPandasWithState(step, "project string, n long, paths array<string>, reason string", "paths array<string>", "append", GroupStateTimeout.ProcessingTimeTimeout)


def merge_batches(table: str, ledger: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that adds each micro-batch's (id, accesses, last_accessed_at) to the records stored under
    ``table``, exactly once: the new snapshot and the number of the batch that it holds are one version under ``ledger``,
    so a batch that comes again after a restart is known and adds nothing."""
    from ..sources import versions

    def sink(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        have, value = versions.latest(spark, ledger)
        if value.get("batch", -1) >= number:
            return
        records = spark.read.parquet(value.get("path", table))
        counted = batch.groupBy("id").agg(F.sum("accesses").alias("accesses"), F.max("last_accessed_at").alias("last_accessed_at"))
        path = f"{ledger}/records-{number}-{have + 1}"
        merge_access(records, counted).write.mode("overwrite").parquet(path)
        versions.publish(spark, ledger, have + 1, {"batch": number, "path": path})

    return sink


def merged(spark, table: str, ledger: str) -> DataFrame:
    """The records as of the last merged batch."""
    from ..sources import versions

    return spark.read.parquet(versions.latest(spark, ledger)[1].get("path", table))


def run_to_end(stream: DataFrame, sink: Callable[[DataFrame, int], None], mode: str, checkpoint: str) -> None:
    """Drain what is there, each micro-batch to ``sink``; a restart resumes from ``checkpoint``."""
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start()
    q.awaitTermination()
