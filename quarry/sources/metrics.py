"""Metrics of queries: what a run counted and how long it took, a JSON line an event."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from ..workspace import hadoop_path


class Metrics:
    """Events below ``root``, a small file each, so that drivers of several jobs may write; null ``root`` records nothing.

    A run's fields are observed in the query's own pass: no second job counts them."""

    def __init__(self, spark: SparkSession, root: str | None):
        self.spark, self.root = spark, root

    def event(self, event: str, **fields) -> None:
        if self.root is None:
            return
        now = datetime.now(timezone.utc)
        line = json.dumps({"timestamp": now.isoformat(), "event": event, "app": self.spark.sparkContext.applicationId, "fields": fields})
        fs, p = hadoop_path(self.spark, f"{self.root}/{now:%Y%m%dT%H%M%S%f}-{uuid.uuid4().hex[:8]}.jsonl")
        out = fs.create(p)
        out.write(bytearray(line + "\n", "utf-8"))
        out.close()

    def observed(self, event: str, df: DataFrame, run: Callable[[DataFrame], object], counted: dict[str, Column], **fields) -> object:
        """``run(df)``, an action over the whole of it, with the ``counted`` aggregates of its rows and its duration; a run
        that fails leaves an event with the error's name."""
        if self.root is None:
            return run(df)
        seen, began = Observation(), time.monotonic()
        try:
            result = run(df.observe(seen, *[c.alias(n) for n, c in counted.items()]))
        except Exception as e:
            self.event(event, **fields, error=type(e).__name__, duration_ms=(time.monotonic() - began) * 1000.0)
            raise
        self.event(event, **fields, **seen.get, duration_ms=(time.monotonic() - began) * 1000.0)
        return result

    def events(self) -> DataFrame:
        """(timestamp, event, app, fields) of what was recorded; fields as JSON text."""
        rows = self.spark.read.text(self.root)
        get = lambda k: F.get_json_object("value", f"$.{k}").alias(k)
        return rows.select(*[get(k) for k in ("timestamp", "event", "app", "fields")])
