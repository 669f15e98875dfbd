"""Recorded events against what the queries return; truth of results; entities and relations."""

import json

import pytest
from pyspark.sql import functions as F
from quarry.operators import lifecycle, store
from quarry.sources.metrics import Metrics
from quarry.workspace import fresh_path


def test_counts_observed_equal_the_result(spark):
    m = Metrics(spark, fresh_path(spark, "metrics"))
    df = spark.range(1000).where("id % 3 = 0")
    rows = m.observed("query.thirds", df, lambda d: d.collect(), {"rows": F.count("*"), "largest": F.max("id")}, limit=5)
    with pytest.raises(Exception):
        m.observed("query.bad", df.select(F.raise_error(F.lit("no"))), lambda d: d.collect(), {"rows": F.count("*")})
    m.event("started", detail="é")
    got = {r.event: json.loads(r.fields) for r in m.events().collect()}
    assert got["query.thirds"]["rows"] == len(rows) == 334 and got["query.thirds"]["largest"] == 999 and got["query.thirds"]["limit"] == 5 and got["query.thirds"]["duration_ms"] > 0
    assert "error" in got["query.bad"] and got["started"] == {"detail": "é"}
    assert len(Metrics(spark, None).observed("x", df, lambda d: d.collect(), {"rows": F.count("*")})) == 334


def test_insert_graph(spark):
    old = spark.createDataFrame([(1, "A", "person", "x", "u", "h")], "id long, name string, entity_type string, description string, user_id string, content_hash string")
    new = spark.createDataFrame([(2, "B", None, None, "u"), (3, "C", "place", "far", None)], "id long, name string, entity_type string, description string, user_id string")
    ents = store.insert_entities(old, new)
    assert {(r.id, r.entity_type) for r in ents.collect()} == {(1, "person"), (2, "unknown"), (3, "place")}
    none = spark.createDataFrame([], "src long, dst long, relation_type string, weight double, relation_class string, provenance string, valid_from timestamp, valid_until timestamp")
    rel = spark.createDataFrame([(1, 2, "knows", None), (2, 3, "in", 7.0), (3, 3, "is", -1.0), (1, 9, "lost", 0.5), (None, 1, "lost", 0.5)], "src long, dst long, relation_type string, weight double")
    kept, bad = store.insert_relations(none, rel, ents, F.current_timestamp())
    assert {(r.src, r.dst, r.weight, r.relation_class) for r in kept.collect()} == {(1, 2, 1.0, "observed"), (2, 3, 1.0, "observed"), (3, 3, 0.0, "observed")}
    assert {(r.src, r.dst) for r in bad.collect()} == {(1, 9), (None, 1)}
