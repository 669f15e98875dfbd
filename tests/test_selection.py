"""Budgets over large groups, consolidation without pairs, verbatim passages, exactly-once merges."""

import random

import pytest
from pyspark.sql import functions as F
from quarry.operators import index, lifecycle, retrieve
from quarry.sources import versions
from quarry.streaming import streams
from quarry.workspace import fresh_path


@pytest.mark.parametrize("most", [0, 30, 10_000])
def test_budget_of_large_groups(spark, monkeypatch, most):
    """The picks one after the other equal the fold, whatever the group's size."""
    monkeypatch.setattr(lifecycle, "LIST_ROWS", most)
    r = random.Random(1)
    rows = [(g, i, r.randrange(5), r.randrange(1, 60)) for g, n in (("a", 200), ("b", 20), (None, 40), ("c", 1)) for i in range(n)]
    want = []
    for g in {x[0] for x in rows}:
        used, picked = 0, 0
        for _, i, _, t in sorted((x for x in rows if x[0] == g), key=lambda x: (x[2], x[1])):
            if picked < 7 and used + t <= 100:
                used, picked = used + t, picked + 1
                want.append((g, i, t))
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, id int, o int, t int")
    assert sorted(map(tuple, lifecycle.budgeted(df, "g", ["o"], "t", 100, 7).collect()), key=repr) == sorted(want, key=repr)


def test_budget_has_no_array_of_a_large_group(spark, monkeypatch):
    monkeypatch.setattr(lifecycle, "LIST_ROWS", 1000)
    big = spark.range(300_000).select(F.lit("x").alias("g"), "id", F.lit(1).alias("t"))
    assert [r.id for r in lifecycle.budgeted(big, "g", ["id"], "t", 3, 10).collect()] == [0, 1, 2]


def test_consolidation_of_many_equal_records(spark):
    """A class of 20,000 equal records is summed, not paired; null hashes and contents match nothing."""
    rows = spark.range(20_000).select("id", F.lit("same").alias("content"), F.lit("h").alias("content_hash"))
    more = spark.createDataFrame([(30_000, "same", None), (30_001, None, None), (30_002, "x", "h"), (30_003, "y", "z")], "id long, content string, content_hash string")
    every = rows.unionByName(more)
    got = {r.new_id: r for r in lifecycle.consolidation_plan(every, every).collect()}
    assert len(got) == 20_002 and got[5].supersedes == 20_001 and got[30_000].supersedes == 20_000 and got[30_002].supersedes == 20_000
    assert got[30_000].fingerprint == got[30_002].fingerprint != got[5].fingerprint
    plan = lifecycle.consolidation_plan(every, every)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect" not in plan


@pytest.mark.parametrize("most", [0, 1 << 20])
def test_consolidation_digest_is_of_the_sorted_list(spark, monkeypatch, most):
    """The digest is the MD5 of the sorted ids of all that a record replaces, by hash or by text, but itself; lists broadcast or not."""
    import hashlib

    monkeypatch.setattr(lifecycle, "LIST_BYTES", most)
    rows = [(i, t, h) for i, (t, h) in enumerate([("a", "h"), ("a", None), ("b", "h"), ("b", "g"), (None, "g"), (None, None), ("c", None), ("a", "h"), ("a", "h")])]
    new = [*rows[:7], (100, "a", "g"), (101, "c", None), (102, "d", "x")]
    make = lambda xs: spark.createDataFrame(xs, "id long, content string, content_hash string")
    got = {r.new_id: (r.supersedes, r.fingerprint) for r in lifecycle.consolidation_plan(make(new), make(rows)).collect()}
    want = {}
    for n, t, h in new:
        ids = sorted(i for i, x, g in rows if i != n and (t is not None and t == x or h is not None and h == g))
        if ids:
            want[n] = (len(ids), hashlib.md5(",".join(f"{i:020}" for i in ids).encode()).hexdigest())
    assert got == want


def test_holding_documents(spark):
    docs = ["The red ring, the blue ring", "xred ringy", "red", None, "", "a-b c!", "Red ring the", "é à ü"]
    passages = ["red ring", "red ring, the", "ring", "d r", "the blue", "-b c", "!!", "", None, "é à", "The red ring"]
    d = spark.createDataFrame(list(enumerate(docs)), "id int, text string")
    p = spark.createDataFrame(list(enumerate(passages)), "q_id int, passage string")
    found = retrieve.holding_documents(index.build(d, "id", "text"), d, p)
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
    want = {(q, i) for q, x in enumerate(passages) for i, t in enumerate(docs) if x and t and any(c.isalnum() for c in x) and x in t}
    assert {tuple(r) for r in found.collect()} == want


def test_merge_adds_a_batch_once(spark):
    """A batch that comes again, as after a restart before its commit, adds nothing."""
    table, ledger = fresh_path(spark, "records"), fresh_path(spark, "ledger")
    spark.createDataFrame([(1, 5, None), (2, 0, None)], "id long, access_count long, last_accessed_at timestamp").write.parquet(table)
    sink = streams.merge_batches(table, ledger)
    batch = spark.createDataFrame([(1, 2, None), (1, 1, None), (9, 4, None)], "id long, accesses long, last_accessed_at timestamp")
    counts = lambda: {r.id: r.access_count for r in streams.merged(spark, table, ledger).collect()}
    assert counts() == {1: 5, 2: 0}
    for number in (0, 0, 1, 1, 0):
        sink(batch, number)
    assert counts() == {1: 11, 2: 0} and len(versions.numbers(spark, ledger)) == 2


def test_merged_stream_equals_batch(spark, tmp_path):
    """Counts merged over several batches and a restart are those of all events."""
    source, state = str(tmp_path / "events"), str(tmp_path / "state")
    table, ledger = fresh_path(spark, "records"), fresh_path(spark, "ledger")
    spark.range(5).select("id", F.lit(0).cast("long").alias("access_count"), F.lit(None).cast("timestamp").alias("last_accessed_at")).write.parquet(table)
    schema = "event_id long, id long, accesses long, last_accessed_at timestamp"
    sent = 0
    for part in range(3):
        rows = [(100 * part + i, (i * (part + 1)) % 5, 1, None) for i in range(20)]
        sent += len(rows)
        spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(source)
        streams.run_to_end(stream, streams.merge_batches(table, ledger), "append", state)
        assert streams.merged(spark, table, ledger).agg(F.sum("access_count")).first()[0] == sent


def test_terms_are_counted_in_bounded_slices(spark, monkeypatch):
    """Words of a slice are counted together, as the tokens of each text alone; a slice has a bounded number of bytes."""
    import pyarrow as pa
    from collections import Counter
    from quarry.functions import text

    texts = ["getUserName HTTPServer2go x_y-z", "", None, "É2a aÉ Ünï½ 漢字abc parseHTMLParserX", "!!!", "İstanbul Straße the The", "x\n\nThe1a2B", "long " * 50, "the"]
    frame = spark.createDataFrame(list(enumerate(texts)), "row int, text string")
    want = {r.row: Counter(r.t or []) for r in frame.select("row", text.tokens(F.col("text")).alias("t")).collect()}
    monkeypatch.setattr(index, "_TEXTS", 4)
    monkeypatch.setattr(index, "_BYTES", 60)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["row", "text"])
    out = list(index._count([batch]))
    assert all(b.num_rows <= 4 for b in out) and len(out) > 3
    got = [r for b in out for r in b.to_pylist()]
    assert [r["row"] for r in got] == list(range(len(texts)))
    assert {r["row"]: Counter(dict(zip(r["terms"], r["tfs"]))) for r in got} == want
    assert all(r["dl"] == sum(r["tfs"]) and len(set(r["terms"])) == len(r["terms"]) for r in got)
