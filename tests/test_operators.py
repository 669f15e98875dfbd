"""Small hand-computed cases."""

import json
import time

import pytest
from pyspark.sql import functions as F
from quarry.functions import lifecycle as life, predicates as P, scoring, text
from quarry.operators import code_search, corpus, evaluation, gram_index, graph, index, joins, lifecycle, retrieve, store, vector_index
from quarry.sources import files
from quarry.streaming import streams


def one(spark, expr, **cols):
    names = ", ".join(f"{k} {'string' if isinstance(v, str) else 'double' if isinstance(v, float) else 'long'}" for k, v in cols.items())
    return spark.createDataFrame([tuple(cols.values())], names).select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize("word,want", [("fooBar2baz", ["foo", "bar2", "baz", "foobar2baz"]), ("HTTPServer", ["http", "server", "httpserver"]), ("plain", ["plain"]), ("snake_case", ["snake", "case"]), ("", [])])
def test_tokens(spark, word, want):
    assert one(spark, text.tokens(F.col("w")), w=word) == want


@pytest.mark.parametrize("meta,wanted,ok", [
    ({"a": {"b": 1, "c": 2}}, {"a": {"b": 1}}, True), ({"a": [1, 2, 3]}, {"a": [3, 1]}, True), ({"a": [1]}, {"a": [2]}, False), ({"a": "1"}, {"a": 1}, False),
    ({"a": True}, {"a": True}, True), ({"a": None}, {"a": None}, True), ({}, {"a": 1}, False), ([1], {"a": 1}, False),
])
def test_json_contains(spark, meta, wanted, ok):
    assert one(spark, P.json_contains(F.col("m"), wanted), m=json.dumps(meta)) is ok


def test_json_contains_null(spark):
    assert spark.createDataFrame([(None,), ("{bad",)], "m string").select(P.json_contains(F.col("m"), {"a": 1}).alias("x")).collect() == [(False,), (False,)]


def test_decay_halves(spark):
    got = one(spark, scoring.decay(F.col("a"), F.lit(0), F.lit("episodic")), a=30.0)
    assert abs(got - 0.5) < 1e-9
    assert one(spark, scoring.decay(F.col("a"), F.lit(0), F.lit("episodic")), a=1e6) == 0.05
    assert one(spark, scoring.reinforcement(F.col("a")), a=1e9) == 3.0


def test_path_rules(spark):
    rows = ["src/a.rs", "node_modules/a.js", "x/.venv/x.py", ".git/x.py", "ios/Pods/p.swift", "a.min.js", "Cargo.lock", "lib/b.kt", "README.md", "a/.b.py", "a/Generated/c.rs", "a/b.d.ts", "run.zsh"]
    got = spark.createDataFrame([(r,) for r in rows], "p string").where(P.path_kept(F.col("p"))).collect()
    assert [r.p for r in got] == ["src/a.rs", "lib/b.kt", "run.zsh"]
    with pytest.raises(ValueError):
        P.glob_regex("/abs/*.py")


def test_ppr_mass(spark):
    e = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("c", "a", 2.0), ("c", "d", 1.0)], "src string, dst string, weight double")
    s = spark.createDataFrame([("a",)], "node string")
    got = {r.node: r.score for r in graph.pagerank(e, s, dampen_hubs=False).collect()}
    assert abs(sum(got.values()) - 1) < 1e-6 and got["a"] > got["c"]
    joined = {r.node: r.r for r in graph._joined_pagerank(e, s, 15, 0.5, None).collect()}
    assert all(abs(joined[n] - x) < 1e-12 for n, x in got.items())


def test_bfs_grows(spark):
    e = spark.createDataFrame([(str(i), str(i + 1), 1.0) for i in range(6)], "src string, dst string, weight double")
    s = spark.createDataFrame([("0",)], "node string")
    two, three = ({r.node for r in graph.bfs(e, s, d).collect()} for d in (2, 3))
    assert two < three and len(three) == 4


def test_communities(spark):
    import itertools

    e = [(f"a{x}", f"a{y}", 1.0) for x, y in itertools.combinations(range(5), 2)] + [(f"b{x}", f"b{y}", 1.0) for x, y in itertools.combinations(range(5), 2)] + [("a0", "b0", 1.0)]
    got = {r.node: r.community for r in graph.communities(spark.createDataFrame(e, "src string, dst string, weight double")).collect()}
    assert len({got[f"a{i}"] for i in range(5)}) == 1 and got["a1"] != got["b1"]


def test_lineage_cycle(spark):
    links = spark.createDataFrame([(1, 2), (2, 1), (5, 6)], "id long, superseded_by long")
    got = sorted(map(tuple, graph.lineage(links, spark.createDataFrame([(1,), (5,)], "id long")).collect()))
    assert got == [(1, 0, 1, False), (1, 1, 2, False), (1, 2, 1, True), (5, 0, 5, False), (5, 1, 6, False)]


def test_parents(spark):
    rows = [("f", 1, 0, 100), ("f", 2, 10, 50), ("f", 3, 20, 30), ("f", 4, 60, 70), ("f", 5, 45, 65), ("f", 6, 20, 30)]
    got = sorted((r.child, r.parent) for r in joins.tightest_parent(spark.createDataFrame(rows, "k string, id int, start int, end int"), "k").collect())
    assert got == [(2, 1), (3, 2), (4, 1), (5, 1)]


def test_budget_skips(spark):
    rows = spark.createDataFrame([("g", 1, "a", 60), ("g", 2, "b", 50), ("g", 3, "c", 30), ("g", 4, "d", 500)], "grp string, ord int, id string, tokens int")
    assert [r.id for r in lifecycle.budgeted(rows, "grp", ["ord"], "tokens", 100, 5).collect()] == ["a", "c"]


def test_jsonl(spark):
    lines = spark.createDataFrame([(1, '{"id": 1, "q": 2}'), (2, "{oops"), (3, '{"q": 1}'), (4, '{"id": 7, "q": 1}'), (5, '{"id": 7, "q": 2}')], "line_no int, raw string")
    got = {r.line_no: r.error for r in store.parse_jsonl(lines, "id long, q int", ["id"]).collect()}
    assert got[1] is None and got[2] == "malformed" and got[3] == "missing: id" and got[4].startswith("duplicate") and got[5].startswith("duplicate")


def test_import_modes(spark):
    p = spark.createDataFrame([(1, None, "x"), (2, 1, "y")], "id long, superseded_by long, payload string")
    have = spark.createDataFrame([(1,)], "id long")
    got = {r.id: r for r in store.import_plan(p, have).collect()}
    assert got[1].action == "remap" and got[1].new_id.startswith("1-import-") and got[2].new_superseded_by == got[1].new_id
    assert {r.id: r.action for r in store.import_plan(p, have, "skip").collect()} == {1: "skip", 2: "insert"}


def test_rrf_weight_is_monotone(spark):
    ch = spark.createDataFrame([(1, "vector", 1, 0.9), (1, "vector", 2, 0.8), (1, "bm25", 2, 5.0), (1, "bm25", 3, 4.0)], "q_id int, channel string, id int, score double")
    order = lambda v, b: [r.id for r in retrieve.rrf(ch, {"vector": v, "bm25": b}, 3).orderBy("rank").collect()]
    assert order(1.0, 1.0)[0] == 2 and order(1.0, 0.001)[0] == 1


def test_chunks_lines(spark):
    t = "para one line\nline two\n\n" + "x" * 30 + "\n\n" + "y" * 30
    got = corpus.structural_chunks(spark.createDataFrame([(1, t)], "id int, t string"), "id", "t", most=40, least=10).collect()
    assert [(r.chunk, r.start_line, r.end_line) for r in got] == [(0, 1, 3), (1, 4, 5), (2, 6, 8)]


def test_source_tree(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.py").write_text("class A(Base):\n    def run(self):\n        helper(1)\n\ndef helper(x):\n    return x\n")
    (tmp_path / "src/gen.py").write_text("# @generated\n")
    (tmp_path / "note.txt").write_text("no")
    tree = files.source_tree(spark, str(tmp_path))
    assert {(r.file_path, r.skipped) for r in tree.collect()} == {("src/a.py", None), ("src/gen.py", "generated")}
    sym = corpus.extract_symbols(tree.where("skipped is null"))
    assert {(r.name, r.symbol_type, r.start_line) for r in sym.collect()} == {("A", "class", 1), ("run", "function", 2), ("helper", "function", 5)}
    refs = {(r.owner, r.to_name, r.relation_type) for r in corpus.extract_references(tree.where("skipped is null"), sym).collect()}
    assert ("A", "helper", "calls") in refs or ("run", "helper", "calls") in refs


def test_nearest_rank(spark):
    v = spark.createDataFrame([("a", float(x)) for x in range(1, 21)], "k string, v double")
    assert evaluation.nearest_rank(v, ["k"], "v", 0.95).first()["p"] == 19.0
    assert evaluation.index_rank(v, ["k"], "v", 0.5).first()["p"] == 11.0


def test_lifecycle_states(spark):
    rows = [(None, None, None, None), ("2024-01-01", "learning_archived", None, None), ("2024-01-01", "x", "9", None), ("2030-01-01", "learning_rejected", None, None), ("2024-01-01", "superseded", None, None), ("2024-01-01", "manual", None, None), (None, None, None, '{"status":"candidate"}'), (None, None, None, '{"status":"rejected"}'), ("2024-01-01", "learning_rejected", "9", '{"status":"rule"}')]
    df = spark.createDataFrame(rows, "u string, r string, s string, l string")
    got = df.select(life.lifecycle_state(F.to_timestamp("u"), F.col("r"), F.col("s"), F.col("l")).alias("x")).collect()
    assert [g.x for g in got] == ["active", "archived", "superseded", "rejected", "superseded", "invalidated", "candidate", "unknown", "rejected"]


def test_effective_query(spark):
    cases = [
        ("plain  text", "plain text", "direct"), ("<system-reminder>a</system-reminder> TASK: one TASK: two", "TASK: two", "task_section"), ("<Work_Context>c</Work_Context> ask ", "ask", "post_work_context"),
        ("<Work_Context>c</Work_Context> # TASK x", "# TASK x", "task_section"), ("a <Work_Context> c", "<Work_Context> c", "work_context"), ("<system-reminder x", "<system-reminder x", "prompt_context"), ("   ", "", "direct"),
    ]
    df = spark.createDataFrame([(c[0],) for c in cases], "t string")
    got = [(r.x.query, r.x.origin) for r in df.select(text.effective_query(F.col("t")).alias("x")).collect()]
    assert got == [c[1:] for c in cases]
    long = one(spark, text.effective_query(F.col("t")), t="ab " * 3000)
    assert len(long.query) == 4095 + 1 - (long.query[-1] == " ") and long.truncated and long.original_chars == 9000


def test_pagerank_without_seeds(spark):
    e = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 1.0), ("c", "a", 1.0)], "src string, dst string, weight double")
    none = spark.createDataFrame([], "node string")
    got = {r.node: r.score for r in graph.pagerank(e, none, dampen_hubs=False).collect()}
    joined = {r.node: r.r for r in graph._joined_pagerank(e, none, 15, 0.5, None).collect()}
    assert abs(sum(got.values()) - 1) < 1e-9 and got["a"] > got["b"] > got["c"] > 0 and all(abs(joined[n] - x) < 1e-12 for n, x in got.items())


def test_components_unsettled(spark):
    e = spark.createDataFrame([(i, i + 1, 1.0) for i in range(40)], "src long, dst long, weight double")
    assert {r.component for r in graph.components(e).collect()} == {0}
    with pytest.raises(RuntimeError):
        graph.components(e, rounds=1)


def test_parents_in_pieces(spark):
    import random

    r = random.Random(1)
    rows = [(f"k{i % 3}", i, a := r.randrange(300), a + r.randrange(120)) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, id long, start long, end long")
    want = set()
    for k, i, a, z in rows:
        before = sorted((x[2], -x[3], x[1]) for x in rows if x[0] == k and (x[2], -x[3], x[1]) < (a, -z, i) and x[3] >= z)
        if before and (before[-1][0], -before[-1][1]) != (a, z):
            want.add((k, i, before[-1][2]))
    for spans in (7, 1 << 16):
        assert {tuple(x) for x in joins.tightest_parent(df, "k", spans).collect()} == want


def test_first_rows(spark):
    df = spark.range(500).selectExpr("id", "id % 7 as a", "xxhash64(id) as b").repartition(5)
    want = [r.id for r in df.orderBy("a", "b").collect()]
    for n in (0, 1, 77, 499, 500, 900):
        assert {r.id for r in store.first_rows(df, ["a", "b"], n, 60).collect()} == set(want[:n])


def test_cosine_blocks(spark, monkeypatch):
    """Sent queries and dealt blocks agree with a plain search; vectors without length or of another length are left out."""
    import numpy as np

    g = np.random.default_rng(3)
    vs = [(i, [round(float(x), 1) for x in g.normal(size=4)]) for i in range(90)] + [(90, [0.0] * 4), (91, None), (92, [1.0])]
    v = spark.createDataFrame(vs, "id long, v array<float>").repartition(4)
    q = spark.createDataFrame([(i, x) for i, x in vs if i % 5 == 0], "q_id long, qv array<float>")
    want = {}
    for i, x in vs[:90]:
        if i % 5 == 0:
            a = np.array(x, np.float32).astype(float)
            sims = [(-round(float(a @ (b := np.array(y, np.float32).astype(float)) / np.sqrt(a @ a) / np.sqrt(b @ b)), 6), j) for j, y in vs[:90] if any(y)]
            want[i] = [j for _, j in sorted(sims)[:6]]
    for block, rows in ((4096, 100_000), (3, 20)):
        monkeypatch.setattr(retrieve, "QUERY_BLOCK", block)
        monkeypatch.setattr(retrieve, "ROW_BLOCK", rows)
        got = {}
        for r in retrieve.cosine_topk(v, q, 6).orderBy("q_id", "rank").collect():
            got.setdefault(r.q_id, []).append(r.id)
        assert got == want


def test_index_terms(spark):
    """The index has the terms that the Column tokenizer has."""
    texts = ["getHTTPServer2x fooBar foo_bar", "Éa ßZ 日本 x2Y", None, "", "plain plain"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    ix = index.build(df, "id", "t")
    want = {(r.id, x): r.ts.count(x) for r in df.select("id", text.tokens(F.col("t")).alias("ts")).collect() for x in r.ts}
    assert {(r.id, r.term): r.tf for r in ix.postings.collect()} == want and ix.stats.first()["n"] == 5


def test_graph_channel(spark):
    ordered = spark.createDataFrame([(q, i, r + 1) for q, ids in ((1, [5, 3, 9, 4]), (2, [8]), (3, [100])) for r, i in enumerate(ids)], "q_id int, id long, rank int")
    edges = spark.createDataFrame([(5, 3, 1.0), (3, 4, 2.0), (4, 5, 1.0), (9, 5, 1.0), (5, 9, 3.0), (5, 77, 9.0), (8, 5, 1.0)], "src long, dst long, weight double")
    got = {(r.q_id, r.id): r.score for r in retrieve.graph_channel(ordered, spark.range(50).withColumnRenamed("id", "node"), edges, seeds=2).collect()}
    inner = edges.where("src in (3, 4, 5, 9) and dst in (3, 4, 5, 9)")
    want = {r.node: r.score for r in graph.pagerank(inner, spark.createDataFrame([(5,), (3,)], "node long"), tolerance=1e-6).collect()}
    assert set(got) == {(1, 5), (1, 3), (1, 9), (1, 4), (2, 8)} and all(abs(got[1, n] - x) < 1e-9 for n, x in want.items())


def test_symbol_probes_and_exact(spark):
    sym = spark.createDataFrame([(1, "parseQuery", "fn parseQuery()", "a.rs", 10, 20), (2, "query", None, "b.rs", 1, 3), (3, "other", "fn other(query)", "a.rs", 30, 40)], "id long, name string, signature string, file_path string, start_line long, end_line long")
    chunks = spark.createDataFrame([(11, "a.rs", 12, 15), (12, "a.rs", 23, 28), (13, "b.rs", 2, 9), (14, "a.rs", 90, 95)], "id long, file_path string, start_line long, end_line long")
    asked = spark.createDataFrame([(0, "parseQuery")], "q_id int, query string").select("q_id", "query", F.lower("query").alias("low"), text.identifier_tokens(F.col("query")).alias("terms"), F.lit(True).alias("codeish"))
    seeds = code_search.probe_symbols(asked, gram_index.build(sym, ("name",)))
    assert {r.id for r in seeds.collect()} == {1, 2}
    keyed, of = lambda df: df.withColumnRenamed("q_id", "key"), lambda df: df.withColumn("file", F.col("file_path"))
    found = keyed(asked.select("q_id", F.lit(14).cast("long").alias("id")))
    got = {r.id: round(r.exact, 4) for r in code_search.exact_channel(keyed(asked), keyed(seeds), of(sym).drop("file_path"), of(chunks), found, None, code_search.Filters()).collect()}
    top = min(4.0, 2.2 + 0.8 + 3 * 0.55 + 0.8) / 4
    assert got[11] == round(top, 4) and got[12] == round(top * 0.35, 4) and 14 not in got


def test_destructive_guard():
    P.destructive_guard(id="7")
    P.destructive_guard(namespace="n", user_id=None)
    P.destructive_guard(include_status=["rejected"])
    for bad in ({}, {"id": " "}, {"namespace": None}, {"include_status": []}):
        with pytest.raises(ValueError):
            P.destructive_guard(**bad)


def test_unknown_memory_type(spark):
    base = spark.createDataFrame([(1, "a", "semantic", 1.0)], "id long, content string, memory_type string, importance_score double")
    new = spark.createDataFrame([(2, "b", "odd", None)], base.schema)
    with pytest.raises(Exception, match="unknown memory type"):
        store.insert(base, new, F.current_timestamp()).collect()


def test_observation_without_confidence(spark):
    df = spark.createDataFrame([(None, None), ('{"x":[1]}', 7.0)], "m string, c double")
    got = [json.loads(r.o) for r in df.select(life.observation_metadata(F.col("m"), F.lit("s"), F.lit("e"), F.col("c"), F.lit(None).cast("string")).alias("o")).collect()]
    assert got[0]["observation"].get("confidence") is None and got[1]["observation"]["confidence"] == 1.0 and got[1]["x"] == [1] and got[0]["observation"]["redaction_state"] == "unknown"


def test_flush_by_size(spark, tmp_path):
    rows = spark.createDataFrame([("p", f"f{i}", i) for i in range(5)] + [("q", "z", 1)], "project string, path string, seq long")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    src = files.change_stream(spark, str(tmp_path / "in"), rows.schema)
    out = str(tmp_path / "out")
    sink = lambda df, n: df.write.mode("append").parquet(out)
    q = streams.flush_batches(src, 2, 3_600_000).writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).foreachBatch(sink).start()
    try:  # timers keep the query alive: wait for its first batch instead of its end
        for _ in range(120):
            if q.lastProgress and q.lastProgress["numInputRows"] or list((tmp_path / "out").glob("_SUCCESS")):
                break
            time.sleep(0.5)
    finally:
        q.stop()
    got = sorted((r.project, r.n, r.paths) for r in spark.read.parquet(out).collect())
    assert got == [("p", 2, ["f0", "f1"]), ("p", 2, ["f2", "f3"])]


def test_debounce(spark, tmp_path):
    rows = spark.createDataFrame([("p", "a", "2024-01-01 00:00:00"), ("p", "b", "2024-01-01 00:00:01"), ("p", "a", "2024-01-01 00:01:00"), ("z", "end", "2024-01-02 00:00:00")], "project string, path string, t string").selectExpr("project", "path", "to_timestamp(t) as ts")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    src = files.change_stream(spark, str(tmp_path / "in"), rows.schema)
    out = str(tmp_path / "out")
    streams.run_to_end(streams.debounce(src, "5 seconds"), lambda df, n: df.write.mode("append").parquet(out), "append", str(tmp_path / "ck"))
    assert sorted((r.project, r.paths) for r in spark.read.parquet(out).collect()) == [("p", ["a"]), ("p", ["a", "b"])]


@pytest.mark.parametrize("spread", [0.15, None])
def test_vector_index_recall(spark, spread, monkeypatch):
    """Clustered vectors need few cells, even ones many; nine of ten neighbours are found, also behind a filter."""
    import numpy as np

    monkeypatch.setattr(vector_index, "PIECE", 40)
    monkeypatch.setattr(vector_index, "QUERY_BLOCK", 16)
    r = np.random.default_rng(3)
    m = r.normal(size=(1500, 24))
    if spread:
        m = r.normal(size=(30, 24))[np.arange(1500) % 30] + spread * m
    rows = [(i, v.tolist(), i % 7) for i, v in enumerate(m)] + [(2000, None, 1), (2001, [0.0] * 24, 1), (2002, [], 1)]
    df = spark.createDataFrame(rows, "id long, v array<double>, label int")
    asks = df.where("id % 20 = 0 and id < 2000").select(F.col("id").alias("q_id"), F.col("v").alias("qv"))
    ix = vector_index.build(df)
    assert ix.rows.count() == 1500 and (ix.probes(10, 1500) <= 4) == bool(spread)
    for where in (None, F.col("label") == 1, (F.col("label") == 1) & (F.col("id") % 50 == 1)):
        got = {(x.q_id, x.id): x.score for x in vector_index.search(ix, asks, 10, where).collect()}
        want = {(x.q_id, x.id): x.score for x in retrieve.cosine_topk(df if where is None else df.where(where), asks, 10).collect()}
        assert len(got) == len(want) and sum(k in got for k in want) >= 0.9 * len(want)
        assert all(abs(got[k] - s) < 1e-6 for k, s in want.items() if k in got)
    none = vector_index.build(df.where("id > 1999 and id <> 2001"))
    assert vector_index.search(none, asks, 10).count() == 0


def test_gram_index_equals_a_scan(spark):
    names = ["parseQuery", "Query", "q", None, "", "été_x", "aaaa", "get_aaa", "日本語テキスト", "a.b*c", "ab", "ba"]
    rows = [(i, n, names[(i * 5 + 1) % len(names)]) for i, n in enumerate(names)]
    df = spark.createDataFrame(rows, "id long, name string, signature string")
    probes = ["que", "q", "aa", "aaa", "été", "本語テ", "b*c", ".b", "zzz", "abq", "_", "query"]
    ix = gram_index.build(df, ("name", "signature"))
    found = gram_index.holding(ix, spark.createDataFrame([(p,) for p in probes + [""]], "p string"))
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.p, r.id) for r in found.collect()) == sorted((p, i) for i, a, b in rows for p in probes if p in (a or "").lower() or p in (b or "").lower())


def test_bm25_topk_is_the_best_of_all_scores(spark, monkeypatch):
    """Scoring where documents lie gives what all scores, ranked, give: by groups, behind a filter, in small blocks, for
    queries of one text, for repeated ids, and beyond the bound of weights."""
    words = "red blue ring plate hotGear x2Y the of and old".split()
    docs = [(i, " ".join(words[(i * j * 7 + j) % len(words)] for j in range(i % 9)), None if i % 31 == 0 else f"p{i % 3}") for i in range(400)]
    d = spark.createDataFrame(docs, "id long, t string, project string").repartition(5)
    q = spark.createDataFrame([(1, "red ring"), (2, "the of and"), (3, "red ring"), (4, "nothing"), (5, None), (6, "gear gear hotGear"), (7, "")], "q_id int, text string")
    some = spark.range(0, 400, 3).toDF("id")
    told = lambda df: sorted(tuple(r) for r in df.collect())
    repeated = d.unionByName(d.where("id % 50 = 0"))
    for scores, triples, hits in ((2_000_000, 2_000_000, 1_000_000), (30, 40, 20)):
        for name, value in (("SCORES", scores), ("TRIPLES", triples), ("HITS", hits)):
            monkeypatch.setattr(retrieve, name, value)
        for rows, by in ((d, ()), (d, ("project",)), (repeated, ())):
            ix = index.build(rows, "id", "t", by)
            for ids in (None, some):
                every = retrieve.bm25_scores(ix, q)
                every = every if ids is None else every.join(ids, "id", "left_semi")
                want = told(retrieve.top_k(every, 7, ["q_id", *by]).select("q_id", *by, "id", "score", "rank"))
                assert want and told(retrieve.bm25_topk(ix, q, 7, ids)) == want
    names = index.build(d.withColumn("id", F.concat(F.lit("é"), "id")), "id", "t")
    want = told(retrieve.top_k(retrieve.bm25_scores(names, q), 7, ["q_id"]).select("q_id", "id", "score", "rank"))
    assert told(retrieve.bm25_topk(names, q, 7)) == want
    monkeypatch.setattr(retrieve, "WEIGHTS", 3)
    assert told(retrieve.bm25_topk(names, q, 7)) == want


def test_nearest_holds_few_likenesses_at_once():
    """A block of 2,000 queries and 20,000 rows, 320 MB of likenesses, is met in steps; ties go by id."""
    import tracemalloc

    import numpy as np

    g = np.random.default_rng(5)
    rows = np.round(g.normal(size=(20_000, 4)), 1)
    queries, ids = rows[:2000], list(range(20_000, 0, -1))
    tracemalloc.start()
    q_ids, found, likes = retrieve._nearest(ids, rows, list(range(2000)), queries, 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6
    size = np.sqrt((rows * rows).sum(1))
    for q in (0, 255, 256, 1999):
        with np.errstate(divide="ignore", invalid="ignore"):
            sim = np.round(rows @ queries[q] / (size * size[q]), 6)
        want = sorted((-s, i) for s, i in zip(sim.tolist(), ids) if s == s)[:5]
        assert [(-s, i) for a, i, s in zip(q_ids, found, likes) if a == q] == want


def test_gram_index_files_equal_texts_once(spark):
    """Postings and hits are of distinct texts; the page, the total and the first rows of a project are of all rows."""
    names = ["red ring", "blue ring", None, "Ring", "plate"]
    rows = [(i, names[i % 5], "Big" if i % 2 else None, f"p{i % 3}") for i in range(600)]
    df = spark.createDataFrame(rows, "id long, name string, signature string, project string").repartition(4)
    ix = gram_index.build(df, ("name", "signature"))
    assert ix.texts.count() == 10 and ix.postings.select("text").distinct().count() <= 10 and ix.texts.agg(F.sum("n")).first()[0] == 600
    asks = spark.createDataFrame([(1, "ring"), (2, "RING"), (3, "i"), (4, "zz"), (5, "big")], "q_id int, query string")
    got = sorted(tuple(r) for r in gram_index.search(ix, asks, "name", 5, 3, F.col("id") % 4 < 3).collect())
    want, firsts = [], []
    for q, p in ((1, "ring"), (2, "ring"), (3, "i"), (5, "big")):
        hits = sorted(((n is not None, n or "", i, n) for i, n, s, _ in rows if i % 4 < 3 and (p in (n or "").lower() or p in (s or "").lower())))
        want += [(q, i, n, k + 1, len(hits)) for k, (_, _, i, n) in enumerate(hits) if 3 <= k < 8]
    assert got == sorted(want)
    for p in ("ring", "big"):
        for g in ("p0", "p1", "p2"):
            hits = sorted((n is not None, n or "", i) for i, n, s, x in rows if x == g and (p in (n or "").lower() or p in (s or "").lower()))
            firsts += [(p, g, i, k + 1) for k, (_, _, i) in enumerate(hits[:7])]
    first = gram_index.first_holding(ix, spark.createDataFrame([("ring",), ("big",)], "p string"), "name", 7, by=("project",))
    assert sorted(tuple(r) for r in first.select("p", "project", "id", "rank").collect()) == sorted(firsts)


def test_channels_run_side_by_side(spark, monkeypatch):
    """The lexical channel, the vectors and the names of a code search wait for each other here: one after the other they never would."""
    import threading

    gate = threading.Barrier(3, timeout=60)
    for name in ("bm25_topk", "probe_symbols", "cosine_topk"):
        def met(*a, _of=getattr(code_search, name), _n=[0], **k):
            _n[0] += 1
            if _n[0] == 1:
                gate.wait()
            return _of(*a, **k)

        monkeypatch.setattr(code_search, name, met)
    chunks = spark.createDataFrame([(i, f"src/f{i % 3}.rs", f"fn run{i}() {{ red ring }}", "rust", i, i + 5, "function", f"run{i}", None) for i in range(9)], "id long, file_path string, content string, language string, start_line long, end_line long, chunk_type string, name string, context_path string")
    symbols = chunks.select("id", "name", F.concat(F.lit("fn "), "name").alias("signature"), "file_path", "start_line", "end_line")
    v = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(9)], "id long, v array<double>")
    q = spark.createDataFrame([(3, "red ring run3")], "q_id long, query string")
    df = code_search.recall_code(chunks, symbols, symbols.selectExpr("id as src", "id as dst"), index.build(chunks, "id", "content"), q, v, v, v.where("id = 3").selectExpr("id as q_id", "v as qv"), 4)
    assert [r.id for r in df.orderBy("rank").collect()][0] == 3 and gate.n_waiting == 0 and not gate.broken


def test_vector_blocks_are_small(spark):
    """A block of rows and one of queries, met, need a few MB: no list of its hits, no second copy of its numbers."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    g = np.random.default_rng(8)
    v = pa.array(list(g.normal(size=(retrieve.ROW_BLOCK, 64)).astype(np.float64)))
    _, q = retrieve._matrix(pa.array(list(g.normal(size=(retrieve.QUERY_BLOCK, 64)))))
    assert retrieve.ROW_BLOCK * 64 * 8 <= 4 << 20 and retrieve.QUERY_STEP * retrieve.ROW_STEP * 8 <= 2 << 20
    tracemalloc.start()
    use, m = retrieve._matrix(v, 64)
    who, near, likes = retrieve._closest(np.arange(len(use)), m, q, 50)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(who) == 50 * len(q) and peak < 30e6
    s = np.round(m @ q[77] / (np.sqrt((m * m).sum(1)) * np.sqrt(q[77] @ q[77])), 6)
    assert near[who == 77].tolist() == sorted(range(len(s)), key=lambda i: (-s[i], i))[:50]


def test_passages_never_sort_texts(spark):
    """Beyond the broadcast bound candidates are hashed and texts streamed past them, with the same result."""
    docs = spark.createDataFrame([(i, f"word{i % 7} red ring of plate{i % 5} and more") for i in range(120)], "id long, text string")
    asked = spark.createDataFrame([(q, f"red ring of plate{q} and") for q in range(6)], "q_id int, passage string")
    ix = index.build(docs, "id", "text")
    want = {(q, i) for q in range(5) for i in range(120) if i % 5 == q}
    for most in (None, 3):
        found = retrieve.holding_documents(ix, docs, asked, most)
        assert {tuple(r) for r in found.collect()} == want
    assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
