"""Values of the queries that SQL cannot express: communities, recall with a graph, approximate neighbours."""

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from quarry.config import CONFIG
from quarry.operators import graph, retrieve
from quarry.plans import graph as plans, retrieval
from quarry.sources.tables import memories, transitions


def swept(edges, resolution=1.0, sweeps=20):
    """Local moving in node order on plain dicts: node -> community."""
    adj, total = defaultdict(lambda: defaultdict(float)), sum(w for *_, w in edges)
    for a, b, w in edges:
        adj[a], adj[b]
        if a != b:
            adj[a][b] += w
            adj[b][a] += w
    k = {n: sum(adj[n].values()) for n in adj}
    home, mass = {n: n for n in adj}, dict(k)
    for _ in range(sweeps):
        moved = 0
        for n in sorted(adj):
            into = defaultdict(float)
            for m, w in adj[n].items():
                into[home[m]] += w
            mass[home[n]] -= k[n]
            gain = {c: into[c] - resolution * k[n] * mass[c] / (2 * total) for c in {*into, home[n]}}
            best = home[n]
            for c in sorted(into):
                if gain[c] > gain[best] + 1e-10:
                    best = c
            moved += best != home[n]
            home[n] = best
            mass[best] += k[n]
        if not moved:
            break
    name = {}
    for n in sorted(adj):
        name.setdefault(home[n], n)
    return {n: name[c] for n, c in home.items()}


def quality(edges, home):
    total, inner, mass = sum(w for *_, w in edges), 0.0, defaultdict(float)
    for a, b, w in edges:
        if a != b:
            mass[home[a]] += w
            mass[home[b]] += w
            inner += 2 * w * (home[a] == home[b])
    return inner / (2 * total) - sum(m * m for m in mass.values()) / (4 * total * total)


def test_communities(spark, sf):
    edges = [tuple(r) for r in transitions(spark, sf).select("src", "dst", "weight").collect()]
    assert {r.node: r.community for r in plans.communities(spark, sf).collect()} == swept(edges)


def test_community_rounds(spark, sf):
    """Rounds never lower the modularity, come near the sweep's, tell cliques apart, and name by the smallest node."""
    edges = [tuple(r) for r in transitions(spark, sf).select("src", "dst", "weight").collect()]
    trace = []
    got = {r.node: r.community for r in graph.community_rounds(transitions(spark, sf), trace=trace).collect()}
    assert [q for q, _ in trace] == sorted(q for q, _ in trace) and abs(quality(edges, got) - trace[-1][0]) < 1e-9
    assert quality(edges, got) >= 0.9 * quality(edges, swept(edges))
    assert all(c == min(n for n in got if got[n] == c) for c in got.values())
    cliques = [(c * 10 + i, c * 10 + j, 1.0) for c in range(4) for i in range(6) for j in range(i)] + [(0, 10, 0.5), (10, 20, 0.5), (20, 30, 0.5), (7, 7, 1.0)]
    found = {r.node: r.community for r in graph.community_rounds(spark.createDataFrame(cliques, "src long, dst long, weight double")).collect()}
    assert found == {c * 10 + i: c * 10 for c in range(4) for i in range(6)} | {7: 7}


def test_communities_of_large_graphs(spark, monkeypatch):
    monkeypatch.setattr(graph, "SWEEP_EDGES", 3)
    e = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (3, 1, 1.0), (4, 5, 1.0), (5, 6, 1.0), (6, 4, 1.0), (3, 4, 0.1)], "src long, dst long, weight double")
    assert {r.node: r.community for r in graph.communities(e).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4}


def test_recall_graph(spark, sf):
    """The three channels fused and reranked, the graph channel iterated on each query's own subgraph."""
    mem = {r.id: r for r in memories(spark, sf).withColumn("age", (F.unix_micros(retrieval.as_of()) - F.unix_micros(F.coalesce("event_time", "ingestion_time"))) / 86_400_000_000.0).collect()}
    ok = {i for i, m in mem.items() if m.valid_until is None or str(m.valid_until) > retrieval.AS_OF}
    top = lambda rows, n: sorted(rows, key=lambda x: (-x[1], x[0]))[:n]
    channels = defaultdict(lambda: {"bm25": [], "vector": []})
    for r in retrieve.bm25_scores(retrieval._index(spark, sf), retrieval._queries(spark, sf)).collect():
        if r.id in ok:
            channels[r.q_id]["bm25"].append((r.id, r.score))
    for r in retrieve.cosine_topk(retrieval._vectors(spark, sf).join(spark.createDataFrame([(i,) for i in ok], "id long"), "id", "left_semi"), retrieval._vector_queries(spark, sf), 50).collect():
        channels[r.q_id]["vector"].append((r.id, r.score))
    ids, spaces = sorted(mem), defaultdict(list)
    for i in ids:
        spaces[mem[i].namespace].append(i)
    edges = [(i, i + 10, 1.0) for i in ids] + [(a, b, 1.0 + a % 3) for s in spaces.values() for a, b in zip(s, s[1:])]
    want = {}
    for q, c in channels.items():
        lists = {n: [i for i, _ in top(rows, 50)] for n, rows in c.items()}
        order = [i for i in dict.fromkeys(lists["vector"] + lists["bm25"]) if i in mem]
        at = {n: k for k, n in enumerate(sorted(order))}
        inner = [(at[a], at[b], w) for a, b, w in edges if a in at and b in at]
        a, b, w = (np.array([e[k] for e in inner], t) for k, t in ((0, np.int64), (1, np.int64), (2, np.float64)))
        r, degree = graph.iterate(a, b, w, len(at), [at[i] for i in order[:20]], 15, 0.5, 1e-6)
        scores = {i: float(r[k] / np.sqrt(max(degree[k], 1))) for i, k in at.items()}
        lists["ppr"] = [i for i, _ in top(scores.items(), len(scores))]
        fused = defaultdict(float)
        for n, weight in zip(("vector", "bm25", "ppr"), CONFIG.memory_weights):
            for k, i in enumerate(lists[n]):
                fused[i] += weight / (61 + k)
        best = {}
        for i, f in top([(i, round(f, 8)) for i, f in fused.items()], 10):
            m = mem[i]
            half = {"episodic": 30.0, "procedural": 365.0}.get(m.memory_type, 180.0)
            decay = max(0.05, 0.5 ** (max(0.0, m.age) / (1 + 0.5 * np.log1p(m.access_count)) / half))
            s = round(f * np.sqrt(max(0.25, min(4.0, m.importance_score))) * decay * (1 + min(0.5 * np.log1p(m.access_count), 3.0)), 8)
            key = m.content_hash or " ".join((m.content or "").split()).lower()
            best[key] = max(best.get(key, (-1.0, 0)), (s, -i))
        want[q] = [(-i, s) for s, i in sorted(best.values(), reverse=True)]
    got = defaultdict(list)
    for r in sorted(retrieval.recall_graph(spark, sf).collect(), key=lambda r: r["rank"]):
        got[r.q_id].append((r.id, r.score))
    assert set(got) == set(want)
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]] and np.allclose([s for _, s in got[q]], [s for _, s in want[q]], atol=2e-8), q


@pytest.mark.parametrize("label", [None, 1])
def test_ann(spark, sf, label):
    """Nine of ten neighbours of all asking vectors, with the exact similarities."""
    got = {(r.q_id, r.id): r.score for r in (retrieval.ann_topk if label is None else retrieval.ann_topk_filtered)(spark, sf).collect()}
    want = {(r.q_id, r.id): r.score for r in (retrieval.cosine_topk if label is None else retrieval.cosine_topk_filtered)(spark, sf).collect()}
    assert len(got) == len(want) and sum(k in got for k in want) >= 0.9 * len(want)
    assert all(abs(got[k] - s) < 1e-6 for k, s in want.items() if k in got)


def test_insert_graph_rounds_as_sql(spark):
    """The weights of relations at a half of the last digit, which the smallest tables lack, are rounded as in SQL."""
    import parity
    from quarry.plans.graph import CATALOG

    sf = "/root/testdata/sf0.01"
    query, sql = CATALOG["insert_graph"]
    assert parity.differ(query(spark, sf), parity.connect(sf), sql) is None
