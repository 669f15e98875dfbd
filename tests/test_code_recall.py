"""Code recall against plain Python: channels, exact symbols, symbol graph, fusion and rerank, one query after the other."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F
from quarry.config import code_overfetch
from quarry.operators import code_search as CS, graph
from quarry.plans import code

CAMEL = regex.compile("[a-z][A-Z]|[0-9][A-Za-z]|[A-Z][A-Z][a-z]")


def tokens(t):
    out = []
    for w in regex.findall(r"[\p{L}\p{N}]+", t or ""):
        if CAMEL.search(w):
            x = w
            for p in ("([a-z])([A-Z])", "([0-9])([A-Za-z])", "([A-Z])([A-Z][a-z])"):
                x = regex.sub(p, r"\1 \2", x)
            out += x.lower().split(" ")
        out.append(w.lower())
    return out


def codeish(q):
    return bool(regex.search(r"_|::|/|\.", q) or regex.search("[a-z][A-Z]", q) or set(q.lower().split()) & {"fn", "function", "class", "struct", "trait", "impl", "method", "module", "import", "enum", "interface"})


def identifier(q):
    return len(q) >= 8 and bool(regex.fullmatch("[A-Za-z0-9_:.]+", q)) and bool(regex.search("[a-z][A-Z]", q))


def rerank(q, terms, path, name, ctx, body, is_code):
    p, n, x, c = ((v or "").lower() for v in (path, name, ctx, body))
    whole = len(q.encode()) >= 4 and (q in p or q in n or q in x)
    got = [0.7 if t in n else 0.55 if t in p else 0.45 if t in x else 0.2 if t in c else 0.0 for t in terms if len(t) >= 2]
    strong = whole or any(w >= 0.55 for w in got)
    raw = (1.8 if whole else 0) + sum(got) + (0.8 * sum(w > 0 for w in got) / len(terms) if terms else 0) + (0.8 if is_code and strong else 0) - (0.6 if len((body or "").encode()) < 96 and not strong else 0)
    return max(0.0, min(4.0, raw)) / 4


def exactness(q, terms, name, sig):
    n, s, own = name.lower(), (sig or "").lower(), set(tokens(name))
    long = len(q.encode()) >= 4
    raw = (2.2 if n == q else 1.6 if long and q in n else 0) + (0.8 if s and long and q in s else 0)
    got = [0.55 if t in own else 0.35 if t in n or t in s else 0.0 for t in terms if len(t) >= 2]
    raw += sum(got) + (0.8 * sum(w > 0 for w in got) / len(terms) if terms else 0)
    return max(0.0, min(4.0, raw)) / 4


def overlap(sa, sz, a, z):
    near = min(abs(a - sa), abs(z - sa))
    return 1.0 if a <= sz and sa <= z else 0.65 if near <= 6 else 0.35 if near <= 16 else 0.0


def opened(t):
    return (t or "").translate(str.maketrans("/\\._-:", "      "))


def ranked(scores, n):
    return sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:n]


def recall(chunks, symbols, relations, vectors, query, qv, limit, route, keep=lambda c: True, prefix=None, mapped=None, filtered=False):
    """[(id, score, rrf, lexical, exact)] of one query in one project."""
    fetch = code_overfetch(limit, filtered, False)
    low, terms, is_code = query.lower(), sorted(set(tokens(query))), codeish(query)
    texts = {i: Counter(tokens(" ".join(x for x in (c.file_path, opened(c.file_path), c.name, c.name and opened(c.name), c.context_path, c.context_path and opened(c.context_path), c.content) if x is not None))) for i, c in chunks.items()}
    n, avg = len(texts), sum(sum(t.values()) for t in texts.values()) / len(texts)
    df = Counter(t for c in texts.values() for t in c)
    bm = defaultdict(float)
    for t, qtf in Counter(tokens(query)).items():
        for i, c in texts.items():
            if c[t]:
                bm[i] += math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * qtf * 2.2 * c[t] / (c[t] + 1.2 * (0.25 + 0.75 * sum(c.values()) / avg))
    ok = {i for i, c in chunks.items() if keep(c)}
    lexical = [(i, s) for i, s in ranked({i: round(s, 6) for i, s in bm.items()}, limit if route == CS.FAST else fetch) if i in ok]
    cos = lambda ids: {i: round(float(qv @ vectors[i] / (np.linalg.norm(qv) * np.linalg.norm(vectors[i]))), 6) for i in ids}
    vector = [(i, s) for i, s in ranked(cos(vectors), fetch) if i in ok] if route == CS.HYBRID else []
    # symbols whose names hold a probe
    seeds = {}
    if route != CS.FAST:
        longest = sorted((t for t in terms if len(t.encode()) >= 3), key=lambda t: (-len(t.encode()), t))[:4]
        for k, p in enumerate(sorted({query.strip(), *longest} - {""})):
            hits = sorted((s for s in symbols.values() if p.lower() in s.name.lower() and (prefix is None or s.file_path.startswith(prefix))), key=lambda s: (s.name, s.id))
            for j, s in enumerate(hits[:20]):
                seeds[s.id] = min(seeds.get(s.id, (k, j)), (k, j))
    order = sorted(seeds, key=lambda i: (seeds[i], i))
    exact = defaultdict(float)
    found = {i for i, _ in lexical} | {i for i, _ in vector}
    if is_code and route != CS.FAST:
        best = [(exactness(low, terms, symbols[i].name, symbols[i].signature), pos, i) for pos, i in enumerate(order)]
        best = sorted((b for b in best if b[0] >= 0.45), key=lambda b: (-b[0], b[1]))[:20]
        files = sorted({symbols[i].file_path for _, _, i in best})[:8]
        pool = {i for i in ok if chunks[i].file_path in files} | (found & ok)
        near = {}
        for _, _, i in best:
            if mapped is not None and i in mapped:
                near[mapped[i][0]] = max(near.get(mapped[i][0], 0), mapped[i][1])
        near = {i: m for i, m in sorted(near.items(), key=lambda x: (-x[1], x[0]))[:80] if i in ok}
        for i in pool | set(near):
            for e, _, s in best:
                if symbols[s].file_path == chunks[i].file_path:
                    exact[i] = max(exact[i], min(1.0, e * overlap(symbols[s].start_line, symbols[s].end_line, chunks[i].start_line, chunks[i].end_line)))
        for i, m in near.items():
            exact[i] = max(exact[i], m)
    exact = {i: e for i, e in exact.items() if e > 0}
    lexical += [(i, 0.0) for i, _ in ranked({i: e for i, e in exact.items() if i not in found}, 40)]
    found = {i for i, _ in lexical} | {i for i, _ in vector}
    ppr = {}
    if route == CS.HYBRID:
        both = [i for i, _ in ranked(cos([i for i in vectors if i in symbols]), 20)]
        nodes = sorted(set(both) | set(order))
        at = {i: k for k, i in enumerate(nodes)}
        edges = [(at[a], at[b]) for a, b in relations if a in at and b in at]
        if nodes:
            a, b = (np.array([e[k] for e in edges], np.int64) for k in (0, 1))
            r, degree = graph.iterate(a, b, np.ones(len(edges)), len(nodes), list(range(len(nodes))), 15, 0.5, 1e-6)
            score = r / np.sqrt(np.maximum(degree, 1))
            for i in found:
                c = chunks[i]
                got = [score[at[s]] for s in nodes if symbols[s].file_path == c.file_path and c.start_line <= symbols[s].end_line and symbols[s].start_line <= c.end_line]
                if got and max(got) > 0:
                    ppr[i] = max(got)
    rrf = defaultdict(float)
    for w, ids in ((0.5, [i for i, _ in vector]), (0.2, [i for i, _ in lexical]), (0.3, [i for i, _ in ranked(ppr, len(ppr))])):
        for k, i in enumerate(ids):
            rrf[i] += w / (61 + k)
    cut = dict(ranked({i: round(s, 8) for i, s in rrf.items()}, fetch))
    for i in exact:
        if i in found and i not in cut:
            cut[i] = 0.0
    out = {}
    for i, s in cut.items():
        c = chunks[i]
        lex, ex = rerank(low, terms, c.file_path, c.name, c.context_path, c.content, is_code), exact.get(i, 0.0)
        out[i] = (round(s + lex * (0.02 if is_code else 0.008) + ex * (0.035 if is_code else 0.0), 8), s, lex, ex)
    return [(i, *out[i]) for i in sorted(out, key=lambda i: (-out[i][0], i))[:limit]]


@pytest.fixture(scope="module")
def corpus(spark, sf):
    c = code._code_search(spark, sf)
    rows = lambda n: {r.id: r for r in c[n].collect()}
    v = {r.id: np.array(r.v, np.float64) for r in c["vectors"].collect()}
    queries = {r.q_id: r.query for r in c["queries"].collect()}
    return rows("chunks"), rows("symbols"), [tuple(r) for r in c["relations"].collect()], v, queries


def same(df, want):
    """Equal ids in equal order, and equal scores, for each key."""
    got = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: r["rank"]):
        got[(r.q_id, r.project) if "project" in df.columns else r.q_id].append((r.id, r.score, r.rrf_score, r.lexical_score, r.exact_score))
    assert set(got) == {k for k, v in want.items() if v}
    for k, rows in got.items():
        assert [r[0] for r in rows] == [r[0] for r in want[k]], k
        assert np.allclose([r[1:] for r in rows], [r[1:] for r in want[k]], atol=2e-6), k


def route(q, served=CS.HYBRID):
    return CS.FAST if served == CS.HYBRID and identifier(q) else served


def test_recall_code(spark, sf, corpus):
    chunks, symbols, relations, v, queries = corpus
    df = code.recall_code(spark, sf)
    same(df, {q: recall(chunks, symbols, relations, v, t, v[q], 10, route(t)) for q, t in queries.items()})
    # one long identifier takes the fast path
    assert {r.q_id for r in df.where(F.col("path") == CS.FAST).collect()} == {q for q, t in queries.items() if identifier(t)} != set()


def test_recall_code_filtered(spark, sf, corpus):
    chunks, symbols, relations, v, queries = corpus
    keep = lambda c: c.file_path.startswith("src/small") and c.language.lower() == "rust" and c.chunk_type.lower() == "function"
    mapped = {i: (i, 0.9) for i in symbols if i % 2 == 0}
    same(code.recall_code_filtered(spark, sf), {q: recall(chunks, symbols, relations, v, t, v[q], 10, route(t), keep, "src/small", mapped, True) for q, t in queries.items()})


def test_recall_code_degraded(spark, sf, corpus):
    chunks, symbols, relations, v, queries = corpus
    df = code.recall_code_degraded(spark, sf)
    same(df, {q: recall(chunks, symbols, relations, v, t, v[q], 10, CS.LEXICAL) for q, t in queries.items()})
    assert {(r.partial, r.reason) for r in df.collect()} == {(True, "semantic_or_graph_unavailable")}


def test_recall_code_projects(spark, sf, corpus):
    import zlib

    chunks, symbols, relations, v, queries = corpus
    of = lambda x: x.file_path.split("/")[1]
    want, state = {}, {}
    for p in {of(c) for c in chunks.values()}:
        mine, own = {i: c for i, c in chunks.items() if of(c) == p}, {i: s for i, s in symbols.items() if of(s) == p}
        state[p] = zlib.crc32(p.encode()) % 4
        if state[p] < 3:
            for q, t in queries.items():
                want[q, p] = recall(mine, own, relations, {i: x for i, x in v.items() if i in mine}, t, v[q], 5, route(t, CS.HYBRID if state[p] < 2 else CS.LEXICAL))
    df = code.recall_code_projects(spark, sf)
    same(df, want)
    names = ("fresh", "stale", "partial", None)
    for r in df.collect():
        assert r.freshness == names[zlib.crc32(chunks[r.id].file_path.encode()) % 4]
        assert r.partial == (state[r.project] in (1, 2)) and (r.reason is None) == (state[r.project] == 0)


def test_equal_texts_are_answered_once(spark, sf, monkeypatch):
    """Queries of one text share what depends on the text: lexical hits of distinct texts only, and of opened files only the
    best chunks; each still has its own answer."""
    from quarry.operators import retrieve

    asked = []
    real = retrieve._weights
    monkeypatch.setattr(retrieve, "_weights", lambda ix, qs, k1: asked.append(qs.count()) or real(ix, qs, k1))
    c = code._code_search(spark, sf)
    many = c["queries"].crossJoin(spark.range(40).withColumnRenamed("id", "copy"))
    many = many.select((F.col("q_id") + F.col("copy") * 100_000).alias("q_id"), "query")
    rows = CS.recall_code(**{**c, "queries": many}, limit=10).collect()
    assert asked == [c["queries"].select("query").distinct().count()]
    # a copy has no vector, and is answered as one alone is
    no_vectors = {**c, "query_vectors": c["query_vectors"].limit(0)}
    alone = {(r.q_id, r.rank): (r.id, r.score) for r in CS.recall_code(**no_vectors, limit=10).collect()}
    got = {(r.q_id, r.rank): (r.id, r.score) for r in rows}
    for k in (1, 39):
        assert {(q - k * 100_000, r): x for (q, r), x in got.items() if q // 100_000 == k} == alone
