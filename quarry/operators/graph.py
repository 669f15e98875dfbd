"""Graph operators on edges(src, dst, weight): neighbours, traversal, PageRank, communities, projections, lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..config import CONFIG
from ..workspace import discard, stored


def degree(edges: DataFrame) -> DataFrame:
    """Edges at either end of each node."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node"))
    return ends.groupBy("node").agg(F.count("*").alias("degree"))


def neighbors(edges: DataFrame, nodes: DataFrame, direction: str = "both") -> DataFrame:
    """(node, neighbor, weight, direction) of each given node."""
    n = nodes.select("node").distinct()
    out = edges.join(n, edges.src == n.node).select("node", F.col("dst").alias("neighbor"), "weight", F.lit("out").alias("direction"))
    into = edges.join(n, edges.dst == n.node).select("node", F.col("src").alias("neighbor"), "weight", F.lit("in").alias("direction"))
    return {"out": out, "in": into, "both": out.unionByName(into)}[direction]


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes."""
    n = nodes.select("node").distinct()
    return edges.join(n, edges.src == n.node, "left_semi").join(n, edges.dst == n.node, "left_semi")


def touching(edges: DataFrame, nodes: DataFrame, limit: int = CONFIG.touching_limit) -> DataFrame:
    """Edges with an end among the nodes, in a fixed order, at most ``limit``."""
    n = nodes.select("node").distinct()
    both = edges.join(n, edges.src == n.node, "left_semi").union(edges.join(n, edges.dst == n.node, "left_semi")).distinct()
    return both.orderBy("src", "dst").limit(limit)


def callers(edges: DataFrame, symbols: DataFrame, of: DataFrame) -> DataFrame:
    hit = edges.join(of.select(F.col("node").alias("dst")).distinct(), "dst", "left_semi").select(F.col("src").alias("id"))
    return symbols.join(hit, "id", "left_semi")


def callees(edges: DataFrame, symbols: DataFrame, of: DataFrame) -> DataFrame:
    hit = edges.join(of.select(F.col("node").alias("src")).distinct(), "src", "left_semi").select(F.col("dst").alias("id"))
    return symbols.join(hit, "id", "left_semi")


def bfs(edges: DataFrame, seeds: DataFrame, depth: int, per_level: int | None = None, total: int | None = None) -> DataFrame:
    """(node, depth, deferred) within ``depth`` hops, either direction; with caps, the first ids of each level are taken
    and the others are marked deferred and not expanded. A level is one join of the frontier with the edges."""
    depth = max(1, min(CONFIG.bfs_max_depth, depth))
    both = edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    seen = stored(seeds.select("node", F.lit(0).alias("depth"), F.lit(False).alias("deferred")).distinct(), "bfs")
    count = seen.count() if total else 0
    for d in range(1, depth + 1):
        front = seen.where((F.col("depth") == d - 1) & ~F.col("deferred")).select(F.col("node").alias("src"))
        new = both.join(front, "src").select(F.col("dst").alias("node")).distinct().join(seen.select("node"), "node", "left_anti")
        room = min(x for x in (per_level, None if total is None else max(0, total - count)) if x is not None) if per_level or total else None
        if room is None:
            level = new.withColumn("deferred", F.lit(False))
        else:
            first = new.orderBy("node").limit(room).withColumn("_in", F.lit(True))
            level = new.join(first, "node", "left").select("node", F.col("_in").isNull().alias("deferred"))
        seen = stored(seen.unionByName(level.select("node", F.lit(d).alias("depth"), "deferred")), "bfs")
        if total:
            count = seen.where("not deferred").count()
    return seen


def iterate(a, b, w, n: int, seeds: list[int], iterations: int, damping: float, tolerance: float | None):
    """(scores, out-degrees) of nodes 0 to n - 1 of a graph in arrays: edges from ``a`` to ``b`` with weights ``w``."""
    import numpy as np

    start = np.zeros(n)
    start[seeds or slice(None)] = 1.0 / (len(set(seeds)) or max(1, n))
    total, degree = np.bincount(a, w, n), np.bincount(a, minlength=n)
    p = np.divide(w, total[a], out=np.zeros(len(a)), where=total[a] != 0)
    r = start
    for _ in range(iterations):
        new = (1 - damping) * start + damping * (np.bincount(b, r[a] * p, n) + r[total == 0].sum() * start)
        moved, r = np.abs(new - r).sum(), new
        if tolerance is not None and moved < tolerance:
            break
    return r, degree


def _small_pagerank(rows: DataFrame, kind: str, iterations: int, damping: float, tolerance: float | None) -> DataFrame:
    """(node, r, out_degree) of a graph whose counted edges fit one task. ``rows``: edges, and seeds with a null dst."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        t = pa.Table.from_batches(list(batches)).to_pandas()
        edge = t[t["dst"].notna()]
        nodes = sorted(set(t["src"]) | set(edge["dst"]))
        at = {n: i for i, n in enumerate(nodes)}
        a, b = edge["src"].map(at).to_numpy(np.int64), edge["dst"].map(at).to_numpy(np.int64)
        w = edge["weight"].to_numpy(np.float64)
        seeds = sorted(set(t.loc[t["dst"].isna(), "src"].map(at)))
        r, degree = iterate(a, b, w, len(nodes), seeds, iterations, damping, tolerance)
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(r), pa.array([int(d) or None for d in degree], pa.int64())], ["node", "r", "out_degree"])

    return rows.coalesce(1).mapInArrow(run, f"node {kind}, r double, out_degree long")


def pagerank(edges: DataFrame, seeds: DataFrame, iterations: int = CONFIG.ppr_iterations, damping: float = CONFIG.ppr_damping, tolerance: float | None = None, dampen_hubs: bool = True) -> DataFrame:
    """Personalised PageRank (node, score): weighted transitions, dangling mass to the seeds (node), each an equal share;
    without a seed every node is one.

    ``tolerance`` stops early on the L1 change; without it all iterations run. Hubs: score / sqrt(out-degree). A graph
    of at most ``broadcast_rows`` edges is iterated by one task, a larger one by joins over all tasks."""
    e = stored(edges.groupBy("src", "dst").agg(F.sum("weight").alias("weight")), "ppr-graph")
    s = seeds.select("node").distinct()
    if e.count() <= CONFIG.broadcast_rows:
        kind = e.schema["src"].dataType.simpleString()
        rows = e.union(s.select(F.col("node").alias("src"), F.lit(None).cast(kind).alias("dst"), F.lit(None).cast("double").alias("weight")))
        final = _small_pagerank(rows, kind, iterations, damping, tolerance)
    else:
        final = _joined_pagerank(e, s, iterations, damping, tolerance)
    score = F.col("r") / F.sqrt(F.greatest(F.coalesce("out_degree", F.lit(1)), F.lit(1))) if dampen_hubs else F.col("r")
    return final.select("node", score.alias("score"))


def _joined_pagerank(e: DataFrame, s: DataFrame, iterations: int, damping: float, tolerance: float | None) -> DataFrame:
    out = e.groupBy("src").agg(F.sum("weight").alias("total"), F.count("*").alias("out_degree"))
    step = stored(e.join(out, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("p")), "ppr-edges")
    n_seeds = s.count()
    nodes = e.select(F.col("src").alias("node")).union(e.select(F.col("dst").alias("node"))).union(s).distinct()
    if not n_seeds:
        s, n_seeds = nodes, nodes.count()
    base = nodes.join(s.withColumn("t", F.lit(1.0 / max(1, n_seeds))), "node", "left").join(out.select(F.col("src").alias("node"), "out_degree"), "node", "left")
    base = stored(base.select("node", F.coalesce("t", F.lit(0.0)).alias("t"), "out_degree"), "ppr-nodes")
    ranks = base.select("node", F.col("t").alias("r"))
    for _ in range(iterations):
        lost = ranks.join(base.where("out_degree is null").select("node"), "node", "left_semi").agg(F.coalesce(F.sum("r"), F.lit(0.0))).first()[0]
        got = ranks.join(step, ranks.node == step.src).groupBy("dst").agg(F.sum(F.col("r") * F.col("p")).alias("in"))
        new = base.join(got, base.node == got.dst, "left")
        new = stored(new.select("node", ((1 - damping) * F.col("t") + damping * (F.coalesce("in", F.lit(0.0)) + F.lit(lost) * F.col("t"))).alias("r")), "ppr-ranks")
        if tolerance is not None:
            moved = new.withColumnRenamed("r", "r2").join(ranks, "node").agg(F.sum(F.abs(F.col("r2") - F.col("r")))).first()[0] or 0.0
        ranks = new
        if tolerance is not None and moved < tolerance:
            break
    return ranks.join(base, "node").select("node", "r", "out_degree")


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, component): smallest node id reachable, by repeated minimum over neighbours with pointer jumping."""
    both = stored(edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), "cc-edges")
    label = stored(both.groupBy("src").agg(F.least("src", F.min("dst")).alias("c")).select(F.col("src").alias("node"), "c"), "cc")
    for _ in range(rounds):
        near = both.join(label, both.dst == label.node).groupBy("src").agg(F.min("c").alias("m"))
        new = label.join(near, label.node == near.src, "left").select("node", F.least("c", "m").alias("c"), F.col("c").alias("old"))
        jump = new.select(F.col("node").alias("k"), F.col("c").alias("j"))
        new = stored(new.join(jump, F.col("c") == F.col("k"), "left").select("node", F.least("c", "j").alias("c"), "old"), "cc")
        changed = new.where("c <> old").limit(1).count()
        label = new.select("node", "c")
        if not changed:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return label.select("node", F.col("c").alias("component"))


#: Edges that one task sweeps in node order; a larger graph is moved by rounds over all tasks.
SWEEP_EDGES = 200_000


def communities(edges: DataFrame, resolution: float = 1.0, sweeps: int = 20) -> DataFrame:
    """(node, community): single-level local moving on the undirected weighted graph; the community is named after its
    smallest node. Modularity uses the whole graph's weight.

    Moves in node order depend on each other, so a graph of up to ``SWEEP_EDGES`` counted edges is swept by one task; of a
    larger one, ``community_rounds`` moves the nodes."""
    if edges.limit(SWEEP_EDGES + 1).count() > SWEEP_EDGES:
        return community_rounds(edges, resolution)
    total = edges.agg(F.sum("weight")).first()[0] or 0.0

    def sweep(batches):
        import pyarrow as pa

        table = pa.Table.from_batches(list(batches))
        if not table.num_rows:
            return
        src, dst, w = (table.column(c).to_pylist() for c in ("src", "dst", "weight"))
        adj: dict = {}
        for a, b, x in zip(src, dst, w):
            if a != b:
                adj.setdefault(a, {})[b] = adj.get(a, {}).get(b, 0.0) + x
                adj.setdefault(b, {})[a] = adj.get(b, {}).get(a, 0.0) + x
            else:
                adj.setdefault(a, {})
        nodes = sorted(adj)
        k = {n: sum(adj[n].values()) for n in nodes}
        home, mass = {n: n for n in nodes}, dict(k)
        for _ in range(sweeps):
            moved = False
            for n in nodes:
                into: dict = {}
                for m, x in adj[n].items():
                    into[home[m]] = into.get(home[m], 0.0) + x
                own = home[n]
                mass[own] -= k[n]
                gain = lambda c: into.get(c, 0.0) - resolution * k[n] * mass[c] / (2 * total)  # noqa: B023,E731
                best, top = own, gain(own)
                for c in sorted(into):
                    if gain(c) > top + 1e-10:
                        best, top = c, gain(c)
                mass[best] += k[n]
                if best != own:
                    home[n], moved = best, True
            if not moved:
                break
        name: dict = {}
        for n in nodes:
            name.setdefault(home[n], n)
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array([name[home[n]] for n in nodes])], ["node", "community"])

    kind = edges.schema["src"].dataType.simpleString()
    return edges.select("src", "dst", "weight").coalesce(1).mapInArrow(sweep, f"node {kind}, community {kind}")


def modularity(both: DataFrame, home: DataFrame, weight: float, resolution: float = 1.0) -> float:
    """Of communities ``home(node, c, k)`` of a graph ``both(a, b, w)`` whose edges stand in both directions."""
    at = lambda n, c: home.select(F.col("node").alias(n), F.col("c").alias(c))
    inner = both.join(at("a", "ca"), "a").join(at("b", "cb"), "b").where("ca = cb").agg(F.coalesce(F.sum("w"), F.lit(0.0))).first()[0]
    mass = home.groupBy("c").agg(F.sum("k").alias("m")).agg(F.coalesce(F.sum(F.col("m") * F.col("m")), F.lit(0.0))).first()[0]
    return inner / (2 * weight) - resolution * mass / (4 * weight * weight) if weight else 0.0


def community_rounds(edges: DataFrame, resolution: float = 1.0, most: int = 40, trace: list | None = None) -> DataFrame:
    """(node, community) by rounds: in each, of the nodes that gain by a move a share, chosen by hash, moves to the
    neighbouring community of the largest gain; masses, weights into communities and modularity are pre-aggregated sums, so
    neither a hub nor a giant community is gathered. A round that doesn't raise the modularity is undone and the share
    halved; rounds end when no node gains, or after ``most``. ``trace`` receives (modularity, share) of each round kept."""
    one = edges.where("src <> dst").select(F.col("src").alias("a"), F.col("dst").alias("b"), F.col("weight").cast("double").alias("w"))
    both = stored(one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")).groupBy("a", "b").agg(F.sum("w").alias("w")), "community-edges")
    weight = float(edges.agg(F.sum("weight")).first()[0] or 0.0)
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    home = stored(nodes.join(both.groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("k")), "node", "left").select("node", F.col("node").alias("c"), F.coalesce("k", F.lit(0.0)).alias("k")), "community-home")
    now, share = modularity(both, home, weight, resolution), 2
    for r in range(most):
        mass = home.groupBy("c").agg(F.sum("k").alias("mass"))
        into = both.join(home.select(F.col("node").alias("b"), "c"), "b").groupBy("a", "c").agg(F.sum("w").alias("w"))
        # a node's own community is an option even if no neighbour is in it
        into = into.unionByName(home.select(F.col("node").alias("a"), "c", F.lit(0.0).alias("w"))).groupBy("a", "c").agg(F.sum("w").alias("w"))
        own = home.select(F.col("node").alias("a"), F.col("c").alias("own"), "k")
        options = into.join(own, "a").join(mass, "c")
        gain = F.col("w") - resolution * F.col("k") * (F.col("mass") - F.when(F.col("c") == F.col("own"), F.col("k")).otherwise(0.0)) / (2 * weight)
        best = options.withColumn("gain", gain).groupBy("a", "own").agg(F.max(F.when(F.col("c") == F.col("own"), F.col("gain"))).alias("stay"), F.min(F.struct((-F.col("gain")).alias("g"), "c")).alias("top"))
        moves = best.where((-F.col("top.g") > F.col("stay") + 1e-10) & (F.col("top.c") != F.col("own"))).select(F.col("a").alias("node"), F.col("top.c").alias("to"))
        moves = stored(moves, "community-moves")
        if not moves.limit(1).count():
            discard(moves)
            break
        some = moves.where(F.pmod(F.xxhash64("node", F.lit(r)), F.lit(share)) == 0)
        new = stored(home.join(some, "node", "left").select("node", F.coalesce("to", "c").alias("c"), "k"), "community-home")
        then = modularity(both, new, weight, resolution)
        discard(moves)
        if then > now + 1e-12:
            discard(home)
            home, now = new, then
            if trace is not None:
                trace.append((now, 1 / share))
        else:
            discard(new)
            share = min(64, 2 * share)
    name = home.groupBy("c").agg(F.min("node").alias("community"))
    return home.join(name, "c").select("node", "community")


def projection(nodes: DataFrame, edges: DataFrame, types: list[str] | None, prune: bool = True) -> tuple[DataFrame, DataFrame]:
    """Edges of the given relation types in canonical order, and the nodes that they refer to."""
    e = (edges if types is None else edges.where(F.col("relation_type").isin(types))).orderBy("src", "dst", "relation_type")
    if not prune:
        return nodes.orderBy("id"), e
    used = e.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return nodes.join(used, "id", "left_semi").orderBy("id"), e


def lineage(links: DataFrame, starts: DataFrame, depth: int = 16) -> DataFrame:
    """(start, depth, id, cycle): the chain of ``superseded_by`` from each start; stops at a repeated id or the depth.

    ``links``: (id, superseded_by). One join a step, as long as some chain goes on."""
    links = links.where("superseded_by is not null").select("id", "superseded_by")
    at = starts.select(F.col("id").alias("start"), F.lit(0).alias("depth"), F.col("id"), F.array("id").alias("path"), F.lit(False).alias("cycle"))
    out = stored(at, "lineage")
    at = out
    for d in range(1, depth + 1):
        step = at.where("not cycle").join(links, "id").select("start", F.lit(d).alias("depth"), F.col("superseded_by").alias("id"), F.concat("path", F.array("superseded_by")).alias("path"), F.array_contains("path", F.col("superseded_by")).alias("cycle"))
        at = stored(step, "lineage")
        if not at.limit(1).count():
            break
        out = out.unionByName(at)
    return out.select("start", "depth", "id", "cycle")
