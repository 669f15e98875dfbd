"""Graph queries over user transitions and the supply graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G, store
from ..sources.tables import as_of, memories, supply, table, transitions, with_views


def _seeds(s, d):
    return transitions(s, d).where("src like 'view_1%'").select(F.col("src").alias("node")).distinct()


def node_degree(s, d):
    return G.degree(transitions(s, d))


def neighbors_both(s, d):
    return G.neighbors(transitions(s, d), _seeds(s, d))


def induced_subgraph(s, d):
    nodes = transitions(s, d).where("weight >= 5").select(F.col("src").alias("node"))
    return G.induced(transitions(s, d), nodes)


def touching_subgraph(s, d):
    return G.touching(transitions(s, d), _seeds(s, d))


def _symbols(s, d):
    e = transitions(s, d)
    return e.select(F.col("src").alias("id")).union(e.select(F.col("dst").alias("id"))).distinct()


def callers(s, d):
    return G.callers(transitions(s, d), _symbols(s, d), _seeds(s, d))


def callees(s, d):
    return G.callees(transitions(s, d), _symbols(s, d), _seeds(s, d))


def bfs_depth3(s, d):
    e = supply(s, d)
    return G.bfs(e, e.agg(F.min("src").alias("node")), 3).select("node", "depth")


def bfs_capped(s, d):
    e = supply(s, d)
    return G.bfs(e, e.agg(F.min("src").alias("node")), 2, per_level=100, total=1000).select("node", "depth", "deferred")


def ppr_fixed15(s, d):
    seeds = _seeds(s, d)
    return G.pagerank(transitions(s, d), seeds, dampen_hubs=False).select("node", F.round("score", 8).alias("score"))


def ppr_hub_dampened(s, d):
    return G.pagerank(transitions(s, d), _seeds(s, d)).select("node", F.round("score", 8).alias("score"))


def ppr_converged(s, d):
    return G.pagerank(transitions(s, d), _seeds(s, d), tolerance=1e-6).select("node", F.round("score", 4).alias("score"))


def lineage_chain(s, d):
    links = table(s, d, "documents").selectExpr("doc_id as id", "case when doc_id % 5 <> 0 then doc_id - 1 when doc_id % 100 = 0 then doc_id + 4 end as superseded_by")
    starts = links.where("id % 5 = 4").select("id")
    return G.lineage(links, starts).select("start", "depth", "id", "cycle")


def communities(s, d):
    return G.communities(transitions(s, d))


def components(s, d):
    return G.components(transitions(s, d))


def projection_scope(s, d):
    e = transitions(s, d).withColumn("relation_type", F.when(F.col("weight") >= 10, "calls").otherwise("imports"))
    nodes, edges = G.projection(_symbols(s, d), e, ["calls"])
    n = nodes.select(F.lit("node").alias("kind"), F.col("id").alias("a"), F.lit("").alias("b"))
    return n.unionByName(edges.select(F.lit("edge").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b")))


def entity_search(s, d):
    return table(s, d, "customer").where(F.contains(F.lower("c_name"), F.lit("00012"))).select("c_custkey", "c_name").orderBy("c_custkey").limit(20)


def insert_graph(s, d):
    """Customers as entities, half of them new, and an order as a relation to the next customer: what is stored of each, and
    the relations whose ends are unknown."""
    c = table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 3 > 0, F.col("c_mktsegment")).alias("entity_type"), F.lit(None).cast("string").alias("description"), F.lit(None).cast("string").alias("user_id"))
    base = store.insert_entities(c.limit(0).withColumn("content_hash", F.lit("")), c.where("id % 2 = 0"))
    ents = store.insert_entities(base, c.where("id % 2 = 1"))
    new = table(s, d, "orders").select(F.col("o_custkey").alias("src"), (F.col("o_custkey") + F.col("o_orderkey") % 3).alias("dst"), F.col("o_orderstatus").alias("relation_type"), F.when(F.col("o_orderkey") % 4 > 0, F.col("o_totalprice") / 200000.0 - 0.1).alias("weight"))
    shape = new.limit(0).withColumns({"relation_class": F.lit(""), "provenance": F.lit(""), "valid_from": as_of(), "valid_until": as_of()})
    kept, bad = store.insert_relations(shape, new, ents, as_of())
    # on the scaled number, as SQL rounds: a decimal rounding puts halves that a double can't hold elsewhere
    rounded = (F.round(F.col("weight") * 1e6) / 1e6).alias("w")
    e = ents.select(F.lit("entity").alias("kind"), F.col("id").alias("a"), F.lit(None).cast("long").alias("b"), F.col("entity_type").alias("t"), F.lit(None).cast("double").alias("w"), F.col("content_hash").alias("more"))
    r = kept.select(F.lit("relation").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), F.col("relation_type").alias("t"), rounded, F.concat_ws(" ", "relation_class", "provenance").alias("more"))
    x = bad.select(F.lit("unknown").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), F.col("relation_type").alias("t"), rounded, F.lit(None).cast("string").alias("more"))
    return e.unionByName(r).unionByName(x)


_T, _S = with_views("transitions"), with_views("supply")
_SEED = "seed as (select distinct src as node from edges where src like 'view_1%')"
_SYM = "sym as (select src as id from edges union select dst from edges)"


def _ppr_sql(dampen: bool, digits: int) -> str:
    steps = ["r0 as (select node, t as r from nd)"]
    for i in range(15):
        steps.append(
            f"r{i + 1} as materialized (select nd.node, 0.5 * t + 0.5 * (coalesce(g.x, 0) + coalesce((select sum(r) from r{i} join nd using (node) where k is null), 0) * t) as r from nd left join (select dst, sum(r * p) as x from r{i} join st on st.src = node group by dst) g on g.dst = nd.node)"
        )
    score = "r / sqrt(greatest(coalesce(k, 1), 1))" if dampen else "r"
    return f"""{_T.rstrip()}, {_SEED}, o as (select src, sum(weight) as tot, count(*) as k from edges group by src), st as (select e.src, dst, weight / tot as p from edges e join o using (src)),
 {_SYM}, nd as (select id as node, case when seed.node is not null then 1.0 / (select count(*) from seed) else 0.0 end::double as t, k from sym left join seed on seed.node = id left join o on o.src = id),
 {', '.join(steps)} select node, round({score}, {digits}) as score from r15 join nd using (node)"""


_RELATED = "n as (select o_custkey as a, o_custkey + o_orderkey % 3 as b, o_orderstatus as t, case when o_orderkey % 4 > 0 then o_totalprice / 200000.0 - 0.1 end as w, o_custkey in (select c_custkey from customer) and o_custkey + o_orderkey % 3 in (select c_custkey from customer) as ok from orders)"

CATALOG = {
    "insert_graph": (insert_graph, f"""with {_RELATED} select 'entity' as kind, c_custkey as a, null::bigint as b, case when c_custkey % 3 > 0 then c_mktsegment else 'unknown' end as t, null::double as w, sha256(c_name || ': ') as more from customer
 union all select 'relation', a, b, t, round(greatest(0.0, least(1.0, coalesce(w, 1.0))), 6), 'observed imported_manual' from n where ok union all select 'unknown', a, b, t, round(w, 6), null from n where not ok"""),
    "node_degree": (node_degree, f"{_T} select node, count(*) as degree from (select src as node from edges union all select dst from edges) group by 1"),
    "neighbors_both": (neighbors_both, f"{_T.rstrip()}, {_SEED} select src as node, dst as neighbor, weight, 'out' as direction from edges where src in (from seed) union all select dst, src, weight, 'in' from edges where dst in (from seed)"),
    "induced_subgraph": (induced_subgraph, f"{_T.rstrip()}, n as (select distinct src from edges where weight >= 5) select src, dst, weight from edges where src in (from n) and dst in (from n)"),
    "touching_subgraph": (touching_subgraph, f"{_T.rstrip()}, {_SEED} select src, dst, weight from edges where src in (from seed) or dst in (from seed) order by src, dst limit 500"),
    "callers": (callers, f"{_T.rstrip()}, {_SEED} select distinct src as id from edges where dst in (from seed)"),
    "callees": (callees, f"{_T.rstrip()}, {_SEED} select distinct dst as id from edges where src in (from seed)"),
    "bfs_depth3": (bfs_depth3, f"""{_S.rstrip()}, e as (select * from edges), b as (select src as a, dst as b from e union select dst, src from e), s0 as (select min(src) as node from e),
 l1 as (select distinct b as node from b where a in (from s0) and b not in (from s0)), l2 as (select distinct b as node from b where a in (from l1) and b not in (from s0) and b not in (from l1)),
 l3 as (select distinct b as node from b where a in (from l2) and b not in (from s0) and b not in (from l1) and b not in (from l2))
 select node, 0 as depth from s0 union all select node, 1 from l1 union all select node, 2 from l2 union all select node, 3 from l3"""),
    "bfs_capped": (bfs_capped, f"""{_S.rstrip()}, b as (select src as a, dst as b from edges union select dst, src from edges), s0 as (select min(src) as node from edges),
 l1 as (select distinct b as node from b where a in (from s0) and b not in (from s0)), t1 as (select node, row_number() over (order by node) > 100 as deferred from l1),
 l2 as (select distinct b as node from b where a in (select node from t1 where not deferred) and b not in (from s0) and b not in (from l1)), t2 as (select node, row_number() over (order by node) > 100 as deferred from l2)
 select node, 0 as depth, false as deferred from s0 union all select node, 1, deferred from t1 union all select node, 2, deferred from t2"""),
    "ppr_fixed15": (ppr_fixed15, _ppr_sql(False, 8)),
    "ppr_hub_dampened": (ppr_hub_dampened, _ppr_sql(True, 8)),
    "ppr_converged": (ppr_converged, _ppr_sql(True, 4)),
    "lineage_chain": (lineage_chain, """with recursive l as (select doc_id as id, case when doc_id % 5 <> 0 then doc_id - 1 when doc_id % 100 = 0 then doc_id + 4 end as nxt from documents),
 c as (select id as start, 0 as depth, id, [id] as path, false as cycle from l where id % 5 = 4 union all select c.start, c.depth + 1, l.nxt, list_append(path, l.nxt), list_contains(path, l.nxt) from c join l using (id) where not c.cycle and l.nxt is not null and c.depth < 16)
 select start, depth, id, cycle from c"""),
    "communities": (communities, None),
    "components": (components, f"""{_T.rstrip().replace('with ', 'with recursive ', 1)}, b as (select src as a, dst as b from edges union select dst, src from edges), r as (select a as node, a as c from b union select b.b, r.c from r join b on b.a = r.node) select node, min(c) as component from r group by 1"""),
    "projection_scope": (projection_scope, f"{_T.rstrip()}, e as (select * from edges where weight >= 10) select 'edge' as kind, src as a, dst as b from e union all select 'node', id, '' from (select src as id from e union select dst from e)"),
    "entity_search": (entity_search, "select c_custkey, c_name from customer where contains(lower(c_name), '00012') order by c_custkey limit 20"),
}
