"""Code search for a batch of queries: channels, exact symbols, symbol graph, fusion, rerank; serving plans and freshness.

Tables: chunks (id, file_path, content, language, start_line, end_line, chunk_type, name, context_path), symbols
(id, name, signature, file_path, start_line, end_line), relations (src, dst), queries (q_id, query).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import CONFIG, code_overfetch
from ..functions import text
from ..workspace import stored, together
from .gram_index import GramIndex, build as gram_index, first_holding
from .index import LexicalIndex
from .joins import overlap_score
from .retrieve import bm25_topk, bounded, cosine_topk, graph_channel, ordered_union, top_k

# Least exactness and number of exact symbols, files opened for them, mapped chunks, chunks added, seeds.
EXACT_LEAST, EXACT_SYMBOLS, EXACT_FILES, EXACT_MAPPED, EXACT_ADDED, PROBE_HITS, SYMBOL_SEEDS = 0.45, 20, 8, 80, 40, 20, 20
# Weights of the lexical and the exact score, of queries about code and of others.
LEXICAL_WEIGHT, EXACT_WEIGHT = (0.02, 0.008), (0.035, 0.0)

@dataclass(frozen=True)
class Filters:
    path_prefix: str | None = None
    language: str | None = None
    chunk_type: str | None = None

    @property
    def some(self) -> bool:
        return any(x is not None for x in (self.path_prefix, self.language, self.chunk_type))

    def keep(self) -> Column:
        tests = [F.lit(True)]
        if self.path_prefix is not None:
            tests.append(F.col("file_path").startswith(self.path_prefix))
        if self.language is not None:
            tests.append(F.lower("language") == self.language.lower())
        if self.chunk_type is not None:
            tests.append(F.lower("chunk_type") == self.chunk_type.lower())
        return reduce(lambda a, b: a & b, tests)


def search_code(index: LexicalIndex, queries: DataFrame, vectors: DataFrame, query_vectors: DataFrame, limit: int) -> DataFrame:
    """(q_id, id, src, rank): the nearest chunks in order, then lexical ones that they lack, ``limit`` in all.

    ``src`` is 0 for a chunk of the vector channel and 1 for one of the lexical channel."""
    lexical = bm25_topk(index, queries.withColumnRenamed("query", "text"), limit)
    both = ordered_union(cosine_topk(vectors, query_vectors, limit), lexical, ["q_id"])
    return both.where(F.col("rank") <= limit)


def _keyed(df: DataFrame, by: list[str]) -> DataFrame:
    """``df`` with its query's key: the query's id, and with projects as a key one for each (query, project)."""
    return df.withColumn("key", F.concat_ws("\t", F.col("q_id").cast("string"), *by) if by else F.col("q_id"))


def _file(df: DataFrame, by: list[str]) -> DataFrame:
    """``df`` with the file of a row, whatever project it is of."""
    return df.withColumn("file", F.concat_ws("\t", *by, "file_path"))


def probe_symbols(asked: DataFrame, grams: GramIndex, path_prefix: str | None = None, by: list[str] | None = None) -> DataFrame:
    """(q_id, by..., id, pos): symbols whose name holds a probe of the query, the first ``PROBE_HITS`` by name of each
    probe (and of each ``by``).

    ``asked``: (q_id, query, terms); ``grams``: the index of the symbols' names."""
    by = by or []
    rows = asked.select("q_id", F.posexplode(text.symbol_probes(F.col("query"), F.col("terms"))).alias("n", "probe"))
    where = None if path_prefix is None else F.col("file_path").startswith(path_prefix)
    first = first_holding(grams, rows.select(F.lower("probe").alias("p")), "name", PROBE_HITS, where, tuple(by)).select("p", *by, "id", F.col("rank").alias("k"))
    mine = rows.join(first, F.lower("probe") == F.col("p")).groupBy("q_id", *by, "id").agg(F.min(F.struct("n", "k")).alias("at"))
    return mine.select("q_id", *by, "id", F.row_number().over(Window.partitionBy("q_id", *by).orderBy("at", "id")).alias("pos"))


def exact_channel(asked: DataFrame, seeds: DataFrame, symbols: DataFrame, chunks: DataFrame, found: DataFrame, mapped: DataFrame | None, filters: Filters, most: int | None = None) -> DataFrame:
    """(key, id, exact): the best of exactness times overlap of the exact symbols with chunks of their files.

    ``asked``: (key[, text], low, terms, codeish), where ``text`` is the first key of one text: what depends on the text
    alone is made once for it. ``found``: (key, id), chunks of the other channels, ``most`` for a key if given; ``mapped``:
    (symbol_id, chunk_id, score) made when indexing. Chunks of the first ``EXACT_FILES`` files are opened, of which a key
    gets those that it can use, ``EXACT_ADDED`` beside ``most`` that it may have found; of other files only those found
    count."""
    asked = (asked if "text" in asked.columns else asked.withColumn("text", F.col("key"))).where("codeish")
    scored = seeds.join(asked.where("key = text"), "key").join(symbols, "id")
    score = text.symbol_exactness(F.col("low"), F.col("terms"), F.col("name"), F.col("signature"))
    scored = scored.withColumn("exactness", score).where(F.col("exactness") >= EXACT_LEAST)
    w = Window.partitionBy("text").orderBy(F.desc("exactness"), "pos")
    best = stored(scored.withColumn("n", F.row_number().over(w)).where(F.col("n") <= EXACT_SYMBOLS).select("text", F.col("id").alias("symbol_id"), "exactness", "file", "start_line", "end_line"), "exact-symbols")
    # the exact symbols of a text in a file: at most EXACT_SYMBOLS
    marks = best.groupBy("text", "file").agg(F.collect_list(F.struct("exactness", "start_line", "end_line")).alias("marks"))
    marks = stored(marks.withColumn("f", F.row_number().over(Window.partitionBy("text").orderBy("file"))), "exact-files")
    body = chunks.where(filters.keep()).select("id", "file", F.col("start_line").alias("a"), F.col("end_line").alias("z"))
    exact = F.array_max(F.transform("marks", lambda m: F.least(F.lit(1.0), m["exactness"] * overlap_score(m["start_line"], m["end_line"], F.col("a"), F.col("z"))))).alias("exact")
    opened = body.join(bounded(marks.where(F.col("f") <= EXACT_FILES)), "file").select("text", "id", exact).where("exact > 0")
    whole = opened if most is None else top_k(opened, EXACT_ADDED + most, ["text"], "exact").select("text", "id", "exact")
    texts = asked.select("key", "text")
    mine = bounded(found).join(body, "id").join(texts, "key").join(marks, ["text", "file"]).select("key", "id", exact)
    if mapped is not None:
        near = best.join(mapped, "symbol_id").select("text", F.col("chunk_id").alias("id"), F.col("score").alias("m"))
        near = near.groupBy("text", "id").agg(F.max("m").alias("m"))
        near = near.withColumn("n", F.row_number().over(Window.partitionBy("text").orderBy(F.desc("m"), "id"))).where(F.col("n") <= EXACT_MAPPED).drop("n")
        near = near.join(body, "id")
        whole = whole.unionByName(near.select("text", "id", F.col("m").alias("exact"))).unionByName(near.join(marks, ["text", "file"]).select("text", "id", exact))
    both = stored(whole, "exact-opened").join(texts, "text").select("key", "id", "exact").unionByName(mine)
    return both.where("exact > 0").groupBy("key", "id").agg(F.max("exact").alias("exact"))


def symbol_ranks(lexical: DataFrame, near: DataFrame, symbols: DataFrame, relations: DataFrame) -> DataFrame:
    """(q_id, id, score), where q_id is the key: PageRank over the symbols near a query."""
    ordered = ordered_union(near.withColumnRenamed("key", "q_id"), lexical.select(F.col("key").alias("q_id"), "id", F.col("pos").alias("rank")), ["q_id"])
    edges = relations.select("src", "dst", F.lit(1.0).alias("weight"))
    return graph_channel(ordered, symbols.select(F.col("id").alias("node")), edges, seeds=1 << 30)


def symbol_graph_channel(ranks: DataFrame, symbols: DataFrame, found: DataFrame, chunks: DataFrame) -> DataFrame:
    """(key, id, score): the best rank of the symbols whose lines a found chunk shares."""
    at = ranks.join(symbols, "id").select(F.col("q_id").alias("key"), "score", "file", F.col("start_line").alias("a"), F.col("end_line").alias("z"))
    lines = bounded(found).join(chunks.select("id", "file", "start_line", "end_line"), "id")
    both = lines.join(at, ["key", "file"]).where("start_line <= z and a <= end_line")
    return both.groupBy("key", "id").agg(F.max("score").alias("score")).where("score > 0")


# How a query is served.
HYBRID, FAST, LEXICAL, NONE = "hybrid_vector_bm25_ppr", "bm25_lexical_fast_path", "bm25_lexical_symbol_hydration", "no_serving_generation"


def recall_code(
    chunks: DataFrame, symbols: DataFrame, relations: DataFrame, index: LexicalIndex, queries: DataFrame, vectors: DataFrame, symbol_vectors: DataFrame, query_vectors: DataFrame, limit: int,
    filters: Filters = Filters(), weights: tuple[float, float, float] = CONFIG.code_weights, mapped: DataFrame | None = None, served: DataFrame | None = None, in_project: bool = True, grams: GramIndex | None = None,
    freshness: DataFrame | None = None,
) -> DataFrame:
    """(q_id, by..., id, score, rrf_score, lexical_score, exact_score, vector_score, bm25_score, ppr_score, rank, path,
    partial, reason[, freshness]).

    With an ``index`` by project every query is put to every project in one job, and chunks, symbols and vectors have that
    column; else there is one project. ``served``: (by..., structural, bm25, vector, graph, indexing, model_ready), the
    generations that serve a project, one row each; without it all are there. What is served chooses the path: the whole
    hybrid, the lexical fast path for queries that are one long identifier (``limit`` lexical candidates and no other
    channel), the lexical channel and exact symbols where vectors or graph are missing, or nothing.

    Each channel is cut, then filtered, before fusion; exact chunks that no channel found join it behind the lexical ones.
    ``freshness``: (by..., path, freshness) of files; a result's is null where it is unavailable."""
    by = list(index.by)
    one = by[0] if by else None
    # queries of one text without a vector have one result: the first of them is answered for all
    own = queries.join(query_vectors.select("q_id", F.lit(True).alias("near")).distinct(), "q_id", "left")
    firsts = own.groupBy(F.col("query").alias("text")).agg(F.min("q_id").alias("first"), F.min(F.when(F.col("near").isNull(), F.col("q_id"))).alias("far"))
    own = own.join(bounded(firsts), F.col("query").eqNullSafe(F.col("text")))
    members = stored(own.select("q_id", "query", "first", F.when(F.col("near"), F.col("q_id")).otherwise(F.col("far")).alias("of")), "code-members")
    queries = members.where("q_id = of or q_id = first").select("q_id", "query", "first").distinct()
    fetch, fast_fetch = code_overfetch(limit, filters.some, False), code_overfetch(limit, filters.some, True)
    chunks, symbols = _file(chunks, by), _file(symbols, by)
    asked = stored(queries.select("q_id", "first", "query", F.lower("query").alias("low"), text.identifier_tokens(F.col("query")).alias("terms"), text.codeish(F.col("query")).alias("codeish"), text.single_identifier(F.col("query")).alias("single")), "code-queries")
    kept = chunks.where(filters.keep()).select("id")
    ready = served if served is not None else _all_served(chunks, by)
    plans = ready.select(*by, *[serving_plan(*[F.col(c) for c in ("structural", "bm25", "vector", "graph", "indexing")], F.lit(i), F.col("model_ready")).alias(n) for i, n in ((False, "plain"), (True, "ident"))])
    plans = stored(plans, "code-plans")

    def planned(df):
        """Rows (q_id, by...) with the query's key and columns and the plan by which it is served."""
        at = df.join(asked, "q_id")
        at = at.join(F.broadcast(plans), by) if by else at.crossJoin(F.broadcast(plans))  # one row of plans
        at = at.withColumn("plan", F.when(F.col("single"), F.col("ident")).otherwise(F.col("plain")))
        return _keyed(at, by).drop("plain", "ident").withColumn("route", F.col("plan.path"))

    hybrid = plans.where(F.col("plain.path") == HYBRID).limit(1).count() > 0
    graph = hybrid and weights[2] > 0

    def by_words():
        df = planned(bm25_topk(index, asked.select("q_id", F.col("query").alias("text")), fetch))
        df = df.where((F.col("route") != NONE) & ((F.col("route") != FAST) | (F.col("rank") <= fast_fetch)))
        return stored(df.join(kept, "id", "left_semi").select("key", "q_id", *by, "id", "score", "rank"), "code-lexical")

    def by_vectors():
        if hybrid:
            df = planned(cosine_topk(vectors, query_vectors, fetch, one)).where(F.col("route") == HYBRID)
            return stored(df.join(kept, "id", "left_semi").select("key", "q_id", *by, "id", "score", "rank"), "code-vector")

    def by_names():
        df = planned(probe_symbols(asked, gram_index(symbols, ("name",)) if grams is None else grams, filters.path_prefix, by)).where(F.col("route").isin(HYBRID, LEXICAL))
        return stored(df.select("key", "q_id", *by, "id", "pos"), "code-seeds")

    def near_symbols():
        if graph:
            return stored(planned(cosine_topk(symbol_vectors, query_vectors, SYMBOL_SEEDS, one)).where(F.col("route") == HYBRID).select("key", "id", "rank"), "code-near")

    lexical, vector, seeds, near = together(by_words, by_vectors, by_names, near_symbols)
    vector = lexical.limit(0) if vector is None else vector
    # the queries of the keys that some channel has met
    met = lexical.select("q_id", *by).unionByName(vector.select("q_id", *by)).unionByName(seeds.select("q_id", *by)).distinct()
    keyed = stored(planned(met), "code-keys")
    slow = keyed.where(F.col("route") != FAST)
    lexical, vector, seeds = (df.drop("q_id", *by) for df in (lexical, vector, seeds))
    found = vector.select("key", "id").unionByName(lexical.select("key", "id")).distinct()
    facts = symbols.select("id", "name", "signature", "file", "start_line", "end_line")
    # the key of the first query of the text
    slow = slow.withColumn("text", F.concat_ws("\t", F.col("first").cast("string"), *by) if by else F.col("first"))

    def of_symbols():
        return stored(exact_channel(slow.select("key", "text", "low", "terms", "codeish"), seeds, facts, chunks, found, mapped, filters, 2 * fetch) if in_project else found.limit(0).withColumn("exact", F.lit(0.0)), "code-exact")

    def of_graph():
        if graph:
            return stored(symbol_ranks(seeds.join(whole, "key"), near, facts, relations), "code-ranks")

    whole = keyed.where(F.col("route") == HYBRID).select("key")
    exact, ranks = together(of_symbols, of_graph)
    # exact chunks that were not found stand behind the lexical ones, without a score
    more = exact.join(found, ["key", "id"], "left_anti").withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("exact"), "id"))).where(F.col("n") <= EXACT_ADDED)
    lexical = stored(lexical.unionByName(more.select("key", "id", F.lit(0.0).alias("score"), (F.col("n") + (1 << 20)).cast("int").alias("rank"))), "code-lexical")
    found = stored(vector.select("key", "id").unionByName(lexical.select("key", "id")).distinct(), "code-found")
    channel = lambda df, c: df.select("key", F.lit(c).alias("channel"), "id", "score", F.row_number().over(Window.partitionBy("key").orderBy("rank", "id")).alias("r"))
    every = channel(vector, "vector").unionByName(channel(lexical, "bm25"))
    if graph:
        ppr = symbol_graph_channel(ranks, facts, found.join(whole, "key", "left_semi"), chunks)
        every = every.unionByName(channel(ppr.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "id"))), "ppr"))
    weight = F.create_map(*[x for c, v in zip(("vector", "bm25", "ppr"), weights) for x in (F.lit(c), F.lit(v))])
    fused = every.groupBy("key", "id").agg(
        F.round(F.sum(weight[F.col("channel")] / (CONFIG.rrf_k + F.col("r"))), 8).alias("rrf_score"),
        *[F.coalesce(F.max(F.when(F.col("channel") == c, F.col("score"))), F.lit(0.0)).alias(f"{c}_score") for c in ("vector", "bm25", "ppr")],
    )
    cut = top_k(fused, fetch, ["key"], "rrf_score").drop("rank")
    # an exact chunk is reranked even if the fusion cut it off, then without its channels' scores
    left = exact.join(found, ["key", "id"], "left_semi").join(cut, ["key", "id"], "left_anti").select("key", "id", *[F.lit(0.0).alias(c) for c in ("rrf_score", "vector_score", "bm25_score", "ppr_score")])
    rows = cut.unionByName(left).join(chunks.drop(*by), "id").join(keyed, "key").join(exact, ["key", "id"], "left")
    lex = text.lexical_rerank(F.col("low"), F.col("terms"), F.col("file_path"), F.col("name"), F.col("context_path"), F.col("content"), F.col("codeish"))
    pick = lambda pair: F.when(F.col("codeish"), pair[0]).otherwise(pair[1])
    rows = rows.withColumn("lexical_score", lex).withColumn("exact_score", F.coalesce("exact", F.lit(0.0)))
    rows = rows.withColumn("score", F.round(F.col("rrf_score") + F.col("lexical_score") * pick(LEXICAL_WEIGHT) + F.col("exact_score") * pick(EXACT_WEIGHT), 8))
    out = top_k(rows, min(limit, PROJECT_LIMIT) if by else limit, ["key"])
    out = out.withColumnRenamed("q_id", "of").join(members.select("q_id", "of"), "of")
    cols = ["q_id", *by, "id", "score", "rrf_score", "lexical_score", "exact_score", "vector_score", "bm25_score", "ppr_score", "rank", "plan.path", "plan.partial", "plan.reason"]
    if freshness is None:
        return out.select(*cols)
    known = freshness.select(F.concat_ws("\t", *by, "path").alias("file"), F.when(F.col("freshness") != "unavailable", F.col("freshness")).alias("freshness"))
    return out.join(known, "file", "left").select(*cols, "freshness")


#: Results of a project where every project is asked.
PROJECT_LIMIT = 50


def _all_served(chunks: DataFrame, by: list[str]) -> DataFrame:
    """Every project as if one generation served it whole."""
    one = chunks.select(*by).distinct() if by else chunks.sparkSession.range(1).select()
    state = {c: F.lit(1) for c in ("structural", "bm25", "vector", "graph")} | {"indexing": F.lit(None).cast("int"), "model_ready": F.lit(True)}
    return one.select(*by, *[v.alias(k) for k, v in state.items()])


# ---------------------------------------------------------------- serving


def serving_plan(structural: Column, bm25: Column, vector: Column, graph: Column, indexing: Column, identifier: Column, model_ready: Column) -> Column:
    """struct(path, partial, reason): how a query is served by the generations that are there.

    Where no capability has a generation of its own, the structural one serves all. Vectors and graph need the model."""
    own = F.coalesce(bm25, vector, graph).isNotNull()
    of = lambda g: F.when(own, g).otherwise(structural)
    path = (
        F.when(of(vector).isNotNull() & of(bm25).isNotNull() & of(graph).isNotNull() & model_ready, F.when(identifier, FAST).otherwise(HYBRID))
        .when(of(bm25).isNotNull(), LEXICAL).otherwise(NONE)
    )
    behind = F.coalesce(indexing > structural, F.lit(False))
    weak = path.isin(LEXICAL, NONE)
    reason = F.when(path == LEXICAL, "semantic_or_graph_unavailable").when(path == NONE, NONE).when(behind, "stale_serving_generation")
    return F.struct(path.alias("path"), (behind | weak).alias("partial"), reason.alias("reason"))


def result_freshness(known: Column, item: Column, serving: Column, indexing: Column, interrupted: Column, fallback: Column) -> Column:
    """Freshness of one result: of its path where that is known, else by its generation; null if it is unavailable."""
    ahead = indexing.isNotNull() & (indexing > serving)
    state = (
        F.when(known.isNotNull(), known).when(serving.isNull(), "unavailable")
        .when(item.isNotNull() & (item == serving) & ahead, F.when(interrupted | fallback, "stale").otherwise("unavailable"))
        .when(item.isNotNull() & (item == serving), "fresh").when(item.isNotNull(), "stale").when(ahead, "stale").otherwise("fresh")
    )
    return F.when(state != "unavailable", state)
