"""Code-retrieval and corpus-ETL queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lifecycle as life, predicates as P, text
from ..operators import code_search as CS, corpus as C, gram_index, index, joins as J, store
from ..sources.tables import table
from ..workspace import together
from .retrieval import bm25_sql, once, tokens_sql

def _asked(s, d):
    """Parts as chunks and symbols, each with one of a few queries and its terms."""
    q = "element_at(array('{}'), cast(p_partkey % 6 + 1 as int))".format("', '".join(QUERIES))
    p = table(s, d, "part").withColumn("q", F.expr(q)).withColumn("terms", F.array_distinct(F.split("q", "[ #]")))
    return p.withColumn("name", F.when(F.col("p_partkey") % 5 > 0, F.concat(F.initcap(F.element_at(F.split("p_name", " "), 1)), F.element_at(F.split("p_name", " "), 2)))).withColumn("path", F.concat_ws("/", F.lower("p_type"), F.col("p_brand")))


QUERIES = ("small ring", "widget", "economy", "brand#2", "red x", "hotgear")


def lexical_rerank(s, d):
    p = _asked(s, d)
    body = F.when(F.col("p_partkey") % 3 == 0, F.repeat("p_name", 12)).otherwise(F.col("p_name"))
    score = text.lexical_rerank(F.col("q"), F.col("terms"), F.col("path"), F.col("name"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")), body, F.col("p_partkey") % 4 == 0)
    return p.select("p_partkey", F.round(score, 6).alias("score"))


def symbol_exactness(s, d):
    p = _asked(s, d)
    score = text.symbol_exactness(F.col("q"), F.col("terms"), F.coalesce("name", F.lit("widget")), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("fn "), F.col("p_name"))))
    return p.select("p_partkey", F.round(score, 6).alias("score"))


def symbol_probes(s, d):
    p = _asked(s, d)
    return p.select("p_partkey", F.array_join(text.symbol_probes(F.concat(F.lit(" "), F.col("q")), F.concat("terms", F.split("p_name", " "), F.array(F.lower("p_type"), F.lit("is")))), "|").alias("probes"))


def symbol_search(s, d):
    """Symbols of one type whose name or signature holds a query, the second page, with the number of all and the freshness
    of their files; every part whose id is divisible by 20 asks for a piece of its name, one or two characters for some."""
    p = table(s, d, "part")
    symbols = p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.when(F.col("p_partkey") % 3 > 0, F.col("p_type")).alias("signature"), F.col("p_brand").alias("file_path"), F.when(F.col("p_size") % 2 == 0, "function").otherwise("class").alias("symbol_type"))
    asks = p.where("p_partkey % 20 = 0").selectExpr("p_partkey as q_id", "case when p_partkey % 100 = 0 then left(p_name, 1) when p_partkey % 60 = 0 then substring(p_name, 2, 2) when p_partkey % 40 = 0 then p_type else substring(p_name, 2, 5) end as query")
    fresh = p.select(F.col("p_brand").alias("path"), F.when(F.col("p_brand").endswith("1"), "unavailable").when(F.col("p_brand").endswith("2"), "stale").otherwise("fresh").alias("freshness")).distinct()
    grams = gram_index.build(symbols, ("name", "signature"))
    return gram_index.search(grams, asks, "name", 5, 5, F.col("symbol_type") == "function", fresh)


def result_filters(s, d):
    p = table(s, d, "pages")
    path = F.regexp_extract("url", "://[^/]*(/[^?#]*)", 1)
    return p.where(F.startswith(path, F.lit("/en/")) & (F.lower(F.regexp_extract("html", 'lang="(\\w+)"', 1)) == "en")).select("page_id", path.alias("path"))


def _symbols(s, d):
    return table(s, d, "lineitem").select(F.col("l_suppkey").alias("file"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (F.col("l_partkey") % 1000).alias("start"), (F.col("l_partkey") % 1000 + F.col("l_quantity").cast("long")).alias("end"))


def _chunks(s, d):
    return table(s, d, "lineitem").where("l_linenumber = 1").select(F.col("l_suppkey").alias("file"), F.col("l_orderkey").alias("id"), (F.col("l_orderkey") % 1000).alias("start"), (F.col("l_orderkey") % 1000 + 20).alias("end"))


def range_overlap(s, d):
    return J.range_overlap(_symbols(s, d), _chunks(s, d), "file").select("file", "a_id", "b_id", "overlap")


def ppr_to_chunks(s, d):
    scores = _symbols(s, d).select(F.col("id").alias("a_id"), F.round((F.col("id") % 991) / 991.0, 6).alias("score"))
    return J.best_per_chunk(J.range_overlap(_symbols(s, d), _chunks(s, d), "file"), scores, 40)


def tightest_parent(s, d):
    return J.tightest_parent(_symbols(s, d), "file")


def _refs(s, d):
    c = table(s, d, "customer")
    return c.select(F.col("c_custkey").alias("ref_id"), F.concat(F.lit("n"), F.col("c_custkey") % 60).alias("name"), F.concat(F.lit("d"), F.col("c_nationkey") % 5, F.lit("/f"), F.col("c_custkey") % 7).alias("file_path"))


def _defs(s, d):
    c = table(s, d, "supplier")
    return c.select(F.col("s_suppkey").alias("id"), F.concat(F.lit("n"), F.col("s_suppkey") % 50).alias("name"), F.concat(F.lit("d"), F.col("s_nationkey") % 5, F.lit("/f"), F.col("s_suppkey") % 7).alias("file_path"))


def resolve_priority(s, d):
    return J.resolve_names(_refs(s, d), _defs(s, d))


def resolve_relations(s, d):
    return J.resolve_relations(_refs(s, d), _defs(s, d).where("id % 2 = 0"), _defs(s, d))


def freshness_map(s, d):
    docs = table(s, d, "documents").select(F.col("doc_id").alias("path"), F.md5("text").alias("content_hash"))
    serving = docs.where("path % 9 <> 0").withColumn("content_hash", F.when(F.col("path") % 14 == 0, F.lit("")).otherwise(F.col("content_hash")))
    indexing = docs.where("path % 2 = 0").withColumn("content_hash", F.when(F.col("path") % 10 == 0, F.lit("x")).when(F.col("path") % 14 == 0, F.lit("")).otherwise(F.col("content_hash"))).withColumn("completed", F.col("path") % 12 != 0)
    return J.freshness(docs.select("path"), serving, indexing, docs.where("path % 7 = 3").select("path"))


def _snap(s, d):
    return table(s, d, "documents").select(F.col("doc_id").alias("path"), F.md5("text").alias("hash"))


def manifest_diff(s, d):
    now = _snap(s, d).where("path % 6 <> 1").withColumn("hash", F.when(F.col("path") % 13 == 0, "new").otherwise(F.col("hash")))
    return C.manifest_diff(_snap(s, d).where("path % 7 <> 2"), now)


def incremental_actions(s, d):
    ch = _snap(s, d).select("path", F.when(F.col("path") % 5 == 0, F.lit(None)).when(F.col("path") % 3 == 0, F.lit("x")).otherwise(F.col("hash")).alias("hash"), (F.col("path") % 11 == 0).alias("generated"))
    return C.incremental_actions(ch, _snap(s, d).where("path % 4 <> 3"))


def line_windows(s, d):
    return C.line_windows(table(s, d, "documents"), "doc_id", "text", 3).select("id", "window", "start_line", "end_line", F.md5("content").alias("digest"))


def structural_chunks(s, d):
    docs = table(s, d, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    return C.structural_chunks(docs, "doc_id", "text", most=1000).select("id", "chunk", "start_line", "end_line", F.md5("content").alias("digest"))


def generated_header(s, d):
    p = table(s, d, "pages")
    heads = ("/* Code generated by x */", "// Code generated by x. DO NOT EDIT.", "// generated by hand", "// @Generated", "# Auto-generated, do not change", "// Generated by the protocol buffer compiler", "// autogenerated, do not edit")
    head = F.concat(F.element_at(F.array(*[F.lit(h) for h in heads]), (F.col("page_id") % 7 + 1).cast("int")), F.lit("\n"), F.col("html"))
    return p.select("page_id", P.generated_header(head).alias("generated"))


PATHS = ("rs", "py", "h", "min.js", "txt", "kt", "lock", "d.ts", "ts", "scala", "pb.swift", "mm", "cs")
TOPS = ("src", "node_modules", "Lib/.git", "a/target", "lib", "x/generated", ".hidden", "egg-info", "out", "vendor")


def _paths(s, d):
    pick = lambda xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.col("page_id") % len(xs) + 1).cast("int"))
    return table(s, d, "pages").select("page_id", "html", F.concat(pick(TOPS), F.when(F.col("page_id") % 11 == 0, "/.f").otherwise("/f"), F.col("page_id"), F.lit("."), pick(PATHS)).alias("path"))


def path_filter(s, d):
    return _paths(s, d).where(P.path_kept(F.col("path"))).select("page_id", "path", P.globs(F.col("path"), ["**/*.rs", "**/*.h", "src/*.py"], ["lib/f1*"]).alias("chosen"))


def language_detect(s, d):
    body = F.element_at(F.array(*[F.lit(x) for x in ("class A {}", "@interface A", "int x;", "#import \"a.h\"", "namespace x", "#import <x>", "  private: int y")]), (F.col("page_id") % 7 + 1).cast("int"))
    return _paths(s, d).select("page_id", P.language(F.col("path"), body).alias("language"))


def job_moves(s, d):
    """Every wanted move of an index job's state, and whether it is legal."""
    states = F.array(*[F.lit(x) for x in STATES])
    n = table(s, d, "orders").select("o_orderkey", F.element_at(states, (F.col("o_orderkey") % 10 + 1).cast("int")).alias("old"), F.element_at(states, (F.floor(F.col("o_orderkey") / 10) % 10 + 1).cast("int")).alias("new"))
    return n.select("o_orderkey", "old", "new", life.legal_move(F.col("old"), F.col("new"), life.JOB_MOVES).alias("legal"))


STATES = ("queued", "running", "paused", "interrupted", "resumable", "completed", "failed", "cancel_requested", "cancelled", "abandoned")


def code_corpus(s, d):
    """(chunks, symbols, relations): parts as code, some as symbols, each calling the seventh after it."""
    p = _asked(s, d).withColumn("name", F.coalesce("name", F.concat(F.lit("get_"), F.translate("p_name", " ", "_"))))
    other = F.translate("p_brand", "#", "_")
    chunks = p.select(
        F.col("p_partkey").alias("id"), F.concat(F.lit("src/"), F.lower("p_type"), F.lit("/"), F.lower("p_brand"), F.lit(".rs")).alias("file_path"), F.concat(F.lit("fn "), "name", F.lit("() { "), "p_name", F.lit("; "), other, F.lit("() }")).alias("content"),
        F.when(F.col("p_size") % 3 == 0, "python").otherwise("rust").alias("language"), (F.col("p_partkey") % 60 * 10).alias("start_line"), (F.col("p_partkey") % 60 * 10 + 8).alias("end_line"),
        F.when(F.col("p_partkey") % 4 == 0, "other").otherwise("function").alias("chunk_type"), F.when(F.col("p_partkey") % 5 > 0, F.col("name")).alias("name"), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("mod::"), other)).alias("context_path"),
    )
    symbols = p.where("p_partkey % 3 = 0").select("p_partkey", "name", F.concat(F.lit("fn "), "name", F.lit("()")).alias("signature")).join(chunks.select(F.col("id").alias("p_partkey"), "file_path", "start_line"), "p_partkey")
    symbols = symbols.select(F.col("p_partkey").alias("id"), "name", "signature", "file_path", (F.col("start_line") + F.col("p_partkey") % 25).alias("start_line"), (F.col("start_line") + F.col("p_partkey") % 25 + 3).alias("end_line"))
    relations = symbols.select(F.col("id").alias("src"), (F.col("id") + 21).alias("dst")).join(symbols.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst")
    return chunks, symbols, relations


_CODE_INDEXES: dict = {}


def _code_search(s, d, by: tuple[str, ...] = ()):
    """The parts as code, with the lexical and the n-gram index, built once for a session and a state of the files; every
    part whose id is divisible by 20 asks: for its words, its camel-cased name, a call, or a path, in turn."""
    chunks, symbols, relations = code_corpus(s, d)
    project = F.split("file_path", "/")[1]
    chunks, symbols = chunks.withColumn("project", project), symbols.withColumn("project", project)

    def made():
        body = chunks.withColumn("text", text.document_text(F.col("file_path"), F.col("name"), F.col("context_path"), F.col("content")))
        # a file of parts is much smaller than what is made of it: dealt to all tasks
        return tuple(together(lambda: index.build(body.select("id", *by, "text").repartition("id"), "id", "text", by), lambda: gram_index.build(symbols, ("name",))))

    ix, grams = once(_CODE_INDEXES, s, f"{d}/part.parquet", by, made)
    v = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    v = v.join(chunks.select("id", "project"), "id", "left") if by else v
    asking = table(s, d, "part").where("p_partkey % 20 = 0").select(F.col("p_partkey").alias("q_id"), F.expr(ASKED).alias("query"))
    asks = v.where("id % 20 = 0").select(F.col("id").alias("q_id"), F.col("v").alias("qv"))
    return {
        "chunks": chunks, "symbols": symbols, "relations": relations, "index": ix, "grams": grams, "queries": asking, "vectors": v.where("project is not null") if by else v,
        "symbol_vectors": v.join(symbols.select("id"), "id", "left_semi"), "query_vectors": asks,
    }


#: What a part asks.
ASKED = "element_at(array(p_name, concat('get', initcap(element_at(split(p_name, ' '), 1)), initcap(element_at(split(p_name, ' '), 2))), concat(initcap(element_at(split(p_name, ' '), 1)), element_at(split(p_name, ' '), 2), ' fn'), concat('src/', lower(p_type))), cast(p_partkey / 20 % 4 as int) + 1)"


def recall_code(s, d):
    return _rounded(CS.recall_code(**_code_search(s, d), limit=10))


def recall_code_filtered(s, d):
    c = _code_search(s, d)
    mapped = c["symbols"].select(F.col("id").alias("symbol_id"), F.col("id").alias("chunk_id"), F.lit(0.9).alias("score")).where("symbol_id % 2 = 0")
    return _rounded(CS.recall_code(**c, limit=10, filters=CS.Filters("src/small", "RUST", "function"), mapped=mapped))


def recall_code_degraded(s, d):
    """No vectors are served: the lexical channel and exact symbols answer."""
    served = s.range(1).selectExpr("3 as structural", "3 as bm25", "cast(null as int) as vector", "3 as graph", "4 as indexing", "true as model_ready")
    return _rounded(CS.recall_code(**_code_search(s, d), limit=10, served=served))


def recall_code_projects(s, d):
    """All projects in one job, each served as its generations allow, with the freshness of each result's file."""
    c = _code_search(s, d, ("project",))
    files = c["chunks"].select("project", "file_path").distinct()
    state = F.pmod(F.crc32("project").cast("long"), F.lit(4))
    served = files.select("project").distinct().select("project", F.when(state < 3, 2).alias("structural"), F.when(state < 3, 2).alias("bm25"), F.when(state < 2, 2).alias("vector"), F.when(state < 2, 2).alias("graph"), F.when(state == 1, 3).alias("indexing"), F.lit(True).alias("model_ready"))
    fresh = files.select("project", F.col("file_path").alias("path"), F.element_at(F.array(*[F.lit(x) for x in ("fresh", "stale", "partial", "unavailable")]), (F.pmod(F.crc32("file_path").cast("long"), F.lit(4)) + 1).cast("int")).alias("freshness"))
    return _rounded(CS.recall_code(**c, limit=5, served=served, freshness=fresh))


def _rounded(df):
    return df.select(*[F.round(c, 6).alias(c) if c.endswith("score") else c for c in df.columns])


def search_code(s, d):
    c = _code_search(s, d)
    return CS.search_code(c["index"], c["queries"], c["vectors"], c["query_vectors"], 20)


def serving_plan(s, d):
    o = table(s, d, "orders")
    g = lambda m: F.when(F.col("o_orderkey") % m > 0, F.col("o_custkey") % 5)
    plan = CS.serving_plan(g(2), F.when(F.col("o_orderkey") % 3 > 0, g(5)), F.when(F.col("o_orderkey") % 3 > 0, g(7)), F.when(F.col("o_orderkey") % 3 > 0, g(11)), F.when(F.col("o_orderkey") % 4 > 0, F.lit(3)), F.col("o_orderkey") % 13 == 0, F.col("o_orderkey") % 17 > 0)
    return o.select("o_orderkey", plan.alias("p")).select("o_orderkey", "p.*")


def result_freshness(s, d):
    k = F.col("o_orderkey")
    g = lambda m: F.when(k % m > 0, k % 3)
    state = CS.result_freshness(F.when(k % 6 == 0, "partial").when(k % 10 == 0, "unavailable"), g(4), F.when(k % 7 > 0, k % 2), F.when(k % 5 > 0, F.lit(1)), k % 11 == 0, k % 13 == 0)
    return table(s, d, "orders").select("o_orderkey", state.alias("freshness"))


def abandoned_generations(s, d):
    docs = table(s, d, "documents").selectExpr("source as project_id", "doc_id % 6 as generation")
    return C.abandoned_generations([docs, docs.where("generation < 3")], docs.select("project_id").distinct().withColumn("generation", F.lit(5).cast("long")))


def index_progress(s, d):
    docs = table(s, d, "documents").groupBy(F.col("source").alias("project")).agg(F.count_if(F.col("doc_id") % 3 > 0).alias("done"), F.count("*").alias("files"), F.count_if(F.col("doc_id") % 4 == 0).alias("embedded"))
    return docs.select("project", C.progress(F.col("done"), F.col("files"), F.col("embedded"), F.col("files")).alias("percent"))


def checkpoint_resume(s, d):
    done = _snap(s, d).where("path % 3 = 0").withColumnRenamed("hash", "have")
    return _snap(s, d).join(done, "path", "left").where(~F.col("hash").eqNullSafe(F.col("have"))).select("path")


def latest_job(s, d):
    o = table(s, d, "orders").select(F.col("o_custkey").alias("project"), F.col("o_orderkey").alias("job"), "o_orderstatus", F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("at_us"))
    return store.latest(o, ["project"], [F.desc("at_us"), F.desc("job")])


def source_symbols(s, d):
    """Symbols of a small generated source tree: one file a nation, with a function that calls the next one's."""
    n = table(s, d, "nation").select(F.concat(F.lit("src/n"), F.col("n_nationkey"), F.lit(".py")).alias("file_path"), F.lit("python").alias("language"), F.concat(F.lit("import os\nclass C"), F.col("n_nationkey"), F.lit("(Base):\n    def run_"), F.col("n_nationkey"), F.lit("(self):\n        return run_"), (F.col("n_nationkey") + 1) % 25, F.lit("(1)\n")).alias("content"))
    sym = C.extract_symbols(n)
    ref = C.extract_references(n, sym)
    a = sym.select("file_path", F.col("symbol_type").alias("kind"), F.col("name"), F.col("start_line").alias("line"), F.col("signature").alias("extra"))
    return a.unionByName(ref.select("file_path", F.col("relation_type").alias("kind"), F.col("to_name").alias("name"), F.col("line_number").alias("line"), F.col("owner").alias("extra")))


_SY = "sy as (select l_suppkey as file, l_orderkey * 10 + l_linenumber as id, l_partkey % 1000 as s, l_partkey % 1000 + cast(l_quantity as bigint) as e from lineitem)"
_CK = "ck as (select l_suppkey as file, l_orderkey as id, l_orderkey % 1000 as s, l_orderkey % 1000 + 20 as e from lineitem where l_linenumber = 1)"
_OV = f"{_SY}, {_CK}, ov as (select sy.file, sy.id as a_id, ck.id as b_id, case when ck.s <= sy.e and sy.s <= ck.e then 1.0 when least(abs(ck.s - sy.s), abs(ck.e - sy.s)) <= 6 then 0.65 when least(abs(ck.s - sy.s), abs(ck.e - sy.s)) <= 16 then 0.35 else 0.0 end::double as overlap from sy join ck using (file))"
_RF = "rf as (select c_custkey as ref_id, 'n' || (c_custkey % 60) as name, 'd' || (c_nationkey % 5) || '/f' || (c_custkey % 7) as fp from customer)"
_DF = "df as (select s_suppkey as id, 'n' || (s_suppkey % 50) as name, 'd' || (s_nationkey % 5) || '/f' || (s_suppkey % 7) as sp from supplier)"
_RS = "select ref_id, id as symbol_id, score from (select *, row_number() over (partition by ref_id order by score desc, id) as n from (select ref_id, id, case when fp = sp then 100 when split_part(fp, '/', 1) = split_part(sp, '/', 1) then 50 else 0 end as score from rf join %s using (name))) where n = 1"
_list = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
_PT = f"pt as (select page_id, ({_list(TOPS)})[cast(page_id % 10 + 1 as int)] || (case when page_id % 11 = 0 then '/.f' else '/f' end) || page_id || '.' || ({_list(PATHS)})[cast(page_id % 13 + 1 as int)] as path from pages)"
_Q = f"""q0 as (select *, ({_list(QUERIES)})[cast(p_partkey % 6 + 1 as int)] as q from part), qs as (select *, list_distinct(string_split_regex(q, '[ #]')) as terms,
 case when p_partkey % 5 > 0 then upper(left(split_part(p_name, ' ', 1), 1)) || substr(split_part(p_name, ' ', 1), 2) || split_part(p_name, ' ', 2) end as name, lower(p_type) || '/' || p_brand as path from q0)"""
_LEX = f"""{_Q}, f as (select p_partkey, q, terms, lower(path) as p, lower(coalesce(name, '')) as n, case when p_partkey % 2 = 0 then lower(p_name) else '' end as x, case when p_partkey % 3 = 0 then repeat(p_name, 12) else p_name end as body from qs),
 g as (select *, (contains(p, q) or contains(n, q) or contains(x, q)) and strlen(q) >= 4 as whole, list_transform(list_filter(terms, lambda t: length(t) >= 2), lambda t: case when contains(n, t) then 0.7 when contains(p, t) then 0.55 when contains(x, t) then 0.45 when contains(lower(body), t) then 0.2 else 0.0 end) as w from f),
 h as (select *, whole or len(list_filter(w, lambda v: v >= 0.55)) > 0 as strong from g)
 select p_partkey, round(greatest(0.0, least(4.0, case when whole then 1.8 else 0.0 end + coalesce(list_sum(w), 0) + 0.8 * len(list_filter(w, lambda v: v > 0)) / len(terms) + case when p_partkey % 4 = 0 and strong then 0.8 else 0.0 end - case when strlen(body) < 96 and not strong then 0.6 else 0.0 end))::double / 4, 6) as score from h"""
_EXACT = f"""{_Q}, f as (select p_partkey, q, terms, lower(coalesce(name, 'widget')) as n, case when p_partkey % 2 = 0 then 'fn ' || lower(p_name) else '' end as s, {tokens_sql("coalesce(name, 'widget')")} as own from qs),
 g as (select *, list_transform(list_filter(terms, lambda t: length(t) >= 2), lambda t: case when list_contains(own, t) then 0.55 when contains(n, t) or contains(s, t) then 0.35 else 0.0 end) as w from f)
 select p_partkey, round(greatest(0.0, least(4.0, case when n = q then 2.2 when strlen(q) >= 4 and contains(n, q) then 1.6 else 0.0 end + case when strlen(q) >= 4 and contains(s, q) then 0.8 else 0.0 end + coalesce(list_sum(w), 0) + 0.8 * len(list_filter(w, lambda v: v > 0)) / len(terms)))::double / 4, 6) as score from g"""
_PROBES = f"""{_Q}, t as (select p_partkey, q, unnest(list_concat(terms, string_split(p_name, ' '), [lower(p_type), 'is'])) as t from qs), r as (select p_partkey, t from (select *, row_number() over (partition by p_partkey order by length(t) desc, t) as n from t where length(t) >= 3) where n <= 4 union select p_partkey, q from qs)
 select p_partkey, string_agg(t, '|' order by t) as probes from r group by 1"""
_CHUNKS = r"""with recursive d as (select doc_id as id, string_split(replace(text, chr(10), chr(10) || chr(10)), chr(10) || chr(10)) as ps from documents),
 u as (select id, unnest(ps) as p, unnest(range(1, len(ps) + 1)) as k from d), pl as (select id, k, p, length(p) - length(replace(p, chr(10), '')) + case when p = '' or ends_with(p, chr(10)) then 0 else 1 end as n from u),
 f as (select id, 0::bigint as k, ''::varchar as cur, 1::bigint as start, 1::bigint as line, null::varchar as done, 0::bigint as s, 0::bigint as e, 0::bigint as c from d
  union all select id, nk, case when flush or cur = '' then p else cur || chr(10) || chr(10) || p end, case when flush then line else start end, line + n + 1, case when flush then cur end, start, line - 1, c + case when flush then 1 else 0 end
   from (select f.id, f.cur, f.start, f.line, f.c, pl.p, pl.n, pl.k as nk, f.cur <> '' and strlen(f.cur) + strlen(pl.p) > 1000 as flush from f join pl on pl.id = f.id and pl.k = f.k + 1) x),
 l as (select id, max(k) as k from f group by 1)
 select id, cast(c - 1 as int) as chunk, cast(s as int) as start_line, cast(e as int) as end_line, md5(done) as digest from f where done is not null
 union all select f.id, cast(c as int), cast(start as int), cast(line as int), md5(cur) from f join l using (id, k) where strlen(cur) >= 10"""
_LEGAL = "'queued>running','running>interrupted','running>completed','running>failed','running>cancel_requested','interrupted>resumable','resumable>running','cancel_requested>cancelled','cancelled>abandoned'"
_SN = "sn as (select doc_id as path, md5(text) as hash from documents)"

_GEN = "case when o_orderkey % {0} > 0 then o_custkey % 5 end"
_SERVING = f"""g as (select o_orderkey as k, {_GEN.format(2)} as st, case when o_orderkey % 3 > 0 then {_GEN.format(5)} end as b, case when o_orderkey % 3 > 0 then {_GEN.format(7)} end as v, case when o_orderkey % 3 > 0 then {_GEN.format(11)} end as gr, case when o_orderkey % 4 > 0 then 3 end as ix from orders),
 e as (select k, st, ix, case when coalesce(b, v, gr) is null then st else b end as b, case when coalesce(b, v, gr) is null then st else v end as v, case when coalesce(b, v, gr) is null then st else gr end as gr from g),
 p as (select k, coalesce(ix > st, false) as behind, case when b is null then 'no_serving_generation' when v is null or gr is null or k % 17 = 0 then 'bm25_lexical_symbol_hydration' when k % 13 = 0 then 'bm25_lexical_fast_path' else 'hybrid_vector_bm25_ppr' end as path from e)
 select k as o_orderkey, path, behind or path in ('bm25_lexical_symbol_hydration', 'no_serving_generation') as partial, case path when 'no_serving_generation' then path when 'bm25_lexical_symbol_hydration' then 'semantic_or_graph_unavailable' else case when behind then 'stale_serving_generation' end end as reason from p"""
_FRESH = """f as (select o_orderkey as k, case when o_orderkey % 4 > 0 then o_orderkey % 3 end as i, case when o_orderkey % 7 > 0 then o_orderkey % 2 end as s, case when o_orderkey % 5 > 0 then 1 end as x from orders),
 t as (select k, case when k % 6 = 0 then 'partial' when k % 10 = 0 then null when s is null then null when i = s and x > s then (case when k % 11 = 0 or k % 13 = 0 then 'stale' end) when i = s then 'fresh' when i is not null then 'stale' when x > s then 'stale' else 'fresh' end as freshness from f) select k as o_orderkey, freshness from t"""
_CODE = f"""{_Q}, nm as (select p_partkey as id, p_name, p_type, p_brand, name as nm0, coalesce(name, 'get_' || replace(p_name, ' ', '_')) as name from qs),
 cd as (select id as doc_id, 'src/' || lower(p_type) || '/' || lower(p_brand) || '.rs' as fp, case when id % 5 > 0 then name end as name, case when id % 2 = 0 then 'mod::' || replace(p_brand, '#', '_') end as ctx, 'fn ' || name || '() {{ ' || p_name || '; ' || replace(p_brand, '#', '_') || '() }}' as content from nm),
 documents as (select doc_id, concat_ws(' ', fp, translate(fp, '/\\._-:', '      '), name, translate(name, '/\\._-:', '      '), ctx, translate(ctx, '/\\._-:', '      '), content) as text from cd),
 benchmark as (select p_partkey as item_id, case cast(p_partkey // 20 % 4 as int) when 0 then p_name when 1 then 'get' || w1 || upper(left(split_part(p_name, ' ', 2), 1)) || substr(split_part(p_name, ' ', 2), 2) when 2 then w1 || split_part(p_name, ' ', 2) || ' fn' else 'src/' || lower(p_type) end as text
  from (select *, upper(left(split_part(p_name, ' ', 1), 1)) || substr(split_part(p_name, ' ', 1), 2) as w1 from part) where p_partkey % 20 = 0)"""

CATALOG = {
    "recall_code": (recall_code, None),
    "recall_code_filtered": (recall_code_filtered, None),
    "recall_code_degraded": (recall_code_degraded, None),
    "recall_code_projects": (recall_code_projects, None),
    "search_code": (search_code, f"""with {_CODE}, {bm25_sql()}, cs as (select q.vec_id as q_id, e.vec_id as id, round(list_dot_product(e.embedding::double[], q.embedding::double[]) / (sqrt(list_dot_product(e.embedding::double[], e.embedding::double[])) * sqrt(list_dot_product(q.embedding::double[], q.embedding::double[]))), 6) as score from embeddings e, embeddings q where q.vec_id % 20 = 0),
 r as (select q_id, id, 0 as src, row_number() over (partition by q_id order by score desc, id) as n from cs union all select q_id, id, 1, row_number() over (partition by q_id order by score desc, id) from bm), u as (select q_id, id, min(src * 1000 + n) as place from r where n <= 20 group by 1, 2)
 select q_id, id, src, rank from (select q_id, id, cast(place // 1000 as int) as src, row_number() over (partition by q_id order by place, id) as rank from u) where rank <= 20"""),
    "serving_plan": (serving_plan, f"with {_SERVING}"),
    "result_freshness": (result_freshness, f"with {_FRESH}"),
    "lexical_rerank": (lexical_rerank, f"with {_LEX}"),
    "symbol_exactness": (symbol_exactness, f"with {_EXACT}"),
    "symbol_probes": (symbol_probes, f"with {_PROBES}"),
    "job_moves": (job_moves, f"with n as (select o_orderkey, ({_list(STATES)})[cast(o_orderkey % 10 + 1 as int)] as old, ({_list(STATES)})[cast((o_orderkey // 10) % 10 + 1 as int)] as new from orders) select *, (old || '>' || new) in ({_LEGAL}) as legal from n"),
    "symbol_search": (symbol_search, """with a as (select p_partkey as q_id, lower(case when p_partkey % 100 = 0 then left(p_name, 1) when p_partkey % 60 = 0 then substr(p_name, 2, 2) when p_partkey % 40 = 0 then p_type else substr(p_name, 2, 5) end) as q from part where p_partkey % 20 = 0),
 h as (select q_id, p_partkey as id, p_name as name, p_brand, row_number() over (partition by q_id order by p_name, p_partkey) as rank, count(*) over (partition by q_id) as total from a join part on contains(lower(p_name), q) or (p_partkey % 3 > 0 and contains(lower(p_type), q)) where p_size % 2 = 0)
 select q_id, id, name, rank, total, case when ends_with(p_brand, '1') then null when ends_with(p_brand, '2') then 'stale' else 'fresh' end as freshness from h where rank > 5 and rank <= 10"""),
    "result_filters": (result_filters, r"""select page_id, regexp_extract(url, '://[^/]*(/[^?#]*)', 1) as path from pages where starts_with(regexp_extract(url, '://[^/]*(/[^?#]*)', 1), '/en/') and lower(regexp_extract(html, 'lang="(\w+)"', 1)) = 'en'"""),
    "range_overlap": (range_overlap, f"with {_OV} select * from ov where overlap > 0"),
    "ppr_to_chunks": (ppr_to_chunks, f"with {_OV} select b_id, max(round((a_id % 991) / 991.0::double, 6)) as score from ov where overlap = 1 group by 1 order by 2 desc, 1 limit 40"),
    "tightest_parent": (tightest_parent, f"""with {_SY}, it as (select *, row_number() over (partition by file order by s, e desc, id) as pos from sy),
 pr as (select c.file, c.id as child, c.s as cs, c.e as ce, p.id as parent, p.s as ps, p.e as pe, row_number() over (partition by c.file, c.pos order by p.pos desc) as n from it c join it p on p.file = c.file and p.pos < c.pos and p.e >= c.e)
 select file, child, parent from pr where n = 1 and not (cs = ps and ce = pe)"""),
    "resolve_priority": (resolve_priority, f"with {_RF}, {_DF} {_RS % 'df'}"),
    "resolve_relations": (resolve_relations, f"""with {_RF}, {_DF}, d2 as (select * from df where id % 2 = 0), a as ({_RS % 'd2'}), b as ({_RS % 'df'})
 select rf.ref_id, coalesce(a.symbol_id, b.symbol_id) as symbol_id, case when coalesce(a.score, b.score) is null then 'unresolved' when a.symbol_id is not null and a.score = 100 then 'observed' else 'inferred' end as relation_class,
 case when coalesce(a.score, b.score) is null then 'none' when a.symbol_id is not null then 'parser' else 'heuristic' end as provenance,
 case when coalesce(a.score, b.score) is null then 'none' when coalesce(a.score, b.score) = 100 then 'exact' when coalesce(a.score, b.score) = 50 then 'likely' else 'ambiguous' end as confidence_class from rf left join a using (ref_id) left join b using (ref_id)"""),
    "freshness_map": (freshness_map, """select doc_id as path, case when doc_id % 9 = 0 and doc_id % 7 = 3 then 'stale' when doc_id % 9 = 0 then 'unavailable' when doc_id % 2 = 0 and doc_id % 12 = 0 then 'partial' when doc_id % 2 = 0 and (doc_id % 10 = 0 or doc_id % 14 = 0) then 'stale' when doc_id % 2 = 0 then 'fresh' when doc_id % 7 = 3 then 'stale' else 'fresh' end as freshness from documents"""),
    "manifest_diff": (manifest_diff, f"with {_SN}, o as (select * from sn where path % 7 <> 2), n as (select path, case when path % 13 = 0 then 'new' else hash end as hash from sn where path % 6 <> 1) select * from (select coalesce(o.path, n.path) as path, case when n.hash is null then 'delete' when o.hash is null then 'insert' when o.hash <> n.hash then 'update' end as action from o full join n using (path)) where action is not null"),
    "incremental_actions": (incremental_actions, f"with {_SN} select path, case when path % 5 = 0 or path % 11 = 0 then 'delete' when path % 3 <> 0 and path % 4 <> 3 then 'skip' else 'upsert' end as action from sn"),
    "line_windows": (line_windows, r"""with l as (select doc_id as id, string_split(text, chr(10)) as ls from documents), x as (select id, ls, unnest(range((len(ls) - 1) // 3 + 1)) as w from l)
 select id, cast(w as int) as window, cast(w * 3 + 1 as int) as start_line, cast(least(len(ls), w * 3 + 3) as int) as end_line, md5(array_to_string(ls[w * 3 + 1:w * 3 + 3], chr(10))) as digest from x"""),
    "structural_chunks": (structural_chunks, _CHUNKS),
    "generated_header": (generated_header, "select page_id, page_id % 7 in (1, 3, 4, 5) as generated from pages"),
    "path_filter": (path_filter, rf"with {_PT} select page_id, path, (ends_with(path, '.rs') or ends_with(path, '.h') or regexp_matches(path, '^src/[^/]*\.py$')) and not regexp_matches(path, '^lib/f1[^/]*$') as chosen from pt where page_id % 10 in (0, 4, 9) and page_id % 11 <> 0 and page_id % 13 in (0, 1, 2, 5, 8, 9, 11)"),
    "language_detect": (language_detect, f"""with {_PT} select page_id, case page_id % 13 when 0 then 'rust' when 1 then 'python' when 2 then (case when page_id % 7 in (1, 3) then 'objective_c' when page_id % 7 in (0, 4, 6) then 'cpp' else 'c' end) when 3 then 'javascript' when 5 then 'kotlin' when 7 then 'typescript' when 8 then 'typescript' when 10 then 'swift' when 11 then 'objective_c' else 'unknown' end as language from pt"""),
    "abandoned_generations": (abandoned_generations, "select distinct source as project_id, doc_id % 6 as generation from documents where doc_id % 6 <> 5"),
    "index_progress": (index_progress, "select source as project, round((count(*) filter (doc_id % 3 > 0) / count(*)::double) * (0.70::double + 0.30::double * (count(*) filter (doc_id % 4 = 0) / count(*)::double)) * 100, 6) as percent from documents group by 1"),
    "checkpoint_resume": (checkpoint_resume, "select doc_id as path from documents where doc_id % 3 <> 0"),
    "latest_job": (latest_job, "select project, job, o_orderstatus, at_us from (select o_custkey as project, o_orderkey as job, o_orderstatus, epoch_us(o_orderdate) as at_us, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as n from orders) where n = 1"),
    "source_symbols": (source_symbols, """select 'src/n' || n_nationkey || '.py' as file_path, k as kind, nm as name, ln as line, ex as extra from nation, lateral (values
 ('class', 'C' || n_nationkey, 2, 'class C' || n_nationkey || '(Base)'), ('function', 'run_' || n_nationkey, 3, 'def run_' || n_nationkey || '(self)'), ('imports', 'os', 1, 'global'), ('extends', 'Base', 2, 'C' || n_nationkey),
 ('calls', 'C' || n_nationkey, 2, 'global'), ('calls', 'run_' || n_nationkey, 3, 'C' || n_nationkey), ('calls', 'run_' || ((n_nationkey + 1) % 25), 4, 'C' || n_nationkey)) t(k, nm, ln, ex)"""),
}
