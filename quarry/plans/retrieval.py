"""Retrieval queries: BM25, term frequency, cosine, fusion, decay, hybrid recall."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..config import CONFIG
from ..functions import scoring, text
from ..operators import index, living_index, retrieve as R, vector_index
from ..sources.tables import AS_OF, as_of, memories, table, with_views
from ..workspace import fresh_path, hadoop_path


def _queries(s, d):
    return table(s, d, "benchmark").selectExpr("item_id as q_id", "text")


_INDEXES: dict = {}


def once(known: dict, s, file: str, by: tuple[str, ...], make):
    """``make()``, called once for a session and a state of the files."""
    fs, path = hadoop_path(s, file)
    files = [fs.getFileStatus(path)] if not fs.getFileStatus(path).isDirectory() else fs.listStatus(path)
    key = (s.sparkContext.applicationId, file, by, tuple(sorted((str(f.getPath()), f.getLen(), f.getModificationTime()) for f in files)))
    if key not in known:
        known[key] = make()
    return known[key]


def _index(s, d, by: tuple[str, ...] = ()):
    """The index of the documents, read by every query."""
    return once(_INDEXES, s, f"{d}/documents.parquet", by, lambda: index.build(table(s, d, "documents").withColumn("project", F.col("source")), "doc_id", "text", by))


def bm25_topk(s, d):
    return R.bm25_topk(_index(s, d), _queries(s, d), 10).select("q_id", "id", "score", "rank")


def bm25_per_namespace(s, d):
    return R.bm25_topk(_index(s, d, ("project",)), _queries(s, d), 3).select("q_id", "project", "id", "score", "rank")


def bm25_allowed_ids(s, d):
    ok = memories(s, d).where("memory_type = 'semantic'").select("id")
    return R.bm25_topk(_index(s, d), _queries(s, d), 5, ok).select("q_id", "id", "score", F.least(F.lit(1.0), "score").alias("clamped"), "rank")


def bm25_living(s, d):
    """BM25 of an index that grew by inserts, patches and deletes, none of them followed by a rebuild."""
    docs = table(s, d, "documents").select("doc_id", "text")
    root = fresh_path(s, "living")
    changed = docs.where("doc_id % 10 = 1").withColumn("text", F.concat(F.reverse("text"), F.lit(" "), F.substring("text", 1, 200)))
    for batch in (docs.where("doc_id % 3 > 0"), docs.where("doc_id % 3 = 0"), changed):
        living_index.upsert(s, root, batch, "doc_id", "text")
    living_index.delete(s, root, docs.where("doc_id % 11 = 0").select(F.col("doc_id").alias("id")))
    living_index.upsert(s, root, docs.where("doc_id % 33 = 0"), "doc_id", "text")
    return R.bm25_topk(living_index.opened(s, root), _queries(s, d), 10).select("q_id", "id", "score", "rank")


def tf_search(s, d):
    return R.tf_search(table(s, d, "documents"), "the of thand", 20, "doc_id", "text")


def camel_tokens(s, d):
    return table(s, d, "pages").select("page_id", F.array_join(text.tokens(F.col("url")), " ").alias("tokens"))


def identifier_tokens(s, d):
    return table(s, d, "part").select("p_partkey", F.array_join(text.identifier_tokens(F.concat_ws("", F.col("p_name"), F.initcap("p_type"), F.col("p_brand"))), " ").alias("tokens"))


def _vectors(s, d):
    return table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")


def _vector_queries(s, d):
    """Every twentieth vector asks for its neighbours among all."""
    return _vectors(s, d).where("id % 20 = 0").select(F.col("id").alias("q_id"), F.col("v").alias("qv"))


def cosine_topk(s, d):
    return R.cosine_topk(_vectors(s, d), _vector_queries(s, d), 10)


def cosine_topk_filtered(s, d):
    return R.cosine_topk(_vectors(s, d).where("label = 1"), _vector_queries(s, d), 10)


def _vector_index(s, d):
    return once(_VECTORS, s, f"{d}/embeddings.parquet", (), lambda: vector_index.build(_vectors(s, d)))


_VECTORS: dict = {}


def ann_topk(s, d):
    """Neighbours by the inverted-file index: similarities are exact, and nine of ten neighbours are found at least."""
    return vector_index.search(_vector_index(s, d), _vector_queries(s, d), 10)


def ann_topk_filtered(s, d):
    return vector_index.search(_vector_index(s, d), _vector_queries(s, d), 10, F.col("label") == 1)


def mrl_truncate(s, d):
    v = _vectors(s, d).withColumn("t", scoring.truncated(F.col("v"), 16))
    return v.select("id", F.round(scoring.norm(F.col("t")), 6).alias("norm"), F.round(F.element_at("t", 1), 6).alias("first"), F.round(F.element_at("t", 16), 6).alias("last"))


def _channels(s, d):
    lex = bm25_topk(s, d).select("q_id", F.lit("bm25").alias("channel"), "id", "score")
    vec = R.cosine_topk(_vectors(s, d), _vector_queries(s, d), 10).select("q_id", F.lit("vector").alias("channel"), "id", "score")
    return lex.unionByName(vec)


def rrf_weighted(s, d):
    return R.rrf(_channels(s, d), {"vector": CONFIG.memory_weights[0], "bm25": CONFIG.memory_weights[1]}, 10)


def rrf_fuse(s, d):
    return R.rrf(_channels(s, d), {"vector": 1.0, "bm25": 1.0}, 10).select("q_id", "id", "score", "rank")


def channel_ranks(s, d):
    w = Window.partitionBy("q_id", "channel").orderBy(F.desc("score"), "id")
    return _channels(s, d).withColumn("rank", F.row_number().over(w) - 1)


def ordered_union(s, d):
    w = Window.partitionBy("q_id").orderBy(F.desc("score"), "id")
    c = _channels(s, d)
    one = lambda n: c.where(F.col("channel") == n).withColumn("rank", F.row_number().over(w)).select("q_id", "id", "rank")
    return R.ordered_union(one("vector"), one("bm25"), ["q_id"])


def dedup_best(s, d):
    rows = memories(s, d).select("id", "namespace", (F.col("importance_score") * 1.0).alias("score"), text.dedup_key(F.col("content"), F.col("content_hash")).alias("key"))
    return R.keep_best(rows, F.col("key"), ["namespace"]).select("id", "namespace", F.round("score", 6).alias("score"))


def decay_score(s, d):
    m = memories(s, d)
    age = scoring.age_days(F.col("ingestion_time"), as_of())
    dec = scoring.decay(age, F.col("access_count"), F.col("memory_type"))
    return m.select("id", F.round(scoring.effective_age(age, F.col("access_count")), 6).alias("eff_age"), F.round(dec, 6).alias("decay"), F.round(scoring.decayed(F.col("importance_score"), age, F.col("access_count"), F.col("memory_type")), 6).alias("score"))


def reinforcement(s, d):
    return memories(s, d).select("id", F.round(scoring.reinforcement(F.col("access_count") * 40), 6).alias("bonus"))


def importance_boost(s, d):
    return memories(s, d).select("id", F.round(scoring.importance_boost(F.col("importance_score")), 6).alias("boost"), F.round(scoring.importance_normal(F.col("importance_score") - 1.0), 6).alias("normal"))


def hybrid_recall(s, d):
    return _recall(s, d).select("q_id", "id", "score", "rank")


def _recall(s, d, graph=None):
    live = F.col("valid_until").isNull() | (F.col("valid_until") > as_of())
    return R.recall(memories(s, d), _index(s, d), _queries(s, d), _vectors(s, d), _vector_queries(s, d), live, as_of(), 10, graph)


def recall_graph(s, d):
    """Recall with the graph channel: documents are entities, linked with the next of their source and ten ids on."""
    m = memories(s, d).select("id", "namespace")
    edges = m.select(F.col("id").alias("src"), (F.col("id") + 10).alias("dst"), F.lit(1.0).alias("weight")).unionByName(
        m.selectExpr("id as src", "lead(id) over (partition by namespace order by id) as dst", "cast(1 + id % 3 as double) as weight").where("dst is not null")
    )
    return _recall(s, d, (m.select(F.col("id").alias("node")), edges)).select("q_id", "id", "score", "rank", F.round("ppr_score", 8).alias("ppr_score"))


def _episodes(s, d):
    """Records valid now, of one type."""
    return memories(s, d).where("(valid_until is null or valid_until > timestamp '%s') and memory_type = 'episodic'" % AS_OF)


def search_memory(s, d):
    """The lexical channel alone, with decay."""
    hits = R.bm25_topk(_index(s, d), _queries(s, d), 50, _episodes(s, d).select("id")).select("q_id", "id", "score")
    return R.single_channel(hits, memories(s, d), 10, as_of(), 0.2).select("q_id", "id", F.round("score", 6).alias("score"), "rank")


def search_memory_vector(s, d):
    """The vector channel alone, with decay."""
    near = R.cosine_topk(_vectors(s, d).join(_episodes(s, d).select("id"), "id", "left_semi"), _vector_queries(s, d), 50).select("q_id", "id", "score")
    return R.single_channel(near, memories(s, d), 10, as_of()).select("q_id", "id", F.round("score", 6).alias("score"), "rank")


def search_trace(s, d):
    return _recall(s, d).select("q_id", "rank", "id", F.array_join("channels", "+").alias("channels"), F.round("fused", 8).alias("fused"), "namespace")


PROMPTS = (
    "{}", "<system-reminder>x</system-reminder>\n{}", "<Work_Context>\nold\n</Work_Context>\n{}", "<Work_Context>\n## TASK\nold</Work_Context>\n{}\n# TASK\ndo it TASK: not this",
    "<Work_Context>\n{}\nTASK: first\nTASK: last  one</Work_Context>  \n", "<Work_Context> {} ", "<!-- MEMORY_MCP_INTERNAL_INITIATOR --> {}", "<system-reminder> ## 1. TASK {} # TASK y",
)


def effective_query(s, d):
    """Turns wrapped in each kind of prompt, whole; every thirteenth is blank and every eleventh very long."""
    turn = F.when(F.col("conv_id") % 13 == 0, F.lit(" \n\t ")).when(F.col("conv_id") % 11 == 0, F.repeat(F.concat("text", F.lit(" \n ")), 30)).otherwise(F.col("text"))
    prompt = F.element_at(F.array(*[F.concat(F.lit(p.split("{}")[0]), turn, F.lit(p.split("{}")[1])) for p in PROMPTS]), ((F.col("conv_id") + F.col("turn")) % len(PROMPTS) + 1).cast("int"))
    q = table(s, d, "conversations").select("conv_id", "turn", text.effective_query(prompt).alias("e"))
    return q.select("conv_id", "turn", F.md5("e.query").alias("query"), "e.origin", "e.effective_chars", "e.truncated")


def query_classes(s, d):
    p = table(s, d, "pages")
    name = F.regexp_extract("url", "://([^/]*)", 1)
    ident = F.concat(F.lit("get"), F.initcap(F.element_at(F.split(name, r"\."), -2)))
    return p.select("page_id", text.codeish(F.col("url")).alias("codeish"), text.single_identifier(ident).alias("identifier"), text.codeish(F.lit("plain words")).alias("plain"))


def jaccard_similarity(s, d):
    """Each turn of a conversation and the one before: overlap of their word sets."""
    a = table(s, d, "conversations").select("conv_id", "turn", text.word_set(F.col("text")).alias("w"))
    b = a.select(F.col("conv_id"), (F.col("turn") - 1).alias("turn"), F.col("w").alias("v"))
    return a.join(b, ["conv_id", "turn"]).select("conv_id", "turn", F.round(text.jaccard(F.col("w"), F.col("v")), 6).alias("jaccard"))


_DTOK = r"""case when regexp_matches(w, '[a-z][A-Z]|[0-9][A-Za-z]|[A-Z][A-Z][a-z]')
 then list_concat(string_split(lower(regexp_replace(regexp_replace(regexp_replace(w, '([a-z])([A-Z])', '\1 \2', 'g'), '([0-9])([A-Za-z])', '\1 \2', 'g'), '([A-Z])([A-Z][a-z])', '\1 \2', 'g')), ' '), [lower(w)])
 else [lower(w)] end"""


def tokens_sql(col: str) -> str:
    return rf"flatten(list_transform(list_filter(string_split_regex({col}, '[^\p{{L}}\p{{N}}]+'), lambda w: w <> ''), lambda w: {_DTOK}))"


def bm25_sql(by: str = "", limit_q: str = "", docs: str = "documents") -> str:
    p = f"{by}, " if by else ""
    on = f" and d2.{by} = po.{by}" if by else ""
    return f"""tok as (select doc_id as id, {'source as ' + by + ', ' if by else ''}{tokens_sql('text')} as t from {docs}),
 qt as (select q_id, term, count(*) as qtf from (select item_id as q_id, unnest({tokens_sql('text')}) as term from benchmark {limit_q}) group by 1, 2),
 st as (select {p}count(*) as n, avg(len(t)) as avgdl from tok {'group by ' + by if by else ''}),
 po as (select {p}id, dl, term, count(*) as tf from (select {p}id, len(t) as dl, unnest(t) as term from tok) where term in (select term from qt) group by all),
 dfs as (select {p}term, count(*) as df from po group by all),
 w as (select {'po.' + p if by else ''}po.id, po.term, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) as w
  from po join dfs d2 on d2.term = po.term{on} join st on {'st.' + by + ' = po.' + by if by else 'true'}),
 bm as (select q_id, {p}id, round(sum(w * qtf), 6) as score from w join qt using (term) group by all)"""


def _cos(where: str) -> str:
    return f"""cs as (select q.vec_id as q_id, e.vec_id as id, round(list_dot_product(e.embedding::double[], q.embedding::double[]) / (sqrt(list_dot_product(e.embedding::double[], e.embedding::double[])) * sqrt(list_dot_product(q.embedding::double[], q.embedding::double[]))), 6) as score
 from embeddings e, embeddings q where q.vec_id % 20 = 0 {where}), cr as (select *, row_number() over (partition by q_id order by score desc, id) as rank from cs)"""


_TOP = "select *, row_number() over (partition by q_id order by score desc, id) as rank from"
_CH = f"with {bm25_sql()}, {_cos('')}, br as ({_TOP} bm), ch as (select q_id, 'bm25' as channel, id, score from br where rank <= 10 union all select q_id, 'vector', id, score from cr where rank <= 10), rk as (select *, row_number() over (partition by q_id, channel order by score desc, id) as r from ch)"


def _rrf_sql(v: float, b: float) -> str:
    return f"fu as (select q_id, id, round(sum(case channel when 'vector' then {v}::double else {b}::double end / (60 + r)), 8) as score, max(case when channel = 'vector' then score end) as vector_score, max(case when channel = 'bm25' then score end) as bm25_score from rk group by 1, 2), fr as ({_TOP} fu)"


_DEC = f"""greatest(0.05, exp(-ln(2) * (greatest(0.0, (epoch_us(timestamp '{AS_OF}') - epoch_us(%s)) / 86400000000.0) / (1 + 0.5 * ln(1 + access_count::double))) / case memory_type when 'episodic' then 30.0 when 'procedural' then 365.0 else 180.0 end))"""
_REIN = "(1 + least(0.5 * ln(1 + access_count::double), 3.0))"
_RECALL = f"""{with_views('memories').rstrip()}, {bm25_sql()}, {_cos('')}, ok as (select id from memories where valid_until is null or valid_until > timestamp '{AS_OF}'),
 b2 as ({_TOP} bm where id in (select id from ok)), c2 as ({_TOP} cs where id in (select id from ok)),
 ch as (select q_id, 'bm25' as channel, id, score from b2 where rank <= 50 union all select q_id, 'vector', id, score from c2 where rank <= 50),
 rk as (select *, row_number() over (partition by q_id, channel order by score desc, id) as r from ch), {_rrf_sql(0.40, 0.15)},
 sc as (select f.q_id, f.id, f.score as fused, f.vector_score, f.bm25_score, m.namespace, coalesce('h:' || content_hash, 'c:' || lower(trim(regexp_replace(content, '\\s+', ' ', 'g')))) as key,
  round(f.score * sqrt(greatest(0.25, least(4.0, importance_score))) * {_DEC % 'coalesce(event_time, ingestion_time)'} * {_REIN}, 8) as score from fr f join memories m using (id) where f.rank <= 10),
 de as (select *, row_number() over (partition by q_id, key order by score desc, id) as n from sc), fin as ({_TOP} de where n = 1)"""

_WS = r"[\x09-\x0D\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _prompts_sql() -> str:
    """Prompts, what they are taken for, and the part that asks, as cases over the kinds of prompt."""
    each = " ".join(f"when {i} then concat({_text(p.split('{}')[0])}, t, {_text(p.split('{}')[1])})" for i, p in enumerate(PROMPTS))
    last = lambda c, m: f"substr({c}, length({c}) - position(reverse({_text(m)}) in reverse({c})) - {len(m) - 2})"
    task = lambda c: "case " + " ".join(f"when contains({c}, {_text(m)}) then {last(c, m)}" for m in text.TASK_MARKERS) + " end"
    wrapped = " or ".join(f"contains(x, {_text(w)})" for w in text.WRAPPERS)
    close = text.CONTEXT_CLOSE
    return f"""k as (select conv_id, turn, (conv_id + turn) % {len(PROMPTS)} as kind, case when conv_id % 13 = 0 then ' ' || chr(10) || chr(9) || ' ' when conv_id % 11 = 0 then repeat(text || ' ' || chr(10) || ' ', 30) else text end as t from conversations),
 x as (select conv_id, turn, case kind {each} end as x from k), y as (select *, case when contains(x, '{close}') then string_split(x, '{close}')[-1] end as a from x), z as (select *, regexp_replace(coalesce(a, ''), '{_WS}+', '', 'g') <> '' as rest from y),
 c as (select *, case when not ({wrapped}) then [x, 'direct'] when rest and ({task('a')}) is not null then [{task('a')}, 'task_section'] when rest then [a, 'post_work_context'] when ({task('x')}) is not null then [{task('x')}, 'task_section']
  when contains(x, '<Work_Context>') then [{last('x', '<Work_Context>')}, 'work_context'] else [x, 'prompt_context'] end as c from z),
 f as (select conv_id, turn, c[2] as origin, trim(regexp_replace(c[1], '{_WS}+', ' ', 'g')) as q from c)
 select conv_id, turn, md5(rtrim(left(q, 4096))) as query, origin, length(rtrim(left(q, 4096))) as effective_chars, length(q) > 4096 as truncated from f"""


def _single(channel: str, where: str) -> str:
    """One channel's fifty, the best of each content, with decay and reinforcement."""
    base = bm25_sql() if channel == "bm" else _cos("")
    return f"""{with_views('memories').rstrip()}, {base}, ok as (select id from memories where (valid_until is null or valid_until > timestamp '{AS_OF}') and memory_type = 'episodic'), b2 as ({_TOP} {channel} where id in (select id from ok)),
 sc as (select q_id, id, least(1.0, score) as base, coalesce('h:' || content_hash, 'c:' || lower(trim(regexp_replace(content, '\\s+', ' ', 'g')))) as key, {_DEC % 'coalesce(event_time, ingestion_time)'} * {_REIN} as factor from b2 join memories using (id) where rank <= 50),
 de as (select *, row_number() over (partition by q_id, key order by base desc, id) as n from sc), fi as (select q_id, id, round(base * factor, 8) as score from de where n = 1), fin as ({_TOP} fi)
 select q_id, id, round(score, 6) as score, rank from fin {where}"""


def search_memory_sql() -> str:
    return _single("bm", "where rank <= 10 and score >= 0.2")


CATALOG = {
    "bm25_topk": (bm25_topk, f"with {bm25_sql()} select q_id, id, score, rank from ({_TOP} bm) where rank <= 10"),
    "bm25_topk_per_namespace": (bm25_per_namespace, f"with {bm25_sql('project')} select q_id, project, id, score, rank from (select *, row_number() over (partition by q_id, project order by score desc, id) as rank from bm) where rank <= 3"),
    "bm25_allowed_ids": (bm25_allowed_ids, f"with {bm25_sql()} select q_id, id, score, least(1.0, score) as clamped, rank from ({_TOP} bm where id % 3 = 1) where rank <= 5"),
    "bm25_living": (bm25_living, f"""with dc as (select doc_id, case when doc_id % 10 = 1 and doc_id % 33 <> 0 then reverse(text) || ' ' || substr(text, 1, 200) else text end as text from documents where doc_id % 11 <> 0 or doc_id % 33 = 0),
 {bm25_sql(docs='dc')} select q_id, id, score, rank from ({_TOP} bm) where rank <= 10"""),
    "tf_search": (tf_search, """select doc_id as id, round(greatest(0.01, least(1.0, ((length(lower(text)) - length(replace(lower(text), 'the', ''))) / 3.0 + (length(lower(text)) - length(replace(lower(text), 'of', ''))) / 2.0 + (length(lower(text)) - length(replace(lower(text), 'thand', ''))) / 5.0) / (strlen(text) + 1) * 1000)), 6) as score
 from documents where contains(lower(text), 'the') and contains(lower(text), 'of') and contains(lower(text), 'thand') order by score desc, id limit 20"""),
    "camel_tokens": (camel_tokens, f"select page_id, array_to_string({tokens_sql('url')}, ' ') as tokens from pages"),
    "identifier_tokens": (identifier_tokens, f"with t as (select p_partkey, list_sort(list_distinct({tokens_sql('p_name || array_to_string(list_transform(string_split(p_type, chr(32)), lambda w: upper(left(w, 1)) || lower(substr(w, 2))), chr(32)) || p_brand')})) as t from part) select p_partkey, array_to_string(t, ' ') as tokens from t"),
    "cosine_topk": (cosine_topk, f"with {_cos('')} select q_id, id, score, rank from cr where rank <= 10"),
    "cosine_topk_filtered": (cosine_topk_filtered, f"with {_cos('and e.label = 1')} select q_id, id, score, rank from cr where rank <= 10"),
    "ann_topk": (ann_topk, None),
    "ann_topk_filtered": (ann_topk_filtered, None),
    "mrl_truncate": (mrl_truncate, """with t as (select vec_id as id, embedding[1:16]::double[] as v from embeddings), n as (select id, v, sqrt(list_dot_product(v, v)) as n from t)
 select id, round(sqrt(list_sum(list_transform(v, lambda x: (x / n) * (x / n)))), 6) as norm, round(v[1] / n, 6) as first, round(v[16] / n, 6) as last from n"""),
    "rrf_weighted": (rrf_weighted, f"{_CH}, {_rrf_sql(0.40, 0.15)} select q_id, id, score, vector_score, bm25_score, rank from fr where rank <= 10"),
    "rrf_fuse": (rrf_fuse, f"{_CH}, {_rrf_sql(1, 1)} select q_id, id, score, rank from fr where rank <= 10"),
    "channel_ranks": (channel_ranks, f"{_CH} select q_id, channel, id, score, r - 1 as rank from rk"),
    "ordered_union": (ordered_union, f"{_CH}, o as (select q_id, id, min((case channel when 'vector' then 0 else 1 end) * 1000 + r) as pl from rk group by 1, 2) select q_id, id, cast(pl // 1000 as int) as src, row_number() over (partition by q_id order by pl, id) as rank from o"),
    "dedup_best": (dedup_best, f"""{with_views('memories')} select id, namespace, round(score, 6) as score from (select id, namespace, importance_score as score, row_number() over (partition by namespace, coalesce('h:' || content_hash, 'c:' || lower(trim(regexp_replace(content, '\\s+', ' ', 'g')))) order by importance_score desc, id) as n from memories) where n = 1"""),
    "decay_score": (decay_score, f"""{with_views('memories')} select id, round(greatest(0.0, (epoch_us(timestamp '{AS_OF}') - epoch_us(ingestion_time)) / 86400000000.0) / (1 + 0.5 * ln(1 + access_count::double)), 6) as eff_age, round({_DEC % 'ingestion_time'}, 6) as decay, round(importance_score * {_DEC % 'ingestion_time'} * {_REIN}, 6) as score from memories"""),
    "reinforcement": (reinforcement, f"{with_views('memories')} select id, round(least(0.5 * ln(1 + access_count * 40.0::double), 3.0), 6) as bonus from memories"),
    "importance_boost": (importance_boost, f"{with_views('memories')} select id, round(sqrt(greatest(0.25, least(4.0, importance_score))), 6) as boost, round(greatest(0.1, least(5.0, importance_score - 1.0)), 6) as normal from memories"),
    "hybrid_recall": (hybrid_recall, f"{_RECALL} select q_id, id, score, rank from fin where rank <= 10"),
    "search_trace": (search_trace, f"{_RECALL} select q_id, rank, id, array_to_string(list_filter([case when vector_score > 0 then 'vector' end, case when bm25_score > 0 then 'bm25' end], lambda x: x is not null), '+') as channels, fused, namespace from fin where rank <= 10"),
    "effective_query": (effective_query, f"with {_prompts_sql()}"),
    "recall_graph": (recall_graph, None),
    "search_memory": (search_memory, search_memory_sql()),
    "search_memory_vector": (search_memory_vector, _single("cs", "where rank <= 10")),
    "query_classes": (query_classes, r"""with h as (select page_id, url, string_split(regexp_extract(url, '://([^/]*)', 1), '.')[-2] as w from pages), i as (select *, 'get' || upper(left(w, 1)) || lower(substr(w, 2)) as ident from h)
 select page_id, regexp_matches(url, '_|::|/|\.') or regexp_matches(url, '[a-z][A-Z]') or list_has_any(string_split_regex(lower(url), '\s+'), ['fn', 'function', 'class', 'struct', 'trait', 'impl', 'method', 'module', 'import', 'enum', 'interface']) as codeish,
  length(ident) >= 8 and regexp_matches(ident, '^[A-Za-z0-9_:.]+$') and regexp_matches(ident, '[a-z][A-Z]') as identifier, false as plain from i"""),
    "jaccard_similarity": (jaccard_similarity, r"""with a as (select conv_id, turn, list_distinct(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}_-]+'), lambda w: length(w) >= 3)) as w from conversations)
 select a.conv_id, a.turn, round(case when len(list_distinct(list_concat(a.w, b.w))) = 0 then 0.0 else len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w)))::double end, 6) as jaccard from a join a b on a.conv_id = b.conv_id and b.turn = a.turn + 1"""),
}
