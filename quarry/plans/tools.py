"""Queries of the record tools: insertion, stale vectors, observations, imports, status, readiness, indexing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lifecycle as life
from ..operators import corpus as C, generations, lifecycle as L, retrieve as R, store
from ..sources.tables import AS_OF, as_of, memories, table, with_views
from ..workspace import fresh_path
from .lifecycle import _A, _RV, DAYS


def insert_memories(s, d):
    base = memories(s, d).where("id % 2 = 0").select("id", "content", "memory_type", "importance_score", "content_hash", "valid_from")
    new = memories(s, d).where("id % 2 = 1").selectExpr("id", "content", "case when id % 3 = 0 then null when id % 3 = 1 then ' Episodic ' else 'procedural' end as memory_type", "case when id % 5 > 0 then importance_score * 3 - 1 end as importance_score")
    return store.insert(base, new, as_of()).select("id", "memory_type", F.round("importance_score", 6).alias("importance_score"), "content_hash", F.unix_micros("valid_from").alias("from_us"))


def stale_embeddings(s, d):
    e = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    m = memories(s, d).select("id", "namespace").join(e, "id", "left").withColumn("embedding_state", F.when(F.col("id") % 7 == 0, "stale").otherwise("ready"))
    return store.stale_embeddings(m)


def phrase_search(s, d):
    return R.phrase_search(table(s, d, "documents"), "The of", 20, "doc_id", "text")


def observation_normalize(s, d):
    c = table(s, d, "conversations").withColumn("raw", F.concat(F.when(F.col("turn") % 5 == 0, F.lit("  TASK: ")).when(F.col("turn") % 5 == 1, "Task: ").otherwise(" "), F.when(F.col("conv_id") % 9 == 0, F.lit(" ")).otherwise(F.col("text")), F.lit("\n")))
    given = F.when(F.col("turn") % 4 == 0, F.lit('{"a":1,"observation":"old"}')).when(F.col("turn") % 4 == 1, F.lit("[1,2]")).when(F.col("turn") % 4 == 2, F.lit("{}"))
    meta = life.observation_metadata(given, F.concat(F.lit(" "), "role"), F.lit("turn "), F.col("turn") / 4.0 - 0.5, F.when(F.col("conv_id") % 2 == 0, " clean ").otherwise(" "))
    get = lambda p: F.get_json_object("m", f"$.{p}")
    out = c.select("conv_id", "turn", F.md5(life.with_observation_prefix(F.col("raw"))).alias("digest"), meta.alias("m"))
    return out.select("conv_id", "turn", "digest", get("observation.source").alias("source"), get("observation.event_type").alias("event_type"), get("observation.confidence").cast("double").alias("confidence"), get("observation.redaction_state").alias("redaction"), get("a").alias("a"), get("source_metadata").alias("rest"))


def import_metadata(s, d):
    m = memories(s, d).select("id", F.expr("""case id % 5 when 0 then '{"migration":{"v":1},"k":"x"}' when 1 then '{"migration":{"v":2},"source_migration":{"v":1}}' when 2 then '{"source_migration":{"v":3}}' when 3 then '7' end""").alias("meta"))
    new = life.import_metadata(F.col("meta"), F.col("id"), F.concat(F.lit("n"), "id"), "target", F.lit(None).cast("string"), "remap", F.lit("2024-09-01T00:00:00+00:00"))
    get = lambda p: F.get_json_object("m", f"$.{p}")
    return m.select("id", new.alias("m")).select("id", get("migration.source_id").cast("long").alias("source_id"), get("migration.imported_id").alias("imported_id"), get("source_migration").alias("moved"), get("source_metadata").alias("rest"), get("k").alias("k"))


def status(s, d):
    return L.status(memories(s, d), as_of(), DAYS)


def readiness(s, d):
    st = table(s, d, "documents").groupBy(F.col("source").alias("project_id")).agg(F.when(F.max("doc_id") % 2 == 0, "completed").otherwise("indexing").alias("status"))
    return L.readiness(st)


def reset_project(s, d):
    return store.reset(table(s, d, "documents").select("doc_id", F.col("source").alias("project_id")), "src1")


#: Files that a task of the tree makes.
TREE_FILES = 1024


def _tree(s, d, changed=None):
    """A source tree, a file a supplier: every seventh file is generated, every eleventh too large; every third class is
    the base of the next. Files for which ``changed`` holds have a function more."""
    k = F.col("s_suppkey")
    # from the row, so that no constant of a megabyte stands in the plan
    filler = F.repeat(F.concat(F.lit("# filler "), F.substring("s_name", 1, 4), F.lit("\n")), 80_000)
    head = F.when(k % 7 == 0, "# @generated\n").when(k % 11 == 0, filler).otherwise("")
    more = F.when(changed, "def extra():\n    main()\n").otherwise("") if changed is not None else F.lit("")
    body = F.concat(head, F.lit("import os\nclass C"), k, F.when(k % 3 == 0, F.concat(F.lit("(C"), k + 1, F.lit(")"))).otherwise(""), F.lit(":\n    def run_"), k, F.lit("(self):\n        return run_"), k + 1, F.lit("(1)\n\ndef main():\n    C"), k, F.lit("().close()\n"), more)
    # a small table is one split; its files are a megabyte each where there is filler
    rows = table(s, d, "supplier")
    return rows.repartition(1 + rows.count() // TREE_FILES, k).select(F.concat(F.lit("src/s"), k, F.lit(".py")).alias("file_path"), F.lit("python").alias("language"), body.alias("content"))


def _by_file(got):
    """How much each file of an index holds."""
    n = lambda t, c: got[t].groupBy("file_path").agg(F.count("*").alias(c))
    lines = got["symbols"].groupBy("file_path").agg(F.sum(F.col("end_line") - F.col("start_line") + 1).cast("long").alias("symbol_lines"))
    owned = got["references"].groupBy("file_path").agg(F.count_if(F.col("owner") != "global").alias("owned"))
    met = got["references"].select("file_path", "ref_id").distinct().join(got["relations"], "ref_id")
    met = met.groupBy("file_path").agg(*[F.count_if(F.col("relation_class") == c).alias(c) for c in ("observed", "inferred", "unresolved")])
    out = got["files"].select("file_path", "state")
    for t in (n("chunks", "chunks"), n("symbols", "symbols"), lines, n("references", "refs"), owned, met):
        out = out.join(t, "file_path", "left")
    return out.na.fill(0)


def index_project(s, d):
    """What becomes of each file, and how much is read from it."""
    return _by_file(C.index_project(_tree(s, d)))


def reindex_project(s, d):
    """The second generation of a project: a fifth of its files are new, a quarter changed, some gone, the rest taken over
    from the first generation."""
    root = fresh_path(s, "generations")
    k = F.regexp_extract("file_path", "[0-9]+", 0).cast("int")
    generations.build(s, root, "first", _tree(s, d).where(k % 5 > 0), parts=2)
    second = generations.build(s, root, "second", _tree(s, d, F.col("s_suppkey") % 4 == 0).where(k % 9 > 0), parts=2)
    return _by_file(generations.served(s, root, second)).withColumn("generation", F.lit(second))


_M = with_views("memories").rstrip()


def _index_sql(files: str, changed: str) -> str:
    """The tree's files by their numbers alone."""
    return f"""with k as (select s_suppkey as k, s_suppkey % 7 = 0 as g, s_suppkey % 7 <> 0 and s_suppkey % 11 = 0 as f, case when s_suppkey % 3 = 0 then 1 else 0 end as sub, case when {changed} then 1 else 0 end as more from {files}),
 n as (select k.*, case when not g and not f then 1 else 0 end as ok, case when k + 1 in (select k from k where not g and not f) then 1 else 0 end as next from k)
 select 'src/s' || k || '.py' as file_path, case when g then 'skipped' when f then 'failed' else 'indexed' end as state, ok * (3 + more) as chunks, ok * (3 + more) as symbols, ok * (3 + 2 + 2 + 2 * more) as symbol_lines, ok * (6 + 2 * sub + 2 * more) as refs, ok * (4 + sub + more) as owned,
  ok * (3 + sub + 2 * more) as observed, ok * next * (1 + sub) as inferred, ok * (2 + (1 - next) * (1 + sub)) as unresolved from n"""


CATALOG = {
    "insert_memories": (insert_memories, f"""{_M} select id, case when id % 2 = 0 then memory_type when id % 3 = 0 then 'semantic' when id % 3 = 1 then 'episodic' else 'procedural' end as memory_type,
 round(case when id % 2 = 0 then importance_score when id % 5 = 0 then 1.0 else greatest(0.1, least(5.0, importance_score * 3 - 1)) end, 6) as importance_score, case when id % 2 = 0 then content_hash else sha256(content) end as content_hash, epoch_us(case when id % 2 = 0 then valid_from else timestamp '{AS_OF}' end) as from_us from memories"""),
    "stale_embeddings": (stale_embeddings, f"{_M} select id, namespace, case when id % 7 = 0 then 'stale' else 'ready' end as embedding_state from memories where id % 7 = 0 or id not in (select vec_id from embeddings)"),
    "phrase_search": (phrase_search, "select doc_id as id, round(greatest(0.01, least(1.0, (length(text) - length(replace(lower(text), 'the of', ''))) / 6.0 / (strlen(text) + 1) * 1000)), 6) as score from documents where contains(lower(text), 'the of') order by score desc, id limit 20"),
    "observation_normalize": (observation_normalize, r"""with c as (select *, case turn % 5 when 0 then '  TASK: ' when 1 then 'Task: ' else ' ' end || case when conv_id % 9 = 0 then ' ' else text end || chr(10) as raw from conversations), b as (select *, regexp_replace(raw, '^\s+|\s+$', '', 'g') as body from c)
 select conv_id, turn, case when body = '' then null else md5(case when regexp_matches(body, '^(TASK|DECISION|CONTEXT|PROJECT|USER|EPIC|RESEARCH):') then body else 'CONTEXT: ' || body end) end as digest, role as source, 'turn' as event_type, greatest(0.0, least(1.0, turn / 4.0 - 0.5))::double as confidence,
 case when conv_id % 2 = 0 then 'clean' else 'unknown' end as redaction, case when turn % 4 = 0 then '1' end as a, case when turn % 4 = 1 then '[1,2]' end as rest from b"""),
    "import_metadata": (import_metadata, """select doc_id as id, doc_id as source_id, 'n' || doc_id as imported_id, case doc_id % 5 when 0 then '{"v":1}' when 1 then '{"migration":{"v":2},"source_migration":{"v":1}}' when 2 then '{"v":3}' end as moved, case when doc_id % 5 = 3 then '7' end as rest, case when doc_id % 5 = 0 then 'x' end as k from documents"""),
    "status": (status, f"{_M}, {_RV} select r.*, t.*, p.* from (select invalidation_reason as reason, count(*) as count from memories where valid_until is not null group by 1) r, (select count(*) as total, count(*) filter (valid_until is null or valid_until > {_A}) as valid, count(*) filter (valid_until is not null) as invalidated from memories) t, (select count(*) as purge_eligible from rv where eligible) p"),
    "readiness": (readiness, "select count(*) as known_projects, count(*) filter (m % 2 = 0) as ready_projects from (select source, max(doc_id) as m from documents group by 1)"),
    "reset_project": (reset_project, "select doc_id, source as project_id from documents where source is distinct from 'src1'"),
    "index_project": (index_project, _index_sql("supplier", "false")),
    "reindex_project": (reindex_project, f"select *, cast(2 as int) as generation from ({_index_sql('(select * from supplier where s_suppkey % 9 > 0)', 's_suppkey % 4 = 0')})"),
}
