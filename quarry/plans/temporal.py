"""Queries over the record store: validity, scope, JSON, paging, counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import predicates as P
from ..operators import store
from ..sources import files
from ..sources.tables import AS_OF, as_of, memories, records, table, with_views
from ..workspace import fresh_path

T = "2024-01-20 00:00:00"
_us = lambda c: F.unix_micros(c).alias(f"{c}_us")


def _at():
    return F.to_timestamp(F.lit(T))


def valid_now(s, d):
    return records(s, d).where(P.valid_now(_at())).select("id", "user_id", _us("valid_from"), _us("valid_until"))


def valid_at(s, d):
    return records(s, d).where(P.valid_at(_at())).select("id", "user_id", _us("valid_from"), _us("valid_until"))


def scope_filter(s, d):
    return memories(s, d).where(P.valid_now(as_of()) & P.scope(namespace="src3", memory_type="semantic", user_id=None)).select("id", "namespace", "memory_type")


def time_range(s, d):
    return memories(s, d).where(P.time_range("event_time", "2024-02-01", "2024-03-01") & P.time_range("ingestion_time", after="2024-02-10")).select("id", _us("event_time"), _us("ingestion_time"))


def list_page(s, d):
    rows = memories(s, d).where(P.valid_now(as_of())).select("id", _us("ingestion_time"))
    return store.page(rows, "ingestion_time_us", 20, 40)


def point_lookup(s, d):
    return memories(s, d).where("id = 17").limit(1).select("id", "namespace", "memory_type")


def hash_lookup(s, d):
    m = memories(s, d)
    keys = table(s, d, "documents").where("doc_id = 1").select(F.md5("text").alias("content_hash"))
    return m.join(keys, "content_hash", "left_semi").select("id", "content_hash")


def json_subset(s, d):
    return records(s, d).where(P.json_contains(F.col("props"), {"k": 7})).select("id", F.get_json_object("props", "$.k").cast("long").alias("k"))


def json_dsl(s, d):
    rule = {"and": [{"field": "k", "op": "in", "value": [1, 2, 3, 50]}, {"field": "k", "op": "ne", "value": 2}, {"field": "z", "op": "exists", "value": False}]}
    both = {"field": "k", "op": "not_in", "value": [50]}
    return records(s, d).where(P.metadata_condition(F.col("props"), rule) & P.metadata_condition(F.col("props"), both)).select("id", F.get_json_object("props", "$.k").cast("long").alias("k"))


def gc_scan(s, d):
    return memories(s, d).where(P.gc(cutoff=as_of(), memory_type="episodic")).select("id", _us("valid_until"), "invalidation_reason").orderBy("valid_until_us", "id").limit(50)


def count_by_reason(s, d):
    return memories(s, d).groupBy("invalidation_reason").agg(F.count("*").alias("n"))


def record_counts(s, d):
    m = memories(s, d)
    return m.agg(F.count("*").alias("total"), F.count_if(P.valid_now(as_of())).alias("valid"), F.count_if(F.col("valid_until").isNotNull()).alias("invalidated"), F.count_if(F.col("namespace") == "src1").alias("in_src1"))


def id_scan(s, d):
    return memories(s, d).where(P.scope(namespace="src5")).select("id")


def capacity_candidates(s, d):
    return memories(s, d).where(P.valid_now(as_of())).select("id", "importance_score", "access_count", "memory_type", _us("ingestion_time"), _us("last_accessed_at"))


def multiword_filter(s, d):
    return table(s, d, "documents").where(P.all_words(F.col("text"), "The of thand")).select("doc_id")


def patch_update(s, d):
    base = memories(s, d).selectExpr("id", "namespace", "importance_score", "content_hash", "'done' as embedding_state")
    new = table(s, d, "documents").where("doc_id % 11 = 0").selectExpr("doc_id as id", "case when doc_id % 2 = 0 then 'moved' end as namespace", "case when doc_id % 33 = 0 then 'changed' end as content_hash")
    return store.patch(base, new).select("id", "namespace", F.round("importance_score", 6).alias("importance_score"), "content_hash", "embedding_state")


def delete_batch(s, d):
    gone = table(s, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("id"))
    return store.delete(memories(s, d).select("id", "namespace"), gone)


def upsert_latest(s, d):
    e = table(s, d, "events").selectExpr("user_id", "event_type", "value", "ts", "event_id")
    old, new = e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1")
    return store.upsert(old, new, ["user_id", "event_type"], "event_id").select("user_id", "event_type", "event_id", "value")


def invalidate_rows(s, d):
    hit = memories(s, d).where("id % 10 = 3").select("id")
    return store.invalidate(memories(s, d).select("id", "valid_until", "invalidation_reason", "superseded_by"), hit, as_of(), "manual").select("id", _us("valid_until"), "invalidation_reason", "superseded_by")


def truncation_probe(s, d):
    return store.truncated(memories(s, d).where("namespace = 'src2'").select("id"), [F.asc("id")], 20)


def project_stats(s, d):
    docs = table(s, d, "documents").select(F.col("source").alias("project"), "doc_id", "text")
    lab = table(s, d, "labels").select(F.col("doc_id").alias("l"), "quality", "toxic")
    chunks = store.conditional_counts(docs, ["project"], short=F.char_length("text") < 50, long=F.char_length("text") >= 4000)
    marked = docs.join(lab, docs.doc_id == lab.l).groupBy("project").agg(F.count("*").alias("labelled"), F.count_if(F.col("quality") == 1).alias("good"))
    return chunks.join(marked, "project", "full").na.fill(0)


def generation_visibility(s, d):
    docs = table(s, d, "documents").selectExpr("doc_id as id", "case when doc_id % 4 < 3 then doc_id % 4 end as generation")
    return docs.where(P.generation_visible(1))


def unembedded_scan(s, d):
    docs = table(s, d, "documents").selectExpr("doc_id as id", "text", "case when doc_id % 3 = 0 then 1 end as embedding")
    return docs.where(F.col("embedding").isNull() & (F.char_length("text") >= 50)).select("id")


def jsonl_export_import(s, d):
    rows = table(s, d, "labels").selectExpr("doc_id as id", "quality", "toxic")
    path = fresh_path(s, "export")
    store.export_jsonl(rows, path)
    back = s.read.text(path).select(F.monotonically_increasing_id().alias("line_no"), F.col("value").alias("raw"))
    got = store.parse_jsonl(back, "id long, quality int, toxic int", ["id", "quality"])
    return got.where("error is null").select("row.id", "row.quality", "row.toxic")


def jsonl_errors(s, d):
    """Turns written as lines of a few files, some of them bad; each line with its number over all files."""
    path = fresh_path(s, "turns")
    c = table(s, d, "conversations").withColumn("k", F.col("conv_id") * 1000 + F.col("turn"))
    good = F.to_json(F.struct(F.concat(F.lit("t"), F.col("k")).alias("id"), F.when(F.col("k") % 5 > 0, F.col("role")).alias("content")))
    line = F.when(F.col("k") % 7 == 0, F.concat(F.lit("{bad "), F.col("k"))).when(F.col("k") % 11 == 0, "").otherwise(good)
    c.select("k", line.alias("value")).repartitionByRange(8, "k").sortWithinPartitions("k").select("value").write.text(path)
    got = store.parse_jsonl(files.jsonl_lines(s, path, 64 << 10), "id string, content string", ["id", "content"])
    return got.select("line_no", "error", "row.id")


def ignored_paths(s, d):
    """Paths under ignore files at the root and in two folders: negated, folder-only, tied and deep rules."""
    k = F.col("page_id")
    ends = F.element_at(F.array(*[F.lit(x) for x in ("py", "log", "rs")]), (k % 3 + 1).cast("int"))
    folder = F.element_at(F.array(*[F.lit(x) for x in ("", "src/", "src/build/", "docs/", "docs/gen/", "keep/")]), (k % 6 + 1).cast("int"))
    paths = table(s, d, "pages").select(F.concat(folder, F.lit("f"), k % 10, F.lit("_"), k, F.lit("."), ends).alias("file_path"))
    rules = files.ignore_rules(s.createDataFrame([(".gitignore", "*.log\nbuild/\n/f1_*\n**/gen/f2*\n"), ("src/.gitignore", "!f3*.log\n"), ("keep/.gitignore", "*\n!*.py\n")], "file_path string, content string"))
    return files.ignored(paths, rules)


_M, _R = with_views("memories"), with_views("records")
_ASOF = f"timestamp '{AS_OF}'"
_T = f"timestamp '{T}'"
_E = "epoch_us"
CATALOG = {
    "valid_now": (valid_now, f"{_R} select id, user_id, epoch_us(valid_from) as valid_from_us, epoch_us(valid_until) as valid_until_us from records where valid_until is null or valid_until > {_T}"),
    "valid_at": (valid_at, f"{_R} select id, user_id, epoch_us(valid_from) as valid_from_us, epoch_us(valid_until) as valid_until_us from records where valid_from <= {_T} and (valid_until is null or valid_until > {_T})"),
    "scope_filter": (scope_filter, f"{_M} select id, namespace, memory_type from memories where (valid_until is null or valid_until > {_ASOF}) and namespace = 'src3' and memory_type = 'semantic'"),
    "time_range": (time_range, f"{_M} select id, epoch_us(event_time) as event_time_us, epoch_us(ingestion_time) as ingestion_time_us from memories where event_time >= timestamp '2024-02-01' and event_time <= timestamp '2024-03-01' and ingestion_time >= timestamp '2024-02-10'"),
    "list_page": (list_page, f"{_M} select id, epoch_us(ingestion_time) as ingestion_time_us from memories where valid_until is null or valid_until > {_ASOF} order by 2 desc, id limit 20 offset 40"),
    "point_lookup": (point_lookup, f"{_M} select id, namespace, memory_type from memories where id = 17"),
    "hash_lookup": (hash_lookup, f"{_M} select id, content_hash from memories where content_hash in (select md5(text) from documents where doc_id = 1)"),
    "json_subset": (json_subset, f"{_R} select id, cast(json_extract_string(props, '$.k') as bigint) as k from records where cast(json_extract_string(props, '$.k') as bigint) = 7"),
    "json_dsl_in_notin": (json_dsl, f"{_R} select id, cast(json_extract_string(props, '$.k') as bigint) as k from records where json_extract_string(props, '$.k') in ('1','2','3','50') and json_extract_string(props, '$.k') not in ('2', '50')"),
    "gc_scan": (gc_scan, f"{_M} select id, epoch_us(valid_until) as valid_until_us, invalidation_reason from memories where valid_until is not null and valid_until <= {_ASOF} and memory_type = 'episodic' order by 2, id limit 50"),
    "count_by_reason": (count_by_reason, f"{_M} select invalidation_reason, count(*) as n from memories group by 1"),
    "record_counts": (record_counts, f"{_M} select count(*) as total, count(*) filter (valid_until is null or valid_until > {_ASOF}) as valid, count(*) filter (valid_until is not null) as invalidated, count(*) filter (namespace = 'src1') as in_src1 from memories"),
    "id_scan": (id_scan, f"{_M} select id from memories where namespace = 'src5'"),
    "capacity_candidates": (capacity_candidates, f"{_M} select id, importance_score, access_count, memory_type, epoch_us(ingestion_time) as ingestion_time_us, epoch_us(last_accessed_at) as last_accessed_at_us from memories where valid_until is null or valid_until > {_ASOF}"),
    "multiword_filter": (multiword_filter, "select doc_id from documents where contains(lower(text), 'the') and contains(lower(text), 'of') and contains(lower(text), 'thand')"),
    "patch_update": (patch_update, f"""{_M} select m.id, case when m.id % 11 = 0 and m.id % 2 = 0 then 'moved' else namespace end as namespace, round(importance_score, 6) as importance_score,
 case when m.id % 33 = 0 then 'changed' else content_hash end as content_hash,
 case when case when m.id % 33 = 0 then 'changed' else content_hash end is distinct from content_hash or content_hash is null then 'stale' else 'done' end as embedding_state from memories m"""),
    "delete_batch": (delete_batch, f"{_M} select id, namespace from memories where id not in (select doc_id from labels where toxic = 1)"),
    "upsert_latest": (upsert_latest, "select user_id, event_type, max(event_id) as event_id, arg_max(value, event_id) as value from events group by 1, 2"),
    "invalidate_rows": (invalidate_rows, f"{_M} select id, epoch_us(case when id % 10 = 3 then {_ASOF} else valid_until end) as valid_until_us, case when id % 10 = 3 then 'manual' else invalidation_reason end as invalidation_reason, superseded_by from memories"),
    "truncation_probe": (truncation_probe, f"{_M} select id, (select count(*) from memories where namespace = 'src2') > 20 as truncated from memories where namespace = 'src2' order by id limit 20"),
    "project_stats": (project_stats, """select source as project, count(*) as total, count(*) filter (length(text) < 50) as short, count(*) filter (length(text) >= 4000) as long,
 count(l.doc_id) as labelled, count(*) filter (l.quality = 1) as good from documents d left join labels l using (doc_id) group by 1"""),
    "generation_visibility": (generation_visibility, "select doc_id as id, case when doc_id % 4 < 3 then doc_id % 4 end as generation from documents where doc_id % 4 in (1, 3)"),
    "unembedded_scan": (unembedded_scan, "select doc_id as id from documents where doc_id % 3 <> 0 and length(text) >= 50"),
    "jsonl_errors": (jsonl_errors, """with c as (select conv_id * 1000 + turn as k, role, row_number() over (order by conv_id * 1000 + turn) as line_no from conversations)
 select line_no, case when k % 7 = 0 then 'malformed' when k % 5 = 0 or role is null then 'missing: content' end as error, case when k % 7 > 0 and k % 5 > 0 and role is not null then 't' || k end as id from c where k % 7 = 0 or k % 11 > 0"""),
    "ignored_paths": (ignored_paths, r"""with p as (select page_id as k, ['', 'src/', 'src/build/', 'docs/', 'docs/gen/', 'keep/'][cast(page_id % 6 + 1 as int)] as f, 'f' || (page_id % 10) || '_' || page_id || '.' || ['py', 'log', 'rs'][cast(page_id % 3 + 1 as int)] as n from pages)
 select distinct f || n as file_path from p where f = 'src/build/' or (f = 'keep/' and not ends_with(n, '.py')) or (f in ('', 'docs/', 'docs/gen/') and ends_with(n, '.log')) or (f = 'src/' and ends_with(n, '.log') and not starts_with(n, 'f3')) or (f = '' and starts_with(n, 'f1_')) or (f = 'docs/gen/' and starts_with(n, 'f2'))"""),
    "jsonl_export_import": (jsonl_export_import, "select doc_id as id, quality, toxic from labels"),
}
