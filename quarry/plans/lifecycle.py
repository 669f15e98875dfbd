"""Lifecycle queries: retention, purge, capacity, duplicates, audit, context selection, observations, learnings, import."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lifecycle as life, text
from ..operators import joins, learning, lifecycle as L, store
from ..sources.tables import AS_OF, as_of, memories, table, with_views

DAYS = 30


def retention_view(s, d):
    v = L.retention_view(memories(s, d), as_of(), DAYS)
    return v.withColumn("eligible_after", F.unix_micros("eligible_after"))


def purge_plan(s, d):
    return L.purge_plan(memories(s, d), as_of(), DAYS, 50)


def purge_fingerprint(s, d):
    return L.fingerprint(L.purge_plan(memories(s, d), as_of(), DAYS, 50), "days=30,limit=50")


def capacity_archive(s, d):
    return L.capacity_archive(memories(s, d), as_of(), 100, 0.8)


def duplicate_matches(s, d):
    m = memories(s, d).select("id", "content", "content_hash")
    return joins.duplicates(m.where("id % 20 = 0"), m)


def consolidation_plan(s, d):
    m = memories(s, d).select("id", "content", "content_hash")
    return L.consolidation_plan(m.where("id % 20 = 0"), m)


def audit_counts(s, d):
    return L.audit(memories(s, d), as_of(), DAYS)


def observation_counts(s, d):
    c = table(s, d, "conversations").select("conv_id", F.to_json(F.struct(F.struct(F.col("role").alias("source"), F.when(F.col("turn") == 0, "opened").otherwise("continued").alias("event_type")).alias("observation"))).alias("metadata"))
    get = lambda k: F.get_json_object("metadata", f"$.observation.{k}").alias(k)
    return c.groupBy(get("source"), get("event_type")).agg(F.count("*").alias("n"))


def observation_prefix(s, d):
    return table(s, d, "conversations").select("conv_id", "turn", F.md5(life.with_observation_prefix(F.col("text"))).alias("digest"))


def search_truth(s, d):
    """The lexical search's results with what is true of their records."""
    from .retrieval import search_memory

    out = L.enriched(search_memory(s, d), memories(s, d), as_of(), DAYS)
    return out.withColumn("eligible_after", F.unix_micros("eligible_after"))


def _turns(s, d):
    return table(s, d, "conversations").selectExpr("conv_id", "turn as id", "text as content").withColumn("tokens", text.token_estimate(F.col("content")))


def bootstrap_budget(s, d):
    return L.budgeted(_turns(s, d).withColumn("ord", F.col("id")), "conv_id", ["ord"], "tokens", 150, 5)


def bootstrap_context(s, d):
    """Records with every prefix, some with urgent tasks, details and the words of the prompt or of the summary."""
    pre = F.element_at(F.array(*[F.lit(p + ": ") for p in ("TASK", "DECISION", "CONTEXT", "PROJECT", "USER", "RESEARCH", "EPIC", "NOTE")]), (F.col("id") % 8 + 1).cast("int"))
    head = F.when(F.col("id") % 12 == 0, "[ ] current: in_progress ").when(F.col("id") % 16 == 0, "[ ] ").when(F.col("id") % 5 == 0, "verification `x` ").otherwise("")
    m = memories(s, d).withColumn("content", F.concat(pre, head, F.substring("content", 1, 40 + 1)))
    return L.bootstrap(m, as_of(), 600, 4, prompt="research verification of the project", summary="verification of a decision")


def task_priority(s, d):
    c = F.concat(F.when(F.col("id") % 2 == 0, "in_progress ").otherwise(""), F.when(F.col("id") % 3 == 0, "Current: ").when(F.col("id") % 7 == 0, "current ").otherwise(""), F.when(F.col("id") % 5 == 0, "[ ]").otherwise(""))
    return memories(s, d).select("id", text.task_priority(c).alias("priority"), text.token_estimate(F.col("content")).alias("tokens"))


def _learned(s, d):
    lab = table(s, d, "labels").select(F.col("doc_id").alias("id"), "quality", "toxic")
    return memories(s, d).join(lab, "id").selectExpr("id", "namespace", "content", "element_at(array('candidate', 'confirmed', 'rule', 'rejected'), cast(id % 4 + 1 as int)) as status", "(id % 11) / 10D as confidence", "importance_score as importance", "toxic = 0 as valid")


def learning_rank(s, d):
    rows = _learned(s, d)
    ch = rows.select((F.col("id") % 7).alias("q_id"), "id", F.round((F.col("id") % 97) / 97.0, 6).alias("score"))
    return learning.rank(rows, ch, F.col("namespace") == "src1", ["candidate", "confirmed", "rule"], 10)


def learning_moves(s, d):
    want = _learned(s, d).select("id", F.expr("element_at(array('confirmed', 'rule', 'rejected', 'candidate', 'archived'), cast(id % 5 + 1 as int))").alias("status"))
    return learning.move(_learned(s, d).select("id", "status"), want)


def learning_lifecycle(s, d):
    kind, status = (F.element_at(F.array(*[F.lit(x) for x in xs]), (F.col("id") % len(xs) + 1).cast("int")) for xs in (life.LEARNING_KINDS, life.LEARNING_STATUSES))
    state = life.learning_lifecycle(status, F.col("valid_until"), F.col("invalidation_reason"), F.col("superseded_by"))
    return memories(s, d).select("id", state.alias("state"), life.learning_memory_type(kind, status).alias("memory_type"))


def learning_validation(s, d):
    meta = F.expr("""concat('{"schema_version":', id % 3, ',"kind":"', element_at(array('user_preference', 'project_lesson', 'project_pattern', 'project_pitfall', 'workflow_rule', 'decision'), cast(id % 6 + 1 as int)),
     '","status":"', element_at(array('candidate', 'confirmed', 'rule', 'rejected', 'superseded', 'archived', 'expired'), cast(id % 7 + 1 as int)), '","confidence":', (id % 13) / 10D,
     case when id % 4 > 0 then concat(',"scope":{"level":"', element_at(array('project', 'global', 'galaxy'), cast(id % 4 as int)), '"}') else '' end, case when id % 5 > 0 then ',"source":{"created_from":"manual"}' else ',"source":{}' end, '}')""")
    return memories(s, d).select("id", F.array_join(life.learning_errors(meta), ",").alias("errors"))


def _prefixed(s, d):
    pre = F.expr("element_at(array('TASK: ', 'EPIC: ', 'USER \u2014 Preference: ', 'USER: ', 'CONTEXT: ', 'RESEARCH: ', 'DECISION: ', '  CONTEXT: ', ''), cast(id % 9 + 1 as int))")
    return memories(s, d).withColumn("content", F.concat(pre, F.col("content")))


def legacy_classify(s, d):
    c = life.legacy_class(F.col("content"), F.col("metadata"), "project", True)
    return _prefixed(s, d).select("id", c.alias("c")).select("id", "c.*")


def migration_plan(s, d):
    have = memories(s, d).where("id % 5 = 0").selectExpr("case when id % 2 = 0 then id end as source_id", "content_hash", "'project_pattern' as kind", "namespace as scope")
    return learning.migration_plan(_prefixed(s, d), have, scope_level="project", allowed=["USER", "CONTEXT:", "TASK:", "  "])


def import_plan(s, d):
    rows = memories(s, d).where("id % 2 = 0").select("id", "superseded_by", F.md5("content").alias("payload"))
    return store.import_plan(rows, memories(s, d).where("id % 6 = 0").select("id"))


def embedding_route(s, d):
    return memories(s, d).select("id", life.route_embedding(F.lit("memory"), F.col("content")).alias("route"), F.lower(text.content_hash(F.col("content"))).alias("hash"))


def embedding_reuse(s, d):
    m = memories(s, d).select("id", F.sha2("content", 256).alias("content_hash"))
    cache = m.where("id % 3 = 0").select("content_hash").distinct().withColumn("vector", text.hash_embedding(F.col("content_hash"), 8))
    return store.cached_embeddings(m, cache).select("id", F.col("vector").isNotNull().alias("cached"))


_M = with_views("memories")
_A = f"timestamp '{AS_OF}'"
_CLOSED = "case when invalidation_reason = 'superseded' or superseded_by is not null then 'superseded' when invalidation_reason = 'learning_rejected' then 'rejected' when invalidation_reason = 'learning_archived' then 'archived' else 'invalidated' end"


def _learning_state(status: str) -> str:
    return f"""case when valid_until is not null then (case when invalidation_reason = 'learning_rejected' then 'rejected' when invalidation_reason = 'learning_archived' then 'archived' when invalidation_reason = 'superseded' or superseded_by is not null then 'superseded' else 'invalidated' end)
 when {status} in ('confirmed', 'rule') then 'active' when {status} in ('rejected', 'archived', 'superseded') then 'unknown' else 'candidate' end"""


_LEARNED = _learning_state("(metadata->>'$.learning.status')")
_STATE = f"case when json_extract(metadata, '$.learning') is not null then {_LEARNED} when valid_until is not null then {_CLOSED} else 'active' end"
_PIN = r"(regexp_matches(content, '^\s*(DECISION|PROJECT|USER):') or importance_score >= 4.0)"
_RV = f"""v as (select id, namespace, {_STATE} as state, {_PIN} as pinned, valid_until is null as missing_valid_until, valid_until + to_days({DAYS}) as ea from memories), rv as (select *, coalesce(ea <= {_A} and not pinned, false) as eligible from v)"""
_PURGE = "pl as (select id, state, epoch_us(ea) as eligible_us from rv where eligible order by ea, id limit 50)"
_DUP = "n as (select id, content, content_hash from memories where id % 20 = 0), u as (select n.id as new_id, m.id, 'content_hash' as m from n join memories m using (content_hash) union all select n.id, m.id, 'content' from n join memories m using (content)), du as (select new_id, id, array_to_string(list_sort(list(distinct m)), ',') as matched_by from u where new_id <> id group by 1, 2)"
_DECAY = f"greatest(0.05, exp(-ln(2) * (greatest(0.0, (epoch_us({_A}) - epoch_us(coalesce(event_time, ingestion_time))) / 86400000000.0) / (1 + 0.5 * ln(1 + access_count::double))) / case memory_type when 'episodic' then 30.0 when 'procedural' then 365.0 else 180.0 end))"
_LEARN = "le as (select m.id, namespace, (['candidate','confirmed','rule','rejected'])[cast(m.id % 4 + 1 as int)] as status, (m.id % 11) / 10.0::double as confidence, importance_score as importance, toxic = 0 as valid, m.valid_until from memories m join labels on doc_id = m.id)"
_PRE = "(['TASK: ','EPIC: ','USER \u2014 Preference: ','USER: ','CONTEXT: ','RESEARCH: ','DECISION: ','  CONTEXT: ',''])[cast(id % 9 + 1 as int)] || content"


def _starts(x: str) -> str:
    return f"starts_with(c, '{x}')"


def _class_sql(allowed: list[str] | None = None) -> str:
    make = lambda k, s, o, r: f"[{k}, {s}, '{o}', '{r}']"
    none = lambda o, r: make("null", "null", o, r)
    outside = f"when not ({' or '.join(_starts(x) for x in allowed)}) then {none('skipped', 'content prefix is not in prefix_allowlist')}" if allowed else ""
    return f"""pc as (select *, ltrim(c) as b, lower(coalesce(metadata, '')) as meta from (select id, {_PRE} as c, content_hash, namespace, metadata from memories)),
 cl as (select id, content_hash, namespace, case when json_extract(metadata, '$.learning.schema_version') is not null then {none('already_migrated', 'record already has metadata.learning.schema_version')} {outside}
 when starts_with(b, 'USER \u2014 Preference:') then {make("'user_preference'", "'confirmed'", 'eligible', 'USER \u2014 Preference prefix')}
 when starts_with(b, 'USER:') and contains(meta, 'rule') then {make("'workflow_rule'", "'rule'", 'eligible', 'USER metadata rule hint')} when starts_with(b, 'USER:') and contains(meta, 'preference') then {make("'user_preference'", "'confirmed'", 'eligible', 'USER metadata preference hint')}
 when starts_with(b, 'USER:') then {none('ambiguous', 'USER prefix requires preference/rule metadata or caller rule')} when starts_with(b, 'CONTEXT:') then {make("'project_pattern'", "'candidate'", 'eligible', 'CONTEXT project scope')}
 when starts_with(b, 'RESEARCH:') and {'false' if allowed else 'true'} then {make("'project_lesson'", "'candidate'", 'eligible', 'RESEARCH explicit lesson extraction')} when starts_with(b, 'TASK:') or starts_with(b, 'EPIC:') then {none('skipped', 'TASK and EPIC records are excluded by default')}
 else {none('ambiguous', 'no eligible legacy learning prefix matched')} end as x from pc)"""


_ERRORS = """case when id % 3 <> 1 then 'schema_version' end, case when id % 6 = 5 then 'kind' end, case when id % 7 = 6 then 'status' end, case when id % 13 > 10 then 'confidence' end, case when id % 4 not in (1, 2) then 'scope' end, case when id % 5 = 0 then 'source' end"""

def _truth_sql() -> str:
    from .retrieval import search_memory_sql

    return f"""{_M.rstrip()}, {_RV}, r as ({search_memory_sql()}) select r.*, case when valid_until is not null or invalidation_reason is not null then case when superseded_by is not null then 'superseded' else 'invalidated' end when superseded_by is not null then 'replacement_linked' else 'active' end as status,
 valid_until is not null or invalidation_reason is not null as invalidated, superseded_by is not null as has_replacement, case when superseded_by is not null then 1 else 0 end as lineage_depth, superseded_by as terminal_replacement,
 state as lifecycle_state, state = 'active' as visible, pinned, eligible as purge_eligible, epoch_us(ea) as eligible_after from r join memories using (id) join rv using (id)"""


def _bootstrap_sql() -> str:
    """The windows, the candidates of each section, and a fold in order with its budget."""
    pre = "['TASK', 'DECISION', 'CONTEXT', 'PROJECT', 'USER', 'RESEARCH', 'EPIC', 'NOTE'][cast(id % 8 + 1 as int)]"
    ws = lambda c: rf"list_distinct(list_filter(string_split_regex(lower({c}), '[^\p{{L}}\p{{N}}_-]+'), lambda w: length(w) >= 3))"
    like = lambda t: f"case when len(w) = 0 then 0 else len(list_intersect(w, {ws(t)})) / len(list_distinct(list_concat(w, {ws(t)})))::double end"
    marks = " or ".join(f"contains(low, '{m}')" for m in text.DETAIL_MARKS)
    return f"""{with_views('memories').rstrip().replace('with ', 'with recursive ', 1)}, c as (select id, ingestion_time, {pre} as prefix, {pre} || ': ' || case when id % 12 = 0 then '[ ] current: in_progress ' when id % 16 = 0 then '[ ] ' when id % 5 = 0 then 'verification `x` ' else '' end || substr(content, 1, 41) as content from memories where valid_until is null or valid_until > timestamp '{AS_OF}'),
 n as (select *, lower(content) as low, {ws('content')} as w, greatest(1, length(content) // 4) as tokens, row_number() over (order by ingestion_time desc, id) as n from c), v as (select *, case when contains(low, 'in_progress') then 4 else 0 end + case when contains(low, 'current:') then 2 else 0 end + case when contains(low, '[ ]') then 1 else 0 end as p from n where n <= 1000),
 t as (select * from v where prefix = 'TASK' and p > 0), pool as (select *, 0 as late, 0 as urgent from v where n <= 200 union all select *, 1, -p from t where n > 200),
 x as (select 'active_tasks' as section, 0 as late, -p as urgent, n, id, tokens, 300 as b from t union all select lower(prefix), late, urgent, n, id, tokens, 200 from pool where prefix not in ('TASK', 'NOTE')
  union all select 'recovery', late, urgent, n, id, tokens, 200 from pool where ({marks} or {like("'research verification of the project'")} > 0.12) and {like("'verification of a decision'")} < 0.72),
 o as (select *, row_number() over (partition by section order by late, urgent, n, id) as r from x where tokens <= b),
 f as (select section, 0::bigint as r, 0::bigint as used, 0 as k, false as take, -1::bigint as id, 0::bigint as tokens from o group by 1
  union all select f.section, o.r, case when f.k < 4 and f.used + o.tokens <= o.b then f.used + o.tokens else f.used end, case when f.k < 4 and f.used + o.tokens <= o.b then f.k + 1 else f.k end, f.k < 4 and f.used + o.tokens <= o.b, o.id, o.tokens from f join o on o.section = f.section and o.r = f.r + 1)
 select section, id, tokens from f where take"""


CATALOG = {
    "retention_view": (retention_view, f"{_M.rstrip()}, {_RV} select id, namespace, state, state = 'active' as visible, pinned, missing_valid_until, epoch_us(ea) as eligible_after, eligible from rv"),
    "purge_plan": (purge_plan, f"{_M.rstrip()}, {_RV}, {_PURGE} from pl"),
    "purge_fingerprint": (purge_fingerprint, f"{_M.rstrip()}, {_RV}, {_PURGE} select md5('days=30,limit=50|' || array_to_string(list_sort(list(cast(id as varchar))), ',')) as fingerprint, count(*) as n from pl"),
    "capacity_archive": (capacity_archive, f"""{_M.rstrip()}, live as (select id, round(importance_score * {_DECAY} * (1 + least(0.5 * ln(1 + access_count::double), 3.0)), 8) as score, coalesce(event_time, ingestion_time) as a, last_accessed_at as l from memories where valid_until is null or valid_until > {_A}),
 lo as (select * from (select *, row_number() over (order by score, a, id) as r, count(*) over () as n from live) where r <= n - 80) select id, score from lo where l <= {_A} - interval 5 minute"""),
    "duplicate_matches": (duplicate_matches, f"{_M.rstrip()}, {_DUP} select new_id, id, matched_by from du"),
    "consolidation_plan": (consolidation_plan, f"{_M.rstrip()}, {_DUP} select new_id, count(*) as supersedes, md5(array_to_string(list_sort(list(lpad(cast(id as varchar), 20, '0'))), ',')) as fingerprint from du group by 1"),
    "audit_counts": (audit_counts, f"""{_M.rstrip()}, st as (select *, {_STATE} as state from memories) select count(*) as total, count(*) filter (state = 'active') as active, count(*) filter (state = 'candidate') as candidate, count(*) filter (state = 'unknown') as unknown, count(*) filter (state = 'superseded') as superseded, count(*) filter (state = 'archived') as archived, count(*) filter (state = 'rejected') as rejected, count(*) filter (state = 'invalidated') as invalidated,
 count(*) filter (valid_until + to_days({DAYS}) <= {_A}) as purge_ready, count(*) filter (superseded_by is not null and valid_until is null) as replacement_without_invalidation, count(*) filter (length(content) > 8000) as oversized, count(*) filter (content_hash is null) as missing_hash from st"""),
    "observation_counts": (observation_counts, "select role as source, case when turn = 0 then 'opened' else 'continued' end as event_type, count(*) as n from conversations group by 1, 2"),
    "observation_prefix": (observation_prefix, r"select conv_id, turn, md5(case when regexp_matches(text, '^\s*(TASK|DECISION|CONTEXT|PROJECT|USER|EPIC|RESEARCH):') then text else 'CONTEXT: ' || text end) as digest from conversations"),
    "search_truth": (search_truth, _truth_sql()),
    "bootstrap_budget": (bootstrap_budget, """with recursive t as (select conv_id, turn, greatest(1, length(text) // 4) as tokens from conversations), o as (select *, row_number() over (partition by conv_id order by turn) as r from t where tokens <= 150),
 f as (select conv_id, 0::bigint as r, 0::bigint as used, 0 as n, false as take, -1::bigint as turn, 0::bigint as tokens from o group by 1
  union all select f.conv_id, o.r, case when f.n < 5 and f.used + o.tokens <= 150 then f.used + o.tokens else f.used end, case when f.n < 5 and f.used + o.tokens <= 150 then f.n + 1 else f.n end, f.n < 5 and f.used + o.tokens <= 150, o.turn, o.tokens from f join o on o.conv_id = f.conv_id and o.r = f.r + 1)
 select conv_id, turn as id, tokens from f where take"""),
    "bootstrap_context": (bootstrap_context, _bootstrap_sql()),
    "task_priority": (task_priority, f"{_M} select id, case when id % 2 = 0 then 4 else 0 end + case when id % 3 = 0 then 2 else 0 end + case when id % 5 = 0 then 1 else 0 end as priority, greatest(1, length(content) // 4) as tokens from memories"),
    "learning_rank": (learning_rank, f"""{_M.rstrip()}, {_LEARN}, sc as (select id % 7 as q_id, id, status, round(round((id % 97) / 97.0::double, 6) * case status when 'rule' then 1.3 when 'confirmed' then 1.1 when 'candidate' then 0.9 else 0.5 end::double * case when namespace = 'src1' then 1.2 else 1.0 end::double * greatest(0.5, least(2.0, 0.5 + confidence)) * greatest(0.5, least(2.0, 0.5 + 1.5 * importance / 5.0)), 6) as score from le where valid and status in ('candidate','confirmed','rule'))
 select * from (select *, row_number() over (partition by q_id order by score desc, id) as rank from sc) where rank <= 10"""),
    "learning_moves": (learning_moves, f"""{_M.rstrip()}, {_LEARN}, w as (select id, status, (['confirmed','rule','rejected','candidate','archived'])[cast(id % 5 + 1 as int)] as nw from le), ok as (select *, (status || '>' || nw) in ('candidate>confirmed','candidate>rule','confirmed>rule','candidate>rejected','confirmed>rejected','candidate>archived','confirmed>archived','rule>archived') as accepted from w)
 select id, case when accepted then nw else status end as status, accepted from ok"""),
    "learning_lifecycle": (learning_lifecycle, f"""{_M.rstrip()}, k as (select *, (['user_preference','project_lesson','project_pattern','project_pitfall','workflow_rule'])[cast(id % 5 + 1 as int)] as kind, (['candidate','confirmed','rule','rejected','superseded','archived'])[cast(id % 6 + 1 as int)] as status from memories)
 select id, {_learning_state('status')} as state, case when kind = 'workflow_rule' or status = 'rule' then 'procedural' when kind = 'project_lesson' then 'episodic' else 'semantic' end as memory_type from k"""),
    "learning_validation": (learning_validation, f"{_M} select id, array_to_string(list_filter([{_ERRORS}], lambda x: x is not null), ',') as errors from memories"),
    "legacy_classify": (legacy_classify, f"{_M.rstrip()}, {_class_sql()} select id, x[1] as kind, x[2] as status, x[3] as outcome, x[4] as reason from cl"),
    "migration_plan": (migration_plan, f"""{_M.rstrip()}, {_class_sql(['USER', 'CONTEXT:', 'TASK:', '  '])}, ex as (select case when id % 2 = 0 then id end as sid, content_hash as h, namespace as sc from memories where id % 5 = 0), i1 as (select distinct sid from ex where sid is not null), i2 as (select distinct h, sc from ex where h is not null),
 j as (select cl.*, case when x[3] <> 'eligible' then null when i1.sid is not null then 'primary' when i2.h is not null then 'fallback' end as already from cl left join i1 on i1.sid = id left join i2 on i2.h = content_hash and sc = namespace and x[1] = 'project_pattern')
 select id, x[1] as kind, x[2] as status, case when already is not null then 'already_migrated' else x[3] end as outcome, x[4] as reason, already from j"""),
    "import_plan": (import_plan, f"""{_M.rstrip()}, p as (select id, superseded_by, case when id % 6 = 0 then 'remap' else 'insert' end as action, case when id % 6 = 0 then id || '-import-' || left(md5(md5(content)), 16) else cast(id as varchar) end as new_id from memories where id % 2 = 0)
 select p.id, p.new_id, p.action, coalesce(q.new_id, cast(p.superseded_by as varchar)) as new_superseded_by from p left join p q on q.id = p.superseded_by"""),
    "embedding_route": (embedding_route, f"{_M} select id, case when length(content) < 4096 then 'sync' else 'queue' end as route, sha256(content) as hash from memories"),
    "embedding_reuse": (embedding_reuse, f"{_M} select id, sha256(content) in (select sha256(content) from memories where id % 3 = 0) as cached from memories"),
}
