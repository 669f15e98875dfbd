"""Lifecycle decisions as CASE expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


# Reasons that name how a record was closed.
SUPERSEDED, REJECTED, ARCHIVED = "superseded", "learning_rejected", "learning_archived"
LEARNING_KINDS = ("user_preference", "project_lesson", "project_pattern", "project_pitfall", "workflow_rule")
LEARNING_STATUSES = ("candidate", "confirmed", "rule", "rejected", "superseded", "archived")
SCOPE_LEVELS = ("global", "project", "workspace", "mode", "agent", "session")
CREATED_FROM = ("manual", "plugin", "migration", "promotion", "supersede", "consolidation")


def lifecycle_state(valid_until: Column, reason: Column, superseded_by: Column, learning: Column | None = None) -> Column:
    """A record with an end is closed, whenever that is: its reason says how. ``learning``: the JSON object of a typed
    learning, whose own rule then holds."""
    closed = (
        F.when((reason == SUPERSEDED) | superseded_by.isNotNull(), "superseded").when(reason == REJECTED, "rejected").when(reason == ARCHIVED, "archived").otherwise("invalidated")
    )
    plain = F.when(valid_until.isNotNull(), closed).otherwise("active")
    if learning is None:
        return plain
    return F.when(learning.isNotNull(), learning_lifecycle(F.get_json_object(learning, "$.status"), valid_until, reason, superseded_by)).otherwise(plain)


def eligible_after(valid_until: Column, days: int) -> Column:
    return valid_until + F.make_dt_interval(F.lit(days))


def learning_lifecycle(status: Column, valid_until: Column, reason: Column, superseded_by: Column) -> Column:
    """Of a closed record the reason decides, of an open one the status; an open one of an ended status is unknown."""
    closed = F.when(reason == REJECTED, "rejected").when(reason == ARCHIVED, "archived").when((reason == SUPERSEDED) | superseded_by.isNotNull(), "superseded").otherwise("invalidated")
    still = F.when(status.isin("confirmed", "rule"), "active").when(status.isin("rejected", "archived", "superseded"), "unknown").otherwise("candidate")
    return F.when(valid_until.isNotNull(), closed).otherwise(still)


def learning_memory_type(kind: Column, status: Column) -> Column:
    return F.when((kind == "workflow_rule") | (status == "rule"), "procedural").when(kind == "project_lesson", "episodic").otherwise("semantic")


# Legal moves of a learning's status, and of an index job.
LEARNING_MOVES = (("candidate", "confirmed"), ("candidate", "rule"), ("confirmed", "rule"), ("candidate", "rejected"), ("confirmed", "rejected"), ("candidate", "archived"), ("confirmed", "archived"), ("rule", "archived"), ("candidate", "superseded"), ("confirmed", "superseded"), ("rule", "superseded"))
JOB_MOVES = (
    ("queued", "running"), ("running", "interrupted"), ("running", "completed"), ("running", "failed"), ("running", "cancel_requested"), ("interrupted", "resumable"), ("resumable", "running"),
    ("cancel_requested", "cancelled"), ("cancelled", "abandoned"),
)


def legal_move(old: Column, new: Column, moves=LEARNING_MOVES) -> Column:
    return F.concat_ws(">", old, new).isin(*[f"{a}>{b}" for a, b in moves])


def legacy_class(content: Column, metadata: Column, scope_level: str = "global", extract_research: bool = False, allowed: list[str] | None = None) -> Column:
    """struct(kind, status, outcome, reason) of a record written before learnings were typed, by its prefix and, for
    USER records, by its JSON metadata."""
    make = lambda k, s, o, r: F.struct(F.lit(k).cast("string").alias("kind"), F.lit(s).cast("string").alias("status"), F.lit(o).alias("outcome"), F.lit(r).alias("reason"))
    body = F.regexp_replace(content, r"^\s+", "")
    p = body.startswith
    hints = F.translate(F.coalesce(metadata, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rule, preference = F.contains(hints, F.lit("rule")), F.contains(hints, F.lit("preference"))  # the other hints hold "rule"
    typed = F.coalesce(F.get_json_object(metadata, "$.learning.schema_version").rlike("^[0-9]+$"), F.lit(False))
    out = F.when(typed, make(None, None, "already_migrated", "record already has metadata.learning.schema_version"))
    if allowed is not None:
        out = out.when(~_any([content.startswith(a) for a in allowed] or [F.lit(False)]), make(None, None, "skipped", "content prefix is not in prefix_allowlist"))
    if scope_level not in SCOPE_LEVELS:
        return out.otherwise(make(None, None, "skipped", "invalid target scope"))
    return (
        out.when(p("USER \u2014 Preference:"), make("user_preference", "confirmed", "eligible", "USER \u2014 Preference prefix"))
        .when(p("USER:") & rule, make("workflow_rule", "rule", "eligible", "USER metadata rule hint"))
        .when(p("USER:") & preference, make("user_preference", "confirmed", "eligible", "USER metadata preference hint"))
        .when(p("USER:"), make(None, None, "ambiguous", "USER prefix requires preference/rule metadata or caller rule"))
        .when(p("CONTEXT:") & F.lit(scope_level == "project"), make("project_pattern", "candidate", "eligible", "CONTEXT project scope"))
        .when(p("RESEARCH:") & F.lit(extract_research), make("project_lesson", "candidate", "eligible", "RESEARCH explicit lesson extraction"))
        .when(p("TASK:") | p("EPIC:"), make(None, None, "skipped", "TASK and EPIC records are excluded by default"))
        .otherwise(make(None, None, "ambiguous", "no eligible legacy learning prefix matched"))
    )


def _any(cs: list[Column]) -> Column:
    out = cs[0]
    for c in cs[1:]:
        out = out | c
    return out


def route_embedding(kind: Column, content: Column) -> Column:
    """Short memories and entities are embedded at once, all else is queued."""
    return F.when(kind.isin("memory", "entity") & (F.char_length(content) < 4096), "sync").otherwise("queue")


def with_observation_prefix(content: Column) -> Column:
    """The trimmed content, as context unless it has a record prefix; null if it is blank."""
    from .text import PREFIXES

    body = F.regexp_replace(content, r"^\s+|\s+$", "")
    return F.when(body == "", F.lit(None).cast("string")).when(body.rlike(rf"^({'|'.join(PREFIXES)}):"), body).otherwise(F.concat(F.lit("CONTEXT: "), body))


def _object(metadata: Column) -> Column:
    """A JSON object as map<string, variant>; any other value under ``source_metadata``; null as an empty map."""
    plain = F.from_json(metadata, "map<string, variant>")
    other = F.map_from_arrays(F.array(F.lit("source_metadata")), F.array(F.try_parse_json(metadata)))
    return F.when(metadata.isNull(), F.from_json(F.lit("{}"), "map<string, variant>")).when(F.schema_of_variant(F.try_parse_json(metadata)).startswith("OBJECT"), plain).otherwise(other)


def _with(entries: Column, name: str, value: Column) -> Column:
    kept = F.map_filter(entries, lambda k, v: k != name)
    return F.map_concat(kept, F.map_from_arrays(F.array(F.lit(name)), F.array(F.parse_json(F.to_json(value)))))


def observation_metadata(metadata: Column, source: Column, event_type: Column, confidence: Column, redaction: Column) -> Column:
    """The JSON metadata of an observation; confidence is kept within 0 and 1, a blank redaction state is unknown."""
    state = F.coalesce(F.nullif(F.trim(redaction), F.lit("")), F.lit("unknown"))
    seen = F.struct(
        F.lit(1).alias("schema_version"), F.trim(source).alias("source"), F.trim(event_type).alias("event_type"), F.when(confidence.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence))).alias("confidence"),
        state.alias("redaction_state"), F.lit("memory_observation_create").alias("created_from"),
    )
    return F.to_json(_with(_object(metadata), "observation", seen))


def import_metadata(metadata: Column, source_id: Column, imported_id: Column, target: str, origin: Column, strategy: str, at: Column) -> Column:
    """The JSON metadata of an imported record: what an earlier import left is moved to ``source_migration``."""
    m = _object(metadata)
    old, older = F.try_element_at(m, F.lit("migration")), F.try_element_at(m, F.lit("source_migration"))
    rest = F.map_filter(m, lambda k, v: ~k.isin("migration", "source_migration") | ((k == "source_migration") & old.isNull()))
    both = F.parse_json(F.to_json(F.struct(old.alias("migration"), older.alias("source_migration"))))
    moved = F.when(older.isNotNull(), both).otherwise(old)
    held = F.when(old.isNull(), rest).otherwise(F.map_concat(rest, F.map_from_arrays(F.array(F.lit("source_migration")), F.array(moved))))
    now = F.struct(F.lit(1).alias("schema_version"), source_id.alias("source_id"), imported_id.alias("imported_id"), F.lit(target).alias("target_project_id"), origin.alias("source_project_id"), at.alias("imported_at"), F.lit(strategy).alias("conflict_strategy"))
    return F.to_json(_with(held, "migration", now))


def learning_errors(metadata: Column) -> Column:
    """Fields of a learning's JSON that are missing or unsound, in a fixed order; empty if it is sound."""
    at = lambda path: F.get_json_object(metadata, f"$.{path}")
    among = lambda path, values: F.coalesce(at(path).isin(*values), F.lit(False))
    tests = (
        (F.coalesce(at("schema_version") == "1", F.lit(False)), "schema_version"), (among("kind", LEARNING_KINDS), "kind"), (among("status", LEARNING_STATUSES), "status"),
        (F.coalesce(at("confidence").try_cast("double").between(0.0, 1.0), F.lit(False)), "confidence"), (among("scope.level", SCOPE_LEVELS), "scope"), (among("source.created_from", CREATED_FROM), "source"),
    )
    return F.filter(F.array(*[F.when(~c, F.lit(n)) for c, n in tests]), lambda x: x.isNotNull())
