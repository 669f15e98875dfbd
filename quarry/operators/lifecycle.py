"""Retention, purge, capacity, consolidation, audit and context selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import lifecycle as life, scoring, text
from ..functions.predicates import protected
from ..workspace import stored
from .retrieve import bounded
from .store import first_rows


def _state(mem: DataFrame) -> Column:
    learning = F.get_json_object("metadata", "$.learning") if "metadata" in mem.columns else None
    return life.lifecycle_state(F.col("valid_until"), F.col("invalidation_reason"), F.col("superseded_by"), learning)


def retention_view(mem: DataFrame, as_of: Column, days: int) -> DataFrame:
    state = _state(mem)
    pinned = protected(F.col("content"), F.col("importance_score"))
    after = life.eligible_after(F.col("valid_until"), days)
    return mem.select(
        "id", "namespace", state.alias("state"), (state == "active").alias("visible"), pinned.alias("pinned"), F.col("valid_until").isNull().alias("missing_valid_until"),
        after.alias("eligible_after"), (F.col("valid_until").isNotNull() & (after <= as_of) & ~pinned).alias("eligible"),
    )


def fingerprint(ids: DataFrame, params: str) -> DataFrame:
    """One row: a digest of the parameters and the ordered ids of a plan (a plan is bounded by its limit)."""
    return ids.agg(F.md5(F.concat(F.lit(params), F.lit("|"), F.array_join(F.array_sort(F.collect_list(F.col("id").cast("string"))), ","))).alias("fingerprint"), F.count("*").alias("n"))


def purge_plan(mem: DataFrame, as_of: Column, days: int, limit: int) -> DataFrame:
    """The ``limit`` rows invalidated longest ago that may be purged."""
    view = retention_view(mem, as_of, days).where("eligible")
    return view.orderBy("eligible_after", "id").limit(limit).select("id", "state", F.unix_micros("eligible_after").alias("eligible_us"))


def capacity_archive(mem: DataFrame, as_of: Column, soft_limit: int, ratio: float, recent_minutes: int = 5) -> DataFrame:
    """Rows to archive when there are more than ``soft_limit``: the lowest scored; those read just now are skipped and not replaced."""
    live = mem.where(F.col("valid_until").isNull() | (F.col("valid_until") > as_of))
    n = live.count()
    if n <= soft_limit:
        return live.limit(0).select("id", F.lit(0.0).alias("score"))
    take = n - int(soft_limit * ratio)
    anchor = F.coalesce("event_time", "ingestion_time")
    score = F.round(F.col("importance_score") * scoring.decay(scoring.age_days(anchor, as_of), F.col("access_count"), F.col("memory_type")) * (1 + scoring.reinforcement(F.col("access_count"))), 8)
    low = first_rows(live.select("id", score.alias("score"), anchor.alias("anchor"), "last_accessed_at"), ["score", "anchor", "id"], take)
    grace = F.unix_micros("last_accessed_at") > F.unix_micros(as_of) - recent_minutes * 60_000_000
    return low.where(~F.coalesce(grace, F.lit(False))).select("id", "score")


#: Lists of ids of more bytes are not broadcast.
LIST_BYTES = 64_000_000


def consolidation_plan(new: DataFrame, existing: DataFrame) -> DataFrame:
    """(new_id, supersedes, fingerprint): how many records of equal hash or equal content each new one replaces, and the
    MD5 of their sorted ids (20 characters each, with zeros before them), which a later apply must match; new records that
    replace nothing are left out. Ids are numbers, those of new records unique.

    The ids that equal a hash and a text are listed once for all new records that have both, as one text; a new record
    takes itself out of it. No pair of records is ever made, however many are equal; the digest of a new record reads its
    whole list."""
    padded = lambda c: F.lpad(F.col(c).cast("string"), 20, "0")
    rows = existing.select(F.col("id"), F.col("content_hash").alias("eh"), F.sha2("content", 256).alias("et"))
    mine = new.select(F.col("id").alias("new_id"), F.col("content_hash").alias("h"), F.sha2("content", 256).alias("t"))
    kinds = bounded(stored(mine.select("h", "t").distinct(), "consolidation-kinds"))
    equal = rows.join(kinds, F.col("eh") == F.col("h")).select("h", "t", "id").unionByName(rows.join(kinds, F.col("et") == F.col("t")).select("h", "t", "id"))
    listed = equal.distinct().select("h", "t", padded("id").alias("p")).groupBy("h", "t").agg(F.count("*").alias("n"), F.expr("listagg(p, ',') within group (order by p)").alias("ids"))
    lists = stored(listed.withColumnsRenamed({"h": "lh", "t": "lt"}), "consolidation-lists")
    few = (lists.agg(F.sum(F.octet_length("ids"))).first()[0] or 0) <= LIST_BYTES
    at = mine.join(bounded(lists) if few else lists, F.col("h").eqNullSafe(F.col("lh")) & F.col("t").eqNullSafe(F.col("lt")))
    # a record that is stored already does not replace itself
    at = at.where((F.col("n") > 1) | (F.col("ids") != padded("new_id")))
    whole, own = F.concat("ids", F.lit(",")), F.concat(padded("new_id"), F.lit(","))
    rest = at.select("new_id", "n", F.octet_length("ids").alias("size"), F.replace(whole, own, F.lit("")).alias("rest"))
    return rest.select("new_id", F.when(F.octet_length("rest") <= F.col("size"), F.col("n") - 1).otherwise(F.col("n")).alias("supersedes"), F.md5(F.rtrim("rest", F.lit(","))).alias("fingerprint"))


def audit(mem: DataFrame, as_of: Column, days: int) -> DataFrame:
    """One row of counts: states, purge readiness, operator flags."""
    state = _state(mem)
    after = life.eligible_after(F.col("valid_until"), days)
    m = mem.withColumn("state", state)
    names = ("active", "candidate", "superseded", "archived", "rejected", "invalidated", "unknown")
    return m.agg(
        F.count("*").alias("total"), *[F.count_if(F.col("state") == s).alias(s) for s in names], F.count_if(after <= as_of).alias("purge_ready"),
        F.count_if(F.col("superseded_by").isNotNull() & F.col("valid_until").isNull()).alias("replacement_without_invalidation"),
        F.count_if(F.char_length("content") > 8000).alias("oversized"), F.count_if(F.col("content_hash").isNull()).alias("missing_hash"),
    )


def status(mem: DataFrame, as_of: Column, days: int) -> DataFrame:
    """(reason, count, total, valid, invalidated, purge_eligible): a row for each reason of a closed record, or one."""
    view = retention_view(mem, as_of, days).where("eligible").agg(F.count("*").alias("purge_eligible"))
    live = F.col("valid_until").isNull() | (F.col("valid_until") > as_of)
    totals = mem.agg(F.count("*").alias("total"), F.count_if(live).alias("valid"), F.count_if(F.col("valid_until").isNotNull()).alias("invalidated"))
    reasons = mem.where("valid_until is not null").groupBy(F.col("invalidation_reason").alias("reason")).agg(F.count("*").alias("count"))
    # totals are one row each
    return totals.crossJoin(F.broadcast(view)).join(reasons, F.lit(True), "left").select("reason", "count", "total", "valid", "invalidated", "purge_eligible")


def readiness(statuses: DataFrame) -> DataFrame:
    """(known_projects, ready_projects) of (project_id, status)."""
    return statuses.agg(F.count("*").alias("known_projects"), F.count_if(F.col("status") == "completed").alias("ready_projects"))


#: A group of more rows than these is not gathered into one list.
LIST_ROWS = 10_000


def budgeted(rows: DataFrame, group: str, order: list[str], tokens: str, budget: int, limit: int, key: str = "id") -> DataFrame:
    """(group, id, tokens): in order, rows that still fit the budget; one that doesn't is skipped; at most ``limit``.

    A group of up to ``LIST_ROWS`` rows is folded as a list. Of a larger one each pick is the first row behind the last
    pick that fits what is left: a minimum that is pre-aggregated, at most ``limit`` of them, whatever the group's size."""
    place = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.col(key).alias("id"))
    fit = rows.where(F.col(tokens) <= budget).select(F.col(group).alias("g"), place.alias("at"), F.col(tokens).cast("long").alias("t"))
    fit = stored(fit, "budget-rows")
    big = stored(fit.groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") > LIST_ROWS).select(F.col("g").alias("of")), "budget-big")
    some = big.limit(1).count() > 0
    small = fit.join(bounded(big), F.col("g").eqNullSafe(F.col("of")), "left_anti") if some else fit
    lists = small.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("at", "t"))).alias("xs"))
    kind = lists.schema["xs"].dataType.elementType.simpleString()
    zero = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast(f"array<{kind}>").alias("picked"))

    def add(s, x):
        take = (F.size(s["picked"]) < limit) & (s["used"] + x["t"] <= budget)
        return F.when(take, F.struct((s["used"] + x["t"]).alias("used"), F.concat(s["picked"], F.array(x)).alias("picked"))).otherwise(s)

    out = lists.select("g", F.explode(F.aggregate("xs", zero, add, lambda s: s["picked"])).alias("p")).select("g", "p.at", "p.t")
    if some:
        state = big.select("of", F.lit(budget).cast("long").alias("left"), F.lit(None).cast(fit.schema["at"].dataType).alias("last"))
        for _ in range(limit):
            open_ = fit.join(bounded(state), F.col("g").eqNullSafe(F.col("of"))).where((F.col("t") <= F.col("left")) & (F.col("last").isNull() | (F.col("at") > F.col("last"))))
            pick = stored(open_.groupBy("g", "left").agg(F.min(F.struct("at", "t")).alias("p")), "budget-picks")
            if not pick.limit(1).count():
                break
            out = out.unionByName(pick.select("g", "p.at", "p.t"))
            state = pick.select(F.col("g").alias("of"), (F.col("left") - F.col("p.t")).alias("left"), F.col("p.at").alias("last"))
    return out.select(F.col("g").alias(group), F.col("at.id").alias(key), F.col("t").alias("tokens"))


# Newest records that a session starts from and that are searched for active tasks, the most results and the
# tokens of a group at least; likeness of a detail to the prompt, and to a summary that already tells it.
RECENT, TASK_SCAN, MOST_RESULTS, LEAST_TOKENS, GROUP_TOKENS, PROMPT_LIKE, SUMMARY_LIKE = 200, 1000, 25, 256, 128, 0.12, 0.72


def bootstrap(mem: DataFrame, as_of: Column, budget: int = 4000, limit: int = 10, prompt: str | None = None, summary: str | None = None) -> DataFrame:
    """(section, id, tokens): context for a session from the newest valid records: active tasks (half the budget), each
    stable prefix group (a third each), and operational details (a third) that ``summary`` doesn't tell already.

    Active tasks come from the newest ``TASK_SCAN`` records, most urgent first; all else from the newest ``RECENT`` ones
    and these tasks. Both windows are constants, so what is selected from is small whatever the corpus."""
    limit, budget = max(1, min(MOST_RESULTS, limit)), max(LEAST_TOKENS, min(20_000, budget))
    live = mem.where(F.col("valid_until").isNull() | (F.col("valid_until") > as_of))
    recent = max(RECENT, limit * 8)
    newest = live.select("id", "content", "ingestion_time").orderBy(F.desc("ingestion_time"), "id").limit(max(TASK_SCAN, recent))
    newest = newest.withColumn("n", F.row_number().over(Window.orderBy(F.desc("ingestion_time"), "id")))  # a bounded number of rows
    rows = stored(newest.select("id", "content", "n", text.prefix_of(F.col("content")).alias("prefix"), text.token_estimate(F.col("content")).alias("tokens")), "bootstrap-window")
    active = (F.col("prefix") == "TASK") & text.active_task(F.col("content"))
    urgency = -text.task_priority(F.col("content"))
    # the newest ones first, then tasks that only the wider window holds, by urgency
    pool = rows.where((F.col("n") <= recent) | active).withColumns({"late": F.when(F.col("n") <= recent, 0).otherwise(1), "urgent": F.when(F.col("n") <= recent, 0).otherwise(urgency)})
    tasks = rows.where(active).select(F.lit("active_tasks").alias("section"), F.lit(0).alias("late"), urgency.alias("urgent"), "n", "id", "tokens")
    stable = pool.where("prefix not in ('', 'TASK')").select(F.lower("prefix").alias("section"), "late", "urgent", "n", "id", "tokens")
    like = lambda t: text.likeness(F.col("content"), F.lit(t))
    detail = text.operational(F.col("content")) if prompt is None else text.operational(F.col("content")) | (like(prompt) > PROMPT_LIKE)
    told = F.lit(False) if summary is None else like(summary) >= SUMMARY_LIKE
    recovery = pool.where(detail & ~told).select(F.lit("recovery").alias("section"), "late", "urgent", "n", "id", "tokens")
    pick = lambda df, b: budgeted(df, "section", ["late", "urgent", "n"], "tokens", b, limit)
    return pick(tasks, budget // 2).unionByName(pick(stable, max(GROUP_TOKENS, budget // 3))).unionByName(pick(recovery, budget // 3))


def truth(mem: DataFrame, as_of: Column, days: int) -> DataFrame:
    """(id, status, invalidated, has_replacement, lifecycle_state, visible, pinned, purge_eligible, eligible_after,
    lineage_depth, terminal_replacement): what a search tells about a record beside its score, from the record alone."""
    view = retention_view(mem, as_of, days).select("id", F.col("state").alias("lifecycle_state"), "visible", "pinned", F.col("eligible").alias("purge_eligible"), "eligible_after")
    gone, linked = F.col("valid_until").isNotNull() | F.col("invalidation_reason").isNotNull(), F.col("superseded_by").isNotNull()
    status = F.when(gone & linked, "superseded").when(gone, "invalidated").when(linked, "replacement_linked").otherwise("active")
    own = mem.select("id", status.alias("status"), gone.alias("invalidated"), linked.alias("has_replacement"), F.when(linked, 1).otherwise(0).alias("lineage_depth"), F.col("superseded_by").alias("terminal_replacement"))
    return own.join(view, "id")


def enriched(results: DataFrame, mem: DataFrame, as_of: Column, days: int) -> DataFrame:
    """Search results (id, ...) with the truth of their records; the records are cut to the results first."""
    return results.join(truth(mem.join(results.select("id").distinct(), "id", "left_semi"), as_of, days), "id")
