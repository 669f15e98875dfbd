"""Interval and priority joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def overlap_score(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """1 for overlapping intervals, else 0.65 or 0.35 where b starts or ends near a's start, else 0."""
    near = F.least(F.abs(b_start - a_start), F.abs(b_end - a_start))
    return F.when((b_start <= a_end) & (a_start <= b_end), 1.0).when(near <= 6, 0.65).when(near <= 16, 0.35).otherwise(0.0)


def range_overlap(a: DataFrame, b: DataFrame, key: str, bucket: int = 64) -> DataFrame:
    """Pairs (a_id, b_id, overlap) of intervals of the same key with a score above 0.

    Intervals are dealt to buckets of their positions (widened by the reach of a near miss), so a key of any number of
    intervals is joined by pieces; a pair counts in the first bucket that both have."""
    def dealt(df, p, reach):
        span = F.sequence(F.floor((F.col("start") - reach) / bucket).cast("long"), F.floor((F.col("end") + reach) / bucket).cast("long"))
        return df.select(F.col(key).alias(f"{p}_key"), F.col("id").alias(f"{p}_id"), F.col("start").alias(f"{p}_start"), F.col("end").alias(f"{p}_end"), F.floor((F.col("start") - reach) / bucket).cast("long").alias(f"{p}_lo"), F.explode(span).alias(f"{p}_b"))

    left, right = dealt(a, "a", 16), dealt(b, "b", 0)
    both = left.join(right, (F.col("a_key") == F.col("b_key")) & (F.col("a_b") == F.col("b_b"))).where(F.col("a_b") == F.greatest("a_lo", "b_lo"))
    scored = both.withColumn("overlap", overlap_score(F.col("a_start"), F.col("a_end"), F.col("b_start"), F.col("b_end")))
    return scored.where("overlap > 0").select(F.col("a_key").alias(key), "a_id", "b_id", "overlap")


def best_per_chunk(pairs: DataFrame, scores: DataFrame, limit: int) -> DataFrame:
    """(b_id, score): the best score of the symbols (a_id, score) that overlap each chunk."""
    got = pairs.where("overlap = 1").join(scores, "a_id").groupBy("b_id").agg(F.max("score").alias("score"))
    return got.orderBy(F.desc("score"), "b_id").limit(limit)


def tightest_parent(items: DataFrame, key: str, spans: int = 1 << 16) -> DataFrame:
    """(key, child, parent): the last interval before each that reaches its end; none if both bounds are equal.

    Order: start ascending, end descending, id. The intervals of a key are dealt to stretches of ``spans`` positions by
    their start; one that reaches into a later stretch is sent there too, so a long key is folded in pieces. Each piece
    is sorted and folded with a stack of open intervals: closed ones leave it, so a piece costs its length."""
    kind = items.schema[key].dataType.simpleString(), items.schema["id"].dataType.simpleString()
    at = lambda c: F.floor(F.col(c) / spans).cast("long")
    rows = items.select(F.col(key).alias("k"), "id", "start", "end", F.explode(F.sequence(at("start"), F.greatest(at("start"), at("end")))).alias("piece"))
    rows = rows.withColumn("own", F.col("piece") == at("start"))

    def fold(t):
        import bisect

        import pyarrow as pa

        ks, ids, a, z, own = (t.column(c).to_pylist() for c in ("k", "id", "start", "end", "own"))
        out: list[tuple] = []
        # open intervals in order of coming, their ends falling strictly: an interval hides earlier ones that end no later
        ends, last = [], []
        for i in sorted(range(len(ids)), key=lambda i: (a[i], -z[i], ids[i])):
            # the last one that reaches this end
            n = bisect.bisect_right(ends, -z[i])
            if n and own[i] and (a[last[n - 1]], z[last[n - 1]]) != (a[i], z[i]):
                out.append((ks[i], ids[i], ids[last[n - 1]]))
            n = bisect.bisect_left(ends, -z[i])
            del ends[n:], last[n:]
            ends.append(-z[i])
            last.append(i)
        return pa.table({key: [o[0] for o in out], "child": [o[1] for o in out], "parent": [o[2] for o in out]}, schema=schema)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    text = f"{key} {kind[0]}, child {kind[1]}, parent {kind[1]}"
    schema = to_arrow_schema(_parse_datatype_string(text))
    return rows.groupBy("k", "piece").applyInArrow(fold, text)


def resolve_names(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """(ref_id, symbol_id, score): the symbol of the referenced name, same file before same directory before any.

    ``refs``: (ref_id, name, file_path); ``symbols``: (id, name, file_path). Symbols are first reduced to the smallest id
    of each (name, file), (name, directory) and name, so a name of any number of namesakes meets each reference thrice."""
    folder = lambda c: F.regexp_replace(c, "/[^/]*$", "")
    s = symbols.select("id", "name", F.col("file_path").alias("f"), folder(F.col("file_path")).alias("d"))
    best = lambda *by, **to: s.groupBy(*by).agg(F.min("id").alias(next(iter(to.values()))))
    r = refs.select("ref_id", "name", F.col("file_path").alias("f"), folder(F.col("file_path")).alias("d"))
    out = r.join(best("name", "f", to="i1"), ["name", "f"], "left").join(best("name", "d", to="i2"), ["name", "d"], "left").join(best("name", to="i3"), "name")
    score = F.when(F.col("i1").isNotNull(), 100).when(F.col("i2").isNotNull(), 50).otherwise(0)
    return out.select("ref_id", F.coalesce("i1", "i2", "i3").alias("symbol_id"), score.alias("score"))


def resolve_relations(refs: DataFrame, fresh: DataFrame, known: DataFrame) -> DataFrame:
    """Every reference with its symbol from this run, else from the store, else unresolved; with class and provenance."""
    first = resolve_names(refs, fresh).select("ref_id", F.col("symbol_id").alias("s1"), F.col("score").alias("p1"))
    second = resolve_names(refs, known).select("ref_id", F.col("symbol_id").alias("s2"), F.col("score").alias("p2"))
    both = refs.join(first, "ref_id", "left").join(second, "ref_id", "left")
    score = F.coalesce("p1", "p2")
    return both.select(
        "ref_id", F.coalesce("s1", "s2").alias("symbol_id"),
        F.when(score.isNull(), "unresolved").when(F.col("s1").isNotNull() & (score == 100), "observed").otherwise("inferred").alias("relation_class"),
        F.when(score.isNull(), "none").when(F.col("s1").isNotNull(), "parser").otherwise("heuristic").alias("provenance"),
        F.when(score.isNull(), "none").when(score == 100, "exact").when(score == 50, "likely").otherwise("ambiguous").alias("confidence_class"),
    )


def duplicates(new: DataFrame, existing: DataFrame) -> DataFrame:
    """(new_id, id, matched_by): records of equal hash or equal content, a row a match; ``lifecycle.consolidation_plan``
    has their numbers and digests without the pairs."""
    n = new.select(F.col("id").alias("new_id"), F.col("content").alias("_c"), F.col("content_hash").alias("_h"))
    by_hash = n.join(existing, F.col("_h") == F.col("content_hash")).select("new_id", "id", F.lit("content_hash").alias("m"))
    by_text = n.join(existing, F.col("_c") == F.col("content")).select("new_id", "id", F.lit("content").alias("m"))
    return by_hash.union(by_text).where("new_id <> id").groupBy("new_id", "id").agg(F.array_join(F.array_sort(F.collect_set("m")), ",").alias("matched_by"))


def freshness(paths: DataFrame, serving: DataFrame, indexing: DataFrame | None, changed: DataFrame | None = None) -> DataFrame:
    """(path, freshness): checkpoints of the serving generation against those being indexed.

    ``serving``: (path, content_hash); ``indexing``: (path, content_hash, completed), none where nothing else is indexed;
    ``changed``: paths known to have changed since. A pending checkpoint makes a path partial, whatever its hash."""
    s = serving.select("path", F.col("content_hash").alias("sh"), F.lit(True).alias("served"))
    out = paths.join(s, "path", "left")
    out = out.join(indexing.select("path", F.col("content_hash").alias("ih"), F.col("completed").alias("ic")), "path", "left") if indexing is not None else out.withColumns({"ih": F.lit(None).cast("string"), "ic": F.lit(None).cast("boolean")})
    out = out.join(changed.select("path").distinct().withColumn("moved", F.lit(True)), "path", "left") if changed is not None else out.withColumn("moved", F.lit(None).cast("boolean"))
    same = (F.col("sh") != "") & (F.col("sh") == F.col("ih"))
    state = (
        F.when(F.col("served").isNull() & F.col("moved"), "stale").when(F.col("served").isNull(), "unavailable").when(~F.col("ic"), "partial")
        .when(F.col("ic") & F.coalesce(same, F.lit(False)), "fresh").when(F.col("ic"), "stale").when(F.col("moved"), "stale").otherwise("fresh")
    )
    return out.select("path", state.alias("freshness"))
