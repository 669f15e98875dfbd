"""Document fingerprints: bottom-k sketches of shingle hashes, in built-in functions.

A sketch holds the k smallest 64-bit hashes of a text's distinct word shingles, in order. Sketches merge across parts
of a document or corpus; they estimate resemblance, containment and the number of distinct shingles, and are exact for
sets of up to k shingles.

Defined results: null text is empty; a text without words has an empty sketch; fewer words than the shingle size make
one shingle. Two empty sketches are alike (1), an empty and another one are not (0). Equal texts have equal
fingerprints. Rows sharing a doc_id are ordered by text; a null doc_id comes after all others. Extra columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ._common import partitions_for, stored

K = 64
WORDS = 5
_SPACES = "[ \\t\\n\\x0B\\f\\r]+"


def _let(value: Column, body) -> Column:
    """Bind ``value`` once for a lambda body that uses it many times."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shingle_hashes(text: Column, words: int = WORDS) -> Column:
    """Hashes of the word shingles, with repeats; words are runs of other characters than space and 0x09-0x0D."""
    hashed = F.transform(F.filter(F.split(F.coalesce(text, F.lit("")), _SPACES), lambda w: w != ""), lambda w: F.xxhash64(w))
    def of(h):
        n = F.size(h)
        whole = F.transform(F.sequence(F.lit(1), F.greatest(n - (words - 1), F.lit(1))), lambda i: F.xxhash64(*[F.get(h, i + (x - 1)) for x in range(words)]))
        return F.when(n == 0, F.array().cast("array<bigint>")).otherwise(whole)
    return _let(hashed, of)


def sketch(text: Column, words: int = WORDS, k: int = K) -> Column:
    return F.slice(F.array_sort(F.array_distinct(shingle_hashes(text, words))), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union of both shingle sets."""
    return F.slice(F.array_sort(F.array_union(a, b)), 1, k)


def distinct_estimate(s: Column, k: int = K) -> Column:
    """Distinct shingles behind a sketch: exact below k, else from the k-th smallest hash."""
    share = (F.element_at(s, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(s) < k, F.size(s).cast("double")).otherwise((k - 1) / share)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Share of the union's k smallest hashes that both sketches hold: an estimate of Jaccard similarity."""
    top = _let(merge(a, b, k), lambda u: F.when(F.size(u) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(F.array_intersect(u, a), b)) / F.size(u)))
    return top.cast("double")


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b holds too."""
    union = distinct_estimate(merge(a, b, k), k)
    both = resemblance(a, b, k) * union
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), both / distinct_estimate(a, k)))


def encode(s: Column) -> Column:
    """A sketch as text: its hashes as 16 hexadecimal digits each."""
    return F.array_join(F.transform(s, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


#: Buckets of doc_id at most: their borders are an array in the plan.
MAX_BUCKETS = 4096


def next_by_id(rows: DataFrame, carry: list[str], per_bucket: int = 5_000, prepare=lambda rows: rows) -> DataFrame:
    """Add ``next_<c>`` for each of ``carry``: the values of the row after it in descending doc_id, the first after the last.

    ``rows``: doc_id long, text, and more; ``prepare`` adds columns to each row, once, after the buckets are known. Rows are dealt to buckets of doc_id by quantiles and ordered within each; a
    bucket also gets a copy of the first row of the bucket that follows, so no row looks beyond its own bucket.
    """
    n = rows.count()
    parts = min(MAX_BUCKETS, partitions_for(rows.sparkSession, n, per_bucket))
    cuts = rows.agg(F.percentile_approx("doc_id", [x / parts for x in range(1, parts)] or [0.5], 10_000).alias("q")).first()["q"] or []
    cuts = sorted(set(cuts), reverse=True)
    above = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]) if cuts else F.array().cast("array<bigint>"), lambda c: c > F.col("doc_id")))
    rows = rows.withColumn("_b", F.when(F.col("doc_id").isNull(), F.lit(len(cuts) + 1)).otherwise(above)).withColumn("_copy", F.lit(False))
    top = stored(rows.groupBy("_b").agg(F.max("doc_id").alias("top")), "fingerprint-tops")
    present = sorted(r["_b"] for r in top.collect())  # as many as buckets
    if not present:
        rows = prepare(rows)
        return rows.select(*[c for c in rows.columns if c not in ("_b", "_copy")], *[F.col(c).alias(f"next_{c}") for c in carry])
    before = F.create_map(*[x for i, b in enumerate(present) for x in (F.lit(b), F.lit(present[i - 1]))])
    others = [c for c in rows.columns if c not in ("_b", "_copy")]
    firsts = rows.join(top.withColumnRenamed("_b", "_t"), (F.col("_b") == F.col("_t")) & F.col("doc_id").eqNullSafe(F.col("top")))
    firsts = firsts.groupBy("_b").agg(F.min(F.struct("text", *[c for c in others if c != "text"])).alias("f"))
    copies = firsts.select(*[F.col("f")[c].alias(c) for c in others], before[F.col("_b")].alias("_b"), F.lit(True).alias("_copy"))
    every = prepare(rows.unionByName(copies))
    others = [c for c in every.columns if c not in ("_b", "_copy")]
    over = "partition by _b order by _copy, doc_id desc nulls last, text asc nulls first"
    step = every.selectExpr("*", f"lead(struct({', '.join(carry)})) over ({over}) as _next").where("not _copy")
    return step.select(*others, *[F.col("_next")[c].alias(f"next_{c}") for c in carry])


def edited_likeness(docs: DataFrame, words: int = WORDS, k: int = K) -> DataFrame:
    """Fingerprint each text and the text whose last third is replaced by the start of the next document's."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    near = next_by_id(rows, ["text", "s"], prepare=lambda r: r.withColumn("s", sketch(F.col("text"), words, k)))
    near = near.withColumn("n_chars", F.char_length("text").cast("long"))
    near = near.withColumn("edited", F.expr("concat(left(text, int(n_chars - floor(n_chars / 3))), left(next_text, int(floor(n_chars / 3))))"))
    near = near.select("doc_id", "n_chars", "s", "next_s", F.sha2("edited", 256).alias("edited_sha256"), sketch(F.col("edited"), words, k).alias("e"))
    return near.select(
        "doc_id", "n_chars", "edited_sha256", encode(F.col("s")).alias("fingerprint"), encode(F.col("e")).alias("edited_fingerprint"),
        resemblance(F.col("s"), F.col("e"), k).alias("near_edited"), resemblance(F.col("s"), F.col("next_s"), k).alias("near_next"),
        distinct_estimate(F.col("s"), k).alias("distinct_shingles"), containment(F.col("s"), F.col("e"), k).alias("held_in_edited"),
    )
