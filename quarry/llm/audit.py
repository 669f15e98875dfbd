"""Filter interaction audit: what each of five filters removes, in every order, from one cube over their flags.

Each text's flags are computed once, JVM-side. Documents are counted by part and the five flags (at most 32 rows a part),
then a CUBE over part and flags sums these counts: a grouping-set row whose selected flags are all false holds the
survivors of that subset of filters. A step of an order is a pair of subsets, before and after its filter, so all steps
are joins of that small table with itself.

A text's first document is the one with the smallest doc_id; it is found by digest, pre-aggregated, and met again by digest
and id, so a text of any number of copies is no hot key.

Defined results: null text is empty (and empty texts equal each other); null source is the part ''. A null doc_id has no
label and no smaller one, so it never fails E; repeated rows of a doc_id count each, and none of them is smaller than
another. Repeated labels: a document is good (toxic) if any of its labels says so. An empty table has no part and no row.
Extra columns are ignored.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ._common import stored

SPACE = r"[\x20\x09-\x0D]+"
FILTERS = "ABCDE"
ALL = (1 << len(FILTERS)) - 1


def text_flags(text: Column) -> dict[str, Column]:
    """The failure conditions that a text alone decides; ``text`` is not null."""
    words = F.array_remove(F.split(text, SPACE), "")
    capitals = F.octet_length(text) - F.octet_length(F.regexp_replace(text, "[A-Z]+", ""))
    return {
        "a": F.size(words) < 200,
        "b": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "c": 100 * capitals.cast("long") > 2 * F.char_length(text).cast("long"),
        "d": F.regexp_like(text, F.lit("[#$%&*|]")),
    }


def flagged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, a, b, c, d, e, good, toxic) of every row of ``docs(doc_id, text, source)``; ``labels(doc_id, quality, toxic)``."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    flags = text_flags(F.col("text"))
    rows = plain.select("doc_id", "part", *[c.alias(k) for k, c in flags.items()], F.unhex(F.sha2("text", 256)).alias("digest"))
    # rows without an id meet nothing in the joins: a number of their own spreads them
    rows = stored(rows.withColumn("own", F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()).otherwise(-1)), "audit-flags")
    first = rows.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumns({"own": F.lit(-1).cast("long"), "first": F.lit(True)})
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    out = rows.join(first, ["digest", "doc_id", "own"], "left").join(marks.withColumn("own", F.lit(-1).cast("long")), ["doc_id", "own"], "left")
    return out.select("part", *flags, (F.col("doc_id").isNotNull() & F.col("first").isNull()).alias("e"), F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def survivors(rows: DataFrame) -> DataFrame:
    """(part, subset, n, good, toxic): documents that no filter of the subset fails, for all subsets, zeros included.

    Bit i of ``subset`` stands for the i-th filter."""
    names = [f.lower() for f in FILTERS]
    counts = rows.groupBy("part", *names).agg(F.count("*").alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))
    cube = counts.cube("part", *names).agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")], F.grouping("part").alias("_p"), *[F.grouping(f).alias(f"_{f}") for f in names])
    clean = F.col("_p") == 0
    subset = F.lit(0)
    for i, f in enumerate(names):
        clean &= (F.col(f"_{f}") == 1) | ~F.col(f)
        subset += F.when(F.col(f"_{f}") == 0, 1 << i).otherwise(0)
    held = cube.where(clean).select("part", subset.alias("subset"), "n", "good", "toxic")
    every = counts.select("part").distinct().select("part", F.explode(F.sequence(F.lit(0), F.lit(ALL))).alias("subset"))
    return every.join(held, ["part", "subset"], "left").na.fill(0, ["n", "good", "toxic"])


def steps() -> list[tuple[str, int, int, int, int]]:
    """(order, step, filter, subset before, subset after) of every step of every order: 600 rows."""
    out = []
    for order in permutations(range(len(FILTERS))):
        before = 0
        for k, f in enumerate(order):
            out.append(("".join(FILTERS[i] for i in order), k + 1, f, before, before | 1 << f))
            before |= 1 << f
    return out


def interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)."""
    left = stored(survivors(flagged(docs, labels)), "audit-survivors")
    of = lambda s: F.max(F.when(F.col("subset") == s, F.col("n")))
    bits = [1 << i for i in range(len(FILTERS))]
    # a part's totals: all, without each filter's failures, without the failures of all, of all but each
    totals = left.groupBy("part").agg(of(0).alias("whole"), F.array(*[of(b) for b in bits]).alias("alone"), of(ALL).alias("last"), F.array(*[of(ALL ^ b) for b in bits]).alias("others"))
    plan = docs.sparkSession.createDataFrame(steps(), "filter_order string, step int, f int, before int, after int")
    cell = lambda p: left.select("part", F.col("subset").alias(p), *[F.col(c).alias(f"{p}_{c}") for c in ("n", "good", "toxic")])
    pairs = cell("before").join(F.broadcast(plan), "before").join(cell("after"), ["part", "after"]).join(totals, "part")
    removed = F.col("before_n") - F.col("after_n")
    pairs = pairs.withColumn("removed", removed).withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "f")))
    return pairs.select(
        "part", "filter_order", "step", F.col("after_n").alias("kept"), "removed", (F.col("whole") - F.col("alone")[F.col("f")] - F.col("removed")).alias("redundant"),
        (F.col("others")[F.col("f")] - F.col("last")).alias("unique_fails"), (F.col("before_good") - F.col("after_good")).alias("good_lost"), (F.col("before_toxic") - F.col("after_toxic")).alias("toxic_lost"), "shapley",
    )
