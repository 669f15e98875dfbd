"""Mixing sources to target weights: a low-discrepancy schedule of slots joined with shuffled blocks of equal words.

1. *Targets.* Sources share a multiple of all words by weight; a target stops at a multiple of its source's size and the
   excess goes to the others by weight. That is the level ``l`` with sum(min(cap, l * weight)) = total, found by running
   sums over the sources in order of cap / weight.
2. *Streams.* A source's documents stand in an order shuffled by hash; their first words' places are prefix sums, by hash
   buckets and then within a bucket, so a source of any size is summed by many tasks. The stream is cut into blocks of
   equal words.
3. *Blocks.* Each pass over a source takes its blocks in a shuffled order of its own; the last block that the target
   reaches is taken in part.
4. *Schedule.* Slot ``i`` of ``n`` falls on the point ``i * a mod n``, ``a`` the number next to ``n`` over the golden ratio
   without a common divisor: every point is met once, and any run of slots spreads evenly. Points are dealt to the sources
   by their cumulative numbers of blocks; a source's slots, in order, take its blocks in order.

Defined results: null text has no word; documents without words are in the result and never in the mix. A null source is a
source of its own, the last. Null and repeated doc_ids are rows each. A source without words has the target 0; an empty
table gives none. Extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

from ._common import bounded, stored

SPACE = r"[\x20\x09-\x0D]+"
WEIGHTS, SHARE, CAP = (3, 1, 2), 1.5, 2
#: Slots of a schedule, about: a block has this part of the mix, one word at least.
SLOTS = 1 << 18
#: Hash buckets of a source's stream.
BUCKETS = 4096
#: More sources than these are an error: their table is windowed by one task.
MOST_SOURCES = 100_000


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, h) of every row: number of words, and the hash that shuffles."""
    words = F.size(F.array_remove(F.split(F.coalesce("text", F.lit("")), SPACE), "")).cast("long")
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), words.alias("size"), F.xxhash64("doc_id", "text", F.lit(11)).alias("h"))


def targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """(no, source, source_size, target), a row a source; ``no`` follows the sources' code points, null last."""
    by = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    # one row a source, a bounded number, in windows without partitions
    named = by.withColumn("no", (F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1).cast("int"))
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), F.col("no") % len(weights))
    s = named.withColumns({"weight": weight, "cap": F.col("source_size") * float(cap), "total": F.sum("source_size").over(Window.partitionBy()) * share})
    order = Window.orderBy(F.col("cap") / F.col("weight"), "no")
    below = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    above = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    s = s.withColumn("level", (F.col("total") - below) / above).withColumn("at", F.row_number().over(order))
    settled = F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.struct("at", "level"))
    level = F.coalesce(F.min(settled).over(Window.partitionBy())["level"], F.lit(float("inf")))
    return s.select("no", "source", "source_size", F.least("cap", level * F.col("weight")).alias("target"))


def _placed(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """(doc_id, no, size, at) of the rows that have words: ``at`` is the place of the first word in its source's stream."""
    known = F.broadcast(sources.select("no", F.col("source").alias("name")))  # at most MOST_SOURCES rows
    r = rows.where("size > 0").join(known, F.col("source").eqNullSafe(F.col("name"))).select("doc_id", "no", "size", "h", F.shiftrightunsigned("h", 52).alias("bucket"))
    sums = r.groupBy("no", "bucket").agg(F.sum("size").alias("words"))
    base = sums.withColumn("base", F.sum("words").over(Window.partitionBy("no").orderBy("bucket")) - F.col("words")).drop("words")
    inside = F.coalesce(F.sum("size").over(Window.partitionBy("no", "bucket").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return r.withColumn("inside", inside).join(base, ["no", "bucket"]).select("doc_id", "no", "size", (F.col("base") + F.col("inside")).alias("at"))


def blocks(sources: DataFrame, slots: int = SLOTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """(no, source_size, block, n_blocks, pass, rank, words): the blocks that the targets reach, and how much of each.

    The blocks of all sources are about ``slots`` for the whole mix, so this table is bounded. ``rank`` counts a source's
    blocks in the order in which they are taken, from 0."""
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    most = max(1, math.ceil(share * total / slots))
    s = sources.where("source_size > 0").select("no", "source_size", F.round("target").cast("long").alias("want"), F.expr(f"(source_size + {most - 1}) div {most}").alias("n_blocks"))
    s = s.where("want > 0").withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(cap - 1)))).where("want > pass * source_size")
    b = s.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)))
    b = b.withColumn("full", F.expr("(block + 1) * source_size div n_blocks - block * source_size div n_blocks"))
    order = Window.partitionBy("no").orderBy("pass", F.xxhash64("no", "pass", "block", F.lit(12)), "block")
    b = b.withColumns({"rank": F.row_number().over(order) - 1, "before": F.sum("full").over(order) - F.col("full")})
    return b.withColumn("words", F.least("full", F.col("want") - F.col("before"))).where("words > 0").select("no", "source_size", "block", "n_blocks", "pass", "rank", "words")


def stride(n: int) -> int:
    """The number next to ``n`` over the golden ratio that has no common divisor with ``n``."""
    near = round(n * (math.sqrt(5) - 1) / 2)
    return next(a for d in range(n + 1) for a in (near + d, near - d) if 0 < a and math.gcd(a, n) == 1)


def schedule(wanted: DataFrame) -> DataFrame:
    """(slot, no, rank): the source and the number of its block that each slot takes; ``wanted`` is the table of blocks."""
    n = wanted.count()
    if n >= 1 << 31:
        raise ValueError("more than 2 ** 31 slots")
    counts = wanted.groupBy("no").agg(F.count("*").alias("m"))
    counts = counts.withColumn("low", F.sum("m").over(Window.orderBy("no")) - F.col("m"))
    # the slot that falls on a point, by the inverse of the stride
    back = pow(stride(n), -1, n) if n > 1 else 1
    points = counts.select("no", F.explode(F.sequence("low", F.col("low") + F.col("m") - 1)).alias("point"))
    slots = points.select("no", (F.col("point") * F.lit(back) % max(n, 1)).alias("slot"))
    return slots.withColumn("rank", F.row_number().over(Window.partitionBy("no").orderBy("slot")) - 1)


def _pieces(rows: DataFrame, sources: DataFrame, slots: int) -> DataFrame:
    """Every block that a document with words lies in, and each slot that takes words of it there; ``slot`` is null and
    ``length`` 0 where none does."""
    wanted = stored(blocks(sources, slots), "mix-blocks")
    taken = wanted.join(schedule(wanted), ["no", "rank"]).groupBy("no", "block").agg(F.collect_list(F.struct("slot", "pass", "words")).alias("uses"))  # one a pass
    taken = stored(taken, "mix-slots")
    p = _placed(rows, sources).join(F.broadcast(wanted.select("no", "source_size", "n_blocks").distinct()), "no", "left")
    # the last block that begins at or before a place
    inside = lambda at: f"(({at} + 1) * n_blocks - 1) div source_size"
    span = F.when(F.col("n_blocks").isNotNull(), F.sequence(F.expr(inside("at")), F.expr(inside("(at + size - 1)"))))
    p = p.withColumn("block", F.explode_outer(span))
    p = p.join(bounded(taken, 4 * slots), ["no", "block"], "left").withColumn("use", F.explode_outer("uses")).withColumn("begin", F.expr("block * source_size div n_blocks"))
    first = F.greatest("begin", "at")
    length = F.when(F.col("use").isNotNull(), F.greatest(F.least(F.col("begin") + F.col("use.words"), F.col("at") + F.col("size")) - first, F.lit(0)))
    return p.select("doc_id", "no", "size", "at", "block", "use.slot", "use.pass", (first - F.col("at")).alias("start"), F.coalesce(length, F.lit(0)).alias("length"))


def _prepared(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    rows = stored(sized(docs), "mix-sizes")
    sources = stored(targets(rows), "mix-sources")
    if sources.count() > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    return rows, sources


def mix(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """The mix: (slot, no, block, pass, doc_id, start, length), pieces of documents in the order of slots, each ``length``
    words from the word ``start`` on; within a slot in the order of their places ``at``."""
    rows, sources = _prepared(docs)
    return _pieces(rows, sources, slots).where("length > 0").select("slot", "no", "block", "pass", "doc_id", "at", "start", "length")


def mixed_shares(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row: the words of it that the mix takes."""
    rows, sources = _prepared(docs)
    got = _pieces(rows, sources, slots).groupBy("no", "at", "doc_id", "size").agg(F.sum("length").alias("taken"))
    known = F.broadcast(sources)  # at most MOST_SOURCES rows
    none = rows.where("size = 0").join(known, rows["source"].eqNullSafe(known["source"])).select("doc_id", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"))
    return got.join(known, "no").select("doc_id", "size", "source_size", "target", "taken").unionByName(none)
