"""Sharding: a uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

Rows stay where the scan put them; how many of each partition's rows go to each shard is drawn exactly (multivariate
hypergeometric, so the joint law is that of a uniform permutation). Each partition permutes its rows and deals them by
these counts, shards receive them and permute again. Only ids and sizes move, never texts. The law is ``rows``: shard
sizes differ by at most one.

Partition numbers and row positions are written to a table before anything is drawn, so a lost executor repeats the
same shuffle. Hot ids or texts don't matter: rows are dealt by position, not by content. Shards are cut into blocks of
random keys, so no task holds a shard.

Defined results: null text has size 1 and the crc32 of the empty string; null or repeated doc_ids are rows like
others. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame, functions as F

from ._common import stored

SHARDS = 8
SEED = 20240229
_PER_BLOCK = 50_000


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """Exact-law draw of how many of ``draws`` items without replacement are good, by inversion outward from the mode."""
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    lg = math.lgamma
    choose = lambda n, k: lg(n + 1) - lg(k + 1) - lg(n - k + 1)
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))
    p = math.exp(choose(good, mode) + choose(bad, draws - mode) - choose(good + bad, draws))
    u = rng.random() - p
    up, down, pu, pd = mode, mode, p, p
    while u > 0 and (up < high or down > low):
        if up < high:
            pu *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
            up += 1
            u -= pu
            if u <= 0:
                return up
        if down > low:
            pd *= down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))
            down -= 1
            u -= pd
            if u <= 0:
                return down
        if pu < 1e-300 and pd < 1e-300:
            break
    return mode


def communication_matrix(sizes: list[int], shards: int, seed: int = SEED) -> list[list[int]]:
    """Rows of each partition for each shard; columns sum to shard sizes at most one apart."""
    total = sum(sizes)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    rng = random.Random(seed)
    out = []
    for n in sizes:
        left, bad, row = n, sum(room), []
        for s in range(shards):
            bad -= room[s]
            row.append(hypergeometric(rng, room[s], bad, left) if s < shards - 1 else left)
            left -= row[-1]
        room = [r - x for r, x in zip(room, row)]
        out.append(row)
    return out


def shard_rows(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"),
        F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("pos"),
    )
    rows = stored(rows, "shard-rows")
    sizes = {r["part"]: r["n"] for r in rows.groupBy("part").agg(F.count("*").alias("n")).collect()}  # a row a partition
    parts = sorted(sizes)
    matrix = communication_matrix([sizes[p] for p in parts], shards, seed)
    ends = []
    for p, row in zip(parts, matrix):
        acc, cum = 0, []
        for x in row:
            acc += x
            cum.append(acc)
        ends.append((p, cum))
    plan = spark.createDataFrame(ends, "part int, ends array<long>")
    dealt = rows.withColumn("n", F.expr(f"row_number() over (partition by part order by xxhash64(pos, {seed}L), pos)"))
    dealt = dealt.join(plan, "part").withColumn("shard", F.size(F.filter("ends", lambda e: e < F.col("n"))))
    blocks = max(1, -(-sum(sizes.values()) // (shards * _PER_BLOCK)))
    dealt = dealt.select("doc_id", "size", "text_crc32", "shard", "pos", F.xxhash64("pos", F.lit(seed + 1)).alias("key"))
    dealt = stored(dealt.withColumn("block", F.pmod(F.shiftright("key", 20), F.lit(blocks))), "shard-dealt")
    base = dealt.groupBy("shard", "block").agg(F.count("*").alias("c"))
    base = base.select("shard", "block", F.expr("coalesce(sum(c) over (partition by shard order by block rows between unbounded preceding and 1 preceding), 0)").alias("base"))
    placed = dealt.withColumn("n", F.expr("row_number() over (partition by shard, block order by key, pos)")).join(base, ["shard", "block"])
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("base") + F.col("n") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
