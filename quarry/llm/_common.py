"""Shared helpers: stored intermediate tables, hashed words in numpy, connected components."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..workspace import discard, fresh_path, stored  # noqa: F401

def partitions_for(spark: SparkSession, rows: int, per_task: int) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(rows) // per_task), 1)


def tidy(run):
    """``run`` over a task's batches, after which the worker gives freed memory back: it may idle beside other stages."""

    def tidied(batches):
        import ctypes

        import pyarrow as pa

        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return tidied


#: Rows of a narrow table that may be broadcast: a few dozen bytes each, so some MB.
BROADCAST_ROWS = 200_000


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if its counted rows are within the bound; else the join shuffles."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


# ---------------------------------------------------------------- hashing in numpy

U = np.uint64
_B = 0x9E3779B97F4A7C15 | 1
_BINV = pow(_B, -1, 1 << 64)
_PIECE = 1 << 20
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser, elementwise."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def mix_int(x: int) -> int:
    return int(mix(np.array([x & (2**64 - 1)], U))[0])


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, U)
    p[:1] = 1
    return np.cumprod(p, dtype=U)


_POW, _INV = _powers(_B, _PIECE + 1), _powers(_BINV, _PIECE + 1)


def _sums(buf: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool) -> np.ndarray:
    """The polynomial of each span of at most ``_PIECE`` bytes, as if it began the buffer."""
    total = np.zeros(len(buf) + 1, U)
    x = (LOWER[buf] if lower else buf).astype(U)
    x += U(1)
    x *= _POW[: len(buf)]
    np.cumsum(x, dtype=U, out=total[1:])
    return (total[end] - total[start]) * _INV[start]


def _hashed(sums: np.ndarray, length: np.ndarray) -> np.ndarray:
    return mix(sums ^ (length.astype(U) << U(32)))


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hashes of spans of bytes, in order and apart; a buffer beyond the bound holds one long span or few."""
    if len(buf) <= _PIECE:
        return _hashed(_sums(buf, start, end, lower), end - start)
    sums = np.zeros(len(start), U)
    for at in range(0, len(buf), _PIECE):
        a, z = np.clip(start - at, 0, _PIECE), np.clip(end - at, 0, _PIECE)
        k = np.flatnonzero(a < z)
        part = _sums(buf[at : at + _PIECE], a[k], z[k], lower)
        # what lies in an earlier piece comes before: shift by its length
        done = np.maximum(at - start[k], 0)
        sums[k] += part * np.array([pow(_B, int(d), 1 << 64) if d else 1 for d in done], U)
    return _hashed(sums, end - start)


def _words(buf: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word starts and ends in the bytes; a word also ends at each position of ``breaks``."""
    n = len(buf)
    ws = _SPACE[buf]
    first = np.empty(n, bool)
    first[0] = True
    first[1:] = ws[:-1]
    first[breaks[breaks < n]] = True
    starts = np.flatnonzero(first & ~ws)
    last = np.empty(n, bool)
    last[-1] = True
    last[:-1] = ws[1:]
    b = breaks[(breaks > 0) & (breaks <= n)] - 1
    last[b] = True
    return starts, np.flatnonzero(last & ~ws) + 1


def text_buffers(texts) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a pyarrow string array; null texts are empty."""
    import pyarrow as pa

    arr = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    arr = arr.cast(pa.large_string())
    if arr.null_count:
        arr = arr.fill_null("")
    if not len(arr):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    off = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]
    return off, np.frombuffer(arr.buffers()[2], np.uint8) if arr.buffers()[2] is not None else np.zeros(0, np.uint8)


def pieces_of(data: np.ndarray, lo: int, hi: int, most: int = _PIECE):
    """Ranges of the bytes from ``lo`` to ``hi``, of at most ``most`` bytes; they end after white space where a word
    does not fill one, and a longer word stays whole in a longer range."""
    while lo < hi:
        end = min(hi, lo + most)
        if end < hi:
            gap = np.flatnonzero(_SPACE[data[lo:end]])
            if len(gap):
                end = lo + int(gap[-1]) + 1
            else:
                while end < hi and not len(gap):
                    gap = np.flatnonzero(_SPACE[data[end : end + most]])
                    end = end + int(gap[0]) + 1 if len(gap) else min(hi, end + most)
        yield lo, end
        lo = end


def word_hashes(texts, lower: bool = True):
    """Yield (index of the first text, word hashes, word offsets of each text) for runs of texts of bounded bytes.

    ``texts``: a pyarrow string array. Words are runs of bytes other than space and 0x09-0x0D, hashed whole however long.
    Null texts have no word.
    """
    off, data = text_buffers(texts)
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + _PIECE, "right")) - 1)
        j = min(j, n)
        lo, hi = int(off[i]), int(off[j])
        if hi == lo:
            yield i, np.zeros(0, U), np.zeros(j - i + 1, np.int64)
        elif hi - lo <= _PIECE:
            buf = data[lo:hi]
            starts, ends = _words(buf, off[i:j] - lo)
            yield i, span_hashes(buf, starts, ends, lower), np.searchsorted(starts, off[i : j + 1] - lo)
        else:  # one text beyond the bound
            h = np.concatenate([span_hashes(data[a:z], *_words(data[a:z], np.zeros(0, np.int64)), lower) for a, z in pieces_of(data, lo, hi)])
            yield i, h, np.array([0, len(h)], np.int64)
        i = j


def shingles(words: np.ndarray, w: int) -> np.ndarray:
    """Hashes of the w-word shingles of one text, in order; fewer words make one shingle; no word makes none."""
    n = len(words)
    if not n:
        return words
    k = min(w, n)
    acc = np.full(n - k + 1, k, U)
    for x in range(k):
        acc = acc * U(0xD6E8FEB86659FD93) + words[x : n - k + 1 + x]
    return mix(acc)


# ---------------------------------------------------------------- connected components


def _reduced(s: DataFrame) -> DataFrame:
    return s.groupBy("u").agg(F.min("v").alias("m"))


#: Links up to this many (32 MB) are merged by one task; beyond, by rounds over all tasks. The components are the same.
ONE_TASK_LINKS = 2_000_000


def components(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, the smallest node that each is connected with) of links in arrays."""
    if not len(u):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b, up = at[: len(u)], at[len(u) :], np.arange(len(nodes))
    while True:
        ra, rb = up[a], up[b]
        apart = ra != rb
        if not apart.any():
            return nodes, nodes[up]
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        # the larger root goes under the smallest root that it is linked with, then every node under its root
        np.minimum.at(up, np.maximum(ra, rb), np.minimum(ra, rb))
        while not np.array_equal(up, above := up[up]):
            up = above


def _forest(most: int, roots: bool):
    """mapInArrow: (u, v) -> (node, component) of the links seen; a forest of at most ``most`` links is held at once,
    and as many links beside it. ``roots``: roots have a row too."""

    def run(batches):
        import pyarrow as pa

        def out(n, c):
            keep = slice(None) if roots else n != c
            return pa.RecordBatch.from_arrays([pa.array(n[keep], pa.int64()), pa.array(c[keep], pa.int64())], ["node", "component"])

        held, links = [(np.zeros(0, np.int64), np.zeros(0, np.int64))], 0
        for b in batches:
            held.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
            links += b.num_rows
            if links >= most:
                n, c = components(*map(np.concatenate, zip(*held)))
                if np.count_nonzero(n != c) > most // 2 and not roots:
                    yield out(n, c)
                    n, c = n[:0], c[:0]
                held, links = [(n, c)], 0
        yield out(*components(*map(np.concatenate, zip(*held))))

    return run


def connected_components(edges: DataFrame, name: str, max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of ``edges(u, v)``; longs, self-loops ignored.

    Each task first reduces its links to a forest. A forest of up to ``ONE_TASK_LINKS`` links is merged by one task.
    A larger one goes through large-star and small-star rounds: each is one pre-aggregated minimum and one equi-join,
    so a hub of any degree is summed map-side and split by the adaptive join. Every round is a table in the shared
    folder.
    """
    links = edges.where("u <> v and u is not null and v is not null").select("u", "v")
    forest = stored(links.mapInArrow(_forest(500_000, False), "u long, v long"), f"{name}-forest")
    if forest.count() <= ONE_TASK_LINKS:
        return forest.coalesce(1).mapInArrow(_forest(500_000, True), "node long, component long")
    return star_rounds(forest, name, max_rounds)


def star_rounds(edges: DataFrame, name: str, max_rounds: int = 60) -> DataFrame:
    e = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{name}-edges")
    mark = None
    for _ in range(max_rounds):
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == mark or not now[0]:
            break
        mark = now
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(_reduced(both).select("u", F.least("u", "m").alias("m")), f"{name}-large")
        large = stored(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), f"{name}-ls")
        small = stored(_reduced(large), f"{name}-small")
        e2 = stored(
            large.join(small, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct(),
            f"{name}-ss",
        )
        discard(e, least, large, small)
        e = e2
    else:
        raise RuntimeError(f"{name}: components did not settle in {max_rounds} rounds")
    nodes = e.groupBy("u").agg(F.min("v").alias("v"))
    return nodes.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
