"""Vector code compression: product quantisation in integers, codebooks fitted on all vectors by rounds.

Vectors become whole numbers, floor(4096 * x), and are stored once as blocks: one row holds the components of up to
``BLOCK`` vectors, dimension by dimension. A round is one ``treeAggregate`` over these blocks: in a task, distances to the
entries of each part's codebook accumulate dimension by dimension, ``np.add.at`` adds each part to the sums and counts of
its entry, and the tensors (a few KB, whatever the table) merge through a reduction tree. All sums are int64 and exact, so
neither the order of blocks nor a lost executor changes a result.

Defined results: a row is dropped if its vector is null, is empty or holds a null or non-finite component. The smallest
vec_ids lend the first entries (of equal ids the smaller vector; null ids come last); fewer vectors make fewer entries. Repeated rows count and are coded each. Errors of null labels are summed together. An empty table gives
none. Vectors of unequal length, of a length that the parts don't divide, or with a component beyond ``LARGEST`` are an
error. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ._common import BROADCAST_ROWS, stored, tidy

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Vectors of a block, and tasks' levels of the reduction tree.
BLOCK, DEPTH = 4096, 2
#: Components beyond this would pass 64 bits in the sums of squares.
LARGEST = 1 << 27
#: Copies of a label's sum where labels are too many to broadcast: rows of one label meet it in so many places.
SALT = 32


def whole(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, v): kept vectors in whole numbers."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    big = F.exists("v", lambda x: F.abs(x) > LARGEST)
    kept = rows.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0)).where(~bad)
    out = kept.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("v"))
    return out.withColumn("v", F.when(big, F.raise_error(F.lit(f"a component beyond {LARGEST / scale:g}")).cast("array<bigint>")).otherwise(F.col("v")))


def _blocked(dim: int, most: int):
    """mapInArrow: (key, label, v) -> blocks (keys, labels, n, block), the block an int32 matrix of dim rows."""

    def run(batches):
        import pyarrow as pa

        def out(b):
            lists = b.column(2)
            if (np.diff(lists.offsets.to_numpy()) != dim).any():
                raise ValueError(f"vectors of another length than {dim}")
            m = lists.flatten().to_numpy().reshape(b.num_rows, dim).astype("<i4")
            one = lambda c: pa.ListArray.from_arrays(pa.array([0, b.num_rows], pa.int32()), c)
            return pa.RecordBatch.from_arrays([one(b.column(0)), one(b.column(1)), pa.array([b.num_rows], pa.int32()), pa.array([np.ascontiguousarray(m.T).tobytes()], pa.binary())], ["ids", "labels", "n", "block"])

        for b in batches:
            for at in range(0, b.num_rows, most):
                yield out(pa.RecordBatch.from_struct_array(b.to_struct_array().slice(at, most)))

    return run


def nearest(block: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, distances) of the vectors of a block for each part: int64 arrays (parts, n).

    ``block``: (dim, n); ``book``: (parts, entries, dim / parts). The first of the nearest entries is taken."""
    parts, entries, width = book.shape
    codes, least = np.empty((parts, block.shape[1]), np.int64), np.empty((parts, block.shape[1]), np.int64)
    for p in range(parts):
        dist = np.zeros((entries, block.shape[1]), np.int64)
        for d in range(width):
            gap = block[p * width + d].astype(np.int64)[None, :] - book[p, :, d][:, None]
            gap *= gap
            dist += gap
        codes[p] = dist.argmin(0)
        least[p] = dist.min(0)
    return codes, least


def _tally(book: np.ndarray):
    """treeAggregate's step over blocks: (sums, counts) of the parts by part position and entry."""
    parts, entries, width = book.shape

    def add(acc, row):
        block = np.frombuffer(row[1], "<i4").reshape(-1, row[0])
        sums, counts = acc
        codes, _ = nearest(block, book)
        for p in range(parts):
            np.add.at(counts[p], codes[p], 1)
            for d in range(width):
                np.add.at(sums[p, :, d], codes[p], block[p * width + d].astype(np.int64))
        return acc

    def merge(a, b):
        a[0][...] += b[0]
        a[1][...] += b[1]
        return a

    return (np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)), add, merge


def fit(blocks: DataFrame, book: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """The codebooks after ``rounds`` rounds over the stored blocks."""
    rdd = blocks.select("n", "block").rdd
    for _ in range(rounds):
        zero, add, merge = _tally(book)
        sums, counts = rdd.treeAggregate(zero, add, merge, DEPTH)
        book = np.where(counts[..., None] > 0, sums // np.maximum(counts, 1)[..., None], book)
    return book


def _coded(book: np.ndarray):
    """mapInArrow: blocks -> (vec_id, label, code, error)."""

    def run(batches):
        import pyarrow as pa

        digits = np.array([f"{e:02x}" for e in range(book.shape[1])])
        for b in batches:
            for i in range(b.num_rows):
                n = b.column(2)[i].as_py()
                codes, least = nearest(np.frombuffer(b.column(3)[i].as_py(), "<i4").reshape(-1, n), book)
                text = digits[codes[0]]
                for p in range(1, len(codes)):
                    text = np.char.add(text, digits[codes[p]])
                yield pa.RecordBatch.from_arrays([b.column(0)[i].values, b.column(1)[i].values, pa.array(text), pa.array(least.sum(0))], ["vec_id", "label", "code", "error"])

    return run


def digest(book: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()


def compress(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(codes, codebooks): (vec_id, label, code, error) of every kept row, and the entries (parts, entries, width)."""
    v = whole(rows)
    label = v.schema["label"].dataType.simpleString()
    # a bounded number of rows: as many as a codebook has entries
    lent = [r["v"] for r in v.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).select("vec_id", "v").collect()]
    if not lent:
        return v.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), np.zeros((parts, 0, 0), np.int64)
    dim = len(lent[0])
    if dim % parts or any(len(x) != dim for x in lent):
        raise ValueError(f"{parts} parts do not divide vectors of length {dim}, or some have another length")
    first = np.array(lent, np.int64)
    book = np.ascontiguousarray(first.reshape(len(first), parts, dim // parts).transpose(1, 0, 2))
    blocks = stored(v.mapInArrow(tidy(_blocked(dim, BLOCK)), f"ids array<bigint>, labels array<{label}>, n int, block binary"), "vector-blocks")
    book = fit(blocks, book, rounds)
    return blocks.mapInArrow(tidy(_coded(book)), f"vec_id long, label {label}, code string, error long"), book


def coded(rows: DataFrame) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every kept row."""
    codes, book = compress(rows.select("vec_id", "embedding", "label"))
    codes = stored(codes, "vector-codes")
    sums = codes.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    if sums.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        both = codes.join(F.broadcast(sums), F.col("label").eqNullSafe(F.col("of")))
    else:
        spread = sums.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        both = codes.withColumn("mine", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALT)).cast("int")).join(spread, (F.col("mine") == F.col("salt")) & F.col("label").eqNullSafe(F.col("of")))
    return both.select("vec_id", "code", "error", "label_error", F.lit(digest(book)).alias("codebooks_sha256"))
