"""Packing along a space-filling curve.

Documents become vectors by hashing their words, projected to three dimensions by signs of the same hash; the grid
cell's Hilbert key orders them, so documents of like words are neighbours. They are range-sorted by that key and laid
end to end along the curve; the stream is cut every 4096 ids. The last, shorter stretch is cut into sequences whose
lengths are powers of two, so nothing is padded.

Ranges are cut by quantiles of (key, hash of the doc_id): a group of copies of any size has one key but is split by
the hash. Tokens and keys are made once and stored; range bases are prefix sums of the ranges' totals, so rows are cut
into pieces as they come sorted from one shuffle.

Defined results: null text is empty and has only the end id; null and repeated doc_ids are rows like others (ordered
by key, doc_id and ids). An empty table gives no pieces. Extra columns are ignored.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ._common import U, mix, stored, tidy, word_hashes
from .tokens import encoder, vocabulary_path

LENGTH = 4096
DIMS, BITS_EACH = 3, 10


def hilbert_key(cells: np.ndarray, bits: int = BITS_EACH) -> np.ndarray:
    """Position on the Hilbert curve of each row of grid cells (n, dims), by the transpose form of the curve."""
    x = cells.T.astype(np.int64).copy()
    d = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(d):
            high = (x[i] & q) != 0
            t = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ t)
            x[i] ^= t
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[d - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_order(texts, doc_ids) -> np.ndarray:
    """The Hilbert key of each text in the high bits, a hash of its doc_id in the low ones: a long below 2**62."""
    n = len(texts)
    out = np.zeros(n, np.int64)
    for at, words, off in word_hashes(texts):
        m = len(off) - 1
        v = np.zeros((m, DIMS))
        count = np.diff(off)
        full = np.flatnonzero(count)
        if len(words):
            for k in range(DIMS):
                # words fall into 4096 features; a feature's sign in each dimension is the projection
                sign = (mix((words & U(4095)) + U(k * 4096 + 1)) & U(1)).astype(np.int64) * 2 - 1
                v[full, k] = np.add.reduceat(sign, off[full])
        v[full] /= np.sqrt(count[full])[:, None]
        side = 1 << BITS_EACH
        cells = np.clip(((np.arctan(v / 4) / np.pi + 0.5) * side).astype(np.int64), 0, side - 1)
        out[at : at + m] = hilbert_key(cells)
    ids = mix(np.asarray(doc_ids, np.int64).astype(U)) >> U(32)
    return (out << 32) | ids.astype(np.int64)


def _cuts(total: int, length: int = LENGTH) -> tuple[int, np.ndarray]:
    """Full sequences, and the borders of the rest cut into powers of two."""
    full = total // length
    left, at, borders = total - full * length, full * length, []
    for b in range(left.bit_length() - 1, -1, -1):
        if left & (1 << b):
            borders.append(at)
            at += 1 << b
    return full, np.array(borders + [at], np.int64)


#: Ranges at most: their borders are held by the driver and sent with a task. Beyond, ranges grow and their sort spills.
MAX_RANGES = 8192


def _sequences(lo: np.ndarray, n: np.ndarray, full: int, rest: np.ndarray, length: int):
    """(document, sequence, start and end in the stream) of every piece of documents at ``lo`` with ``n`` ids each."""

    def of(x):
        return np.where(x < full * length, x // length, full + np.searchsorted(rest, x, "right") - 1)

    def begin(seq):
        return np.where(seq < full, seq * length, rest[np.clip(seq - full, 0, len(rest) - 1)])

    first, count = of(lo), of(lo + n - 1) - of(lo) + 1
    row = np.repeat(np.arange(len(lo)), count)
    seq = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    return row, seq, begin(seq), np.maximum(lo[row], begin(seq)), np.minimum(lo[row] + n[row], begin(seq + 1))


def pack(docs: DataFrame, vocab: str | None = None, end_id: int = 2, length: int = LENGTH, per_range: int = 16 << 20) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row for each piece of a document."""
    spark = docs.sparkSession
    vocab = vocab or vocabulary_path()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def tokenise(batches):
        import pyarrow as pa

        enc = encoder(vocab)
        for b in batches:
            at = 0
            for ids, size in enc.encode_array(b.column(1), end_id):
                part = b.slice(at, len(size))
                at += len(size)
                o = curve_order(part.column(1), part.column(0).fill_null(-1).to_numpy(zero_copy_only=False))
                off = np.concatenate(([0], np.cumsum(size * ids.itemsize))).astype(np.int32)
                raw = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(off), pa.py_buffer(ids.tobytes())])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(o), pa.array(size), raw], ["doc_id", "o", "n", "ids"])

    made = stored(rows.mapInArrow(tidy(tokenise), "doc_id long, o long, n long, ids binary"), "pack-tokens")
    total = made.agg(F.sum("n")).first()[0] or 0
    parts = min(MAX_RANGES, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-2 * total // per_range)))
    cuts = made.agg(F.percentile_approx("o", [x / parts for x in range(1, parts)] or [0.5], max(10_000, 16 * parts)).alias("q")).first()["q"] or []
    borders = np.array(sorted(set(cuts)), np.int64)

    @F.arrow_udf("int")
    def range_of(o):
        import pyarrow as pa

        return pa.array(np.searchsorted(borders, o.to_numpy(), "right").astype(np.int32))

    placed = made.withColumn("rng", range_of("o"))
    sums = {r["rng"]: r["n"] for r in placed.groupBy("rng").agg(F.sum("n").alias("n")).collect()}  # a row a range
    base, at = {}, 0
    for r in sorted(sums):
        base[r] = at
        at += sums[r]
    full, rest = _cuts(at, length)

    def cut(batches):
        import pyarrow as pa

        last, at = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            rng, n = b.column(1).to_numpy(), b.column(2).to_numpy()
            off = np.frombuffer(b.column(3).buffers()[1], np.int32)[b.column(3).offset :][: b.num_rows + 1]
            width = int(off[1] - off[0]) // int(n[0])
            ids = np.frombuffer(b.column(3).buffers()[2], f"<u{width}", int(off[-1] - off[0]) // width, int(off[0]))
            # the rows of a range come together and in order
            cum = np.cumsum(n) - n
            new = np.flatnonzero(np.concatenate(([rng[0] != last], rng[1:] != rng[:-1])))
            shift = np.full(len(n), at, np.int64)
            for k in new:
                shift[k:] = base[int(rng[k])] - cum[k]
            lo = cum + shift
            last, at = rng[-1], int(lo[-1] + n[-1])
            row, seq, begin, a, z = _sequences(lo, n, full, rest, length)
            wide = memoryview(ids.astype("<u4")).cast("B")
            x = (cum[row] + a - lo[row]) * 4
            crc = [crc32(wide[i:j]) for i, j in zip(x.tolist(), (x + (z - a) * 4).tolist())]
            cols = [a - lo[row], z - a, np.array(crc, np.int64), n[row], seq, a - begin]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), *map(pa.array, cols)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    laid = placed.select("doc_id", "rng", "n", "ids", "o").repartitionById(len(borders) + 1, F.col("rng")).sortWithinPartitions("rng", "o", "doc_id", "ids")
    return laid.select("doc_id", "rng", "n", "ids").mapInArrow(tidy(cut), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
