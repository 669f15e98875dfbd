"""An inverted-file vector index: vectors by their nearest centroid, and a search that opens the nearest cells.

Centroids are fitted by one task on a bounded sample (``SAMPLE`` vectors, those with the smallest hash of their id); every
vector is then filed under its cell. How many cells a search opens is measured when the index is built: as many as the
sample's own neighbours need for ``TARGET`` of them to be found, few where vectors cluster and many where they don't, for
10, 20, 40 ... neighbours. A filter that keeps one row in m spreads the neighbours, so a search for k rows opens what m * k
neighbours need; a query that is still left fewer than k rows opens twice as many cells, until all are open. So a filter
never leaves a query short. Similarities are exact. ``retrieve.cosine_topk`` stays the exact way.

A cell of any number of vectors is stored and searched in pieces of ``PIECE`` rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..workspace import stored
from .retrieve import _matrix, _nearest, top_k

#: Vectors that centroids are fitted on, of which so many ask when the number of opened cells is measured.
SAMPLE, PROBE_ASKS = 16_384, 256
#: Cells are the square root of the vectors' number, up to these.
MOST_CELLS = 1024
PIECE, QUERY_BLOCK = 50_000, 4096
TARGET, NEIGHBOURS = 0.95, 10


@dataclass(frozen=True)
class VectorIndex:
    """``rows``: (cell, piece, id, v, and the other columns of the vectors), in order of cell; ``cells``: (cell, n, pieces);
    ``centroids``: a matrix of unit rows; ``reach``: pairs (neighbours, cells that hold them), rising; ``total``, ``sample``:
    numbers of vectors filed and fitted on."""

    rows: DataFrame
    cells: DataFrame
    centroids: object
    reach: tuple[tuple[int, int], ...]
    total: int
    sample: int

    def probes(self, k: int, kept: int) -> int:
        """Cells to open for ``k`` neighbours among ``kept`` of all rows; the sample is thinner than the table."""
        want = k * self.total / max(1, kept) * min(1.0, self.sample / max(1, self.total))
        return next((cells for neighbours, cells in self.reach if neighbours >= want), len(self.centroids))


def _unit(m):
    import numpy as np

    size = np.sqrt((m * m).sum(1, keepdims=True))
    return np.divide(m, size, out=np.zeros_like(m), where=size > 0)


def _fitted(sample, cells: int, rounds: int = 12):
    """(centroids, reach) of unit vectors: spherical k-means from evenly spread starts; an empty cell keeps its centroid."""
    import numpy as np

    centre = sample[np.linspace(0, len(sample) - 1, cells).astype(int)].copy()
    for _ in range(rounds):
        near = (sample @ centre.T).argmax(1)
        total = np.zeros_like(centre)
        np.add.at(total, near, sample)
        moved = _unit(total)
        used = (moved != 0).any(1)
        centre[used] = moved[used]
    near = (sample @ centre.T).argmax(1)
    asks = sample[:: max(1, len(sample) // PROBE_ASKS)][:PROBE_ASKS]
    alike = np.sort(asks @ sample.T, axis=1)
    order = np.argsort(-(asks @ centre.T), axis=1)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(cells)[None, :].repeat(len(asks), 0), 1)
    reach, k = [], min(NEIGHBOURS, len(sample))
    while k <= len(sample) and (not reach or reach[-1][1] < cells):
        # the places in a query's order of cells at which its neighbours are found
        who, which = np.nonzero(asks @ sample.T >= alike[:, -k][:, None])
        found = np.sort(place[who, near[which]])
        reach.append((k, int(found[min(len(found) - 1, math.ceil(TARGET * len(found)))]) + 1))
        k *= 2
    return centre, reach


def build(vectors: DataFrame, cells: int | None = None) -> VectorIndex:
    """``vectors``: (id, v, further columns). Vectors that are null, without length or of another dimension than the
    sample's first are in no cell, as they are near nothing."""
    import numpy as np

    usable = vectors.where("v is not null and size(v) > 0")
    n = usable.count()
    spark = vectors.sparkSession
    some = usable.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("id", F.col("v").cast("array<double>").alias("v"))
    want = max(1, min(cells or math.ceil(math.sqrt(max(1, n))), MOST_CELLS))

    def fit(batches):
        import pyarrow as pa

        parts = [_matrix(b.column(1))[1] for b in batches]
        dim = next((p.shape[1] for p in parts if len(p)), 0)
        m = _unit(np.concatenate([p for p in parts if p.shape[1] == dim])) if dim else np.zeros((0, 0))
        m = m[(m != 0).any(1)]
        if len(m):
            centre, reach = _fitted(m, min(want, len(m)))
            told = pa.array([[len(m), *(x for pair in reach for x in pair)]] * len(centre), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([told, pa.array(list(centre), pa.list_(pa.float64()))], ["told", "centre"])

    got = some.coalesce(1).mapInArrow(fit, "told array<int>, centre array<double>").collect()  # at most MOST_CELLS rows
    centre = np.array([r["centre"] for r in got]) if got else np.zeros((0, 0))
    shared = spark.sparkContext.broadcast(centre)
    extra = [c for c in vectors.columns if c not in ("id", "v")]

    def file(batches):
        import pyarrow as pa

        c = shared.value
        for b in batches:
            use, m = _matrix(b.column(1), c.shape[1])
            use = [u for u, ok in zip(use, (m != 0).any(1)) if ok] if len(use) else []
            m = m[(m != 0).any(1)] if len(m) else m
            cell = (_unit(m) @ c.T).argmax(1) if len(use) else np.zeros(0)
            at = pa.array(use, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), *[col.take(at) for col in b.columns]], ["cell", "id", "v", *extra])

    plain = usable.select("id", F.col("v").cast("array<double>").alias("v"), *extra)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema.fields)
    filed = plain.mapInArrow(file, f"cell int, {schema}") if len(centre) else plain.limit(0).withColumn("cell", F.lit(0)).select("cell", "id", "v", *extra)
    filed = stored(filed.withColumn("v", F.col("v").cast("array<float>")) if vectors.schema["v"].dataType.simpleString() == "array<float>" else filed, "vectors-filed")
    counts = stored(filed.groupBy("cell").agg(F.count("*").alias("n")).withColumn("pieces", F.ceil(F.col("n") / PIECE).cast("int")), "vectors-cells")
    dealt = filed.join(F.broadcast(counts.drop("n")), "cell").withColumn("piece", F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int")).drop("pieces")
    # by cell: a search reads the row groups of the cells that it opens
    rows = stored(dealt.select("cell", "piece", "id", "v", *extra).repartitionByRange("cell", "piece").sortWithinPartitions("cell", "piece"), "vectors-rows")
    told = got[0]["told"] if got else [0]
    return VectorIndex(rows, counts, centre, tuple(zip(told[1::2], told[2::2])), n, told[0])


def _opened(index: VectorIndex, asks: DataFrame, low: int, high: int) -> DataFrame:
    """(q_id, qv, cell): the ``low``-th to ``high``-th nearest cells of each query."""
    import numpy as np

    centre = index.centroids
    kind = asks.schema["q_id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for b in batches:
            use, m = _matrix(b.column(1), centre.shape[1])
            if len(use):
                near = np.argsort(-(_unit(m) @ centre.T), axis=1, kind="stable")[:, low:high]
                at = pa.array(np.repeat(use, near.shape[1]), pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(near.ravel().astype(np.int32))], ["q_id", "qv", "cell"])

    return asks.mapInArrow(run, f"q_id {kind}, qv array<double>, cell int")


def _searched(index: VectorIndex, opened: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """(q_id, id, score): the best ``k`` of each query in each piece of the cells that it opens."""
    opened = stored(opened, "vectors-opened")
    asked = opened.groupBy("cell").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("blocks"))
    each = F.broadcast(index.cells.drop("n").join(asked, "cell"))  # a row a cell
    left = rows.select("cell", "piece", "id", F.col("v").cast("array<double>").alias("v")).join(each.select("cell", "blocks"), "cell")
    left = left.select("cell", "piece", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "id", "v")
    right = opened.join(each.select("cell", F.col("blocks").alias("of"), "pieces"), "cell")
    right = right.select("cell", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"), F.pmod(F.xxhash64("q_id"), F.col("of")).cast("int").alias("block"), "q_id", "qv")
    kinds = {c: df.schema[c].dataType.simpleString() for df, c in ((right, "q_id"), (left, "id"))}

    def meet(a, b):
        import pyarrow as pa

        a, b = a.combine_chunks(), b.combine_chunks()
        out: tuple = ([], [], [])
        if a.num_rows and b.num_rows:
            _, q = _matrix(b.column("qv").combine_chunks())
            _, m = _matrix(a.column("v").combine_chunks())
            out = _nearest(a.column("id").to_pylist(), m, b.column("q_id").to_pylist(), q, k)
        return pa.table({"q_id": pa.array(out[0], b.schema.field("q_id").type), "id": pa.array(out[1], a.schema.field("id").type), "score": pa.array(out[2], pa.float64())})

    return left.groupBy("cell", "piece", "block").cogroup(right.groupBy("cell", "piece", "block")).applyInArrow(meet, f"q_id {kinds['q_id']}, id {kinds['id']}, score double")


def search(index: VectorIndex, queries: DataFrame, k: int, where: Column | None = None) -> DataFrame:
    """(q_id, id, score, rank): of the rows that ``where`` keeps, the nearest ``k`` in the cells opened for each query.

    ``queries``: (q_id, qv). A query with fewer than ``k`` rows opens further cells, twice as many a round."""
    total = len(index.centroids)
    rows = index.rows if where is None else index.rows.where(where)
    asks = queries.where("qv is not null").select("q_id", F.col("qv").cast("array<double>").alias("qv"))
    low, high = 0, index.probes(k, index.total if where is None else rows.count())
    if not total:
        return top_k(asks.join(rows.select("id", F.lit(0.0).alias("score")), F.lit(False)).select("q_id", "id", "score"), k, ["q_id"])
    found = stored(_searched(index, _opened(index, asks, 0, high), rows, k), "vectors-found")
    while high < total:
        short = asks.join(found.groupBy("q_id").agg(F.count("*").alias("n")).where(F.col("n") >= k), "q_id", "left_anti")
        short = stored(short, "vectors-short")
        if not short.limit(1).count():
            break
        low, high = high, min(total, 2 * high)
        found = stored(found.unionByName(_searched(index, _opened(index, short, low, high), rows, k)), "vectors-found")
    return top_k(found, k, ["q_id"])
