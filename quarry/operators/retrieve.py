"""Ranked retrieval for a batch of queries: BM25, term frequency, cosine, fusion, reranking, deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import CONFIG
from ..functions import scoring, text
from ..workspace import stored, trimmed
from .index import LexicalIndex


def bounded(df: DataFrame, rows: int = CONFIG.broadcast_rows) -> DataFrame:
    """``df`` with a broadcast hint only if its counted rows are below the bound."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def hashed(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` as the side of a join that is held as a hash table, by every task where its counted rows are below the bound,
    else a share by each: the other side, wide rows such as texts, is never sorted."""
    rows = CONFIG.broadcast_rows if rows is None else rows
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df.hint("shuffle_hash")


def top_k(ranked: DataFrame, k: int, by: list[str], score: str = "score", tie: str = "id", rank: str = "rank") -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc(score), F.asc(tie))
    return ranked.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


#: Weights of query terms that are sent to each task, documents that it reads at once, scores of a block of them, triples
#: (document, term, query) and hits that it holds at once.
WEIGHTS, DOCUMENTS, SCORES, TRIPLES, HITS = 1_000_000, 1024, 500_000, 500_000, 250_000


def _weights(index: LexicalIndex, queries: DataFrame, k1: float) -> DataFrame:
    """(q_id, by..., term, w, avgdl): what a term of a query counts. Repeated query terms count again."""
    by = list(index.by)
    wanted = queries.select("q_id", F.explode(text.tokens(F.col("text"))).alias("term")).groupBy("q_id", "term").agg(F.count("*").alias("qtf"))
    df = index.terms.join(index.stats, by) if by else index.terms.crossJoin(F.broadcast(index.stats))  # one row of statistics
    idf = F.log(1.0 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return stored(wanted.join(df, "term").select("q_id", *by, "term", (idf * F.col("qtf") * (k1 + 1.0)).alias("w"), "avgdl"), "query-terms")


def _summed(index: LexicalIndex, weights: DataFrame, k1: float, b: float) -> DataFrame:
    by = list(index.by)
    met = index.postings.join(bounded(weights), [*by, "term"])
    if index.dead is not None:
        met = met.join(bounded(index.dead), "id", "left").where("upto is null or segment >= upto")
    part = F.col("w") * F.col("tf") / (F.col("tf") + k1 * (1.0 - b + b * F.col("dl") / F.col("avgdl")))
    return met.groupBy("q_id", *by, "id").agg(F.round(F.sum(part), 6).alias("score"))


def bm25_scores(index: LexicalIndex, queries: DataFrame, k1: float = CONFIG.k1, b: float = CONFIG.b) -> DataFrame:
    """(q_id, by..., id, score) of every document that holds a query term; statistics are of the whole corpus (or of
    each ``by`` group), whatever is filtered afterwards. ``queries``: (q_id, text); repeated query terms count again."""
    return _summed(index, _weights(index, queries, k1), k1, b)


def bm25_topk(index: LexicalIndex, queries: DataFrame, k: int, ids: DataFrame | None = None, k1: float = CONFIG.k1, b: float = CONFIG.b) -> DataFrame:
    """(q_id, by..., id, score, rank): the ``k`` best of ``bm25_scores`` for each query (and each ``by`` group), of the
    documents ``ids(id)`` if given.

    Queries of one text are one. Documents are scored where they lie, all their terms at once, and a task hands on the best
    ``k`` of its documents, so no score of another document is shuffled. Up to ``WEIGHTS`` counted weights of query terms
    are sent to each task; more are joined with the postings."""
    by = list(index.by)
    queries = queries.groupBy("q_id").agg(F.array_join(F.array_sort(F.collect_list("text")), " ").alias("text"))
    texts = stored(queries.groupBy("text").agg(F.min("q_id").alias("q_id")), "query-texts")
    weights = _weights(index, texts, k1)
    if not index.plain or weights.limit(WEIGHTS + 1).count() > WEIGHTS:
        scored = _summed(index, weights, k1, b)
        scored = scored if ids is None else scored.join(ids, "id", "left_semi")
    else:
        scored = _best(index, weights, k, ids, k1, b)
    best = top_k(scored, k, ["q_id", *by])
    same = queries.select("q_id", "text").join(texts.withColumnRenamed("q_id", "of"), "text").select("q_id", "of")
    return best.withColumnRenamed("q_id", "of").join(same, "of").select("q_id", *by, "id", "score", "rank")


def _best(index: LexicalIndex, weights: DataFrame, k: int, ids: DataFrame | None, k1: float, b: float) -> DataFrame:
    """(q_id, by..., id, score): the ``k`` best documents of each task for each query (and each ``by`` group)."""
    import numpy as np
    import pyarrow as pa

    by, spark = list(index.by), weights.sparkSession
    group = lambda: F.concat_ws("\0", *[F.col(c).cast("string") for c in by]) if by else F.lit("")
    t = weights.withColumn("group", group()).toArrow().combine_chunks()  # at most WEIGHTS rows
    encoded = {c: t.column(c).combine_chunks().dictionary_encode() if t.num_rows else None for c in ("q_id", "group", "term")}
    docs = index.documents.withColumn("group", group())
    docs = docs if not by else docs.where(" and ".join(f"`{c}` is not null" for c in by))
    kinds = {c: index.documents.schema[c].dataType.simpleString() for c in ["id", *by]} | {"q_id": weights.schema["q_id"].dataType.simpleString()}
    names = ["q_id", *by, "id"]
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", score double"
    if not t.num_rows:
        return spark.createDataFrame([], schema)
    code = {c: e.indices.to_numpy(zero_copy_only=False).astype(np.int64) for c, e in encoded.items()}
    n_terms = len(encoded["term"].dictionary)
    at = code["group"] * n_terms + code["term"]
    order = np.argsort(at, kind="stable")
    rows, first = np.unique(at[order], return_index=True)
    each = np.unique(code["group"], return_index=True)[1]
    shared = spark.sparkContext.broadcast({
        "terms": encoded["term"].dictionary, "groups": encoded["group"].dictionary, "q": encoded["q_id"].dictionary, "rows": rows, "ends": np.append(first, len(order)),
        "of": code["q_id"][order], "w": t.column("w").to_numpy()[order], "avgdl": t.column("avgdl").to_numpy()[each].astype(float), "by": t.select(by).take(pa.array(each)) if by else None,
    })

    def shrink(batches):
        """Documents with the codes of their query terms only."""
        import pyarrow.compute as pc

        known = shared.value
        for x in (b.slice(i, DOCUMENTS) for b in batches for i in range(0, b.num_rows, DOCUMENTS)):
            terms, tfs = x.column("terms"), x.column("tfs")
            where = pc.index_in(terms.flatten(), value_set=known["terms"])
            keep = where.is_valid().to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.cumsum(pc.fill_null(terms.value_lengths(), 0).to_numpy(zero_copy_only=False))])
            ends = np.concatenate([[0], np.cumsum(keep)])[ends]
            g = pc.index_in(x.column("group"), value_set=known["groups"])
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), v) for v in (where.drop_null(), tfs.flatten().filter(pa.array(keep)))]
            out = pa.RecordBatch.from_arrays([x.column("id"), g, x.column("dl"), *lists, *[x.column(c) for c in more]], ["id", "g", "dl", "codes", "tfs", *more])
            yield out.filter(pc.and_(pa.array(np.diff(ends) > 0), g.is_valid()))

    more = ["segment"] if index.dead is not None else []
    whole = docs.select("id", "group", "dl", "terms", "tfs", *more)
    held = whole.mapInArrow(trimmed(shrink), f"id {kinds['id']}, g int, dl long, codes array<int>, tfs array<long>" + ", segment int" * len(more))
    if index.dead is not None:
        held = held.join(bounded(index.dead), "id", "left").where("upto is null or segment >= upto").drop("upto", "segment")
    if ids is not None:
        held = held.join(ids, "id", "left_semi")

    def score(batches):
        known = shared.value
        nq, pending = len(known["q"]), 0
        least = np.full(nq * len(known["groups"]), -np.inf)
        buffer: list = []

        def settle():
            """The best ``k`` of each query and group among the hits so far."""
            slot, s, doc = (np.concatenate([h[i] for h in buffer]) for i in range(3))
            o = np.lexsort((doc, -s, slot))
            slot, s, doc = slot[o], s[o], doc[o]
            start = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))
            place = np.arange(len(slot)) - np.repeat(start, np.diff(np.append(start, len(slot))))
            least[slot[place == k - 1]] = s[place == k - 1]
            best = place < k
            buffer[:] = [(slot[best], s[best], doc[best])]

        for x in (b.slice(i, DOCUMENTS) for b in batches for i in range(0, b.num_rows, DOCUMENTS)):
            kind = x.schema.field("id").type
            mine = x.column("id").to_numpy(zero_copy_only=False)
            mine = mine if mine.dtype != object else mine.astype(str)
            g, dl = (x.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("g", "dl"))
            n = x.column("codes").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            doc = np.repeat(np.arange(len(n)), n)
            tf = x.column("tfs").flatten().to_numpy(zero_copy_only=False).astype(float)
            key = g[doc] * len(known["terms"]) + x.column("codes").flatten().to_numpy(zero_copy_only=False)
            row = np.minimum(np.searchsorted(known["rows"], key), len(known["rows"]) - 1)
            ok = known["rows"][row] == key
            doc, tf, row = doc[ok], tf[ok], row[ok]
            part = tf / (tf + k1 * (1.0 - b + b * dl[doc] / known["avgdl"][g[doc]]))
            many = known["ends"][row + 1] - known["ends"][row]
            # blocks of documents with a bounded number of scores and of triples
            before = np.concatenate([[0], np.cumsum(np.bincount(doc, many, len(n)))])
            low, most = 0, max(1, SCORES // nq)
            while low < len(n):
                high = min(len(n), low + most, max(low + 1, int(np.searchsorted(before, before[low] + TRIPLES, "right")) - 1))
                a, z = np.searchsorted(doc, [low, high])
                of = np.repeat(known["ends"][row[a:z]] - np.concatenate([[0], np.cumsum(many[a:z])[:-1]]), many[a:z]) + np.arange(int(many[a:z].sum())) if z > a else np.zeros(0, int)
                if len(of):
                    cell = np.repeat(doc[a:z] - low, many[a:z]) * nq + known["of"][of]
                    got = np.bincount(cell, known["w"][of] * np.repeat(part[a:z], many[a:z]), (high - low) * nq)
                    hit = np.flatnonzero(got)
                    s, slot = np.round(got[hit], 6), g[low + hit // nq] * nq + hit % nq
                    good = s >= least[slot]
                    buffer.append((slot[good], s[good], mine[low + hit[good] // nq]))
                    pending += int(good.sum())
                    if pending > HITS:
                        settle()
                        pending = 0
                low = high
        if buffer:
            settle()
            slot, s, doc = buffer[0]
            for i in range(0, len(slot), 100_000):
                j = slot[i : i + 100_000]
                groups = [known["by"].column(c).combine_chunks().take(pa.array(j // nq)) for c in by]
                yield pa.RecordBatch.from_arrays([known["q"].take(pa.array(j % nq)), *groups, pa.array(doc[i : i + 100_000], kind), pa.array(s[i : i + 100_000])], [*names, "score"])

    if ids is None and index.dead is None:
        return whole.mapInArrow(trimmed(lambda batches: score(shrink(batches))), schema)
    return held.mapInArrow(trimmed(score), schema)


def holding_documents(index: LexicalIndex, docs: DataFrame, passages: DataFrame, most: int | None = None) -> DataFrame:
    """(q_id, id): documents (id, text) whose text holds a passage (q_id, passage), by the index of these documents.

    A whole word of the passage (not its first or last, which may be part of a longer one) is a term of every document
    that holds it: the documents of the rarest such term are the candidates, and only they are searched. For passages of one or
    two words all terms that hold their longest word stand in for it. A passage without a letter or digit has none. Candidates
    and passages are broadcast up to ``most`` rows, and hashed by shares beyond."""
    from . import gram_index

    words = text.raw_words(F.lower("passage"))
    asked = stored(passages.select("q_id", "passage", words.alias("words")).where(F.size("words") > 0), "passages")
    rare = asked.where(F.size("words") > 2).select("q_id", F.explode(F.slice("words", 2, F.size("words") - 2)).alias("term")).distinct()
    rare = rare.join(index.terms, "term").groupBy("q_id").agg(F.min(F.struct("df", "term")).alias("x")).select("q_id", "x.term")
    short = asked.where(F.size("words") <= 2)
    if short.limit(1).count():
        grams = gram_index.build(index.terms.select(F.col("term").alias("id"), "term"), ("term",))
        longest = F.array_max(F.transform("words", lambda w: F.struct(F.char_length(w).alias("n"), w.alias("w"))))["w"]
        part = short.select("q_id", longest.alias("p"))
        rare = rare.unionByName(part.join(gram_index.holding(grams, part.select("p")), "p").select("q_id", F.col("id").alias("term")))
    met = stored(index.postings.join(bounded(stored(rare, "passage-terms")), "term").select("q_id", "id").distinct(), "passage-candidates")
    found = docs.join(hashed(met, most), "id").join(hashed(asked.select("q_id", "passage"), most), "q_id")
    return found.where(F.contains("text", F.col("passage"))).select("q_id", "id").distinct()


def tf_search(docs: DataFrame, query: str, limit: int, id_col: str, text_col: str) -> DataFrame:
    """Documents that hold every word of the query, by term frequency."""
    from ..functions.predicates import all_words

    words = [w for w in query.lower().split() if len(w) >= 2]
    hit = docs.where(all_words(F.col(text_col), query))
    return hit.select(F.col(id_col).alias("id"), F.round(text.term_frequency(F.col(text_col), words), 6).alias("score")).orderBy(F.desc("score"), "id").limit(limit)


def phrase_search(docs: DataFrame, query: str, limit: int, id_col: str, text_col: str) -> DataFrame:
    """Documents that hold the whole query, whatever the case, by its occurrences per byte."""
    low = F.lower(F.col(text_col))
    hits = (F.char_length(low) - F.char_length(F.replace(low, F.lit(query.lower()), F.lit("")))) / len(query)
    score = F.greatest(F.lit(0.01), F.least(F.lit(1.0), hits / (F.octet_length(low) + 1) * 1000))
    found = docs.where(F.contains(low, F.lit(query.lower()))).select(F.col(id_col).alias("id"), F.round(score, 6).alias("score"))
    return found.orderBy(F.desc("score"), "id").limit(limit)


#: Queries and rows of a block of a vector search, and of the products of which a block is made. A worker holds one block of
#: each and one product: 4 MB of rows of 64 numbers and 2 MB of likenesses, however many rows and queries there are.
QUERY_BLOCK, ROW_BLOCK, QUERY_STEP, ROW_STEP = 4096, 8192, 128, 2048


def _closest(place, rows, queries, k: int):
    """Arrays (query, row, likeness) of the ``k`` nearest rows of each query in a block, ties by ``place``. Vectors without
    length are near nothing. At most ``QUERY_STEP`` times ``ROW_STEP`` likenesses are held at once."""
    import numpy as np

    out: tuple[list, list, list] = ([np.zeros(0, int)], [np.zeros(0, int)], [np.zeros(0)])
    size = lambda m: np.sqrt(np.concatenate([(x * x).sum(1) for x in np.array_split(m, -(-len(m) // ROW_STEP))])) if len(m) else np.zeros(0)
    long, wide = size(rows), size(queries)
    for q in range(0, len(queries) if len(rows) else 0, QUERY_STEP):
        some = queries[q : q + QUERY_STEP]
        who, near, likes = (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        least = np.full(len(some), -np.inf)
        for r in range(0, len(rows), ROW_STEP):
            with np.errstate(divide="ignore", invalid="ignore"):
                sim = some @ rows[r : r + ROW_STEP].T
                sim /= wide[q : q + QUERY_STEP, None] * long[None, r : r + ROW_STEP]
            np.round(sim, 6, out=sim)
            sim[np.isnan(sim)] = -np.inf
            if sim.shape[1] > k:
                least = np.maximum(least, np.partition(sim, -k, 1)[:, -k])
            i, j = np.nonzero((sim >= least[:, None]) & (sim > -np.inf))
            who, near, likes = np.concatenate([who, i]), np.concatenate([near, j + r]), np.concatenate([likes, sim[i, j]])
            # the best so far, ties by id
            o = np.lexsort((place[near], -likes, who))
            who, near, likes = who[o], near[o], likes[o]
            start = np.searchsorted(who, np.arange(len(some)))
            best = np.arange(len(who)) - start[who] < k
            who, near, likes = who[best], near[best], likes[best]
            full = np.flatnonzero(np.bincount(who, minlength=len(some)) == k)
            least[full] = likes[np.searchsorted(who, full, "right") - 1]
        for c, x in zip(out, (who + q, near, likes)):
            c.append(x)
    return tuple(np.concatenate(c) for c in out)


def _nearest(ids: list, rows, q_ids: list, queries, k: int):
    """``_closest`` of lists of ids, ties by id: lists (q_id, id, score)."""
    import numpy as np

    place = np.empty(len(ids), int)
    place[sorted(range(len(ids)), key=ids.__getitem__)] = np.arange(len(ids))
    who, near, likes = _closest(place, rows, queries, k)
    return [q_ids[i] for i in who.tolist()], [ids[j] for j in near.tolist()], likes.tolist()


def _matrix(column, dim: int | None = None):
    """(rows that have vectors of the dimension, their matrix) of a list array."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    dim = dim if dim is not None else int(next(iter(size[size > 0]), 0))
    use = np.flatnonzero(size == dim) if dim else np.zeros(0, int)
    if not len(use):
        return [], np.zeros((0, dim))
    flat = (column if len(use) == len(column) else column.take(pa.array(use))).flatten().to_numpy(zero_copy_only=False)
    return use.tolist(), flat.astype(np.float64, copy=False).reshape(len(use), dim)


def cosine_topk(vectors: DataFrame, queries: DataFrame, k: int, by: str | None = None) -> DataFrame:
    """(q_id[, by], id, score, rank): exact. ``vectors``: (id, v); ``queries``: (q_id, qv), a stated set, against all rows;
    with ``by``, a column of the vectors, the nearest ``k`` of each of its values.

    Up to ``QUERY_BLOCK`` counted queries are sent to each task; more are dealt to blocks, as the rows are, and each
    block of rows meets each block of queries. Blocks are matrix products that keep their nearest ``k``."""
    import numpy as np

    spark = vectors.sparkSession
    part = F.lit(0) if by is None else F.col(by)
    # single numbers are widened where they are multiplied
    wide = lambda df, c: F.col(c) if df.schema[c].dataType.simpleString() == "array<float>" else F.col(c).cast("array<double>").alias(c)
    vs = vectors.select("id", wide(vectors, "v"), part.alias("part"))
    qs = queries.select("q_id", wide(queries, "qv"))
    schema = f"q_id {qs.schema['q_id'].dataType.simpleString()}, part {vs.schema['part'].dataType.simpleString()}, id {vs.schema['id'].dataType.simpleString()}, score double"

    def meet(ids, v, parts, by_dim):
        """Record batches (q_id, part, id, score) of a block of rows and queries by dimension."""
        import pyarrow as pa
        import pyarrow.compute as pc

        place = np.empty(len(ids), int)
        place[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))
        for dim, (q_ids, q) in by_dim.items():
            use, m = _matrix(v, dim)
            use = np.array(use, int)
            of = parts.take(pa.array(use)).dictionary_encode(null_encoding="encode")
            name = of.indices.to_numpy(zero_copy_only=False)
            for n in range(len(of.dictionary)):
                at = np.flatnonzero(name == n) if len(of.dictionary) > 1 else slice(None)
                mine = use[at]
                who, near, likes = _closest(place[mine], m[at], q, k)
                yield pa.RecordBatch.from_arrays([q_ids.take(pa.array(who)), of.dictionary.take(pa.array(np.full(len(who), n))), ids.take(pa.array(mine[near])), pa.array(likes)], ["q_id", "part", "id", "score"])

    ranked = lambda df: top_k(df.drop("part") if by is None else df.withColumnRenamed("part", by), k, ["q_id"] + ([] if by is None else [by]))
    few = qs.limit(QUERY_BLOCK + 1).toArrow()  # at most a block
    if few.num_rows <= QUERY_BLOCK:
        few = few.combine_chunks()
        q_ids, qv = (few.column(c).combine_chunks() for c in ("q_id", "qv"))
        shared = spark.sparkContext.broadcast(_by_dim(q_ids, qv))

        def search(batches):
            for b in (x.slice(i, ROW_BLOCK) for x in batches for i in range(0, x.num_rows, ROW_BLOCK)):
                yield from meet(b.column(0), b.column(1), b.column(2), shared.value)

        return ranked(vs.mapInArrow(trimmed(search), schema))
    rows, asked = max(1, -(-vs.count() // ROW_BLOCK)), -(-qs.count() // QUERY_BLOCK)
    left = vs.select(F.pmod(F.xxhash64("id"), F.lit(rows)).alias("r"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(asked - 1).cast("long"))).alias("q"), "id", "v", "part")
    right = qs.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(rows - 1).cast("long"))).alias("r"), F.pmod(F.xxhash64("q_id"), F.lit(asked)).alias("q"), "q_id", "qv")

    def cell(a, b):
        import pyarrow as pa

        one = lambda t, c: t.column(c).combine_chunks()
        kinds = pa.schema([("q_id", b.schema.field("q_id").type), ("part", a.schema.field("part").type), ("id", a.schema.field("id").type), ("score", pa.float64())])
        got = list(trimmed(lambda _: meet(one(a, "id"), one(a, "v"), one(a, "part"), _by_dim(one(b, "q_id"), one(b, "qv"))))(None)) if a.num_rows and b.num_rows else []
        return pa.Table.from_batches([x.cast(kinds) for x in got], kinds)

    return ranked(left.groupBy("r", "q").cogroup(right.groupBy("r", "q")).applyInArrow(cell, schema))


def _by_dim(q_ids, qv) -> dict:
    """The queries' ids and vectors by dimension."""
    import pyarrow as pa
    import pyarrow.compute as pc

    out = {}
    for dim in pc.unique(pc.list_value_length(qv)).to_pylist():
        if dim:
            use, m = _matrix(qv, dim)
            out[dim] = (q_ids.take(pa.array(use, pa.int64())), m)
    return out


def rrf(channels: DataFrame, weights: dict[str, float], limit: int, k: int = CONFIG.rrf_k) -> DataFrame:
    """Reciprocal-rank fusion of (q_id, channel, id, score): score, and each channel's score and rank."""
    w = Window.partitionBy("q_id", "channel").orderBy(F.desc("score"), F.asc("id"))
    ranked = channels.withColumn("r", F.row_number().over(w))
    weight = F.create_map(*[x for c, v in weights.items() for x in (F.lit(c), F.lit(v))])
    out = ranked.groupBy("q_id", "id").agg(
        F.round(F.sum(weight[F.col("channel")] / (k + F.col("r"))), 8).alias("score"),
        *[F.max(F.when(F.col("channel") == c, F.col("score"))).alias(f"{c}_score") for c in weights],
    )
    return top_k(out, limit, ["q_id"])


def keep_best(rows: DataFrame, key: Column, by: list[str], score: str = "score", tie: str = "id") -> DataFrame:
    """One row for each key, the best-scored."""
    w = Window.partitionBy(*by, "_k").orderBy(F.desc(score), F.asc(tie))
    return rows.withColumn("_k", key).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_k", "_n")


def ordered_union(first: DataFrame, second: DataFrame, by: list[str]) -> DataFrame:
    """Both lists of (by, id, rank): the first's ids in order, then those of the second that it lacks."""
    both = first.select(*by, "id", F.lit(0).alias("src"), "rank").unionByName(second.select(*by, "id", F.lit(1).alias("src"), "rank"))
    one = both.groupBy(*by, "id").agg(F.min(F.struct("src", "rank")).alias("at"))
    w = Window.partitionBy(*by).orderBy("at.src", "at.rank", "id")
    return one.select(*by, "id", F.col("at.src").alias("src"), F.row_number().over(w).alias("rank"))


def rerank_memory(fused: DataFrame, mem: DataFrame, as_of: Column) -> DataFrame:
    """Fused ids with importance and decay applied; ids are joined back to their rows only after the cut."""
    rows = fused.join(mem, "id")
    age = scoring.age_days(F.coalesce("event_time", "ingestion_time"), as_of)
    dec = scoring.decay(age, F.col("access_count"), F.col("memory_type"))
    return rows.withColumn("fused", F.col("score")).withColumn("score", F.round(F.col("score") * scoring.importance_boost(F.col("importance_score")) * dec * (1 + scoring.reinforcement(F.col("access_count"))), 8))


def graph_channel(ordered: DataFrame, nodes: DataFrame, edges: DataFrame, seeds: int = 20) -> DataFrame:
    """(q_id, id, score): PageRank on the subgraph that the candidates of each query induce.

    ``ordered``: (q_id, id, rank), a bounded list for each query, so each query's graph is iterated by one task;
    ``nodes``: (node) of the graph; ``edges``: (src, dst, weight). The first ``seeds`` candidates that are nodes are the
    seeds; without one there are no scores."""
    kind = ordered.schema["id"].dataType.simpleString()
    mine = stored(ordered.join(nodes.select(F.col("node").alias("id")).distinct(), "id", "left_semi").select("q_id", "id", "rank"), "graph-candidates")
    ends = lambda c: mine.select("q_id", F.col("id").alias(c))
    inner = edges.join(ends("src"), "src").join(ends("dst"), ["q_id", "dst"]).select("q_id", "src", "dst", F.col("weight").cast("double").alias("weight"), F.lit(None).cast("int").alias("rank"))
    rows = inner.unionByName(mine.select("q_id", F.col("id").alias("src"), F.lit(None).cast(kind).alias("dst"), F.lit(None).cast("double").alias("weight"), F.col("rank").cast("int").alias("rank")))

    def run(key, table):
        import numpy as np
        import pyarrow as pa

        from .graph import iterate

        t = table.to_pandas()
        at = {n: i for i, n in enumerate(sorted(t.loc[t["rank"].notna(), "src"]))}
        e = t[t["rank"].isna()]
        start = [at[n] for n in t[(t["rank"] <= seeds)]["src"]]
        if not start:
            return pa.table({"q_id": [], "id": [], "score": []}, schema=out)
        r, degree = iterate(e["src"].map(at).to_numpy(np.int64), e["dst"].map(at).to_numpy(np.int64), e["weight"].to_numpy(np.float64), len(at), start, CONFIG.ppr_iterations, CONFIG.ppr_damping, CONFIG.ppr_tolerance)
        return pa.table({"q_id": [key[0].as_py()] * len(at), "id": list(at), "score": r / np.sqrt(np.maximum(degree, 1))}, schema=out)

    from pyspark.sql.pandas.types import to_arrow_schema

    text_schema = f"q_id {ordered.schema['q_id'].dataType.simpleString()}, id {kind}, score double"
    out = to_arrow_schema(spark_schema(text_schema))
    return rows.groupBy("q_id").applyInArrow(run, text_schema)


def spark_schema(text_schema: str):
    from pyspark.sql.types import _parse_datatype_string

    return _parse_datatype_string(text_schema)


def single_channel(ranked: DataFrame, mem: DataFrame, limit: int, as_of: Column, min_score: float | None = None) -> DataFrame:
    """Search by one channel: (q_id, id, base, score, rank) without repeats of a content; the channel's score (above 1: 1)
    times decay and reinforcement orders them anew, weak ones are cut after the limit.

    ``ranked``: (q_id, id, score), already filtered and cut to the channel's fetch."""
    rows = ranked.join(mem, "id").withColumn("base", F.least(F.lit(1.0), F.col("score")))
    best = keep_best(rows, text.dedup_key(F.col("content"), F.col("content_hash")), ["q_id"], "base")
    age = scoring.age_days(F.coalesce("event_time", "ingestion_time"), as_of)
    scored = best.withColumn("score", F.round(scoring.decayed(F.col("base"), F.coalesce(age, F.lit(0.0)), F.col("access_count"), F.col("memory_type")), 8))
    out = top_k(scored, limit, ["q_id"]).select("q_id", "id", "base", "score", "rank")
    return out if min_score is None else out.where(F.col("score") >= max(0.0, min(1.0, min_score)))


def recall(
    mem: DataFrame, index: LexicalIndex, queries: DataFrame, vectors: DataFrame, query_vectors: DataFrame, where: Column, as_of: Column, limit: int, graph: tuple[DataFrame, DataFrame] | None = None,
    min_score: float | None = None, weights: tuple[float, float, float] = CONFIG.memory_weights,
) -> DataFrame:
    """Hybrid recall for a batch: vector, lexical and graph channels, fusion, rerank, dedup, least score.

    ``graph``: (nodes, edges) of the entities; the vector candidates in order, then the lexical ones, seed it."""
    from ..config import overfetch

    fetch, ok = overfetch(limit, True), mem.where(where).select("id")
    lexical = stored(bm25_topk(index, queries, fetch, ok), "recall-lexical")
    vector = stored(cosine_topk(vectors.join(ok, "id", "left_semi"), query_vectors, fetch).select("q_id", "id", "score", "rank"), "recall-vector")
    tag = lambda df, c: df.select("q_id", F.lit(c).alias("channel"), "id", "score")
    every = tag(lexical, "bm25").unionByName(tag(vector, "vector"))
    if graph is not None:
        every = every.unionByName(tag(graph_channel(ordered_union(vector, lexical, ["q_id"]), *graph), "ppr"))
    v, b, p = weights
    fused = rrf(every, {"vector": v, "bm25": b, "ppr": p}, limit).drop("rank")
    scored = rerank_memory(fused, mem, as_of)
    best = keep_best(scored, text.dedup_key(F.col("content"), F.col("content_hash")), ["q_id"])
    out = top_k(best, limit, ["q_id"])
    if min_score is not None:
        out = out.where(F.col("score") >= max(0.0, min(1.0, min_score)))
    return out.withColumn("channels", scoring.channels(F.col("vector_score"), F.col("bm25_score"), F.col("ppr_score")))
