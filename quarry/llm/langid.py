"""Language ID: multinomial naive Bayes over hashed character n-grams.

``fit`` counts hashed character n-grams of labelled documents on the executors; only the table of counts
(languages x buckets) reaches the driver. ``predict`` broadcasts the log-probability matrix and scores batches as a
sparse document-by-bucket product in numpy.

Defined results: null text or text without a letter is ``und`` with score 0; so is every text if nothing was learned.
Rows with null text or null language teach nothing. Ties go to the alphabetically first language. Texts are scored
whole, in pieces of bounded size (n-grams across their borders included). Input columns other than those named are ignored; repeated rows are judged each.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from ._common import U, tidy

#: At most about this many documents of each language are learned from (chosen by a hash of their id).
FIT_DOCS_PER_LANG = 3000
#: A label set beyond this is not a set of languages, and an error: at this bound the broadcast matrix has 66 MB.
MAX_LANGS = 250
BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
#: n-grams per text beyond which evidence counts no further, for the score only: n-grams are not independent.
TEMPER = 40.0
_PIECE = 1 << 19
_BLOCK = 1 << 21


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...]
    logp: np.ndarray  # (BUCKETS, languages), float32
    prior: np.ndarray


def _grams(text: str):
    """Yield buckets of the character n-grams of the lower-cased text, piece by piece; white space, digits and marks
    count as one boundary."""
    most = max(ORDERS)
    tail = np.zeros(0, U)
    for at in range(0, len(text), _PIECE):
        c = np.frombuffer(text[at : at + _PIECE].lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(U)
        c = np.where((c <= 64) | ((c >= 91) & (c <= 96)) | ((c >= 123) & (c <= 191)), U(1), c)
        c = np.concatenate((tail, c))
        c = c[np.concatenate(([True], (c[1:] != 1) | (c[:-1] != 1)))]
        out, h = [], np.zeros(len(c), U)
        for n in range(1, most + 1):
            if len(c) < n:
                break
            h = h[: len(c) - n + 1] * U(0x9E3779B97F4A7C15) + c[n - 1 :] + U(n)
            if n in ORDERS:
                # those that end before this piece were counted with the last one
                x = h[max(0, len(tail) - n + 1) :] * U(0xD6E8FEB86659FD93)
                out.append((x >> U(48)).astype(np.int64))
        tail = c[1 - most :]
        yield np.concatenate(out)


def _posterior(sums: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    z = sums * np.minimum(1.0, TEMPER * len(ORDERS) / np.maximum(sizes, 1))[:, None]
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def _evidence(m: Model, texts) -> tuple[np.ndarray, np.ndarray]:
    """(log-probabilities of each text, its number of n-grams): the sparse matrix of bucket counts by text times the
    matrix of the model, in blocks of bounded size. Null texts have no n-gram."""
    sums, sizes = np.tile(m.prior.astype(np.float64), (len(texts), 1)), np.zeros(len(texts))
    rows, buckets, held = [], [], 0

    def flush():
        start = np.cumsum([0, *map(len, buckets[:-1])])
        np.add.at(sums, rows, np.add.reduceat(m.logp.take(np.concatenate(buckets), 0), start, 0, np.float64))
        rows.clear()
        buckets.clear()

    for i, t in enumerate(texts):
        for k in _grams(t.as_py()) if t.is_valid else ():
            if len(k):
                rows.append(i)
                buckets.append(k)
                sizes[i] += len(k)
                held += len(k)
            if held * len(m.langs) >= _BLOCK:
                flush()
                held = 0
    if held:
        flush()
    return sums, sizes


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", per_lang: int = FIT_DOCS_PER_LANG) -> Model:
    docs = docs.select(F.col(doc_id).alias("i"), F.col(text).alias("t"), F.col(lang).alias("g")).where("t is not null and g is not null")
    counts = {r["g"]: r["n"] for r in docs.groupBy("g").agg(F.count("*").alias("n")).limit(MAX_LANGS + 1).collect()}
    if len(counts) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    if not counts:
        return Model((), np.zeros((BUCKETS, 0), np.float32), np.zeros(0, np.float32))
    langs = tuple(sorted(counts))
    share = F.create_map(*[x for g in langs for x in (F.lit(g), F.lit(min(1.0, per_lang / counts[g])))])
    unit = F.pmod(F.xxhash64("i", F.lit(7)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    sample = docs.where(unit < share[F.col("g")]).select("g", "t")

    def count(batches):
        import pyarrow as pa

        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for g, t in zip(b.column(0).to_pylist(), b.column(1)):
                acc = sums.setdefault(g, np.zeros(BUCKETS, np.int64))
                for k in _grams(t.as_py()):
                    acc += np.bincount(k, minlength=BUCKETS)
        for g, acc in sums.items():
            k = np.flatnonzero(acc)
            yield pa.RecordBatch.from_arrays([pa.array([g] * len(k), pa.string()), pa.array(k.astype(np.int32)), pa.array(acc[k])], ["g", "k", "c"])

    got = sample.mapInArrow(tidy(count), "g string, k int, c long").groupBy("g", "k").agg(F.sum("c").alias("c")).toPandas()
    table = np.full((BUCKETS, len(langs)), 0.5)
    table[got["k"].to_numpy(), got["g"].map({g: x for x, g in enumerate(langs)}).to_numpy()] += got["c"].to_numpy()
    logp = np.log(table / table.sum(0)).astype(np.float32)
    return Model(langs, logp, np.full(len(langs), -np.log(len(langs)), np.float32))


def predict(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) for every row; score is the tempered posterior of the language."""
    spark = docs.sparkSession
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t"), F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    shared = spark.sparkContext.broadcast(model)

    def score(batches):
        import pyarrow as pa

        m = shared.value
        for b in batches:
            n = b.num_rows
            pred, conf = ["und"] * n, np.zeros(n)
            use = np.flatnonzero(b.column(2).to_numpy(zero_copy_only=False).astype(bool)) if m.langs else ()
            if len(use):
                z = _posterior(*_evidence(m, b.column(1).take(pa.array(use))))
                conf[use] = z.max(1)
                for i, k in zip(use, z.argmax(1)):
                    pred[i] = m.langs[k]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pred), pa.array(conf)], ["doc_id", "lang_pred", "score"])

    return rows.mapInArrow(tidy(score), f"doc_id {kind}, lang_pred string, score double")


def identify(docs: DataFrame, fold: bool = True) -> DataFrame:
    """Fit on the labelled rows outside the held-out fold and judge all rows: doc_id, held_out, lang_pred, score."""
    train = docs.where(~held_out()) if fold else docs
    return predict(docs, fit(train)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, min_score: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose language is known with at least ``min_score``; same columns.

    The classifier learns from the labelled rows of ``docs`` themselves; without any, rows with a letter stay.
    """
    model = fit(docs)
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    if not model.langs:
        return docs.where(letters)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    # only the text goes to Python and only a flag comes back
    @F.arrow_udf("boolean")
    def known(text):
        import pyarrow as pa

        sums, sizes = _evidence(shared.value, text)
        return pa.array((_posterior(sums, sizes).max(1) >= min_score) & text.is_valid().to_numpy(False))

    return docs.where(letters).where(known("text"))
