"""Substring search by an n-gram index: postings of the grams of short texts, range-sorted, met from the rarest on.

Every distinct text is filed once, under its distinct grams of one, two and three characters. A probe of three characters
or more is looked up by its rarest grams of three, a shorter one by itself; texts that hold all of these are candidates,
and the probe is then looked for in each. No probe meets a text with which it shares no gram, so no join is a nested loop.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..workspace import stored
from .retrieve import bounded

LONGEST = 3
#: Grams by which a probe is looked up.
RAREST = 3
#: Texts for which the postings have a range.
RANGE = 20_000


@dataclass(frozen=True)
class GramIndex:
    """``postings``: (gram, text, field), sorted by gram; ``counts``: (gram, n); ``texts``: (text, fields..., n), the distinct
    texts, numbered, with their rows; ``rows``: what was indexed; ``fields``: its text columns."""

    postings: DataFrame
    counts: DataFrame
    texts: DataFrame
    rows: DataFrame
    fields: tuple[str, ...]


def _runs(chars: Column, n: int) -> Column:
    """The runs of ``n`` characters of an array of characters."""
    at = F.when(F.size(chars) >= n, F.sequence(F.lit(0), F.size(chars) - n)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.concat(*[F.get(chars, i + k) for k in range(n)]))


def _chars(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), ""), lambda c: c != "")


def build(rows: DataFrame, fields: tuple[str, ...]) -> GramIndex:
    """``rows``: (id, texts and further columns); null texts hold nothing. Case is ignored."""
    rows = stored(rows, "gram-rows")
    # numbered by their place in the stored table
    each = stored(rows.groupBy(*fields).agg(F.count("*").alias("n")), "gram-distinct")
    texts = stored(each.select(F.monotonically_increasing_id().alias("text"), *fields, "n"), "gram-texts")

    def filed(k: int, f: str) -> Column:
        grams = F.array_distinct(F.concat(*[_runs(F.col(f"_{f}"), n) for n in range(1, LONGEST + 1)]))
        return F.transform(grams, lambda g: F.struct(g.alias("gram"), F.lit(k).cast("byte").alias("field")))

    each = F.flatten(F.array(*[filed(k, f) for k, f in enumerate(fields)]))
    spread = texts.select("text", *[F.coalesce(_chars(F.col(f)), F.array().cast("array<string>")).alias(f"_{f}") for f in fields]).select("text", F.explode(each).alias("x")).select("x.gram", "text", "x.field")
    # ranges of gram and text, of which there are more where there are more texts: the texts of one frequent gram are several ranges
    ranges = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-texts.count() // RANGE))
    postings = stored(spread.repartitionByRange(ranges, "gram", "text").sortWithinPartitions("gram"), "gram-postings")
    return GramIndex(postings, stored(postings.groupBy("gram").agg(F.count("*").alias("n")), "gram-counts"), texts, rows, tuple(fields))


def holding_texts(index: GramIndex, probes: DataFrame) -> DataFrame:
    """(p, text, fields..., n): the indexed texts that hold the probe ``p``, lower-cased and not empty, with their rows."""
    chars = F.col("chars")
    asked = probes.where("p <> ''").select("p").distinct().withColumn("chars", F.filter(F.split("p", ""), lambda c: c != ""))
    grams = F.when(F.size(chars) >= LONGEST, F.array_distinct(_runs(chars, LONGEST))).otherwise(F.array("p"))
    grams = asked.select("p", F.size(grams).alias("of"), F.explode(grams).alias("gram")).join(index.counts, "gram")
    w = Window.partitionBy("p")
    # a gram that no text has leaves its probe without a row
    rare = grams.withColumn("have", F.count("*").over(w)).where("have = of").withColumn("k", F.row_number().over(w.orderBy("n", "gram"))).where(F.col("k") <= RAREST)
    rare = stored(rare.select("p", "gram", F.least("of", F.lit(RAREST)).alias("need")), "gram-wanted")
    met = index.postings.join(bounded(rare), "gram").groupBy("p", "text", "field").agg(F.count("*").alias("n"), F.first("need").alias("need"))
    found = met.where("n = need").select("p", "text").distinct().join(index.texts, "text")
    return found.where(reduce(lambda a, b: a | b, [F.coalesce(F.contains(F.lower(f), F.col("p")), F.lit(False)) for f in index.fields]))


def _of_texts(index: GramIndex, rows: DataFrame, found: DataFrame) -> DataFrame:
    """``found(p, text, ...)`` with the rows of each text."""
    same = reduce(lambda a, b: a & b, [rows[f].eqNullSafe(found[f]) for f in index.fields])
    return rows.join(bounded(found), same).drop(*[found[f] for f in index.fields])


def holding(index: GramIndex, probes: DataFrame) -> DataFrame:
    """(p, all columns of the indexed rows): the rows of which a text holds the probe ``p``, lower-cased and not empty."""
    return _of_texts(index, index.rows, stored(holding_texts(index, probes).select("p", *index.fields), "gram-found"))


def first_holding(index: GramIndex, probes: DataFrame, order: str, most: int, where: Column | None = None, by: tuple[str, ...] = (), total: bool = False) -> DataFrame:
    """(p, all columns of the indexed rows, rank[, total]): the ``most`` first rows by ``order``, one of the texts, and id
    (of each ``by``) that hold each probe, with the number of all. Of equal texts the first rows are taken before a probe
    meets them, so that it meets a text once and not all its rows."""
    rows = index.rows if where is None else index.rows.where(where)
    one = [*by, *index.fields]
    firsts = rows.withColumn("_k", F.row_number().over(Window.partitionBy(*one).orderBy("id"))).where(F.col("_k") <= most)
    found = stored(holding_texts(index, probes).select("p", *index.fields), "gram-found")
    met = stored(_of_texts(index, firsts, found), "gram-hits")
    w = Window.partitionBy("p", *by).orderBy(order, "id")
    page = met.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).drop("_k")
    if not total:
        return page
    sizes = _of_texts(index, rows.groupBy(*one).agg(F.count("*").alias("n")), found).groupBy("p", *by).agg(F.sum("n").alias("total"))
    return page.join(sizes, ["p", *by])


def search(index: GramIndex, queries: DataFrame, order: str, limit: int, offset: int = 0, where: Column | None = None, freshness: DataFrame | None = None) -> DataFrame:
    """(q_id, id, ``order``, rank, total[, freshness]): a page of the rows that hold each query, by ``order`` and id, with
    the number of all. ``queries``: (q_id, query); ``freshness``: (path, freshness) joined by ``file_path``."""
    asked = queries.select("q_id", F.lower("query").alias("p"))
    page = first_holding(index, asked, order, offset + limit, where, total=True).where(F.col("rank") > offset)
    out = asked.join(page.select("p", "id", order, "rank", "total", *(["file_path"] if freshness is not None else [])), "p")
    if freshness is None:
        return out.select("q_id", "id", order, "rank", "total")
    known = freshness.select(F.col("path").alias("file_path"), F.when(F.col("freshness") != "unavailable", F.col("freshness")).alias("freshness"))
    return out.join(known, "file_path", "left").select("q_id", "id", order, "rank", "total", "freshness")
