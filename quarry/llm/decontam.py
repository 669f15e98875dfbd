"""Benchmark decontamination: spaced-seed hashing, in built-in functions.

Fixed masks ignore some token positions; the hashes of the others, taken at every position of benchmark items and of
documents, are joined. A hit fixes a diagonal on which the item's words are compared with the document's; the pair
counts if some window of the item has enough equal words, so substitutions are tolerated.

The masks leave no gap: whichever words of a window are replaced, as long as ``SHARE`` of them is left, some mask fits
at some place (a test tries all patterns). Items of 10 words and more have three masks of weight 5, items of 5 to 9 words
four of weight 4; of fewer words no replaced one leaves the share, so these are sought by their whole sequence.

The items' hashes are broadcast only when their counted size is below ``MAX_BROADCAST``; beyond, the join shuffles.
Distinct diagonals are gathered by document and stretch, its text is split into words once, and the words on each
diagonal meet those of the item.

Defined results: words are lower-cased runs of letters and digits; a character of a script that has no spaces between
words is a word of its own; null texts have none. Items without words give nothing. Rows with the same doc_id (or
item_id, null included) are reported once for each pair of ids. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ._common import bounded, stored

# 1 marks a compared position.
MASKS = ("110111", "11010011", "11111")
SHORT_MASKS = ("1111", "11011", "10111", "11101")
#: From how many words on an item has masks, and the long ones.
SHORT, LONG = 5, 10
#: The window of item words in which matches are counted (or the whole item, if shorter), and the share that must match.
WINDOW, SHARE = 20, 0.8
MAX_BROADCAST = 32 << 20
#: Diagonals of one document that are verified together begin within so many words.
STRETCH = 4096
# Blocks of scripts without spaces between words (Thai to Tibetan, Burmese, Khmer, kana, Han).
_ALONE = "\\u0E00-\\u0FFF\\u1000-\\u109F\\u1780-\\u17FF\\u3040-\\u30FF\\u3400-\\u9FFF\\uF900-\\uFAFF\\x{20000}-\\x{3FFFF}"
_WORD = f"[{_ALONE}&&[\\p{{L}}\\p{{N}}]]|[\\p{{L}}\\p{{N}}&&[^{_ALONE}]]+"


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(_WORD), F.lit(0))


def masks_for(n: int) -> tuple[str, ...]:
    """The masks by which an item of ``n`` words is sought."""
    return MASKS if n >= LONG else SHORT_MASKS if n >= SHORT else ("1" * n,)


def _hashed(df: DataFrame, text: str, keep: list[Column]) -> DataFrame:
    return df.select(*keep, F.transform(words_of(F.col(text)), lambda w: F.xxhash64(w)).alias("h"))


def _let(name: str, value: str, body: str) -> str:
    """SQL that evaluates ``value`` once for all its uses in ``body``, wherever the optimizer moves the expression."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _seeds(h: str, mask: str) -> str:
    at = [f"get({h}, i + {x})" for x, c in enumerate(mask) if c == "1"]
    return f"transform(case when size({h}) >= {len(mask)} then sequence(0, size({h}) - {len(mask)}) else cast(array() as array<int>) end, i -> xxhash64({int(mask, 2)}, {', '.join(at)}))"


def _keys(rows: DataFrame, h: str, masks: list[str], pos: str, keep: list[str]) -> DataFrame:
    """One row for each mask and position: ``keep``, key and ``pos``. (An outer generator: no filter is inferred from it.)"""
    every = rows.selectExpr(*keep, f"size({h}) as _n", _let("a", h, f"concat({', '.join(_seeds('a', m) for m in masks)})") + " as _s")
    flat = every.selectExpr(*keep, "_n", "posexplode_outer(_s) as (_p, key)")
    where, before = "_p", "0"
    for m in masks[:-1]:
        before = f"{before} + greatest(_n - {len(m) - 1}, 0)"
        where = f"case when _p >= {before} then _p - ({before}) else {where} end"
    return flat.where("key is not null").selectExpr(*keep, "key", f"{where} as {pos}")


def _verify(hits: DataFrame) -> DataFrame:
    """hits: doc_id, item_id, ih, diag, part (the document's words on the diagonal) -> those whose best window suffices."""
    same = _let("d", "part", _let("t", "ih", "transform(sequence(0, size(t) - 1), j -> case when get(d, j + least(diag, 0)) = get(t, j) then 1 else 0 end)"))
    w = f"least(size(a), {WINDOW})"
    best = f"array_max(transform(sequence(1, size(a) - {w} + 1), j -> struct(aggregate(slice(a, j, {w}), 0, (s, x) -> s + x) as c, -j as j)))"
    found = _let("a", same, f"struct({best} as best, aggregate(a, 0, (s, x) -> s + x) as matched)")
    hits = hits.selectExpr("doc_id", "item_id", "diag", f"least(size(ih), {WINDOW}) as w", "size(ih) as n", f"{found} as f")
    good = hits.where(F.col("f.best.c") >= F.ceil(F.col("w") * SHARE))
    return good.selectExpr("doc_id", "item_id", "f.best.c / w as share", "f.matched as matched", "n as item_words", "diag - f.best.j - 1 as doc_word")


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, share (best window), matched, item_words, doc_word: a row for each pair that overlaps."""
    items = _hashed(benchmark, "text", [F.col("item_id")]).withColumnRenamed("h", "ih").where("size(ih) > 0")
    sizes = [r["n"] for r in items.select(F.least(F.size("ih"), F.lit(LONG)).alias("n")).distinct().collect()]  # LONG at most
    use = sorted({m for n in sizes for m in masks_for(n)}, key=lambda m: (len(m), m)) or list(MASKS)
    tally = items.agg(F.count("*").alias("c"), F.sum(F.size("ih").cast("double")).alias("s")).first()
    small = (tally["s"] or 0) * len(MASKS) * 64 + tally["c"] * 64 <= MAX_BROADCAST
    sized, index = items.withColumn("len", F.size("ih")), None
    for n in sorted(sizes):  # each item by the masks of its length
        own = _keys(sized.where(F.least("len", F.lit(LONG)) == n), "ih", list(masks_for(n)), "ipos", ["item_id", "len"])
        index = own if index is None else index.unionByName(own)
    if index is None:
        index = _keys(sized, "ih", use, "ipos", ["item_id", "len"])
    # only keys and positions are unfolded, never a document's words: a row for each position would copy them
    seeds = _keys(_hashed(docs, "text", [F.col("doc_id").alias("d")]), "h", use, "pos", ["d"])
    index = index.select(F.col("item_id").alias("t"), "len", "key", "ipos")
    hits = seeds.join(F.broadcast(index) if small else index, "key").selectExpr("d", "t", "len", "pos - ipos as diag").distinct()
    hits = stored(hits, "leak-hits").groupBy("d", F.expr(f"floor(diag / {STRETCH})").alias("s"), F.pmod(F.xxhash64("t"), F.lit(64)).alias("b"))
    hits = stored(hits.agg(F.collect_list(F.struct("t", "len", "diag")).alias("on")), "leak-diagonals")
    near = bounded(hits.select("d", "on"), 20_000).join(docs.select("doc_id", "text"), F.col("d").eqNullSafe(F.col("doc_id")))
    near = _hashed(near, "text", [F.col("doc_id"), F.col("on")])
    cut = _let("a", "h", "transform(on, x -> struct(x.t as t, x.diag as diag, slice(a, greatest(x.diag, 0) + 1, x.len) as part))")
    near = near.selectExpr("doc_id", f"{cut} as cut").selectExpr("doc_id", "explode_outer(cut) as x").where("x is not null").selectExpr("doc_id", "x.t as t", "x.diag as diag", "x.part as part")
    near = near.join(F.broadcast(items) if small else items, F.col("t").eqNullSafe(F.col("item_id")))
    # written before it is grouped: else the optimizer would sort the hits with their word arrays
    best = stored(_verify(near), "leaks").groupBy("doc_id", "item_id").agg(F.max(F.struct("share", "matched", "item_words", (-F.col("doc_word")).alias("at"))).alias("b"))
    return best.select("doc_id", "item_id", "b.share", "b.matched", "b.item_words", (-F.col("b.at")).alias("doc_word"))
