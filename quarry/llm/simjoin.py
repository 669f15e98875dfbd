"""N-gram Jaccard join: exact links between shingle sets, found with signature trees.

1. *Routing*. The sets of linked documents differ in few shingles, so of enough hash-range parts of the sets at least
   one is equal (pigeonhole, by size band) and holds shingles. Each distinct set sends the hashes of its parts to buckets;
   sets with an equal part form a group. Groups of the same members are one.
2. *Signature trees*. The members of a group are leaves of a tree whose nodes hold OR-combined token bitmaps and size
   ranges. A dual traversal drops node pairs whose largest possible overlap is below the required one. What is left
   ties sets into coarse components, so sets that share no more than a passage stay apart. Large groups go in blocks:
   first with one pivot each, then what the pivot's component doesn't hold with every block.
3. *Verification*. Within a coarse component the same trees are built over the sets themselves, and remaining pairs are
   verified exactly, unless already connected. Components of the links, plus exact copies, give the class id.

Defined results: null or wordless text has no shingle and links with nothing; fewer words than the shingle size make
one shingle. Rows with the same doc_id are one node and each gets a row; a null doc_id gets a null component. Shingles
are compared as 64-bit hashes. Extra columns are ignored.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ._common import U, bounded, components, connected_components, mix, mix_int, partitions_for, shingles, stored, tidy, word_hashes

BITS = 1024
LEAF, FAN = 32, 8
#: A tree of up to so many leaves is not worth its nodes: its members are compared directly.
FEW = 4
#: Bounds of a block: distinct sets, and their shingles in total.
BLOCK_SETS, BLOCK_SHINGLES = 2048, 1_500_000
#: Members of a block of signatures.
BLOCK_SIGNATURES = 4096
_RATIO = 1.35


def required_overlap(a, b, num: int, den: int):
    """Smallest intersection of sets of sizes a and b with den * intersection >= num * union."""
    return -(-(num * (a + b)) // (num + den))


# ---------------------------------------------------------------- routing


def _band_starts(upto: int) -> list[int]:
    out = [1]
    while out[-1] <= upto:
        out.append(max(out[-1] + 1, int(np.ceil(out[-1] * _RATIO))))
    return out


_STARTS = np.array(_band_starts(1 << 40), np.int64)


@lru_cache(None)
def band_plan(band: int, num: int, den: int) -> tuple[int, int, int]:
    """(parts, spare, least) of a size band: parts beyond those that may differ are spare, so that a set may leave out
    as many parts of fewer than ``least`` shingles; ``least`` is as large as few sets have more such parts."""
    low, largest = int(_STARTS[band]), int(_STARTS[band + 1]) - 1
    need = (den - num) * 2 * largest // (den + num) + 1
    for least in (3, 2, 1):
        m = need
        for _ in range(6):
            lam = low / m
            weak = math.exp(-lam) * sum(lam**k / math.factorial(k) for k in range(least))
            m = math.ceil(need / (1 - min(0.5, 1.5 * weak)))
        if weak <= 0.08 or least == 1:
            spare = m - need + (need > 4)
            return need + spare, spare, least
    raise AssertionError


#: Splits of a set into parts, each by another hash, before single shingles are its keys.
SPLITS = 3


def part_keys(s: np.ndarray, num: int, den: int) -> np.ndarray:
    """Keys of the parts of a sorted set; any two linked sets have a key in common.

    Of a split's parts, as many as ``spare`` and one more are equal in two linked sets. A set with no more than ``spare``
    weak parts (of fewer than ``least`` shingles) files only its strong ones, and then one of the equal ones is among
    them; what is strong in one set is so in the other, so a pair meets as soon as either is such a set. A set with more
    weak parts files its strong ones too, and goes on to the next split; two sets that both went through all splits meet
    by their first shingles in hash order (prefix filter). No key stands for an empty part, so none is met by chance."""
    n = len(s)
    band = int(np.searchsorted(_STARTS, n, "right")) - 1
    out, last = [], False
    while band < len(_STARTS) - 1 and int(_STARTS[band]) <= max(n, n * den // num):
        m, spare, least = band_plan(band, num, den)
        for split in range(SPLITS):
            x = np.sort(mix(s ^ U(mix_int(split)))) if split else s
            part = ((x >> U(32)) * U(m)) >> U(32)
            first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
            strong = np.diff(np.append(first, n)) >= least
            ids, sums = part[first][strong], np.add.reduceat(mix(x), first, dtype=U)[strong]
            out.append(mix(sums ^ mix(ids + U(mix_int(band + 1 + (split << 32))))))
            if m - int(strong.sum()) <= spare:
                break
        else:
            last = True
        band += 1
    if last:
        out.append(mix(s[: n - -(-num * n // den) + 1] ^ U(mix_int(1 << 48))))
    return np.concatenate(out)


#: Bits of a signature: the power of two from twice the shingles on, within these.
LEAST_BITS, MOST_BITS = 256, 1 << 17


def signature(s: np.ndarray) -> bytes:
    """The bitmap of a set: the lowest bits of a shingle choose the bit, so halves combine to a narrower bitmap."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (2 * len(s) - 1).bit_length()))
    on = np.zeros(bits, bool)
    on[(s & U(bits - 1)).astype(np.int64)] = True
    return np.packbits(on).tobytes()


def _set_hash(s: np.ndarray) -> np.ndarray:
    return mix(s).sum(dtype=U).astype(np.int64)


def _features(w: int):
    def run(batches):
        import pyarrow as pa

        for b in batches:
            n = np.zeros(b.num_rows, np.int64)
            h1, h2, sig = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64), [b""] * b.num_rows
            for at, words, off in word_hashes(b.column(1)):
                for i in range(len(off) - 1):
                    if off[i] < off[i + 1]:
                        s = np.unique(shingles(words[off[i] : off[i + 1]], w))
                        n[at + i] = len(s)
                        h1[at + i] = _set_hash(s)
                        h2[at + i] = mix(s ^ U(0x5851F42D4C957F2D)).sum(dtype=U).astype(np.int64)
                        sig[at + i] = signature(s)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(h1), pa.array(h2), pa.array(sig, pa.binary())], ["doc_id", "n", "h1", "h2", "sig"])

    return run


def _blob(rest: np.ndarray, ids: np.ndarray) -> bytes:
    """Entries in order of ids: counts of entries and documents, width of a document, the least document, documents above
    it, entries of each (unless all have one), and six bytes of each key."""
    new = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
    docs, many = ids[new], np.diff(np.append(new, len(ids)))
    above = (docs - docs[0]).astype(U)
    wide = 4 if int(above[-1]) < 1 << 32 else 8
    head = np.array([len(rest), len(docs), wide, docs[0]], "<i8").tobytes()
    count = many.astype("<u4").tobytes() if len(docs) < len(rest) else b""
    return head + above.astype(f"<u{wide}").tobytes() + count + np.ascontiguousarray(rest.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _entries(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, m, wide, least = np.frombuffer(blob, "<i8", 4).tolist()
    at = 32 + m * wide
    ids = np.frombuffer(blob, f"<u{wide}", m, 32).astype(np.int64) + least
    if m < n:
        ids, at = np.repeat(ids, np.frombuffer(blob, "<u4", m, at)), at + 4 * m
    key = np.zeros((n, 8), np.uint8)
    key[:, :6] = np.frombuffer(blob, np.uint8, 6 * n, at).reshape(n, 6)
    return key.view("<u8").ravel(), ids


def _distinct(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct entries in order of key and id."""
    order = np.lexsort((ids, keys))
    keys, ids = keys[order], ids[order]
    new = np.concatenate(([True], (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])))
    return keys[new], ids[new]


def _packed(keys: np.ndarray, ids: np.ndarray, buckets: int):
    """Rows (bucket, blob) of the distinct entries."""
    import pyarrow as pa

    keys, ids = _distinct(keys, ids)
    where, rest = (keys % U(buckets)).astype(np.int32), (keys // U(buckets)) & U((1 << 48) - 1)
    order = np.lexsort((ids, where))
    rest, ids, where = rest[order], ids[order], where[order]
    cut = np.flatnonzero(np.concatenate(([True], where[1:] != where[:-1])))
    blobs = [_blob(rest[a:z], ids[a:z]) for a, z in zip(cut, np.append(cut[1:], len(where)))]
    return pa.RecordBatch.from_arrays([pa.array(where[cut]), pa.array(blobs, pa.binary())], ["bucket", "blob"])


def key_groups(docs: DataFrame, w: int, num: int, den: int, buckets: int, most: int = 1 << 19) -> DataFrame:
    """(comp, rep): the sets (by hash) that have a key in common; each group of members once.

    A bucket's keys are sorted in one task; its size is set by ``buckets``. Copies of a set are one entry for any
    ``most`` keys of a task, and one in the bucket. Within a bucket, keys are told apart by 48 further bits; a group too
    many is no harm.
    """

    def run(batches):
        keys, ids, held = [], [], 0
        for b in batches:
            for _, words, off in word_hashes(b.column(0)):
                for i in range(len(off) - 1):
                    if off[i] < off[i + 1]:
                        s = np.unique(shingles(words[off[i] : off[i + 1]], w))
                        keys.append(part_keys(s, num, den))
                        ids.append(np.full(len(keys[-1]), _set_hash(s)))
                        held += len(keys[-1])
                if held >= most:
                    yield _packed(np.concatenate(keys), np.concatenate(ids), buckets)
                    keys, ids, held = [], [], 0
        if held:
            yield _packed(np.concatenate(keys), np.concatenate(ids), buckets)

    def meet(table):
        import pyarrow as pa

        parts = [_entries(x.as_py()) for x in table.column("blob")]
        keys, ids = _distinct(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
        start = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        size = np.diff(np.append(start, len(keys)))
        name = mix(np.add.reduceat(mix(ids.astype(U)), start, dtype=U) ^ size.astype(U))
        one = np.unique(name, return_index=True)[1]
        one = one[size[one] > 1]
        n = size[one]
        at = np.arange(n.sum()) + np.repeat(start[one] - (np.cumsum(n) - n), n)
        return pa.table({"comp": pa.array(np.repeat(name[one].astype(np.int64), n)), "rep": pa.array(ids[at])})

    return docs.where("doc_id is not null").select("text").mapInArrow(tidy(run), "bucket int, blob binary").groupBy("bucket").applyInArrow(meet, "comp long, rep long").distinct()


# ---------------------------------------------------------------- signature trees


class Links:
    """Union-find over positions; the root is the smallest position."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def union(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def roots(self, xs) -> np.ndarray:
        return np.array([self.find(int(x)) for x in xs])


def _levels(bits, pop, size):
    """From leaves to the root: OR of bitmaps, smallest and largest size, smallest bit count of each node."""
    out, step = [], LEAF
    while True:
        at = np.arange(0, len(bits), step)
        out.append((np.bitwise_or.reduceat(bits, at, axis=0), np.minimum.reduceat(size[0], at), np.maximum.reduceat(size[1], at), np.minimum.reduceat(pop, at)))
        bits, size, pop = out[-1][0], (out[-1][1], out[-1][2]), out[-1][3]
        if len(bits) == 1:
            return out
        step = FAN


def _possible(tree, num: int, den: int) -> np.ndarray:
    """Dual traversal: pairs of leaves, (a, b) with a <= b, that may hold a linked pair."""
    pairs = np.array([[0, 0]])
    for depth in range(len(tree) - 1, -1, -1):
        ors, low, high, few = tree[depth]
        if depth < len(tree) - 1:
            kids = np.arange(FAN)
            a = np.repeat(pairs[:, :1] * FAN + kids, FAN, axis=1).ravel()
            b = np.tile(pairs[:, 1:] * FAN + kids, (1, FAN)).ravel()
            ok = (a <= b) & (b < len(ors)) & (a < len(ors))
            pairs = np.unique(np.stack((a[ok], b[ok]), 1), axis=0)
        keep = []
        for at in range(0, len(pairs), 1 << 14):
            p = pairs[at : at + (1 << 14)]
            a, b = p[:, 0], p[:, 1]
            common = np.bitwise_count(ors[a] & ors[b]).sum(1, dtype=np.int64)
            # a member has at least (its bits - common) shingles that no member of the other node has
            best = np.minimum(np.minimum(high[a] - np.maximum(few[a] - common, 0), high[b] - np.maximum(few[b] - common, 0)), np.minimum(high[a], high[b]))
            need = required_overlap(low[a], low[b], num, den)
            apart = np.maximum(low[a], low[b]) * num > np.minimum(high[a], high[b]) * den
            keep.append(p[((best >= need) & ~((low[a] > high[b]) & apart) & ~((low[b] > high[a]) & apart)) | (a == b)])
        pairs = np.concatenate(keep)
    return pairs[np.argsort(pairs[:, 1] - pairs[:, 0], kind="stable")]


def tree_pairs(bits: np.ndarray, size: np.ndarray, num: int, den: int, apart=None):
    """Yield arrays (i, j): pairs of two leaves whose bitmaps and sizes allow a link. ``apart(i, j)`` tells which pairs
    (of rows with columns) still matter when their leaves are reached."""
    pop = np.bitwise_count(bits).sum(1, dtype=np.int64)
    order = np.lexsort((bits[:, 0], size))
    bits, size, pop, n = bits[order], size[order], pop[order], len(size)
    for a, b in _possible(_levels(bits, pop, (size, size)), num, den):
        ra, rb = np.arange(a * LEAF, min(n, (a + 1) * LEAF)), np.arange(b * LEAF, min(n, (b + 1) * LEAF))
        common = np.bitwise_count(bits[ra][:, None, :] & bits[rb][None, :, :]).sum(2, dtype=np.int64)
        best = np.minimum((size[ra] - pop[ra])[:, None], (size[rb] - pop[rb])[None, :]) + common
        ok = best >= required_overlap(size[ra][:, None], size[rb][None, :], num, den)
        if a == b:
            ok &= ra[:, None] < rb[None, :]
        if apart is not None:
            ok &= apart(order[ra], order[rb])
        x, y = np.nonzero(ok)
        if len(x):
            yield order[ra[x]], order[rb[y]]


def link_sets(sets: list[np.ndarray], num: int, den: int, links: Links, side: np.ndarray | None = None) -> None:
    """Join what is linked; ``side``: only pairs with a True member matter."""
    if len(sets) < 2:
        return
    size = np.array([len(s) for s in sets], np.int64)
    mat = np.zeros((len(sets), BITS), bool)
    for row, s in enumerate(sets):
        mat[row, (s & U(BITS - 1)).astype(np.int64)] = True

    def apart(a, b):
        ok = links.roots(a)[:, None] != links.roots(b)[None, :]
        return ok if side is None else ok & (side[a][:, None] | side[b][None, :])

    for x, y in tree_pairs(np.packbits(mat, axis=1).view(U), size, num, den, apart):
        for i, j in zip(x.tolist(), y.tolist()):
            if links.find(i) != links.find(j):
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                    links.union(i, j)


def _folded(sigs: list[bytes], bits: int) -> np.ndarray:
    out = np.empty((len(sigs), bits // 64), U)
    for i, s in enumerate(sigs):
        x = np.frombuffer(s, U)
        while len(x) > bits // 64:
            x = x[: len(x) // 2] | x[len(x) // 2 :]
        out[i] = x
    return out


def _sig_cells(num: int, den: int):
    """Ties of the sets of each block of a cell whose bitmaps allow a link: (u, v) with v the first of u's component."""

    def run(table):
        import pyarrow as pa

        table = table.combine_chunks()
        comp, blk, rep, n = (table.column(c).to_numpy() for c in ("comp", "blk", "rep", "n"))
        side = table.column("side").to_numpy(zero_copy_only=False).astype(bool)
        sigs = table.column("sig").to_pylist()
        wide = np.array([8 * len(s) for s in sigs])
        order = np.lexsort((rep, n, blk, comp))
        cut = np.flatnonzero(np.concatenate(([True], (comp[order][1:] != comp[order][:-1]) | (blk[order][1:] != blk[order][:-1]))))
        count = np.diff(np.append(cut, len(order)))
        us, vs = [], []
        # linked sets differ in size by less than a factor of two, so in width by one step at most
        for bits in np.unique(wide).tolist():
            used = np.flatnonzero((wide == bits) | (wide == 2 * bits))
            row = np.full(len(wide), -1)
            row[used] = np.arange(len(used))
            mat = _folded([sigs[k] for k in used], bits)
            pop = np.bitwise_count(mat).sum(1, dtype=np.int64)

            def tie(i, j):
                """Rows of the table whose pairs pass."""
                keep = (row[i] >= 0) & (row[j] >= 0) & (np.minimum(wide[i], wide[j]) == bits) & (np.maximum(n[i], n[j]) * num <= np.minimum(n[i], n[j]) * den) & (side[i] | side[j])
                i, j = i[keep], j[keep]
                a, b = row[i], row[j]
                best = np.minimum(n[i] - pop[a], n[j] - pop[b]) + np.bitwise_count(mat[a] & mat[b]).sum(1, dtype=np.int64)
                keep = best >= required_overlap(n[i], n[j], num, den)
                us.append(i[keep])
                vs.append(j[keep])

            # groups of a few leaves: members that stand k places apart
            for k in range(1, min(FEW * LEAF, int(count.max()))):
                few = (count > k) & (count <= FEW * LEAF)
                m = count[few] - k
                at = np.arange(m.sum()) + np.repeat(cut[few] - (np.cumsum(m) - m), m)
                step = max(1, (1 << 25) // bits)
                for x in range(0, len(at), step):
                    tie(order[at[x : x + step]], order[at[x : x + step] + k])
            for c, m in zip(cut[count > FEW * LEAF], count[count > FEW * LEAF]):
                mine = order[c : c + m]
                mine = mine[row[mine] >= 0]
                if len(mine) > 1:
                    for i, j in tree_pairs(mat[row[mine]], n[mine], num, den):
                        tie(mine[i], mine[j])
                        if sum(map(len, us)) > 1 << 20:  # keep a forest of them
                            us[:], vs[:] = [[x] for x in _forest_rows(us, vs)]
        u, v = _forest_rows(us, vs)
        return pa.table({"u": pa.array(rep[u]), "v": pa.array(rep[v])})

    return run


def _forest_rows(us: list, vs: list) -> tuple[np.ndarray, np.ndarray]:
    if not sum(map(len, us)):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    node, root = components(np.concatenate(us), np.concatenate(vs))
    return node[node != root], root[node != root]


def _cells(w: int, num: int, den: int):
    """Link the sets of each block of a cell; returns (u, v) with v the smallest document of u's local component."""

    def run(table):
        import pyarrow as pa

        table = table.select(["comp", "blk", "rep", "side", "text"]).combine_chunks()
        sets: list = [None] * table.num_rows
        for at, words, off in word_hashes(table.column("text")):
            for i in range(len(off) - 1):
                sets[at + i] = np.unique(shingles(words[off[i] : off[i + 1]], w))
        comp, blk, rep = (table.column(c).to_numpy() for c in ("comp", "blk", "rep"))
        side = table.column("side").to_numpy(zero_copy_only=False).astype(bool)
        order = np.lexsort((rep, blk, comp))
        cut = np.flatnonzero(np.concatenate(([True], (comp[order][1:] != comp[order][:-1]) | (blk[order][1:] != blk[order][:-1])))) if len(order) else []
        u, v = [], []
        for a, z in zip(cut, np.append(cut[1:], len(order))):
            rows = [int(r) for r in order[a:z] if sets[r] is not None and len(sets[r])]
            links = Links(len(rows))
            s = side[rows]
            link_sets([sets[r] for r in rows], num, den, links, None if s.all() else s)
            for x, r in enumerate(rows):
                if (root := links.find(x)) != x:
                    u.append(int(rep[r]))
                    v.append(int(rep[rows[root]]))
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return run


def jaccard_components(docs: DataFrame, words: int = 3, num: int = 90, den: int = 100, name: str = "jaccard") -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row; linked when den * intersection >= num * union."""
    if 2 * num < den:
        raise ValueError("a similarity below one half")
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    feats = stored(docs.mapInArrow(tidy(_features(words)), "doc_id long, n long, h1 long, h2 long, sig binary"), f"{name}-sets")
    total = feats.agg(F.sum("n")).first()[0] or 0
    buckets = partitions_for(spark, int(total * max(0.2, 2.5 * (den - num) / (den + num))), 1 << 20)
    sets = feats.where("n > 0 and doc_id is not null")
    # coarse components: groups of equal keys, narrowed by signatures
    groups = stored(key_groups(docs, words, num, den, buckets), f"{name}-groups")
    sizes = groups.groupBy("comp").agg(F.count("*").alias("c"), F.min("rep").alias("pivot")).withColumn("nb", F.ceil(F.col("c") / BLOCK_SIGNATURES))
    sigs = sets.groupBy("h1").agg(F.max(F.struct("n", "sig")).alias("x")).select(F.col("h1").alias("rep"), "x.n", "x.sig")
    sigs = stored(groups.select("rep").distinct().join(sigs, "rep"), f"{name}-sigs")
    todo = _dealt(groups, sizes, f"{name}-groups")
    narrow = lambda cells: cells.join(sigs, "rep").groupBy("cell").applyInArrow(_sig_cells(num, den), "u long, v long")
    packs = partitions_for(spark, groups.count(), 1 << 17)
    ties = _linked(todo, packs, narrow, lambda c, _: F.ceil(c / BLOCK_SIGNATURES), f"{name}-ties")
    coarse = stored(connected_components(ties, f"{name}-coarse"), f"{name}-coarse")
    classes = stored(sets.groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("rep")), f"{name}-classes")
    members = stored(classes.join(coarse, classes.h1 == coarse.node).select("rep", "n", F.col("component").alias("comp")), f"{name}-coarse-members")
    blocks = lambda c, s: F.greatest(F.ceil(c / BLOCK_SETS), F.ceil(s / BLOCK_SHINGLES))
    shape = members.groupBy("comp").agg(F.count("*").alias("c"), F.sum("n").alias("s"), F.min("rep").alias("pivot")).where("c > 1")
    todo = _dealt(members, shape.withColumn("nb", blocks(F.col("c"), F.col("s"))), f"{name}-members")
    packs = partitions_for(spark, todo.agg(F.sum("n")).first()[0] or 0, BLOCK_SHINGLES // 2)
    links = _linked(todo, packs, lambda cells: _verified(docs, cells, words, num, den), blocks, f"{name}-links")
    final = stored(connected_components(links, f"{name}-final"), f"{name}-final")
    named = stored(classes.join(final, classes.rep == final.node, "left").select("h1", "h2", F.col("n").alias("k"), F.coalesce("component", "rep").alias("component_id")), f"{name}-named")
    # copies carry the class's key: where rows share a doc_id they share the smallest component
    out = feats.join(named, (feats.h1 == named.h1) & (feats.h2 == named.h2) & (feats.n == named.k), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def _dealt(members: DataFrame, shape: DataFrame, name: str) -> DataFrame:
    """Members with their group's pivot and number of blocks, and their block."""
    shape = shape.select("comp", "pivot", "nb")
    return stored(members.join(shape, "comp").withColumn("blk", F.pmod(F.xxhash64("rep"), F.col("nb"))), f"{name}-dealt")


def _linked(todo: DataFrame, packs: int, run, blocks, name: str) -> DataFrame:
    """Links (u, v) within the groups of ``todo``: ``run`` makes them of the cells, ``blocks(members, shingles)`` is the
    number of blocks of a group's rest."""
    size = F.sum("n") if "n" in todo.columns else F.lit(0)
    found = [stored(run(_first_cells(todo, packs)), f"{name}-1")]
    if todo.where("nb > 1").limit(1).count():
        # which members are tied to their group's pivot, in their own block
        near = stored(connected_components(found[0], f"{name}-local"), f"{name}-local")
        pivots = near.select(F.col("node").alias("pivot"), F.col("component").alias("of_pivot"))
        big = todo.where("nb > 1").join(near, todo.rep == near.node, "left").join(pivots, "pivot", "left")
        big = stored(big.withColumn("main", F.coalesce(F.col("component") == F.col("of_pivot"), F.col("rep") == F.col("pivot"))).drop("node", "component", "of_pivot"), f"{name}-big")
        rest = big.where("not main")
        tally = stored(rest.groupBy("comp").agg(blocks(F.count("*"), size).alias("nr")), f"{name}-tally")
        # each block of what is left meets every block of the pivot's component, and each other block of what is left
        left = rest.join(tally, "comp").select("comp", "rep", F.explode(F.sequence(F.lit(0), F.col("nb").cast("int") - 1)).alias("blk"), F.pmod(F.xxhash64("rep", F.lit(3)), F.col("nr")).alias("part"), F.lit(True).alias("side"))
        every = big.where("main").join(tally, "comp").select("comp", "rep", F.col("blk").cast("int").alias("blk"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("nr").cast("long") - 1)).alias("part"), F.lit(False).alias("side"))
        cells = left.unionByName(every).select("comp", F.xxhash64("blk", "part").alias("blk"), "rep", "side", F.xxhash64("comp", "blk", "part").alias("cell"))
        found.append(stored(run(cells), f"{name}-2"))
        if tally.where("nr > 1").limit(1).count():
            pairs = rest.join(tally.where("nr > 1"), "comp").withColumn("a", F.pmod(F.xxhash64("rep", F.lit(3)), F.col("nr")).cast("int"))
            pairs = pairs.withColumn("b", F.explode(F.sequence(F.lit(0), F.col("nr").cast("int") - 1))).where("a <> b")
            cells = pairs.select("comp", F.xxhash64(F.least("a", "b"), F.greatest("a", "b"), F.lit(9)).alias("blk"), "rep", F.lit(True).alias("side"))
            found.append(stored(run(cells.withColumn("cell", F.xxhash64("comp", "blk"))), f"{name}-3"))
    links = found[0]
    for f in found[1:]:
        links = links.union(f)
    return links


def _first_cells(todo: DataFrame, packs: int) -> DataFrame:
    """Small groups share cells; a group of several blocks has a cell for each, with its pivot in all."""
    own = todo.select("comp", "blk", "rep", F.lit(True).alias("side"), F.when(F.col("nb") == 1, F.pmod(F.xxhash64("comp"), F.lit(packs))).otherwise(F.xxhash64("comp", "blk")).alias("cell"))
    extra = todo.where("nb > 1 and rep = pivot").select("comp", "rep", F.col("blk").alias("home"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb").cast("long") - 1)).alias("blk")).where("blk <> home")
    return own.unionByName(extra.select("comp", "blk", "rep", F.lit(True).alias("side"), F.xxhash64("comp", "blk").alias("cell")))


def _verified(docs: DataFrame, cells: DataFrame, words: int, num: int, den: int) -> DataFrame:
    one = docs.withColumnRenamed("doc_id", "rep").where("rep is not null")
    return bounded(cells).join(one, "rep").groupBy("cell").applyInArrow(_cells(words, num, den), "u long, v long")
