"""Substring dedup: near-duplicate passages by compact windows.

Under each of a few hash functions, the passages of a text that share a min-hash form a compact window: a shingle, and
how far passages around it may reach before a smaller hash. A Cartesian tree over the hashes gives the windows; only
those wide enough for a passage are kept (about two for each passage length of text).

Windows of equal min-hash meet by key in buckets. A key may be no more than a frequent line, so each window also carries
contexts: under the first hash function, a hash of each passage of least length within it that holds the shingle (over
all windows, one for each position of a text); and the least hashes of the shingles just before and just after it. Each
window is tied to the first one with its key and to the first with its key and each of its contexts. A task sends
the windows that are first with their key or a context, so a passage held by a third of all rows reaches a bucket once
for each task. Ties of two documents are joined as intervals over all hash functions, the regions' words are fetched,
and passages are verified:
a run of shingles found in the other region, at most a fifth of them not, and at least ``MIN_WORDS`` words long.

The result has a row for each document and passage with one document that has it too; the first document of a passage
is reported as well. Found with certainty: equal passages. A passage of similarity 0.8 is missed if all hash functions
disagree, with probability 0.2 to the number of functions; where a key is also held by an earlier document that lacks
the passage, the contexts before and after must disagree as well, or the key, which is likelier.

Defined results: null texts have no passage. Words are runs of other characters than white space, A-Z lower-cased.
Rows with a null doc_id are left out; rows with the same doc_id are not compared with each other. Repeats within one
text are not reported. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ._common import U, discard, mix, mix_int, partitions_for, shingles, stored, tidy, word_hashes

WORDS = 5
MIN_WORDS = 50
HASHES = 3
#: A run may hold one shingle that the other region lacks for each four that it has: similarity 0.8.
_GAIN, _LOSS = 1, 4


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each window of ``width`` values, by doubling."""
    have, m = 1, x
    while have * 2 <= width:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    return np.minimum(m[: len(x) - width + 1], m[width - have :][: len(x) - width + 1]) if have < width else m


def compact_windows(h: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, left end, right end) of the compact windows of at least ``width`` values; ends inclusive.

    A position counts if it is the minimum of some window of ``width`` values (the first of equal ones). Its nearest
    smaller neighbours are such positions too, so the Cartesian tree is built over these alone. Zeros stand between
    texts: they end windows and are no minima."""
    n = len(h)
    if n < width:
        return (np.zeros(0, np.int64),) * 3
    # the least value of each window, and for each position the largest of those of the windows that hold it
    low = np.concatenate((np.zeros(width - 1, h.dtype), sliding_min(h, width), np.zeros(width - 1, h.dtype)))
    pos = np.flatnonzero((~sliding_min(~low, width) == h))
    left, right, stack = [0] * len(pos), [n - 1] * len(pos), []
    val = h[pos].tolist()
    at = pos.tolist()
    for i, v in enumerate(val):
        while stack and val[stack[-1]] > v:
            right[stack.pop()] = at[i] - 1
        left[i] = at[stack[-1]] + 1 if stack else 0
        stack.append(i)
    left, right = np.array(left, np.int64), np.array(right, np.int64)
    keep = (h[pos] != 0) & (right - left + 1 >= width)
    return pos[keep], left[keep], right[keep]


def _ends(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return packed["c"] - packed["l"].astype(np.int32), packed["c"] + packed["r"].astype(np.int32)


#: ``m`` counts a window's contexts, which follow in an array of their own.
_ROW = np.dtype([("k", "<u8"), ("d", "<i8"), ("c", "<i4"), ("l", "<u4"), ("r", "<u4"), ("m", "<u4")])
_TIE = np.dtype([("x", "<i8"), ("p", "<i8"), ("xa", "<i4"), ("xz", "<i4"), ("pa", "<i4"), ("pz", "<i4")])
_LEAST = MIN_WORDS - WORDS + 1
_NEAR = _LEAST // 2 - 1


def whole_passages(s: np.ndarray) -> np.ndarray:
    """A hash of the ``_LEAST`` shingles from each position on: every fifth shingle spells all their words."""
    n = len(s) - _LEAST + 1
    at = [*range(0, _LEAST - 1, WORDS), _LEAST - 1]
    acc = np.full(n, 7, U)
    for x in at:
        acc = acc * U(0xD6E8FEB86659FD93) + s[x : x + n]
    return (mix(acc) >> U(32)).astype("<u4")


def contexts(low: np.ndarray, c: np.ndarray, l: np.ndarray, r: np.ndarray, start: np.ndarray, end: np.ndarray, whole: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(contexts, how many each window has) of windows at ``c`` from ``l`` to ``r``, in texts from ``start`` to before
    ``end``; ``low``: the least hash of the ``_NEAR`` shingles from each position on."""
    before, after = c - start >= _NEAR, c + 1 + _NEAR <= end
    m = before.astype(np.int64) + after
    n = 0
    if whole is not None:
        a = np.maximum(l, c - _LEAST + 1)
        n = np.minimum(c, r - _LEAST + 1) - a + 1
        m = m + n
    out = np.empty(int(m.sum()), "<u4")
    first = np.cumsum(m) - m
    out[first[before]] = low[c[before] - _NEAR] | np.uint32(1)
    out[(first + before)[after]] = low[c[after] + 1] & np.uint32(0xFFFFFFFE)
    if whole is not None:
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        out[step + np.repeat(first + before + after, n)] = whole[step + np.repeat(a, n)]
    return out, m


def _pack(rows: np.ndarray, subs: np.ndarray) -> bytes:
    return np.array([len(rows)], "<i8").tobytes() + rows.tobytes() + subs.tobytes()


def _unpack(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    rows, subs = [], []
    for b in blobs:
        n = int(np.frombuffer(b, "<i8", 1)[0])
        rows.append(np.frombuffer(b, _ROW, n, 8))
        subs.append(np.frombuffer(b, "<u4", offset=8 + n * _ROW.itemsize))
    return np.concatenate(rows), np.concatenate(subs)


def _taken(rows: np.ndarray, subs: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows in ``order``, each with its contexts."""
    m = rows["m"].astype(np.int64)
    start = (np.cumsum(m) - m)[order]
    m = m[order]
    return rows[order], subs[np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(start, m)]


def _tied(rows: np.ndarray, x: np.ndarray, p: np.ndarray) -> np.ndarray:
    t = np.zeros(len(x), _TIE)
    t["x"], t["p"] = rows["d"][x], rows["d"][p]
    (t["xa"], t["xz"]), (t["pa"], t["pz"]) = _ends(rows[x]), _ends(rows[p])
    return t


def _ties(rows: np.ndarray, subs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows that are first with their key or a context, such contexts, ties of the others to the first ones of other
    documents, merged by pair of documents)."""
    if not len(rows):
        return rows, subs, np.zeros(0, _TIE)
    rows, subs = _taken(rows, subs, np.lexsort((rows["c"], rows["d"], rows["k"])))
    new = np.concatenate(([True], rows["k"][1:] != rows["k"][:-1]))
    group = np.cumsum(new) - 1
    head = np.flatnonzero(new)[group]
    # the first row with the key and context, for each context
    row = np.repeat(np.arange(len(rows)), rows["m"])
    key = (group[row].astype(U) << U(32)) | subs
    order = np.argsort(key, kind="stable")
    one = np.concatenate(([True], key[order][1:] != key[order][:-1])) if len(key) else np.zeros(0, bool)
    lead = np.empty(len(row), np.int64)
    if len(row):
        lead[order] = row[order[one]][np.cumsum(one) - 1]
    x, p = np.divmod(distinct(np.concatenate((np.arange(len(rows)) * len(rows) + head, row * len(rows) + lead))), len(rows))
    other = rows["d"][x] != rows["d"][p]
    ties = merge_ties(_tied(rows, x[other], p[other]))
    mine = np.zeros(len(row), bool)
    mine[order[one]] = True
    out = rows.copy()
    out["m"] = np.bincount(row[mine], minlength=len(rows))
    keep = new | (out["m"] > 0)
    return out[keep], subs[mine], ties


def merge_ties(t: np.ndarray) -> np.ndarray:
    """Interval join: of each pair of documents, ties whose regions overlap in both become one."""
    if not len(t):
        return t
    t = t[np.lexsort((t["pa"], t["xa"], t["p"], t["x"]))]
    out = []
    for r in t.tolist():
        if out:
            q = out[-1]
            if q[0] == r[0] and q[1] == r[1] and r[2] <= q[3] and r[4] <= q[5] and q[4] <= r[5]:
                out[-1] = (q[0], q[1], min(q[2], r[2]), max(q[3], r[3]), min(q[4], r[4]), max(q[5], r[5]))
                continue
        out.append(r)
    return np.array(out, _TIE)


def _spread(words: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingles of the texts that have ``MIN_WORDS`` words, with a gap after each text: (shingles, starts, lengths)."""
    n = np.diff(off)
    m = np.where(n >= MIN_WORDS, n - (WORDS - 1), 0)
    start = np.cumsum(m + 1) - (m + 1)
    if not m.any():
        return np.zeros(0, U), start, m
    out = np.zeros(int(m.sum()) + len(m), U)
    step = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
    out[step + np.repeat(start, m)] = shingles(words, WORDS)[step + np.repeat(off[:-1], m)]
    return out, start, m


def _windows(buckets: int, most: int = 1 << 18):
    """mapInArrow: (doc_id, text) -> (bucket, blob) of window rows; negative buckets carry a task's own ties."""

    def emit(rows: list, subs: list, task: int):
        import pyarrow as pa

        keep, subs, ties = _ties(np.concatenate(rows), np.concatenate(subs))
        where = (keep["k"] % U(buckets)).astype(np.int64)
        order = np.argsort(where, kind="stable")
        (keep, subs), where = _taken(keep, subs, order), where[order]
        cut = np.flatnonzero(np.concatenate(([True], where[1:] != where[:-1]))) if len(where) else []
        at = np.concatenate(([0], np.cumsum(keep["m"], dtype=np.int64)))
        out = [(int(where[a]), _pack(keep[a:z], subs[at[a] : at[z]])) for a, z in zip(cut, np.append(cut[1:], len(where)).astype(int))]
        out += [(-1 - (task + at) % buckets, ties[at : at + (1 << 15)].tobytes()) for at in range(0, len(ties), 1 << 15)]
        return pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.binary())], ["bucket", "blob"])

    def run(batches):
        from pyspark import TaskContext

        task, rows, subs, held = TaskContext.get().partitionId(), [], [], 0
        seeds = [U(mix_int(1000 + k)) for k in range(HASHES)]
        for b in batches:
            doc = b.column(0).to_numpy(zero_copy_only=False)
            for at, words, off in word_hashes(b.column(1)):
                s, start, m = _spread(words, off)
                if not len(s):
                    continue
                gap = start + m
                low = (sliding_min(mix(s ^ U(mix_int(77))), _NEAR) >> U(32)).astype("<u4")
                for k, seed in enumerate(seeds):
                    h = mix(s ^ seed) | U(1)
                    h[gap] = 0
                    c, l, r = compact_windows(h, _LEAST)
                    t = np.searchsorted(start, c, "right") - 1
                    w = np.zeros(len(c), _ROW)
                    w["k"], w["d"], w["c"] = mix(h[c] + U(2 * k)), doc[at + t], c - start[t]
                    w["l"], w["r"] = c - l, r - c
                    sub, w["m"] = contexts(low, c, l, r, start[t], gap[t], None if k else whole_passages(s))
                    rows.append(w)
                    subs.append(sub)
                    held += len(w) + len(sub) // 4
                if held >= most:
                    yield emit(rows, subs, task)
                    rows, subs, held = [], [], 0
        if held:
            yield emit(rows, subs, task)

    return run


def _meet(table):
    import pyarrow as pa

    blobs = [x.as_py() for x in table.column("blob")]
    if table.column("bucket")[0].as_py() < 0:
        t = merge_ties(np.concatenate([np.frombuffer(x, _TIE) for x in blobs]))
    else:
        t = _ties(*_unpack(blobs))[2]
    return pa.table({c: pa.array(t[c].astype(np.int64)) for c in _TIE.names})


def _regions(batches):
    """(text, doc_id, regions): the words of the shingles of each region (a, z), as 4-byte hashes; a text is hashed once."""
    import pyarrow as pa

    for b in batches:
        cut = b.column(2).offsets.to_numpy()
        one = b.column(2).flatten()
        a, z = (one.field(k).to_numpy() for k in (0, 1))
        cut = cut - cut[0]
        blobs = [b""] * len(a)
        for at, words, off in word_hashes(b.column(0)):
            for i in range(len(off) - 1):
                w = (words[off[i] : off[i + 1]] >> U(32)).astype("<u4")
                for k in range(cut[at + i], cut[at + i + 1]):
                    blobs[k] = w[a[k] : z[k] + WORDS].tobytes()
        row = np.repeat(np.arange(b.num_rows), np.diff(cut))
        yield pa.RecordBatch.from_arrays([b.column(1).take(pa.array(row)), pa.array(a), pa.array(blobs, pa.binary())], ["doc_id", "at", "words"])


def runs(found: np.ndarray, least: int) -> list[tuple[int, int, float]]:
    """Stretches of at least ``least`` shingles that begin and end with found ones and lack at most a fifth, as long as
    they can be: none lies within another, but they may overlap."""
    out, n = [], len(found)
    if not n:
        return out
    edges = np.flatnonzero(np.diff(np.concatenate(([0], found.astype(np.int8), [0]))))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return out
    score = np.concatenate(([0], np.cumsum(np.where(found, _GAIN, -_LOSS))))
    # the farthest end whose score is not below the start's: the best score from an end on never rises
    best = np.maximum.accumulate(score[ends][::-1])
    far = len(ends) - 1 - np.searchsorted(best, score[starts], "left")
    last = -1
    for a, j in zip(starts.tolist(), far.tolist()):
        z = int(ends[j])
        if j > last and z - a >= least:
            out.append((a, z, float(found[a:z].mean())))
            last = j
    return out


def spans(stretches: list[tuple[int, int, float]]) -> list[tuple[int, int, bool]]:
    """(start, end, whether it is more than one) of the unions of overlapping stretches."""
    out: list[tuple[int, int, bool]] = []
    for a, z, _ in stretches:
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], z, True)
        else:
            out.append((a, z, False))
    return out


def within(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Which of ``x`` are in ``p``."""
    if not len(p):
        return np.zeros(len(x), bool)
    p = np.sort(p)
    return p[np.minimum(np.searchsorted(p, x), len(p) - 1)] == x


def distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


def likeness(x: np.ndarray, p: np.ndarray) -> float:
    x, p = distinct(x), distinct(p)
    both = int(within(x, p).sum())
    return both / max(1, len(x) + len(p) - both)


def _earlier(ids: np.ndarray) -> np.ndarray:
    """The position of the last earlier equal value, or -1."""
    order = np.argsort(ids, kind="stable")
    out = np.full(len(ids), -1, np.int64)
    same = ids[order[1:]] == ids[order[:-1]]
    out[order[1:][same]] = order[:-1][same]
    return out


def like_stretches(s: np.ndarray, other: np.ndarray, at: int, least: int, pieces: np.ndarray) -> list[tuple[int, int, int, int, float]]:
    """Longest stretches of ``s`` (which begins at ``at``) and ``other`` of similarity 0.8 between two equal ``pieces``,
    the second of which ends later in both; those that two others cover are left out."""
    out: list[tuple] = []
    if not len(pieces):
        return out
    xa, xz, pa, pz = pieces.T
    had = np.concatenate(([0], np.cumsum(xz - xa)))
    sets, last = None, -1
    # counts of shingles bound the similarity only where none repeats, so the sets decide
    block = max(1, (1 << 18) // len(pieces))
    for lo in range(0, len(pieces), block):
        i_ = np.arange(lo, min(len(pieces), lo + block))
        nx, np_, c = xz[None, :] - xa[i_, None], pz[None, :] - pa[i_, None], had[None, 1:] - had[i_, None]
        fit = (nx >= least) & (np_ >= least) & (c >= 0.8 * (nx + np_ - c))
        far = len(pieces) - 1 - np.argmax(fit[:, ::-1], 1)
        for i in (i_[fit.any(1)]).tolist():
            if far[i - lo] <= last:
                continue
            if sets is None:
                names, ids = np.unique(np.concatenate((s, other)), return_inverse=True)
                ix, ip = ids[: len(s)], ids[len(s) :]
                sets = names, ix, ip, _earlier(ix), _earlier(ip)
            names, ix, ip, ex, ep = sets
            js = np.flatnonzero(fit[i - lo, i:])
            js = js[pz[i + js] >= np.maximum.accumulate(pz[i + js])]
            a, b, zs, es = int(xa[i]), int(pa[i]), xz[i + js], pz[i + js]
            # a shingle counts from its first place in the stretch on; one that both have, from the later of the two
            new_x, new_p = ex[a : zs[-1]] < a, ep[b : es[-1]] < b
            place = np.full((2, len(names)), len(js))
            place[0, ix[a : zs[-1]][new_x]] = np.searchsorted(zs, a + np.flatnonzero(new_x), "right")
            place[1, ip[b : es[-1]][new_p]] = np.searchsorted(es, b + np.flatnonzero(new_p), "right")
            both = np.cumsum(np.bincount(place.max(0), minlength=len(js) + 1))[: len(js)]
            sim = both / (np.cumsum(new_x)[zs - a - 1] + np.cumsum(new_p)[es - b - 1] - both)
            good = np.flatnonzero(sim >= 0.8)
            if len(good) and i + js[good[-1]] > last:
                k = good[-1]
                if len(out) > 1 and at + a <= out[-2][1]:
                    out.pop()
                out.append((at + a, at + int(zs[k]), b, int(es[k]), float(sim[k])))
                last = i + int(js[k])
    return out


def equal_pieces(s: np.ndarray, other: np.ndarray) -> np.ndarray:
    """(start, end, start, end): longest pieces of ``s`` that stand word for word in ``other``."""
    order = np.argsort(other, kind="stable")
    k = order[np.minimum(np.searchsorted(other[order], s), len(other) - 1)]
    k = np.where(other[k] == s, k, -2 - np.arange(len(s)) * 2)
    cut = np.flatnonzero(np.concatenate(([True], np.diff(k) != 1, [True])))
    a, z = cut[:-1], cut[1:]
    a, z = a[k[a] >= 0], z[k[a] >= 0]
    return np.stack((a, z, k[a], k[a] + z - a), 1)


#: Shingles of a text whose regions are cut together.
_STRETCH = 1 << 16
#: Shingles whose membership is looked up at once.
_TOGETHER = 1 << 20


def _shingled(words, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingles of rows ``lo`` to ``hi`` end to end, borders of the rows), of a binary array of 4-byte words."""
    off = np.frombuffer(words.buffers()[1], np.int32)[words.offset + lo : words.offset + hi + 1].astype(np.int64)
    w = np.frombuffer(words.buffers()[2], "<u4", int(off[-1] - off[0]) // 4, int(off[0])).astype(U) if off[-1] > off[0] else np.zeros(0, U)
    n = np.maximum(np.diff(off) // 4 - (WORDS - 1), 0)
    if len(w) < WORDS:
        return np.zeros(0, U), np.zeros(hi - lo + 1, np.int64)
    start = (off[:-1] - off[0]) // 4
    cut = np.concatenate(([0], np.cumsum(n)))
    return shingles(w, WORDS)[np.arange(cut[-1]) + np.repeat(start - cut[:-1], n)], cut


def _enough(x: np.ndarray, xc: np.ndarray, p: np.ndarray, pc: np.ndarray) -> np.ndarray:
    """Rows of which at least four fifths of a least passage's shingles stand in the other region."""
    # a row's keys lie together: the number of the row, then the high bits of the shingle
    key = lambda s, c: np.repeat(np.arange(len(c) - 1, dtype=U), np.diff(c)) << U(40) | s >> U(24)
    found = np.concatenate(([0], np.cumsum(within(key(x, xc), key(p, pc)))))
    return np.flatnonzero(np.diff(found[xc]) * 5 >= _LEAST * 4)


def _common_passages(sx: np.ndarray, sp: np.ndarray):
    """(a, z, b, e, similarity): stretches of two regions' shingles."""
    for a, z, many in spans(runs(within(sx, sp), _LEAST)):
        back = [] if many else spans(runs(within(sp, sx[a:z]), _LEAST))
        places = [(a, z, b, e, likeness(sx[a:z], sp[b:e])) for b, e, more in back if not more]
        places = [max(places, key=lambda q: (q[4], -q[2]))] if places else []
        if not places or places[0][4] < 0.8:
            pieces = equal_pieces(sx[a:z], sp)
            places = like_stretches(sx[a:z], sp, a, _LEAST, pieces)
            whole = [(a + w, a + x, y, v, 1.0) for w, x, y, v in pieces[pieces[:, 1] - pieces[:, 0] >= _LEAST].tolist()]
            places += [q for q in whole if not any(o[0] <= q[0] and q[1] <= o[1] for o in places)]
        yield from places


def _verify(batches):
    import pyarrow as pa
    import pyarrow.compute as pc

    names = ["doc_id", "start_word", "end_word", "match_doc_id", "match_start", "match_end", "similarity"]
    kinds = [pa.int64()] * 6 + [pa.float64()]
    for b in batches:
        cols: list[list] = [[] for _ in names]
        ids = np.stack([b.column(k).to_numpy() for k in range(4)], 1)
        size = np.cumsum(pc.add(pc.binary_length(b.column(4)), pc.binary_length(b.column(5))).to_numpy()) // 4 // _TOGETHER
        for part in np.unique(size):
            lo, hi = int(np.searchsorted(size, part)), int(np.searchsorted(size, part, "right"))
            (x, xc), (p, pcut) = _shingled(b.column(4), lo, hi), _shingled(b.column(5), lo, hi)
            for k in _enough(x, xc, p, pcut):
                dx, dp, ax, ap = ids[lo + k].tolist()
                for a, z, c, e, sim in _common_passages(x[xc[k] : xc[k + 1]], p[pcut[k] : pcut[k + 1]]):
                    one = (dx, ax + a, ax + z + WORDS - 1, dp, ap + c, ap + e + WORDS - 1, sim)
                    for col, d, v in zip(cols, one, (one[3], one[4], one[5], dx, one[1], one[2], sim)):
                        col += [d, v]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)


def repeated_passages(docs: DataFrame, name: str = "passages") -> DataFrame:
    """doc_id, start_word, end_word, match_doc_id, match_start, match_end, similarity: passages of 50 words or more
    (word positions, ends exclusive) that another document has too."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = partitions_for(spark, size * HASHES // 130, 1 << 18)
    found = docs.mapInArrow(tidy(_windows(buckets)), "bucket int, blob binary").groupBy("bucket").applyInArrow(_meet, "x long, p long, xa long, xz long, pa long, pz long")
    found = stored(found, f"{name}-ties")
    # over all hash functions and buckets: regions of a pair that fall into the same stretch of either text are joined
    span = 4 * MIN_WORDS
    ties = found.groupBy("x", "p", F.floor(F.col("xa") / (64 * span)).alias("s"), F.floor((F.col("pa") - F.col("xa")) / span).alias("g")).agg(F.min("xa").alias("xa"), F.max("xz").alias("xz"), F.min("pa").alias("pa"), F.max("pz").alias("pz"))
    ties = stored(ties.withColumn("pair", F.xxhash64("x", "p", "s", "g")), f"{name}-pairs")
    discard(found)
    ask = ties.select(F.col("x").alias("d"), "pair", F.lit(0).alias("side"), F.col("xa").alias("a"), F.col("xz").alias("z")).union(
        ties.select(F.col("p").alias("d"), "pair", F.lit(1).alias("side"), F.col("pa").alias("a"), F.col("pz").alias("z"))
    )
    # a region asked for by many pairs is cut from its text once, with other regions of the same stretch of the text
    want = ask.select("d", "a", "z").distinct().groupBy("d", F.floor(F.col("a") / _STRETCH).alias("s")).agg(F.collect_list(F.struct("a", "z")).alias("on"))
    # regions are as many as the corpus has repeats: the join shuffles at every size
    got = want.join(docs.hint("merge"), want.d == docs.doc_id).select("text", "doc_id", "on")
    cutout = stored(got.mapInArrow(tidy(_regions), "doc_id long, at long, words binary").select("doc_id", "at", "words", (F.octet_length("words") / 4).cast("long").alias("n")), f"{name}-regions")
    x, p = cutout.select(*[F.col(c).alias(f"x_{c}") for c in cutout.columns]), cutout.select(*[F.col(c).alias(f"p_{c}") for c in cutout.columns])
    n = lambda z, a: F.col(z) - F.col(a) + WORDS
    both = ties.join(x.hint("merge"), (F.col("x") == F.col("x_doc_id")) & (F.col("xa") == F.col("x_at")) & (n("xz", "xa") == F.col("x_n")))
    both = both.join(p.hint("merge"), (F.col("p") == F.col("p_doc_id")) & (F.col("pa") == F.col("p_at")) & (n("pz", "pa") == F.col("p_n")))
    out = both.select("x", "p", "xa", "pa", "x_words", "p_words").mapInArrow(tidy(_verify), "doc_id long, start_word long, end_word long, match_doc_id long, match_start long, match_end long, similarity double")
    best = out.groupBy("doc_id", "start_word", "end_word").agg(F.min(F.struct(-F.col("similarity"), "match_doc_id", "match_start", "match_end").alias("b")).alias("b"))
    return best.select("doc_id", "start_word", "end_word", "b.match_doc_id", "b.match_start", "b.match_end", (-F.col("b.col1")).alias("similarity"))
