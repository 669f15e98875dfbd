"""Token-ID files: flat unsigned integers plus 64-bit document offsets, memory-mapped.

A file set is a folder of ``part-NNNNN.ids`` (little-endian unsigned 16- or 32-bit ids, by vocabulary size),
``part-NNNNN.off`` (64-bit offsets of its documents, one more than documents) and ``part-NNNNN.doc`` (64-bit doc_ids).
Parts are ranges of ascending doc_id; their bases are prefix sums of the parts' totals, in ``bases.json``. Files are
written under a name of the attempt and renamed, so repeated tasks leave one file each.

Defined results: null text is empty and has only the end id; null doc_ids come first; rows with the same doc_id are
ordered by a hash of their text. An empty table writes no part. Texts are encoded whole. Extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from ._common import LOWER, U, fresh_path, partitions_for, pieces_of, span_hashes, text_buffers, tidy

_RUN = 1 << 20
_SLOTS = 1 << 21
_STATE: dict = {}


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class PieceTable:
    """64-bit hashes of pieces to their ids, in open addressing: at most half the slots are taken."""

    def __init__(self, slots: int, dtype: np.dtype):
        self.slots, self.dtype = slots, dtype
        self.clear()

    def clear(self) -> None:
        self.key, self.at, self.len = np.zeros(self.slots, U), np.zeros(self.slots, np.int32), np.zeros(self.slots, np.int32)
        self.ids, self.used, self.count = np.zeros(1 << 16, self.dtype), 0, 0

    def find(self, h: np.ndarray) -> np.ndarray:
        """The slot of each hash, or -1."""
        out = (h & U(self.slots - 1)).astype(np.int64)
        left = np.flatnonzero(self.key[out] != h)
        while len(left):
            k = self.key[out[left]]
            out[left[k == 0]] = -1
            left = left[(k != 0) & (k != h[left])]
            out[left] = (out[left] + 1) & (self.slots - 1)
            left = left[self.key[out[left]] != h[left]]
        return out

    def room(self, n: int) -> bool:
        return self.count + n <= self.slots // 2

    def add(self, h: np.ndarray, ids: np.ndarray, lens: np.ndarray) -> None:
        """Distinct new hashes, and the ids of all of them end to end."""
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros(max(len(self.ids), len(ids)), self.dtype)))
        self.ids[self.used : self.used + len(ids)] = ids
        at = self.used + np.cumsum(lens) - lens
        self.used, self.count = self.used + len(ids), self.count + len(h)
        pos, left = (h & U(self.slots - 1)).astype(np.int64), np.arange(len(h))
        while len(left):
            free = left[self.key[pos[left]] == 0]
            self.key[pos[free]] = h[free]  # of several that want a slot, the last gets it
            won = self.key[pos[left]] == h[left]
            done, left = left[won], left[~won]
            self.at[pos[done]], self.len[pos[done]] = at[done], lens[done]
            pos[left] = (pos[left] + 1) & (self.slots - 1)


_SPACE, _LETTER, _DIGIT, _MARK, _OTHER = range(5)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[33:127] = _MARK
_CLASS[[9, 10, 11, 12, 13, 32]] = _SPACE
_CLASS[48:58] = _DIGIT
_CLASS[[*range(65, 91), *range(97, 123)]] = _LETTER
_CLASS[39] = _OTHER  # an apostrophe: its pieces depend on what follows
#: Bytes that begin, or are, characters on whose class libraries differ.
_SUSPECT = np.zeros(256, bool)
_SUSPECT[[*range(9), *range(14, 32), 127, 0xC2, 0xE1, 0xE2, 0xEF]] = True


#: Stands between words that are encoded together; one id of its own in the vocabulary.
_MARKER = "\u00a4"


def _two_byte_letters(buf: np.ndarray) -> np.ndarray:
    """Where the letters from U+00C0 to U+00FF begin."""
    at = np.flatnonzero(buf[:-1] == 0xC3)
    return at[(buf[at + 1] != 0x97) & (buf[at + 1] != 0xB7)]


class Encoder:
    """Encodes texts with a vocabulary whose pieces never cross white space, each distinct piece once.

    Words of ASCII (without an apostrophe) and the letters from U+00C0 to U+00FF fall into pieces as the vocabulary's own
    rule has it: runs of letters, single digits, runs of marks. Any other word is one piece, which the whole tokenizer
    encodes. Pieces met before come from a
    table of bounded size by 64-bit hashes of their lower-cased bytes; new ones are encoded in bulk and told apart by the
    tokens that end a word. Texts with characters on whose class libraries differ are encoded as a whole, and so are
    all texts of vocabularies without word ends.
    """

    def __init__(self, path: str, slots: int = _SLOTS):
        import re

        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        self.dtype = np.dtype("<u2") if self.tok.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.bare = Tokenizer.from_file(path)
        self.bare.normalizer = normalizers.Sequence([])
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.last = np.zeros(self.tok.get_vocab_size(), bool)
        for token, k in self.tok.get_vocab().items():
            self.last[k] = token.endswith("</w>")
        self.by_word = bool(self.last.any())
        self.odd = re.compile(r"[\x00-\x08\x0e-\x1f\x7f-\x9f\u180e\u200b-\u200f\u2028-\u202e\u2060-\u206f\ufeff\ud800-\udfff]").search
        self.table = PieceTable(slots, self.dtype)
        self.mark = self._whole([_MARKER])[0]

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.dtype) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _apart(self, words: list[str]) -> list[np.ndarray]:
        """The ids of each word: encoded as one text with a mark between, or each by itself if one holds the mark."""
        if len(self.mark) != 1 or any(_MARKER in w for w in words):
            return self._whole(words)
        ids = self._whole([f" {_MARKER} ".join(words)])[0]
        cut = np.flatnonzero(ids == self.mark[0])
        return [ids[a:z] for a, z in zip([0, *(cut + 1)], [*cut, len(ids)])]

    def _learn(self, buf: np.ndarray, h: np.ndarray, start: np.ndarray, end: np.ndarray, other: np.ndarray) -> None:
        """Encode distinct new pieces of ``buf`` (lower-cased but for ``other`` ones) and add them to the table."""
        plain = np.flatnonzero(~other)
        if len(plain):
            # the pieces and a space after each, gathered into one text
            n = end[plain] - start[plain] + 1
            cum = np.cumsum(n)
            at = np.arange(cum[-1]) - np.repeat(cum - n, n) + np.repeat(start[plain], n)
            at[cum - 1] = 0
            text = LOWER[buf[at]]
            text[cum - 1] = 32
            two = _two_byte_letters(text) + 1
            text[two] += np.where(text[two] < 0x9F, 32, 0).astype(np.uint8)
            ids = np.array(self.bare.encode_batch_fast([text.tobytes().decode()], add_special_tokens=False)[0].ids, self.dtype)
            cut = np.flatnonzero(self.last[ids]) + 1
            if len(cut) != len(plain):
                raise AssertionError("a piece without one word end")
            self.table.add(h[plain], ids, np.diff(cut, prepend=0))
        rest = np.flatnonzero(other)
        if len(rest):
            ids = self._apart([buf[a:z].tobytes().decode() for a, z in zip(start[rest], end[rest])])
            self.table.add(h[rest], np.concatenate(ids), np.array([len(x) for x in ids], np.int64))

    def _run(self, buf: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids before each of ``breaks``) of bytes that hold whole words; texts begin at ``breaks``."""
        n = len(buf)
        if not n:
            return np.zeros(0, self.dtype), np.zeros(len(breaks), np.int64)
        kind = _CLASS[buf]
        two = _two_byte_letters(buf)
        kind[two] = kind[two + 1] = _LETTER
        cut = np.zeros(n + 1, bool)
        cut[breaks] = True
        if (kind == _OTHER).any():  # all bytes of a word with such a byte get its class
            gap = kind == _SPACE
            first = np.flatnonzero(~gap & np.concatenate(([True], gap[:-1])) | (cut[:-1] & ~gap))
            bad = np.maximum.reduceat(kind, first) == _OTHER
            word = np.cumsum(np.bincount(first, minlength=n)) - 1
            kind[~gap & bad[np.maximum(word, 0)]] = _OTHER
        full = kind != _SPACE
        begin = cut[:-1] | (kind == _DIGIT)
        begin[0] = True
        begin[1:] |= kind[1:] != kind[:-1]
        stop = np.ones(n, bool)
        stop[:-1] = begin[1:]
        start, end = np.flatnonzero(begin & full), np.flatnonzero(stop & full) + 1
        h = span_hashes(buf, start, end)
        h[h == 0] = 1
        slot = self.table.find(h)
        new = np.flatnonzero(slot < 0)
        if len(new):
            one = new[np.unique(h[new], return_index=True)[1]]
            if not self.table.room(len(one)):
                self.table.clear()
                one = np.unique(h, return_index=True)[1]
                if not self.table.room(len(one)):
                    self.table = PieceTable(1 << (2 * len(one)).bit_length(), self.dtype)
            self._learn(buf, h[one], start[one], end[one], kind[start[one]] == _OTHER)
            slot = self.table.find(h)
        at, lens = self.table.at[slot].astype(np.int64), self.table.len[slot].astype(np.int64)
        cum = np.concatenate(([0], np.cumsum(lens)))
        ids = self.table.ids[np.arange(cum[-1]) + np.repeat(at - cum[:-1], lens)]
        return ids, cum[np.searchsorted(start, breaks)]

    def encode_array(self, texts, end_id: int | None = None):
        """Yield (ids of some texts end to end, ids of each): the texts of a pyarrow string array, null ones empty, in
        order, each followed by ``end_id``. What is held at once is bounded by bytes, or is one text."""
        off, data = text_buffers(texts)
        i, n = 0, len(off) - 1
        while i < n:
            j = min(n, max(i + 1, int(np.searchsorted(off, off[i] + _RUN, "right")) - 1))
            lo, hi = int(off[i]), int(off[j])
            buf = data[lo:hi]
            suspects = np.flatnonzero(_SUSPECT[buf])
            whole = range(i, j) if not self.by_word else np.unique(np.searchsorted(off[i : j + 1], suspects + lo, "right") - 1) + i
            whole = [k for k in whole if not self.by_word or self.odd(data[off[k] : off[k + 1]].tobytes().decode())]
            parts, lens, at = [], [], i
            for k in [*whole, j]:
                if at < k:
                    for a, z in pieces_of(data, int(off[at]), int(off[k])):
                        ids, before = self._run(data[a:z], np.clip(off[at:k] - a, 0, z - a))
                        parts.append(ids)
                        lens.append((at, k, np.diff(np.append(before, len(ids)))))
                if k < j:
                    ids = self._whole([data[off[k] : off[k + 1]].tobytes().decode()])[0]
                    parts.append(ids)
                    lens.append((k, k + 1, np.array([len(ids)])))
                at = k + 1
            size = np.zeros(j - i, np.int64)
            for a, z, x in lens:
                size[a - i : z - i] += x
            ids = np.concatenate(parts) if parts else np.zeros(0, self.dtype)
            if end_id is not None:
                ids, size = np.insert(ids, np.cumsum(size), np.array(end_id, self.dtype)), size + 1
            yield ids, size
            i = j

    def encode(self, texts: list[str]) -> list[bytes]:
        import pyarrow as pa

        out = []
        for ids, size in self.encode_array(pa.array(texts, pa.large_string())):
            cut = np.concatenate(([0], np.cumsum(size)))
            out += [ids[a:z].tobytes() for a, z in zip(cut[:-1], cut[1:])]
        return out


def encoder(path: str) -> Encoder:
    """One encoder for each worker process."""
    if path not in _STATE:
        _STATE[path] = Encoder(path)
    return _STATE[path]


def crc32_u32(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


# ---------------------------------------------------------------- files


def _fs(uri: str):
    """(file system, path) of a folder's URI; local folders as such, others through pyarrow."""
    from pyarrow import fs

    if uri.startswith("file:") or "://" not in uri:
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


def _put(uri: str, name: str, attempt: str, data: list[bytes]) -> None:
    fs, path = _fs(uri)
    tmp = f"{path}/.{name}.{attempt}"
    with fs.open_output_stream(tmp) as f:
        for d in data:
            f.write(d)
    fs.move(tmp, f"{path}/{name}")


def _map(uri: str, name: str, dtype) -> np.ndarray:
    """The file's array: memory-mapped where the folder is local, read otherwise."""
    fs, path = _fs(uri)
    if type(fs).__name__ == "LocalFileSystem":
        return np.memmap(f"{path}/{name}", dtype, "r") if os.path.getsize(f"{path}/{name}") else np.zeros(0, dtype)
    with fs.open_input_file(f"{path}/{name}") as f:
        return np.frombuffer(f.read(), dtype)


def write_token_files(docs: DataFrame, folder: str, vocab: str, end_id: int, per_part: int = 5_000) -> dict:
    """Write the file set; returns what is in ``bases.json``: parts with their documents, ids and bases."""
    spark = docs.sparkSession
    fs, path = _fs(folder)
    fs.create_dir(path, recursive=True)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    parts = partitions_for(spark, rows.count(), per_part)
    # the range borders are sampled: a hash of the text splits repeats of an id, and no text reaches the driver
    rows = rows.withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), "tie").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie").select("doc_id", "text")

    def write(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        task = TaskContext.get()
        enc = encoder(vocab)
        name, ids, lens, keys = f"part-{task.partitionId():05d}", [], [], []
        for b in batches:
            keys.append(b.column(0).fill_null(-(1 << 63)).to_numpy(zero_copy_only=False).astype("<i8"))
            for some, size in enc.encode_array(b.column(1), end_id):
                ids.append(some)
                lens.append(size)
        if lens:
            lens = np.concatenate(lens)
            off = np.concatenate(([0], np.cumsum(lens))).astype("<i8")
            attempt = str(task.taskAttemptId())
            _put(folder, f"{name}.ids", attempt, [x.tobytes() for x in ids])
            _put(folder, f"{name}.off", attempt, [off.tobytes()])
            _put(folder, f"{name}.doc", attempt, [k.tobytes() for k in keys])
            yield pa.RecordBatch.from_arrays([pa.array([task.partitionId()], pa.int32()), pa.array([len(lens)]), pa.array([int(off[-1])]), pa.array([enc.dtype.str])], ["part", "docs", "ids", "dtype"])

    got = sorted(rows.mapInArrow(tidy(write), "part int, docs long, ids long, dtype string").collect())  # a row a part
    bases, at, row = [], 0, 0
    for r in got:
        bases.append({"part": r["part"], "docs": r["docs"], "ids": r["ids"], "base": at, "row": row, "dtype": r["dtype"]})
        at, row = at + r["ids"], row + r["docs"]
    meta = {"end_id": end_id, "ids": at, "docs": row, "parts": bases}
    _put(folder, "bases.json", "0", [json.dumps(meta).encode()])
    return meta


def read_meta(folder: str) -> dict:
    fs, path = _fs(folder)
    with fs.open_input_file(f"{path}/bases.json") as f:
        return json.loads(f.read())


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files."""
    parts = read_meta(folder)["parts"]
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not parts:
        return spark.createDataFrame([], schema)

    def read(batches):
        import pyarrow as pa

        for b in batches:
            for k in b.column(0).to_pylist():
                p = parts[k]
                name = f"part-{p['part']:05d}"
                ids, off, doc = _map(folder, f"{name}.ids", p["dtype"]), _map(folder, f"{name}.off", "<i8"), _map(folder, f"{name}.doc", "<i8")
                crc = np.array([crc32_u32(ids[a:z]) for a, z in zip(off[:-1], off[1:])], np.int64)
                key = pa.array(np.asarray(doc), pa.int64(), mask=np.asarray(doc) == -(1 << 63))
                yield pa.RecordBatch.from_arrays([key, pa.array(np.asarray(off[:-1]) + p["base"]), pa.array(np.diff(off)), pa.array(crc)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return spark.range(0, len(parts), 1, len(parts)).mapInArrow(read, schema)


def round_trip(docs: DataFrame, vocab: str | None = None, end_id: int = 1) -> DataFrame:
    spark = docs.sparkSession
    folder = fresh_path(spark, "tokens")
    write_token_files(docs, folder, vocab or vocabulary_path(), end_id)
    return read_token_files(spark, folder)
