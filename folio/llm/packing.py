"""Packing: first-fit decreasing over a tournament tree of bin capacities, in randomised groups of documents.

Words are cut at the bytes of an Arrow column, without copying them, and each is encoded by the library once while a Python
worker remembers it, through the tasks of a job. Every document is tokenised once and cut into full sequences and a rest.
Full pieces are sequences of their own and meet no tree; they are numbered where they are. Rests and short documents, at most
one a document, are dealt into random groups of bounded expected size, and each group is packed on its own: pieces in order
of falling length, each into the first bin with room, found in O(log n) in a tournament tree whose inner nodes hold the most
room below them. Groups share nothing, so a lost executor repeats its own groups only.

Defined results: null text is the empty text; the empty text is the one end token; repeated rows each give their pieces;
ties in length are broken by a hash, then by document; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import unicodedata
import uuid
import zlib
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import splitter
from .common import staged, table

#: What the byte-level pre-tokenizer tells apart, of the characters below U+0250; texts beyond are split by the library itself, so that no difference between Unicode tables counts (fixed values).
LETTER, NUMBER, BLANK, OTHER = range(4)
KIND = np.array([BLANK if c in "\t\n\v\f\r \x85\xa0" else {"L": LETTER, "N": NUMBER}.get(unicodedata.category(c)[0], OTHER) for c in map(chr, range(0x250))], np.uint8)
#: Bytes of text that are split at once.
SOME = 4_000_000
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, key long"
OUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Tree:
    """Bins of equal capacity; place() gives the first bin with room and its offset there."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(bins - 1, 0).bit_length()
        self.room = [capacity] * (2 * self.leaves)
        self.capacity = capacity

    def place(self, size: int) -> tuple[int, int]:
        room, k = self.room, 1
        while k < self.leaves:
            k *= 2
            if room[k] < size:
                k += 1
        offset = self.capacity - room[k]
        room[k] -= size
        leaf = k - self.leaves
        while k > 1:
            k //= 2
            best = room[2 * k] if room[2 * k] > room[2 * k + 1] else room[2 * k + 1]
            if room[k] == best:
                break
            room[k] = best
        return leaf, offset


class Ids:
    """Word to ids with every word encoded once; `limit` words and eight times as many ids are kept at most, then the table starts anew."""

    def __init__(self, path: str, limit: int):
        self.path, self.limit = path, limit
        self.clear()

    def clear(self):
        self.at: dict[str, int] = {}
        self.flat, self.start, self.size = np.zeros(0, np.uint32), np.zeros(1, np.int32), np.zeros(0, np.int64)

    def codes(self, vocab: list[str]) -> np.ndarray:
        """Numbers in the table of different words."""
        out = np.fromiter(map(self.at.get, vocab, repeat(-1)), np.int64, len(vocab))
        new = np.flatnonzero(out < 0)
        if len(self.at) + len(new) > self.limit or len(self.flat) > 8 * self.limit:
            self.clear()
            new = np.arange(len(vocab))
        if len(new):
            ids, flat, lengths, first = splitter(self.path).ids, [], [], len(self.at)
            for w in (words := [vocab[i] for i in new.tolist()]):
                x = ids(w)
                flat += x
                lengths.append(len(x))
            out[new] = np.arange(first, first + len(new))
            self.at.update(zip(words, range(first, first + len(new))))
            self.flat = np.concatenate([self.flat, np.array(flat, np.uint32)])
            self.size = np.concatenate([self.size, np.array(lengths, np.int64)])
            self.start = np.append(0, np.cumsum(self.size)).astype(np.int32)
        return out

    def gather(self, codes: np.ndarray) -> np.ndarray:
        return pa.ListArray.from_arrays(pa.array(self.start), pa.array(self.flat)).take(pa.array(codes)).flatten().to_numpy()


@lru_cache(1)
def known_ids(path: str, limit: int, job: str) -> Ids:
    """One table a Python worker, which serves the tasks of one job that follow each other there."""
    return Ids(path, limit)


def word_starts(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Where the byte-level pre-tokenizer starts words, in the UTF-8 bytes of texts of characters below U+0250 that lie from off[i] to off[i + 1].

    Its rules: 's 't 're 've 'm 'll 'd; letters, numbers or others in a run, with one space before; blanks in a run, of which
    the last is left to what follows.
    """
    n = len(data)
    bound = np.zeros(n + 1, bool)  # a text starts or the last one ends
    bound[off] = True
    kind = KIND[data]
    lead = np.flatnonzero(data >= 0xC2)  # of two bytes
    kind[lead] = kind[lead + 1] = KIND[(data[lead].astype(np.int64) & 31) << 6 | data[lead + 1] & 63]
    new = bound[:-1].copy()
    new[1:] |= (kind[1:] != kind[:-1]) & (data[:-1] != 0x20)
    blank = kind == BLANK
    blank[:-1] &= ~blank[1:]
    new |= blank & ~bound[1:]  # the last blank before something else in its text
    second = lead[new[lead + 1]] + 1
    new[second], new[second - 1] = False, True
    mark = np.flatnonzero((data == 0x27) & new & ~bound[1:])
    one = data[mark + 1]
    two = np.where(bound[mark + 2], 0, data[np.minimum(mark + 2, n - 1)])
    long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
    cut = long | np.isin(one, np.frombuffer(b"stmd", np.uint8))
    new[mark[cut] + 1] = False
    after = mark[cut] + 2 + long[cut]
    new[after[after < n]] = True
    return np.flatnonzero(new)


def _bytes(text: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of texts in a row, and the offsets of the texts with a last one."""
    _, off, data = text.buffers()
    off = np.frombuffer(off, np.int32)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(data or b"", np.uint8)[off[0] : off[-1]]
    return data, off - off[0]


def _words(path: str, b: pa.RecordBatch):
    """Of some rows of b(doc_id, text) at a time: doc_ids, the words of their texts in a row, and offsets of the texts among the words with a last one."""
    s = splitter(path)
    _, off = _bytes(b.column("text"))
    lo = 0
    while lo < b.num_rows:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + SOME, "right")) - 1)
        some = b.slice(lo, hi - lo)
        lo = hi
        odd = np.zeros(some.num_rows, bool)
        for x in s.special:
            odd |= pc.match_substring(some.column("text"), x).to_numpy(zero_copy_only=False)
        data, at = _bytes(some.column("text"))
        far = np.flatnonzero(data >= 0xC9)
        far = far[(data[far] > 0xC9) | (data[np.minimum(far + 1, len(data) - 1)] >= 0x90)]
        odd[np.searchsorted(at, far, "right") - 1] = True
        if odd.any():
            rest = some.filter(pa.array(odd))
            lists = pa.array([s.words(t) for t in rest.column("text").to_pylist()], pa.list_(pa.string()))
            yield rest.column("doc_id"), lists.values, lists.offsets.to_numpy().astype(np.int64)
            some = some.filter(pa.array(~odd))
            data, at = _bytes(some.column("text"))
        starts = word_starts(data, at) if len(data) else np.zeros(0, np.int64)
        bounds = np.append(starts, len(data)).astype(np.int32)
        yield some.column("doc_id"), pa.StringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(data)), np.searchsorted(starts, at)


def _pieces(path: str, capacity: int, end: int, limit: int):
    job = uuid.uuid4().hex

    def run(batches):
        known = known_ids(path, limit, job)
        for doc_id, words, off in (x for b in batches if b.num_rows for x in _words(path, b) if len(x[0])):
            enc = words.dictionary_encode()
            codes = known.codes(enc.dictionary.to_numpy(zero_copy_only=False).tolist())[enc.indices.to_numpy()]
            # all ids of the rows one after another, each document's followed by the end token
            n = len(doc_id)
            count = np.add.reduceat(np.append(known.size[codes], 0), off[:-1]) * (np.diff(off) > 0)
            ends = np.cumsum(count + 1)
            ids = np.full(int(ends[-1]), end, "<u4")
            own = np.ones(len(ids), bool)
            own[ends - 1] = False
            ids[own] = known.gather(codes)
            each = -(-(count + 1) // capacity)
            row = np.repeat(np.arange(n), each)
            start = (np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)) * capacity
            total = (count + 1)[row]
            length = np.minimum(capacity, total - start)
            lo = (ends - count - 1)[row] + start
            view = memoryview(ids).cast("B")
            crc = np.array([zlib.crc32(view[4 * x : 4 * (x + m)]) for x, m in zip(lo.tolist(), length.tolist())], np.int64)
            key = np.random.default_rng(len(row)).integers(0, 2**62, len(row)) ^ crc * 2654435761 % 2**62
            yield pa.RecordBatch.from_arrays([doc_id.take(pa.array(row)), *(pa.array(x, pa.int64()) for x in (start, length, crc, total, key))], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "key"])

    return run


def _pack(capacity: int):
    def run(key, t):
        t = t.sort_by([("length", "descending"), ("key", "ascending"), ("doc_id", "ascending"), ("start", "ascending")])
        lengths = t.column("length").to_pylist()
        tree = Tree(len(lengths), capacity)
        at = [tree.place(n) for n in lengths]
        group = key[0].as_py()
        t = t.append_column("sequence_id", pa.array([group << 32 | b for b, _ in at], pa.int64())).append_column("offset", pa.array([o for _, o in at], pa.int64()))
        return t.select(["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, path: str, capacity: int = 2048, end: int = 1, group_rows: int = 16_384, known_words: int = 1_000_000) -> DataFrame:
    """One row per piece of every row of docs(doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    given = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    pieces = staged(given.mapInArrow(_pieces(path, capacity, end, known_words), SCHEMA), "pieces", 1000)  # six numbers a piece
    full = pieces.where(F.col("length") == capacity)
    # group numbers take the bits from 32 on, row numbers of full pieces those below 2^62
    full = full.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.lit(1 << 62) + F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = pieces.where(F.col("length") < capacity)
    groups = max(1, -(-rest.count() // group_rows))
    dealt = rest.withColumn("pack_group", F.pmod(F.xxhash64("key", "doc_id", "start"), F.lit(groups)))
    return dealt.groupBy("pack_group").applyInArrow(_pack(capacity), OUT).unionByName(full)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
