"""BPE encoding and decoding through a table of distinct words.

Spark splits every text into the words that the tokenizer's own pre-tokenizer would see. Each task turns its documents into
chunks: a list of the chunk's distinct words and, per document, the positions' indices into that list. The words of all chunks
meet in buckets by hash, where every distinct word is encoded once; the ids go back to the chunks, which join them to their
positions, and decode through the id-to-piece table, whose size is the vocabulary's. Only packed distinct words, ids and
indices are shuffled, never one row per word.

Defined results: null text is the empty text; the empty text has no ids and decodes to the empty string; repeated rows each
give a row; extra columns are ignored; a special token's string in a text gives that token's id, as in the library; a null doc_id
is kept; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged, table

#: Texts beyond this range (and with the dotted capital I) are split by the library itself, so that no difference between Unicode tables of two regex engines counts.
ODD = r"[^\x{0}-\x{24F}]|\x{130}"
#: The pre-tokenizer's pattern over lower-cased text of that range (fixed value).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\t-\r \x{85}\x{A0}\p{L}\p{N}]+"


class Alphabet(dict):
    """Character to what stands for its bytes in the byte-level alphabet, asked of the library once a character."""

    def __init__(self, library):
        super().__init__()
        self.library = library

    def __missing__(self, c: str) -> str:
        self[c] = "".join(x for x, _ in self.library.pre_tokenize_str(c))
        return self[c]


class Splitter:
    """The words of a text as the tokenizer's normalizer and pre-tokenizer give them, special tokens whole."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok = Tokenizer.from_file(path)
        self.alphabet = Alphabet(pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False))
        self.special = {x["content"]: x["id"] for x in json.loads(self.tok.to_str())["added_tokens"]}
        self.cut = re.compile("|".join(re.escape(x) for x in sorted(self.special, key=len, reverse=True)) or r"(?!)")

    def words(self, text: str) -> list[str]:
        out, at = [], 0
        for m in [*self.cut.finditer(text), None]:
            part = text[at : m.start() if m else len(text)]
            if part:
                norm = self.tok.normalizer.normalize_str(part) if self.tok.normalizer else part
                out += [norm[a:b] for _, (a, b) in self.tok.pre_tokenizer.pre_tokenize_str(norm)]
            if m:
                out.append(m[0])
                at = m.end()
        return out

    def ids(self, word: str) -> list[int]:
        if word in self.special:
            return [self.special[word]]
        return [t.id for t in self.tok.model.tokenize("".join(map(self.alphabet.__getitem__, word)))]


@lru_cache(2)
def splitter(path: str) -> Splitter:
    return Splitter(path)


def special_pattern(path: str) -> str:
    with open(path) as f:
        return "|".join("\\Q" + x["content"] + "\\E" for x in json.load(f)["added_tokens"]) or "(?!)"


def _squeeze(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.Codec("zstd", compression_level=6).compress(data, asbytes=True)


def _open(data: bytes) -> bytes:
    n = int.from_bytes(data[:8], "little")
    return pa.Codec("zstd").decompress(data[8:], decompressed_size=n, asbytes=True) if n else b""


def _planes(x: np.ndarray) -> bytes:
    """Numbers below 2^32 as four planes of bytes, of which the upper ones are mostly zero."""
    return _squeeze(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def _numbers(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(_open(data), np.uint8).reshape(4, -1).T).view("<u4").reshape(-1)


def _chunks(path: str, buckets: int, most_words: int, most_bytes: int):
    def run(batches):
        import xxhash

        part, k, seen, rows, size = TaskContext.get().partitionId(), 0, {}, [], 0
        names, open_, held = ["chunk", "doc_ids", "packed", "bucket", "words"], [], 0

        def close():
            """The open documents as one row: ids, numbers of words, and indices, which pack better together."""
            if open_:
                rows.append(([d for d, _ in open_], _planes(np.array([len(c) for _, c in open_], np.uint32)), _planes(np.concatenate([c for _, c in open_]))))
                open_.clear()
                return len(rows[-1][2])
            return 0

        def out():
            close()
            name, n = f"{part}-{k}", len(rows)
            yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array([r[0] for r in rows], pa.list_(pa.int64())), pa.array([r[2] for r in rows], pa.binary()), pa.nulls(n, pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names)
            words = list(seen)
            home = np.fromiter((xxhash.xxh32_intdigest(w) % buckets for w in words), np.int64, len(words))
            order = np.argsort(home, kind="stable")
            cut = np.searchsorted(home[order], np.arange(buckets + 1))
            there = [j for j in range(buckets) if cut[j] < cut[j + 1]]
            for lo in range(0, len(there), 1000):
                some = there[lo : lo + 1000]
                each = [order[cut[j] : cut[j + 1]] for j in some]
                m = len(some)
                yield pa.RecordBatch.from_arrays([pa.array([name] * m), pa.nulls(m, pa.list_(pa.int64())), pa.array([_planes(e) for e in each], pa.binary()), pa.array(some, pa.int32()), pa.array([_squeeze("\n".join(words[i] for i in e).encode("utf-8", "surrogatepass")) for e in each], pa.binary())], names)

        for b in batches:
            split = splitter(path)
            col = b.column("words")
            odd = b.column("odd").to_pylist()
            if any(x is not None for x in odd):
                lists = col.to_pylist()
                col = pa.array([split.words(t) if t is not None else w for t, w in zip(odd, lists)], pa.list_(pa.string()))
            off = col.offsets.to_numpy().astype(np.int64)
            enc = col.values.slice(off[0], off[-1] - off[0]).dictionary_encode()
            off -= off[0]
            codes, vocab = enc.indices.to_numpy(), enc.dictionary.to_pylist()
            if len(seen) + len(vocab) > most_words and seen:
                yield from out()
                k, seen, rows, size, held = k + 1, {}, [], 0, 0
            here = np.fromiter((seen.setdefault(w, len(seen)) for w in vocab), np.uint32, len(vocab))
            codes = here[codes] if len(vocab) else np.zeros(0, np.uint32)
            for i, d in enumerate(b.column("doc_id").to_pylist()):
                open_.append((d, codes[off[i] : off[i + 1]]))
                held += int(off[i + 1] - off[i])
                if held > 150_000:
                    size, held = size + close(), 0
            if size > most_bytes:
                yield from out()
                k, seen, rows, size, held = k + 1, {}, [], 0, 0
        if rows or open_:
            yield from out()

    return run


def _encode(path: str):
    """A bucket's words: every distinct one is encoded once, and each chunk gets the ids of its words, by position.

    Rows come ordered by bucket, so that the table holds one bucket's words at a time.
    """

    def run(batches):
        s, table_, home = splitter(path), {}, None
        for b in batches:
            out = []
            for bucket, blob in zip(b.column("bucket").to_pylist(), b.column("words").to_pylist()):
                if bucket != home:
                    table_, home = {}, bucket
                lengths, flat = [], []
                for w in _open(blob).decode("utf-8", "surrogatepass").split("\n"):
                    ids = table_.get(w)
                    if ids is None:
                        ids = table_[w] = s.ids(w)
                    lengths.append(len(ids))
                    flat += ids
                out.append((_planes(np.array(lengths, np.uint32)), _planes(np.array(flat, np.uint32))))
            yield pa.RecordBatch.from_arrays([b.column("chunk"), b.column("packed"), pa.array([x for x, _ in out], pa.binary()), pa.array([x for _, x in out], pa.binary())], ["chunk", "places", "lengths", "ids"])

    return run


def _assemble(pieces):
    def run(key, docs, words):
        name = pieces.value
        places, lengths, flat = [], [], []
        for a, b, c in zip(*(words.column(x).to_pylist() for x in ("places", "lengths", "ids"))):
            places.append(_numbers(a))
            lengths.append(_numbers(b))
            flat.append(_numbers(c))
        n = sum(map(len, places))
        ids, text, count = [""] * n, [""] * n, np.zeros(n, np.int64)
        if n:
            at, size, each = np.concatenate(places), np.concatenate(lengths).astype(np.int64), np.concatenate(flat)
            count[at] = size
            digits = [str(x) for x in range(len(name))]
            each = each.tolist()
            lo = 0
            for i, m in zip(at.tolist(), size.tolist()):
                x = each[lo : lo + m]
                lo += m
                ids[i] = " ".join([digits[v] for v in x])
                text[i] = " ".join([name[v] for v in x])
        out = [[], [], [], []]
        for names, lengths, packed in zip(*(docs.column(x).to_pylist() for x in ("doc_ids", "words", "packed"))):
            all_, lo = _numbers(packed), 0
            for d, m in zip(names, _numbers(lengths).tolist()):
                codes = all_[lo : lo + m]
                lo += m
                each = codes.tolist()
                out[0].append(d)
                out[1].append(int(count[codes].sum()))
                out[2].append(hashlib.sha256(" ".join([ids[i] for i in each]).encode()).hexdigest())
                out[3].append(hashlib.sha256(" ".join([text[i] for i in each]).encode("utf-8", "surrogatepass")).hexdigest())
        return pa.table({"doc_id": pa.array(out[0], pa.int64()), "n_tokens": pa.array(out[1], pa.int64()), "ids_sha256": pa.array(out[2], pa.string()), "decoded_sha256": pa.array(out[3], pa.string())})

    return run


def pieces(path: str) -> list[str]:
    """The id-to-piece table: as many rows as the vocabulary has, whatever the corpus."""
    from tokenizers import Tokenizer

    vocab = Tokenizer.from_file(path).get_vocab(with_added_tokens=True)
    out = [""] * (max(vocab.values(), default=-1) + 1)
    for piece, k in vocab.items():
        out[k] = piece
    return out


def encode_decode(docs: DataFrame, path: str, most_words: int = 1_000_000, most_bytes: int = 32_000_000) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of docs(doc_id, text)."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    odd = text.rlike(ODD) | text.rlike(special_pattern(path))
    split = F.regexp_extract_all(F.lower(text), F.lit(SPLIT), F.lit(0))
    given = docs.select(F.col("doc_id").cast("long"), F.when(odd, text).alias("odd"), F.when(odd, F.array().cast("array<string>")).otherwise(split).alias("words"))
    n = docs.count()
    buckets = max(32, min(n // 4000, math.isqrt(n)))  # distinct words grow more slowly than the corpus
    rows = staged(given.mapInArrow(_chunks(path, buckets, most_words, most_bytes), "chunk string, doc_ids array<long>, packed binary, bucket int, words binary"), "bpe", 1000)
    words = rows.where("bucket is not null").select("chunk", "packed", "bucket", "words").repartition(buckets, "bucket").sortWithinPartitions("bucket")
    back = words.mapInArrow(_encode(path), "chunk string, places binary, lengths binary, ids binary")
    kept = rows.where("bucket is null").select(F.col("chunk").alias("part"), "doc_ids", "words", "packed")
    table_ = spark.sparkContext.broadcast(pieces(path))
    return kept.groupBy("part").cogroup(back.groupBy("chunk")).applyInArrow(_assemble(table_), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
