"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are its distinct words, their stems (first letters), word pairs and pairs with one word between, hashed to 2^bits slots and present or
absent. Training takes the labelled rows outside the held-out fold, at most `most_rows` of them (those of smallest hash), deals
them to `shards` tasks, and runs FTRL-proximal in each: per-coordinate rates from the sums of squared gradients and L1
shrinkage, so most weights are exactly zero. The shards' weights are averaged; what is broadcast is the list of nonzero
weights, at most 2^bits of them. Scoring reads every whole text once and shuffles nothing.

Defined results: null text is the empty text; a text without words gets the intercept's score; a null doc_id counts as the
text "null" for the fold and has no label; documents labelled more than once count with their highest label; a labelled doc_id
that stands in several rows trains with one text (the least), so that the bound holds for rows whatever the copies; without any
training row every score is 0 (weights zero would say 0.5, which is no evidence of toxicity); repeated rows score alike; an empty
table gives no rows; extra columns are ignored by the query and kept by scored() and accepted().
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.skew import aside
from .common import mix, table, words_of

BITS, MOST_ROWS, SHARDS, EPOCHS = 20, 10_000, 1, 4
#: Texts whose features a worker holds at once when scoring.
SOME = 250
#: Lengths of the word beginnings that count as stems, one more kind of unigram.
STEMS = (4, 5, 6, 7)
PAIR, SKIP = np.uint64(0x51), np.uint64(0xA7)


def word_slots(vocab: list[str]) -> np.ndarray:
    """For each word the 64-bit hashes of the word and of its stems; a stem that isn't shorter repeats the word's hash."""
    import xxhash

    out = np.empty((len(vocab), 1 + len(STEMS)), np.uint64)
    h = xxhash.xxh64_intdigest
    for i, w in enumerate(vocab):
        out[i, 0] = x = h(w)
        n = len(w)
        for j, m in enumerate(STEMS, 1):
            out[i, j] = h(w[:m] + "-") if n > m else x
    return out


def features(words: pa.ListArray, bits: int, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the rows' features and the row of each, distinct; with `wanted` (slot to bool) only those slots."""
    off = words.offsets.to_numpy().astype(np.int64)  # of a slice: from its own first row
    enc = words.values.slice(off[0], off[-1] - off[0]).dictionary_encode()
    off = off - off[0]
    codes = enc.indices.to_numpy()
    hashes = word_slots(enc.dictionary.to_pylist())
    shift = np.uint64(64 - bits)
    slots = (hashes >> shift).astype(np.int64)
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))
    some, rows = [], []

    def add(slot, at):
        if wanted is not None:
            keep = wanted[slot]
            slot, at = slot[keep], at[keep]
        some.append(slot)
        rows.append(at)

    seen = np.unique(row * max(len(slots), 1) + codes) if len(codes) else np.zeros(0, np.int64)
    at, word = seen // max(len(slots), 1), seen % max(len(slots), 1)
    for j in range(slots.shape[1]):
        add(slots[word, j], at)
    h = hashes[codes, 0] if len(codes) else np.zeros(0, np.uint64)
    for gap, salt in ((1, PAIR), (2, SKIP)):
        if len(h) > gap:
            same = row[gap:] == row[:-gap]
            both = mix(h[:-gap] * np.uint64(3) + h[gap:] * np.uint64(7) + salt)
            add((both[same] >> shift).astype(np.int64), row[gap:][same])
    pair = np.unique(np.concatenate(rows) << (bits + 1) | np.concatenate(some))
    return pair & ((1 << (bits + 1)) - 1), pair >> (bits + 1)


def ftrl(rows: list[tuple[np.ndarray, int]], bits: int, epochs: int, alpha=0.2, beta=1.0, l1=2.0, l2=0.5) -> tuple[np.ndarray, np.ndarray]:
    """(slots, weights) that are not zero; the last slot is the intercept, free of L1."""
    size = 1 << bits
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    shrink = np.full(size + 1, l1)
    shrink[size] = 0

    def weights(i):
        zi = z[i]
        return np.where(np.abs(zi) <= shrink[i], 0.0, -(zi - np.sign(zi) * shrink[i]) / ((beta + np.sqrt(n[i])) / alpha + l2))

    for e in range(epochs):
        for k in np.random.default_rng(e).permutation(len(rows)):
            i, y = rows[k]
            w = weights(i)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
            root = np.sqrt(n[i])
            n[i] += g * g
            z[i] += g - (np.sqrt(n[i]) - root) / alpha * w
    w = weights(np.arange(size + 1))
    at = np.flatnonzero(w)
    return at, w[at]


def _train(bits: int, epochs: int):
    def run(key, t):
        t = t.sort_by("k")
        words, rows = t.column("h").combine_chunks(), []
        for lo in range(0, t.num_rows, 400):  # a few texts at a time: their word pairs take more memory than their features
            slot, row = features(words.slice(lo, 400), bits)
            cut = np.searchsorted(row, np.arange(min(400, t.num_rows - lo) + 1))
            rows += [np.append(slot[cut[i] : cut[i + 1]], 1 << bits).astype(np.int32) for i in range(len(cut) - 1)]
        rows = list(zip(rows, t.column("toxic").to_pylist()))
        at, w = ftrl(rows, bits, epochs)
        return pa.table({"slot": pa.array(at, pa.int64()), "w": pa.array(w, pa.float64())})

    return run


def held_out():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, bits: int = BITS, most_rows: int = MOST_ROWS, shards: int = SHARDS, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """(slots, weights): the mean of the shards' models, at most 2^bits + 1 of them, whatever the corpus."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held_out())
    spread = F.xxhash64("doc_id", F.lit(7))
    total = known.count()
    if total > most_rows:  # a threshold of the hash, so that the bound needs no sort of all labels
        known = known.where(F.pmod(spread, F.lit(1 << 30)) < F.lit(int((1 << 30) * (most_rows / total))))
    # at most about most_rows labels, a few bytes each; of the copies of a labelled doc_id one text stays, combined before the shuffle
    picked = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.max("toxic").alias("toxic"))
    picked = picked.select("doc_id", "toxic", words_of(F.col("text")).alias("h"), spread.alias("k"))
    parts = picked.withColumn("shard", F.pmod("k", F.lit(shards))).groupBy("shard").applyInArrow(_train(bits, epochs), "slot long, w double")
    found = parts.groupBy("slot").agg((F.sum("w") / shards).alias("w")).toPandas()
    return found["slot"].to_numpy(np.int64), found["w"].to_numpy(float)


def _score(model, bits: int):
    def run(batches):
        w = np.zeros((1 << bits) + 1)
        at, values = model.value
        w[at] = values
        some, wanted = len(at) > 0, w != 0
        # Spark bounds a batch's bytes; a text's features take more memory than the text, so they are made for a few texts at a time
        for b in (whole.slice(lo, SOME) for whole in batches for lo in range(0, whole.num_rows, SOME)):
            slot, row = features(b.column(b.num_columns - 1), bits, wanted)
            total = np.bincount(row, w[slot], b.num_rows) + w[1 << bits]
            p = 1 / (1 + np.exp(-np.clip(total, -35, 35))) if some else np.zeros(b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(p, pa.float64())], [*b.schema.names[:-1], "score"])

    return run


def scored(docs: DataFrame, weights: tuple[np.ndarray, np.ndarray], bits: int = BITS, name: str = "score") -> DataFrame:
    """docs (any columns, among them text) with the score under `name`; a column of docs of that name is returned as given_<name>."""
    docs = aside(docs, [name])
    model = docs.sparkSession.sparkContext.broadcast(weights)
    given = docs.select("*", words_of(F.col("text")).alias(name))  # the words, in the place that the score takes
    return given.mapInArrow(_score(model, bits), T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def accepted(docs: DataFrame, labels: DataFrame, cutoff: float = 0.5) -> DataFrame:
    """The rows of docs scored below cutoff by a model trained on the labelled ones among them; docs' own columns, a column score among them."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    given = docs.toDF(*names).withColumnRenamed(names[docs.columns.index("text")], "text")
    out = scored(given, train(docs, labels)).where(F.col("score") < cutoff).drop("score")
    return out.toDF(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = scored(docs.select("doc_id", held_out().alias("held_out"), "text"), train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
