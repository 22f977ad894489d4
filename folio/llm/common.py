"""What the operators share: tables, durable staging, words as Arrow arrays, connected components."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.skew import heavy_keys, spread_join
from ..operators.stage import BATCH, discard, shared_dir, staged  # noqa: F401

#: Words of the license and near-duplicate operators, after A-Z is lower-cased (fixed value).
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Characters that are no part of a whitespace-separated word (fixed value).
BLANKS = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text):
    """A-Z lower-cased, null as the empty string, nothing else changed."""
    return F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    """The array of lower-cased words."""
    return F.regexp_extract_all(ascii_lower(text), F.lit(WORD), F.lit(0))


def hashed(words):
    """64-bit hashes of an array of strings."""
    return F.transform(words, lambda w: F.xxhash64(w))


def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """An Arrow list column as (flat values, offsets of the rows with a last one)."""
    column = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    offsets = column.offsets.to_numpy().astype(np.int64)
    values = column.values.slice(offsets[0], offsets[-1] - offsets[0])
    return values.to_numpy(zero_copy_only=False), offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the public splitmix64 steps), vectorised; wraps around."""
    x = x.astype(np.uint64, copy=True)
    x += np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def shingles(hashes: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `width` words and the row of each; a row with fewer words gives one run of them all, a row without words none."""
    n = len(hashes)
    h = hashes.astype(np.uint64)
    lengths = np.diff(offsets)
    row = np.repeat(np.arange(len(lengths)), lengths)
    left = offsets[1:][row] - np.arange(n)  # words from here to the end of the row
    out = np.full(n, 1469598103934665603, np.uint64)
    for k in range(width):
        there = np.zeros(n, np.uint64)
        there[: max(n - k, 0)] = h[k:]
        out = np.where(left > k, mix(out ^ there), out)
    first = np.zeros(n, bool)
    first[offsets[:-1][lengths > 0]] = True
    keep = (left >= width) | (first & (lengths[row] < width))
    return out[keep], row[keep]


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, comp) of every vertex of edges(a, b): comp is the smallest id of its component.

    Alternates large-star and small-star rounds; no vertex's neighbours are gathered, every round is a min aggregate
    and a join in which the rows of a vertex of many edges are dealt into parts, and each round's edges are written to the
    shared folder in place of the last round's. Ends when a round changes nothing.
    """

    def mark(x):
        return x.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    e = staged(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    seen = mark(e)
    for _ in range(rounds):
        total = seen[0]
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = staged(both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), "least")
        large = spread_join(both, least.select("u", F.least("u", "m").alias("m")), ["u"], heavy_keys(least, ["u"], 2 * total))
        large = staged(large.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large")
        root = staged(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), "root")
        small = spread_join(large, root.select("u", "m"), ["u"], heavy_keys(root, ["u"], total))
        after = staged(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(root.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "edges")
        discard(e, least, large, root)
        e, last, seen = after, seen, mark(after)
        if seen == last:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("id"), F.col("m").alias("comp")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("comp"))).groupBy("id").agg(F.min("comp").alias("comp"))

