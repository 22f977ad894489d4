"""Joins that deal the rows of heavy keys into parts, and names that don't clash."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def aside(docs: DataFrame, names: list[str]) -> DataFrame:
    """docs with its columns of these names, which an operator is to add, renamed to given_<name>."""
    for name in names:
        if name in docs.columns:
            other = f"given_{name}"
            while other in docs.columns:
                other = f"given_{other}"
            docs = docs.withColumnRenamed(name, other)
    return docs


def heavy_keys(counts: DataFrame, keys: list[str], total: int, n: str = "n") -> DataFrame:
    """keys, parts: the keys of counts(keys, n) that have over a quarter of a partition's share of `total` rows, and the parts to deal them into.

    There are at most 4 x shuffle partitions of them, whatever the data, so that they may be broadcast.
    """
    limit = max(1, total // (4 * int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return counts.where(F.col(n) > limit).select(*keys, F.ceil(F.col(n) / limit).cast("int").alias("parts"))


def spread_join(big: DataFrame, small: DataFrame, keys: list[str], heavy: DataFrame | None = None, by=None, how: str = "inner") -> DataFrame:
    """big joined to small on keys, null to null; rows of a heavy key are dealt into parts, and its small rows, which are few, go to each part.

    heavy: heavy_keys() by some of the keys, those of big counted here if not given. by: what deals a key's rows, the same
    whenever a task runs again: a hash of the whole row, or a row number where big is a staged table and rows may be equal.
    """
    if heavy is None:
        heavy = heavy_keys(big.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), keys, big.count())
    hot = heavy.columns[:-1]
    heavy = F.broadcast(heavy.toDF(*[f"_h{i}" for i in range(len(hot))], "_parts"))
    every = lambda pairs: reduce(lambda a, b: a & b, [F.col(x).eqNullSafe(F.col(y)) for x, y in pairs])
    same, names = every(zip(hot, heavy.columns)), [f"_k{i}" for i in range(len(keys))]
    left = big.join(heavy, same, "left").withColumn("_part", F.when(F.col("_parts").isNull(), 0).otherwise(F.pmod(F.xxhash64(*big.columns) if by is None else by, F.col("_parts").cast("long"))).cast("int")).drop(*heavy.columns)
    right = small.join(heavy, same, "left").withColumn("_of", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop(*heavy.columns)
    right = right.withColumnsRenamed(dict(zip(keys, names)))
    return left.join(right, every(zip(keys, names)) & (F.col("_part") == F.col("_of")), how).drop(*names, "_part", "_of")
