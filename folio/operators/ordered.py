"""Joins and runs along an order: the last row before, the nearest one, and runs without a gap.

Rows are dealt by a range partitioning over key and order, so a key of any size lies in as many partitions as it fills, one after the
other. Inside a partition a window carries values from row to row; over the edges of partitions a key's last values are carried
by a window over one row for each partition that the key lies in. No window holds a key whole, and no pair of rows that doesn't match is formed.

Equal places of a key are one while they are ordered, and met by their rows again with the rows of a heavy place dealt into parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .skew import aside, heavy_keys, spread_join
from .stage import staged


def _sliced(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """rows, written, with _p: the number of their range partition by keys and order."""
    return staged(rows.repartitionByRange(*keys, *order).withColumn("_p", F.spark_partition_id()), "slices")


def _before(slices: DataFrame, keys: list[str], values: dict[str, Column]) -> DataFrame:
    """keys, _p and, for each value (an aggregate of a key's rows in a partition that may be null), its last one in the key's partitions before."""
    ends = slices.groupBy(*keys, "_p").agg(*[v.alias(c) for c, v in values.items()])
    earlier = Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    return ends.select(*keys, "_p", *[F.last(c, ignorenulls=True).over(earlier).alias(c) for c in values])


def _last(points: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """keys, _at and v, that of right's last row at or before, of every points(keys, _at); right(keys, _at, v): one row for each place, v begins with it."""
    both = points.select(*keys, "_at", F.lit(1).alias("_tag"), F.lit(None).cast(right.schema["v"].dataType).alias("v")).unionByName(right.select(*keys, "_at", F.lit(0).alias("_tag"), "v"))
    slices = _sliced(both, keys, ["_at", "_tag"])
    here = F.last("v", ignorenulls=True).over(Window.partitionBy("_p", *keys).orderBy("_at", "_tag"))
    carry = _before(slices, keys, {"carry": F.max("v")})
    return slices.withColumn("v", here).where("_tag = 1").join(carry, [*keys, "_p"], "left").select(*keys, "_at", F.coalesce("v", "carry").alias("v"))


def asof(left: DataFrame, right: DataFrame, keys: list[str], at: str, direction: str = "backward", within: int | None = None) -> DataFrame:
    """left with matched_at and right's other columns of the row of equal keys that is last at or before its `at` (backward), first at or after
    it (forward), or nearest (ties to the earlier one); `within`: how far away it may be.

    `at` is a whole number in both (a time as microseconds). Of right's rows at one place that with the greatest other columns, compared from
    left to right, is the match; null keys and places match nothing; every row of left is returned once, repeated ones too; columns of left named like the
    new ones are returned as given_<name>; an empty right matches nothing.
    """
    values = [c for c in right.columns if c not in (*keys, at)]
    left = aside(left, ["matched_at", *values])
    known = lambda df: df.where(" and ".join(f"`{c}` is not null" for c in (*keys, at)))
    places = staged(known(left).groupBy(*keys, F.col(at).cast("long").alias("_at")).agg(F.count(F.lit(1)).alias("n")), "places")
    rows = known(right).select(*keys, F.col(at).cast("long").alias("_at"), *values)

    def met(sign: int) -> DataFrame:
        turned = rows.withColumn("_at", sign * F.col("_at"))
        best = turned.groupBy(*keys, "_at").agg(F.max(F.struct("_at", *values)).alias("v"))
        return _last(places.select(*keys, (sign * F.col("_at")).alias("_at")), best, keys).select(*keys, (sign * F.col("_at")).alias("_at"), F.when(F.col("v").isNotNull(), F.struct((sign * F.col("v._at")).alias("_at"), *[F.col(f"v.{c}").alias(c) for c in values])).alias("v"))

    if direction == "nearest":
        ahead = met(-1).withColumnRenamed("v", "w")
        out = met(1).join(ahead, [*keys, "_at"])
        near = F.col("w._at").isNull() | (F.col("_at") - F.col("v._at") <= F.col("w._at") - F.col("_at"))
        out = out.withColumn("v", F.when(F.col("v").isNotNull() & near, F.col("v")).otherwise(F.col("w"))).drop("w")
    else:
        out = met(-1 if direction == "forward" else 1)
    if within is not None:
        out = out.withColumn("v", F.when(F.abs(F.col("_at") - F.col("v._at")) <= within, F.col("v")))
    out = out.select(*keys, "_at", "v")
    big = left.withColumn("_at", F.col(at).cast("long"))
    heavy = heavy_keys(places, [*keys, "_at"], places.agg(F.sum("n")).first()[0] or 0)
    out = spread_join(big, out, [*keys, "_at"], heavy, how="left").drop("_at")
    return out.select(*left.columns, F.col("v._at").alias("matched_at"), *[F.col(f"v.{c}").alias(c) for c in values])


def runs(rows: DataFrame, keys: list[str], at: str, gap: int) -> DataFrame:
    """keys, run, first, last, n: the runs of a key's rows in which no row is more than `gap` after the one before; numbered from 1 along `at`, a whole number.

    Null keys are a key like others; rows without a place are in no run; repeated rows count each; an empty table gives no rows.
    """
    names = [f"_key_{c}" for c in keys]
    # null keys made equal to themselves
    places = rows.where(F.col(at).isNotNull()).select(*[F.struct(F.col(c)).alias(n) for c, n in zip(keys, names)], F.col(at).cast("long").alias("_at"))
    slices = _sliced(places.groupBy(*names, "_at").agg(F.count(F.lit(1)).alias("n")), names, ["_at"])
    inside = Window.partitionBy("_p", *names).orderBy("_at")
    edge = _before(slices, names, {"edge": F.max("_at")})
    prior = F.coalesce(F.lag("_at").over(inside), F.col("edge"))
    begun = slices.join(edge, [*names, "_p"]).withColumn("prior", prior).withColumn("fresh", F.when(F.col("prior").isNull() | (F.col("_at") - F.col("prior") > gap), 1).otherwise(0))
    begun = begun.withColumn("run", F.sum("fresh").over(inside))
    begun = staged(begun.select(*names, "_p", "_at", "n", "fresh", "run"), "begun")
    # runs that began in the key's partitions before
    counts = begun.groupBy(*names, "_p").agg(F.sum("fresh").alias("c"))
    counts = counts.select(*names, "_p", F.coalesce(F.sum("c").over(Window.partitionBy(*names).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("c"))
    part = begun.groupBy(*names, "_p", "run").agg(F.min("_at").alias("first"), F.max("_at").alias("last"), F.sum("n").alias("n"))
    part = part.join(counts, [*names, "_p"]).withColumn("run", F.col("run") + F.col("c"))
    out = part.groupBy(*names, "run").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n"))
    return out.select(*[F.col(f"{n}.{c}").alias(c) for c, n in zip(keys, names)], "run", "first", "last", "n")


def line_runs(docs: DataFrame, pattern: str, least: int = 2) -> DataFrame:
    """doc_id, first_line, n_lines, n_chars of the runs of `least` or more lines next to each other (by \\n, from 0) that match pattern, in docs(doc_id, text).

    Only matching lines are shuffled, their lengths rather than themselves, by the text's row. Null and empty texts have none; repeated rows each give
    their runs; a null doc_id is kept; extra columns are ignored; an empty table gives no rows.
    """
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), F.split(F.coalesce("text", F.lit("")), "\n", -1).alias("x"))
    lines = rows.select("doc_id", "row", F.posexplode("x").alias("line", "text"))
    hit = lines.where(F.col("text").rlike(pattern)).select("doc_id", "row", "line", F.length("text").alias("length"))
    start = F.col("line") - F.row_number().over(Window.partitionBy("row").orderBy("line"))
    found = hit.withColumn("start", start).groupBy("row", "doc_id", "start").agg(F.min("line").cast("long").alias("first_line"), F.count(F.lit(1)).alias("n_lines"), F.sum("length").alias("n_chars"))
    return found.where(F.col("n_lines") >= least).select("doc_id", "first_line", "n_lines", "n_chars")


def identities(sums: DataFrame, rules: list[tuple[str, str, str, str]]) -> DataFrame:
    """rule, n, testable, passed, worst of declared identities over a table of one row an entity: (name, SQL of one side, of the other, tolerance).

    A row is testable where both sides are known; it passes where they differ by the tolerance at most; worst is the largest difference.
    One aggregate with map-side combine, whatever the number of rules. An empty table tests nothing.
    """
    sides = [(F.abs(F.expr(a) - F.expr(b)), F.expr(tolerance)) for _, a, b, tolerance in rules]
    row = sums.agg(F.count(F.lit(1)).alias("n"), *[f.alias(f"{c}{k}") for k, (d, t) in enumerate(sides) for c, f in (("testable", F.count(d)), ("passed", F.count_if(d <= t)), ("worst", F.max(d)))])
    each = [F.struct(F.lit(name).alias("rule"), "n", F.col(f"testable{k}").alias("testable"), F.col(f"passed{k}").alias("passed"), F.col(f"worst{k}").cast("double").alias("worst")) for k, (name, *_) in enumerate(rules)]
    return row.select(F.inline(F.array(*each)))
