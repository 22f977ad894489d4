"""Sharding by proportional stratified interleaving, under the `rows` law.

Rows of each source are put in a seeded random order, a row's place there over the source's size is its fractional rank, all
rows are sorted by fractional rank, and the sorted list is cut into equal runs, so every shard holds each source in the
mixture's proportion and shard sizes differ by one row at most.

Both ranks are two-level: counts per small bucket, a running sum over the buckets, and a running sum within a bucket. No
window runs over a whole source or the whole table, so a source with a third of all rows is spread like any other. Rows equal in
source, doc_id, size and checksum are one row with a number while they are ranked, and get places of their own, which are in
different buckets, by runs of at most 1024; so neither one doc_id nor one row may fill a bucket.

Defined results: null text has size 8 and the checksum of no bytes; null source is a stratum of its own; a null doc_id counts as
the text "null" in the random order; repeated rows are separate rows and keep their number; ties in the random order go to the
smaller doc_id, checksum, size; extra columns are ignored; an empty table gives no rows; groups of equal texts are not kept
together (the mixture is what this method keeps).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import staged, table

SEED = "folio-1"


def interleave(docs: DataFrame, shards: int = 24, seed: str = SEED, bucket_rows: int = 2000) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row of docs(doc_id, text, source)."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "source",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + F.lit(8)).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).cast("long").alias("text_crc32"),
    )
    same = ["source", "doc_id", "size", "text_crc32"]
    rows = staged(rows.groupBy(*same).agg(F.count(F.lit(1)).alias("c")), "shard")
    total = rows.agg(F.sum("c")).first()[0] or 0
    buckets = max(1, -(-total // bucket_rows))
    # the seeded random order within a source: md5 of seed, doc_id, size and checksum; its first 12 hex digits also pick the bucket
    rows = rows.withColumn("m", F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "size", "text_crc32").cast("binary")))
    rows = rows.withColumn("b", F.floor(F.conv(F.substring("m", 1, 12), 16, 10).cast("double") * F.lit(buckets / 16.0**12)).cast("long"))
    ahead = lambda w: F.coalesce(F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = rows.groupBy("source", "b").agg(F.sum("c").alias("c"))
    before = per.select("source", "b", ahead(Window.partitionBy("source").orderBy("b")).alias("skip"), F.sum("c").over(Window.partitionBy("source")).alias("of"))
    low = Window.partitionBy("source", "b").orderBy("m", "doc_id", "text_crc32", "size")
    ranked = rows.withColumn("k", ahead(low)).alias("r").join(before.alias("c"), F.expr("r.source <=> c.source and r.b = c.b")).select(*[F.col(f"r.{x}") for x in same], "m", "r.c", (F.col("skip") + F.col("k")).alias("rank"), "of")
    run = 1024
    ranked = ranked.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("c") - 1, F.lit(run).cast("long"))).alias("lo")).repartition("m", "lo")
    ranked = ranked.select(*same, "m", "of", F.explode(F.sequence(F.col("rank") + F.col("lo") + 1, F.col("rank") + F.least("c", F.col("lo") + run))).alias("rank"))
    # the fractional rank (2 rank - 1) / (2 of), as a double of two longs
    ranked = ranked.withColumn("place", (2 * F.col("rank") - 1).cast("double") / (2 * F.col("of")).cast("double"))
    ranked = ranked.withColumn("g", F.least(F.floor(F.col("place") * buckets), F.lit(buckets - 1)).cast("long"))
    ranked = staged(ranked, "ranked")
    runs = ranked.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    # one row per bucket_rows rows of input: split once more so that the running sum has no single partition either
    wide = 1024
    runs = runs.withColumn("h", F.floor(F.col("g") / wide))
    tops = runs.groupBy("h").agg(F.sum("n").alias("hn"))
    tops = tops.select("h", F.coalesce(F.sum("hn").over(Window.orderBy("h").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("hs"))
    runs = runs.join(tops, "h").select("g", (F.col("hs") + F.coalesce(F.sum("n").over(Window.partitionBy("h").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("skip"))
    order = Window.partitionBy("g").orderBy("place", "source", "m", "doc_id", "text_crc32", "size")
    at = ranked.withColumn("k", F.row_number().over(order)).join(runs, "g").withColumn("pos", F.col("skip") + F.col("k") - 1)
    n = F.lit(max(total, 1))
    shard = F.expr(f"(pos * {shards}) div {max(total, 1)}")
    first = F.expr(f"(shard * {max(total, 1)} + {shards - 1}) div {shards}")
    return at.withColumn("shard", shard.cast("int")).withColumn("slot", (F.col("pos") - first).cast("long")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interleave(table(spark, sf_dir, "documents"))


ORACLE = f"""
WITH c AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, j: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
b AS (SELECT doc_id, source, octet_length(encode(coalesce(text, ''))) + 8 AS size, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT) AS bytes FROM documents),
x AS (SELECT doc_id, source, size, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, x: xor(c // 256, t[xor(c, x) % 256 + 1])), 4294967295) AS text_crc32 FROM b, c),
r AS (SELECT *, md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null') || ':' || size || ':' || text_crc32) AS m FROM x),
k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY m, doc_id NULLS FIRST, text_crc32, size) AS rank, count(*) OVER (PARTITION BY source) AS n FROM r),
p AS (SELECT *, row_number() OVER (ORDER BY (2 * rank - 1)::DOUBLE / (2 * n)::DOUBLE, source NULLS FIRST, m, doc_id NULLS FIRST, text_crc32, size) - 1 AS pos, count(*) OVER () AS total FROM k),
s AS (SELECT *, pos * 24 // total AS shard FROM p)
SELECT doc_id, size, text_crc32, 'rows' AS law, shard::INTEGER AS shard, pos - (shard * total + 23) // 24 AS slot, NULL::INTEGER AS grown_shard FROM s
"""
