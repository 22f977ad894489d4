"""Filter interaction audit over a packed bitmap index.

Five filters are applied to every text in each of their 120 orders. What a filter removes depends only on the set of filters
before it, so 80 pairs (set before, filter) decide all 600 steps. Every partition makes NumPy bitsets of its rows: one of 64-bit words for each
filter and each label, its rows sorted by part and each part padded to whole words, so that a part's bitmap is a run of words.
For each pair the filter's bitset AND NOT the union of those before is counted by popcount, part by part; the counts of all
partitions are summed by Spark, and the steps of the 120 orders are read from the sums.

Whether a text equals that of a smaller doc_id is the one thing that a partition can't see: equal texts meet as digests, whose
smallest and largest doc_id come from an aggregate with map-side combine; only digests under two ids are joined back, with the
rows of a heavy one dealt into parts.

Defined results: null text is the empty text (equal to other empty ones); a null source is the part ''; a null doc_id has no
labels, isn't smaller than any id and has no smaller one, so filter E never fails for it; rows of one doc_id are rows of their
own and don't make each other fail E; a doc_id with several rows of labels is good (toxic) if one of them says so; null labels
say nothing; extra columns are ignored; texts are counted whole; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.skew import heavy_keys, spread_join
from .common import BLANKS, staged, table

FILTERS = "ABCDE"
#: (set of filters before, filter): the sets are bit masks, A is bit 0
PAIRS = [(s, f) for s in range(1 << len(FILTERS)) for f in range(len(FILTERS)) if not s >> f & 1]
COUNTS = ["kept", "removed", "good_lost", "toxic_lost"]
#: Bits of a row's flags after the filters'.
GOOD, TOXIC = len(FILTERS), len(FILTERS) + 1
#: Parts held by a worker at once; beyond it their counts so far go out, and Spark sums them.
PARTS = 2000


def failures(docs: DataFrame) -> DataFrame:
    """doc_id, part, digest, flags (bits of A to D) of every row of docs(doc_id, text, source)."""
    text = F.coalesce("text", F.lit(""))
    words = F.array_remove(F.split(text, f"[{BLANKS}]+"), "")
    at = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("part"), text.alias("text"), words.alias("words"))
    n, distinct = F.size("words"), F.size(F.array_distinct("words"))
    capitals, length = F.regexp_count("text", F.lit("[A-Z]")), F.char_length("text")
    fails = [n < 200, 100 * distinct.cast("long") < 50 * n.cast("long"), 100 * capitals.cast("long") > 2 * length.cast("long"), F.col("text").rlike("[#$%&*|]")]
    flags = sum((F.when(x, 1 << k).otherwise(0) for k, x in enumerate(fails)), F.lit(0))
    return at.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), flags.cast("int").alias("flags"))


def flagged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, flags of every row: the bits of A to E, then good and toxic."""
    rows = staged(failures(docs).withColumn("row", F.monotonically_increasing_id()), "failures")
    ids = rows.groupBy("digest").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count(F.lit(1)).alias("n"))
    copies = staged(ids.where("least < most"), "copies")
    total, many = rows.count(), rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    rows = spread_join(rows, copies.select("digest", "least"), ["digest"], heavy_keys(copies, ["digest"], total), F.col("row"), how="left")
    rows = rows.select("row", "doc_id", "part", (F.col("flags") + F.when(F.col("doc_id") > F.col("least"), 1 << FILTERS.index("E")).otherwise(0)).alias("flags"))
    said = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max(F.when(F.col("quality") == 1, 1 << GOOD).otherwise(0)) + F.max(F.when(F.col("toxic") == 1, 1 << TOXIC).otherwise(0))).alias("said"))
    rows = spread_join(rows, said, ["doc_id"], heavy_keys(many, ["doc_id"], total), F.col("row"), how="left")
    return rows.select("part", (F.col("flags") + F.coalesce("said", F.lit(0))).cast("int").alias("flags"))


def _popcount(words: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Set bits of each part's run of words."""
    return np.add.reduceat(np.bitwise_count(words).astype(np.int64), starts)


def index(flags: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bitsets of rows sorted by part: a row of words for each bit of flags and a last one of the rows that there are; the word at which each part starts."""
    at, sizes = np.unique(part, return_index=True)[1], np.bincount(part)
    words = -(-sizes // 64)
    starts = np.cumsum(words) - words
    place = starts[part] * 64 + np.arange(len(part)) - at[part]
    bits = np.zeros((TOXIC + 2, int(words.sum()) * 64), bool)
    for k in range(TOXIC + 1):
        bits[k, place] = flags >> k & 1
    bits[-1, place] = True
    return np.packbits(bits, axis=1).view(np.uint64), starts


def counted(bits: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """COUNTS of every part and pair, from the bitsets."""
    filters, good, toxic, there = bits[: len(FILTERS)], bits[GOOD], bits[TOXIC], bits[-1]
    out = np.zeros((len(starts), len(PAIRS), len(COUNTS)), np.int64)
    union = np.zeros((1 << len(FILTERS), bits.shape[1]), np.uint64)
    for s in range(1, len(union)):
        low = s & -s
        union[s] = union[s ^ low] | filters[low.bit_length() - 1]
    for k, (s, f) in enumerate(PAIRS):
        removed = filters[f] & ~union[s]
        for c, words in enumerate((there & ~union[s | 1 << f], removed, removed & good, removed & toxic)):
            out[:, k, c] = _popcount(words, starts)
    return out


def _partition(batches):
    """part, prior, filter and COUNTS of a partition's rows."""
    held: dict[str, np.ndarray] = {}

    def sums():
        names = list(held)
        x = np.concatenate([held[n] for n in names]) if names else np.zeros((0, len(COUNTS)), np.int64)
        prior, which = np.array(PAIRS, np.int32).T
        held.clear()
        return pa.RecordBatch.from_arrays([
            pa.array(np.repeat(np.array(names, object), len(PAIRS)).tolist(), pa.string()), pa.array(np.tile(prior, len(names))), pa.array(np.tile(which, len(names))),
            *[pa.array(x[:, c]) for c in range(len(COUNTS))]], ["part", "prior", "filter", *COUNTS])

    for b in batches:
        if not b.num_rows:
            continue
        parts = b.column("part").dictionary_encode()
        code, flags = parts.indices.to_numpy(), b.column("flags").to_numpy()
        order = np.argsort(code, kind="stable")
        for name, x in zip(parts.dictionary.to_pylist(), counted(*index(flags[order], code[order]))):
            held[name] = held[name] + x if name in held else x
        if len(held) > PARTS:
            yield sums()
    if held:
        yield sums()


def steps(spark: SparkSession) -> DataFrame:
    """filter_order, step, filter, prior of the 600 steps: fixed, whatever the data."""
    rows = []
    for order in permutations(range(len(FILTERS))):
        name, before = "".join(FILTERS[f] for f in order), 0
        for k, f in enumerate(order):
            rows.append((name, k + 1, f, before))
            before |= 1 << f
    return spark.createDataFrame(rows, "filter_order string, step int, filter int, prior int")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step and the counts of that step, for each part of docs."""
    sums = flagged(docs, labels).mapInArrow(_partition, "part string, prior int, filter int, " + ", ".join(f"{c} long" for c in COUNTS))
    sums = sums.groupBy("part", "filter", "prior").agg(*[F.sum(c).alias(c) for c in COUNTS])
    # the 16 pairs of a part and filter, which all its steps are read from
    pairs = sums.groupBy("part", "filter").agg(F.map_from_entries(F.collect_list(F.struct("prior", F.struct(*COUNTS)))).alias("at"))
    last = (1 << len(FILTERS)) - 1
    fails, unique = F.expr("at[0].removed"), F.col("at")[F.lit(last) - F.pow(F.lit(2), F.col("filter")).cast("int")]["removed"]
    # orders with a given set of b filters before one of five: b! (4 - b)!
    ways = F.array(*[F.lit(factorial(b) * factorial(len(FILTERS) - 1 - b)).cast("long") for b in range(len(FILTERS))])
    share = F.transform(F.map_entries("at"), lambda e: e["value"]["removed"] * F.get(ways, F.bit_count(e["key"])))
    pairs = pairs.select("part", "filter", "at", fails.alias("fails"), unique.alias("unique_fails"), F.aggregate(share, F.lit(0).cast("long"), lambda a, x: a + x).alias("shapley"))
    out = pairs.join(F.broadcast(steps(docs.sparkSession)), "filter").withColumn("x", F.col("at")[F.col("prior")])
    return out.select("part", "filter_order", "step", "x.kept", "x.removed", (F.col("fails") - F.col("x.removed")).alias("redundant"), "unique_fails", "x.good_lost", "x.toxic_lost", "shapley")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLE = r"""
WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
  [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * len(regexp_extract_all(text, '[A-Z]')) > 2 * length(text), regexp_matches(text, '[#$%&*|]'), coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)] AS fails
  FROM w LEFT JOIN l USING (doc_id)),
g AS (SELECT part, good, toxic, fails, count(*) AS n FROM f GROUP BY ALL),
o AS (SELECT a || b || c || d || e AS filter_order, [a, b, c, d, e] AS x FROM (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS a), (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS b), (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
  (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS d), (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS e) WHERE len(list_distinct([a, b, c, d, e])) = 5),
s AS (SELECT filter_order, k AS step, ascii(x[k]) - 64 AS f, list_transform(x[1:k - 1], lambda y: ascii(y) - 64) AS before FROM o, (SELECT unnest(range(1, 6)) AS k)),
t AS (SELECT part, filter_order, step, f, sum(CASE WHEN NOT fails[f] AND NOT gone THEN n ELSE 0 END) AS kept, sum(CASE WHEN fails[f] AND NOT gone THEN n ELSE 0 END) AS removed, sum(CASE WHEN fails[f] AND gone THEN n ELSE 0 END) AS redundant,
  sum(CASE WHEN fails[f] AND len(list_filter(fails, lambda y: y)) = 1 THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN fails[f] AND NOT gone AND good THEN n ELSE 0 END) AS good_lost, sum(CASE WHEN fails[f] AND NOT gone AND toxic THEN n ELSE 0 END) AS toxic_lost
  FROM (SELECT g.*, s.*, list_bool_or(list_prepend(false, list_transform(before, lambda y: fails[y]))) AS gone FROM g, s) GROUP BY ALL)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  sum(removed) OVER (PARTITION BY part, f)::BIGINT AS shapley FROM t
"""
