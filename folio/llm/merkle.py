"""Merkle manifest of a dataset, in Pregel-style supersteps over RDDs.

A row is a leaf: the digest of its columns. The leaves of a group (a language) ascend by doc_id and are paired, level by level, to
the group's root; the groups' roots are paired likewise to the root of the dataset. A vertex is a block of 1024 (2 ** LEVELS) consecutive nodes
of a group. Going up, nodes message their block; a block that has all its nodes hashes its ten levels and forwards its top to the
block above, so a superstep raises ten levels and its messages shrink by 1024. Going down, a block that was told the siblings from its top
to the root adds those inside and tells each block below; blocks of leaves fold every leaf, as it is given now, up to a root, which is
held against the dataset's. Blocks and messages are of bounded size and a group of any size is spread over all tasks. Every
superstep's vertices are written to the shared folder, so a lost executor costs one superstep at most.

Places in a group come from a range partitioning: each partition counts its groups' rows, and running sums of those counts, one a
partition and group, give the place of its first row.

Defined results: nulls in a column are `-` in the leaf; a null lang is a group of its own, before all others; null doc_ids come
first in their group; rows of one doc_id ascend by leaf, and equal rows are separate leaves; extra columns are ignored; whole texts
are hashed; a dataset of one group has its root as root, a group of one leaf that leaf; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import sha256
from zlib import crc32

import pyarrow as pa
from pyspark import RDD
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from .common import staged, table

#: Levels of a block, of 2 ** LEVELS nodes.
LEVELS = 10
LEFT, RIGHT, ALONE = 0, 1, 2
NONE = bytes(32)


def digest(*parts: bytes) -> bytes:
    return sha256(b"".join(parts)).hexdigest().encode()


def leaves(docs: DataFrame, tampered=None) -> DataFrame:
    """lang, doc_id, leaf, changed (32 bytes each) of every row of docs; changed: the leaf where n_chars is one more, null where tampered doesn't hold."""

    def field(c):
        value = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    def leaf(n_chars):
        return F.unhex(F.sha2(F.concat(*[field(c) for c in (F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text"))]), 256))

    more = F.col("n_chars").cast("decimal(20,0)") + 1
    changed = F.lit(None).cast("binary") if tampered is None else F.when(tampered & F.col("n_chars").isNotNull(), leaf(more))
    return docs.select("lang", F.col("doc_id").cast("long").alias("doc_id"), leaf(F.col("n_chars")).alias("leaf"), changed.alias("changed"))


def _runs(batches, width: int = 1 << LEVELS):
    """Chunks of up to `width` rows of one group of a sorted partition; i: the place of the first one among the partition's rows of the group."""
    names = ["p", "lang", "i", "n", "ids", "leaves", "changed"]

    def chunk(kind):
        arrays = [pa.array([p], pa.int32()), pa.array([lang], pa.string()), pa.array([i], pa.int64()), pa.array([len(ids)], pa.int32()), pa.array([ids], pa.list_(kind)), pa.array([b"".join(leaf)]), pa.array([b"".join(changed)])]
        return pa.RecordBatch.from_arrays(arrays, names)

    p, lang, i, ids, leaf, changed, kind = None, None, 0, [], [], [], None
    for b in batches:
        kind = b.schema.field("id").type
        for q, group, one, x, y in zip(*[b.column(c).to_pylist() for c in ("p", "lang", "id", "leaf", "changed")]):
            if ids and (group != lang or len(ids) == width):
                yield chunk(kind)
                i = i + len(ids) if group == lang else 0
                ids, leaf, changed = [], [], []
            p, lang = q, group
            ids.append(one)
            leaf.append(x)
            changed.append(y or NONE)
    if ids:
        yield chunk(kind)


def chunks(rows: DataFrame) -> DataFrame:
    """lang, total, start, ids, leaves, changed: runs of rows(lang, id, order, leaf, changed), which ascend by order and leaf within lang."""
    kind = rows.schema["id"].dataType.simpleString()
    rows = staged(rows.withColumn("row", F.monotonically_increasing_id()), "leaves")
    order = ["lang", "order", "leaf", "row"]
    runs = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(F.spark_partition_id().alias("p"), "lang", "id", "leaf", "changed")
    runs = staged(runs.mapInArrow(_runs, f"p int, lang string, i long, n int, ids array<{kind}>, leaves binary, changed binary"), "runs")
    # one row a partition and group
    sums = runs.groupBy("lang", "p").agg(F.sum("n").alias("n"))
    group = Window.partitionBy("lang")
    sums = sums.select(F.col("lang").alias("_lang"), F.col("p").alias("_p"), F.coalesce(F.sum("n").over(group.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("n").over(group).alias("total"))
    met = runs.join(sums, F.col("lang").eqNullSafe(F.col("_lang")) & (F.col("p") == F.col("_p")))
    return met.select("lang", "total", (F.col("before") + F.col("i")).alias("start"), "ids", "leaves", "changed")


def _place(key) -> int:
    """Where a key's rows go, the same in every worker."""
    return crc32(repr(key).encode("utf-8", "surrogatepass"))


def grown(nodes: list[bytes], total: int, height: int) -> list[list[bytes]]:
    """The levels of a block over its nodes, hex digests, `height` at most; total: the nodes of its group at the lowest of these levels."""
    levels = [nodes]
    for _ in range(min(height, (total - 1).bit_length())):
        below = levels[-1]
        levels.append([digest(*below[k : k + 2]) for k in range(0, len(below), 2)])
    return levels


def siblings(levels: list[list[bytes]], k: int) -> list[tuple[int, bytes]]:
    """What stands beside node k and the nodes over it, up to the block's top: the side that the node is on, and its sibling."""
    out = []
    for nodes in levels[:-1]:
        out.append((ALONE, b"") if k ^ 1 >= len(nodes) else (LEFT if k % 2 == 0 else RIGHT, nodes[k ^ 1]))
        k >>= 1
    return out


def fold(node: bytes, path: Iterable[tuple[int, bytes]]) -> bytes:
    for side, other in path:
        node = digest(node) if side == ALONE else digest(node, other) if side == LEFT else digest(other, node)
    return node


def _split(blob: bytes) -> list[bytes]:
    return [blob[k : k + 32].hex().encode() for k in range(0, len(blob), 32)]


def _packed(path: list[tuple[int, bytes]]) -> bytes:
    return b"".join(bytes([side]) + (bytes.fromhex(other.decode()) or NONE) for side, other in path)


def _unpacked(path: bytes) -> list[tuple[int, bytes]]:
    return [(path[k], b"" if path[k] == ALONE else path[k + 1 : k + 33].hex().encode()) for k in range(0, len(path), 33)]


def _pieces(r: Row, height: int) -> Iterator[tuple]:
    """The messages of a run of leaves to the blocks that it reaches into."""
    at = 0
    while at < len(r.ids):
        block, k = divmod(r.start + at, 1 << height)
        n = min((1 << height) - k, len(r.ids) - at)
        yield (r.lang, block), (k, r.total, r.ids[at : at + n], bytes(r.leaves[at * 32 : (at + n) * 32]), bytes(r.changed[at * 32 : (at + n) * 32]))
        at += n


def _complete(item: tuple, height: int) -> tuple:
    """A block of all its messages: lang, block, total, ids, nodes, changed, top."""
    (lang, block), parts = item
    parts = sorted(parts, key=lambda x: x[0])
    total, nodes = parts[0][1], b"".join(x[3] for x in parts)
    top = grown(_split(nodes), total, height)[-1][0]
    return lang, block, total, [i for x in parts for i in x[2]], nodes, b"".join(x[4] for x in parts), bytes.fromhex(top.decode())


def raised(rows: DataFrame, height: int) -> list[DataFrame]:
    """Upward supersteps over chunks() of rows: the blocks of leaves, the blocks over them, and so on, each a written table.

    Of a group that one block of a table holds, that block's top is the group's root; no table after it has the group."""
    spark, n = rows.sparkSession, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind, width = rows.schema["id"].dataType.simpleString(), 1 << height

    def superstep(messages: RDD, ids: str) -> DataFrame:
        done = messages.groupByKey(n, _place).map(lambda x: _complete(x, height))
        return staged(spark.createDataFrame(done, f"lang string, block long, total long, ids array<{ids}>, nodes binary, changed binary, top binary", verifySchema=False), "blocks")

    out = [superstep(chunks(rows).rdd.flatMap(lambda r: _pieces(r, height)), kind)]
    while (out[-1].agg(F.max("total")).first()[0] or 0) > width:
        below = out[-1].where(F.col("total") > width).select("lang", "block", "total", "top")
        out.append(superstep(below.rdd.map(lambda r: ((r.lang, r.block // width), (r.block % width, -(-r.total // width), [], bytes(r.top), b""))), "long"))
    return out


def tops(levels: list[DataFrame], height: int) -> DataFrame:
    """lang, level, top: the groups' roots and the table of levels that each stands in."""
    found = [b.where(F.col("total") <= 1 << height).select("lang", F.lit(k).alias("level"), "top") for k, b in enumerate(levels)]
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return staged(out, "tops")


def _told(item: tuple) -> tuple | None:
    """A block and what it was told: (block row, path from its top, subroot, root)."""
    block = said = None
    for tag, value in item[1]:
        if tag:
            said = value
        else:
            block = value
    return None if block is None or said is None else (block, *said)


def lowered(levels: list[DataFrame], told: DataFrame, height: int) -> RDD:
    """Downward supersteps from told(lang, level, path, subroot, root), what stands beside each group's root: (block of leaves, path, subroot, root)."""
    spark, n = told.sparkSession, int(told.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    down, met = None, None
    for k in range(len(levels) - 1, -1, -1):
        messages = told.where(F.col("level") == k).rdd.map(lambda r: ((r.lang, 0), (1, (bytes(r.path), bytes(r.subroot), bytes(r.root)))))
        if down is not None:
            messages = messages.union(down.rdd.map(lambda r: ((r.lang, r.block), (1, (bytes(r.path), bytes(r.subroot), bytes(r.root))))))
        met = levels[k].rdd.map(lambda r: ((r.lang, r.block), (0, r))).union(messages).groupByKey(n, _place).map(_told).filter(lambda x: x is not None)
        if k:
            down = staged(spark.createDataFrame(met.flatMap(lambda x: _forward(x, height)), "lang string, block long, path binary, subroot binary, root binary", verifySchema=False), "down")
    return met


def _forward(met: tuple, height: int) -> Iterator[tuple]:
    """The messages of a block to those below it."""
    r, path, subroot, root = met
    levels = grown(_split(bytes(r.nodes)), r.total, height)
    for k in range(len(levels[0])):
        yield r.lang, (r.block << height) + k, _packed(siblings(levels, k)) + path, subroot, root


def _verified(met: tuple, height: int) -> tuple:
    """A block's leaves with their proofs and the roots that they fold to, as arrays."""
    r, path, subroot, root = met
    above, levels, changed = _unpacked(path), grown(_split(bytes(r.nodes)), r.total, height), _split(bytes(r.changed))
    # the fold over a block's top depends on what comes out there only
    known: dict[bytes, bytes] = {}
    proofs, folded = [], []
    for k, leaf in enumerate(levels[0]):
        inside = siblings(levels, k)
        proofs.append(digest(*[other for _, other in inside + above]).decode())
        top = fold(changed[k] if any(r.changed[32 * k : 32 * k + 32]) else leaf, inside)
        if top not in known:
            known[top] = fold(top, above)
        folded.append(known[top].decode())
    return r.ids, [x.decode() for x in levels[0]], proofs, folded, subroot.hex(), root.hex()


def manifest(docs: DataFrame, tampered=None, height: int = LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row of docs(doc_id, source, lang, n_chars, text).

    tampered: the condition under which a row is given with another n_chars when it is verified; height: the levels of a block."""
    spark = docs.sparkSession
    rows = leaves(docs, tampered).select("lang", F.col("doc_id").alias("id"), F.col("doc_id").alias("order"), "leaf", "changed")
    levels = raised(rows, height)
    subroots = tops(levels, height)
    # the groups' roots are leaves of one more tree, in the order of lang
    forest = raised(subroots.select(F.lit("").alias("lang"), F.col("lang").alias("id"), F.col("lang").alias("order"), F.col("top").alias("leaf"), F.lit(None).cast("binary").alias("changed")), height)
    root = tops(forest, height)
    whole = lowered(forest, root.select("lang", "level", F.unhex(F.lit("")).alias("path"), F.col("top").alias("subroot"), F.col("top").alias("root")), height)
    beside = spark.createDataFrame(whole.flatMap(lambda x: _beside(x, height)), "_lang string, path binary, root binary", verifySchema=False)
    told = staged(subroots.join(beside, F.col("lang").eqNullSafe(F.col("_lang"))).select("lang", "level", "path", F.col("top").alias("subroot"), "root"), "told")
    out = lowered(levels, told, height).map(lambda x: _verified(x, height))
    out = spark.createDataFrame(out, "doc_id array<long>, leaf array<string>, proof_sha256 array<string>, folded_root array<string>, subroot string, root string", verifySchema=False)
    out = out.select("subroot", "root", F.inline(F.arrays_zip("doc_id", "leaf", "proof_sha256", "folded_root")))
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _beside(met: tuple, height: int) -> Iterator[tuple]:
    """What stands beside every group's root, up to the root of the dataset."""
    r, path, _, root = met
    levels = grown(_split(bytes(r.nodes)), r.total, height)
    for k, lang in enumerate(r.ids):
        yield lang, _packed(siblings(levels, k)) + path, root


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    return manifest(table(spark, sf_dir, "documents"), F.coalesce(ids % 7 == 0, F.lit(False)))


ORACLE = """
WITH RECURSIVE c AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, j: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
d AS (SELECT *, xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(doc_id::VARCHAR)), '..'), lambda x: ('0x' || x)::BIGINT)), lambda c, x: xor(c // 256, t[xor(c, x) % 256 + 1])), 4294967295) AS crc FROM documents, c),
e AS (SELECT doc_id, lang, n_chars, crc, coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-') || coalesce(octet_length(encode(lang)) || ':' || lang, '-') AS a, coalesce(octet_length(encode(text)) || ':' || text, '-') AS b FROM d),
l AS (SELECT doc_id, lang, sha256(a || coalesce(length(n_chars::VARCHAR) || ':' || n_chars, '-') || b) AS leaf,
  sha256(a || coalesce(length((n_chars + CASE WHEN crc % 7 = 0 THEN 1 ELSE 0 END)::VARCHAR) || ':' || (n_chars + CASE WHEN crc % 7 = 0 THEN 1 ELSE 0 END), '-') || b) AS given FROM e),
k AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM l),
n AS (SELECT 0 AS level, lang, i, leaf AS h, count(*) OVER (PARTITION BY lang) AS m FROM k
  UNION ALL SELECT level + 1, lang, i // 2, sha256(string_agg(h, '' ORDER BY i)), (any_value(m) + 1) // 2 FROM n WHERE m > 1 GROUP BY level, lang, i // 2),
s AS (SELECT lang, h, level FROM n WHERE m = 1),
f AS (SELECT 0 AS level, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, lang, h, count(*) OVER () AS m FROM s
  UNION ALL SELECT level + 1, i // 2, NULL, sha256(string_agg(h, '' ORDER BY i)), (any_value(m) + 1) // 2 FROM f WHERE m > 1 GROUP BY level, i // 2),
p AS (SELECT doc_id, leaf, lang, i, 0 AS level, given AS fold, '' AS sibs FROM k
  UNION ALL SELECT doc_id, leaf, p.lang, p.i // 2, p.level + 1, sha256(CASE WHEN p.i % 2 = 0 THEN fold || coalesce(x.h, '') ELSE x.h || fold END), sibs || coalesce(x.h, '')
  FROM p JOIN s ON s.lang IS NOT DISTINCT FROM p.lang AND p.level < s.level LEFT JOIN n x ON x.lang IS NOT DISTINCT FROM p.lang AND x.level = p.level AND x.i = xor(p.i, 1)),
q AS (SELECT doc_id, leaf, s.h AS subroot, f.i, 0 AS level, fold, sibs FROM p JOIN s ON s.lang IS NOT DISTINCT FROM p.lang AND p.level = s.level JOIN f ON f.level = 0 AND f.lang IS NOT DISTINCT FROM p.lang
  UNION ALL SELECT doc_id, leaf, subroot, q.i // 2, q.level + 1, sha256(CASE WHEN q.i % 2 = 0 THEN fold || coalesce(x.h, '') ELSE x.h || fold END), sibs || coalesce(x.h, '')
  FROM q LEFT JOIN f x ON x.level = q.level AND x.i = xor(q.i, 1) WHERE q.level < (SELECT max(level) FROM f))
SELECT doc_id, leaf, subroot, h AS root, sha256(sibs) AS proof_sha256, fold AS folded_root, fold = h AS verified FROM q JOIN f ON f.m = 1 AND q.level = f.level
"""
