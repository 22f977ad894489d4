"""Embedding near-dedup by a subspace pigeonhole join.

Unit vectors of cosine >= c are at squared distance 2 - 2c at most. Vectors are turned by a seeded sign-and-Hadamard rotation,
which spreads their energy evenly, and split into blocks; of a pair within the distance at least one block is within a
proportional share of the squared distance. Each block is range-joined: a grid over its first coordinates with cells as wide as the
block's radius, every cell met with itself and half of its neighbours; cells of many vectors are dealt into parts, so that no task
holds more than two parts. In a tile the block distance filters, the full cosine in double precision decides, and a pair is counted
only in the block where it is closest, so that links are counted once without any table of pairs. Equal vectors are one vector
with a weight. Components come from each tile's spanning links.

Defined results: vectors that are null, empty, zero or hold null or non-finite components have no links and are kept; vectors
of other lengths never link; equal vectors are a class with an id of its own, so rows of one vec_id are judged each by its own vector
and link only if these do; a null vec_id links like any other, is no smallest id while its component has another (else component_id
is null) and is kept; components of any size, tiny or huge, count; extra columns are ignored; ties at the threshold count as links; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.skew import heavy_keys, spread_join
from .common import components, flat, staged, table

BLOCKS, GRID_DIMS, PART = 4, 2, 8000
#: Vectors of an Arrow batch.
ARROW = 5000


def rotated(x: np.ndarray, seed: int = 11) -> np.ndarray:
    """Rows of x (doubles) turned by random signs and a Hadamard transform, padded to a power of two; the same steps for each row, so equal rows give equal results."""
    n = 1 << max(x.shape[1] - 1, 0).bit_length()
    rng = np.random.default_rng(seed)
    y = np.zeros((len(x), n))
    y[:, : x.shape[1]] = x
    for _ in range(2):
        y = y * rng.choice([-1.0, 1.0], n)
        h = 1
        while h < n:
            v = y.reshape(len(y), n // (2 * h), 2, h)
            y = np.stack([v[:, :, 0] + v[:, :, 1], v[:, :, 0] - v[:, :, 1]], 2).reshape(len(y), n)
            h *= 2
        y = y / np.sqrt(n)
    return y


def _unit(raw: list[bytes], kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), kind).astype(np.float64).reshape(len(raw), -1)
    # scaled by a power of two, which is exact, so that no square over- or underflows
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _prepare(kind: str):
    def run(batches):
        for b in batches:
            ids, raw = [], []
            for v, e in zip(b.column("vec_id").to_pylist(), b.column("embedding")):
                e = e.values if e.is_valid else None
                if e is None or not len(e) or e.null_count:
                    x = None
                else:
                    x = e.to_numpy(zero_copy_only=False).astype(kind) + 0.0
                    x = x.tobytes() if np.isfinite(x).all() and x.any() else None
                ids.append(v)
                raw.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(raw, pa.binary())], ["vec_id", "v"])

    return run


def _split(size: int, blocks: int) -> tuple[int, int]:
    """(blocks, their dimensions) of turned vectors of `size` dimensions; short vectors have fewer blocks, each with more of the distance."""
    blocks = min(blocks, size)
    return blocks, size // blocks


def _cells(kind: str, cosine: float, blocks: int, dims: int):
    """A row for each block: the vector's cell there."""

    def run(batches):
        for b in batches:
            raw, rep, weight = (b.column(c).to_pylist() for c in ("v", "rep", "weight"))
            by_size: dict[int, list[int]] = {}
            for i, r in enumerate(raw):
                by_size.setdefault(len(r), []).append(i)
            for size, at in by_size.items():
                y = rotated(_unit([raw[i] for i in at], kind))
                count, step = _split(y.shape[1], blocks)
                radius = np.sqrt((2 - 2 * cosine) / count) * (1 + 1e-6) + 1e-9
                for j in range(count):
                    cell = np.floor(y[:, j * step : j * step + min(dims, step)] / radius).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([
                        pa.array([size] * len(at), pa.int32()), pa.array([j] * len(at), pa.int32()), pa.array(cell.tolist(), pa.list_(pa.int32())),
                        pa.array([rep[i] for i in at], pa.int64()), pa.array([weight[i] for i in at], pa.int64()), pa.array([raw[i] for i in at], pa.binary()),
                    ], ["size", "block", "cell", "rep", "weight", "v"])

    return run


def _tile(kind: str, cosine: float, blocks: int):
    def run(key, t):
        mine = np.array(t.column("left").to_pylist(), bool)
        j, within = key[1].as_py(), key[-1].as_py()
        rep, weight = t.column("rep").to_numpy(), t.column("weight").to_numpy()
        x = _unit(t.column("v").to_pylist(), kind)
        y = rotated(x)
        count, step = _split(y.shape[1], blocks)
        y, budget = y[:, : step * count], (2 - 2 * cosine) / count
        a = np.flatnonzero(mine)
        c = a if within else np.flatnonzero(~mine)
        out = np.zeros(len(rep), np.int64)
        parent = np.arange(len(rep))

        def root(i):
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        part = y[:, j * step : (j + 1) * step].astype(np.float32)
        square = (part * part).sum(1, keepdims=True)
        one = np.ones_like(square)
        # one product of extended rows gives the squared distances
        right = np.ascontiguousarray(np.hstack([-2 * part, one, square])[c].T)
        part = np.hstack([part, square, one])
        for lo in range(0, len(a), 512):
            p = a[lo : lo + 512]
            at = np.flatnonzero(part[p] @ right <= np.float32(budget + 1e-5))
            u, v = p[at // len(c)], c[at % len(c)]
            if within:
                u, v = u[u < v], v[u < v]
            for s in range(0, len(u), 100_000):
                m, n = u[s : s + 100_000], v[s : s + 100_000]
                ok = (x[m] * x[n]).sum(1) >= cosine
                m, n = m[ok], n[ok]
                d = np.square(y[m] - y[n]).reshape(len(m), count, step).sum(2)
                ok = d.argmin(1) == j
                m, n = m[ok], n[ok]
                np.add.at(out, m, weight[n])
                np.add.at(out, n, weight[m])
                for f, g in zip(m.tolist(), n.tolist()):
                    f, g = root(f), root(g)
                    if f != g:
                        parent[g] = f
        hit = np.flatnonzero(out)
        return pa.table({"rep": pa.array(rep[hit], pa.int64()), "links": pa.array(out[hit], pa.int64()), "to": pa.array(rep[[root(i) for i in hit]] if len(hit) else rep[:0], pa.int64())})

    return run


def near_duplicates(vectors: DataFrame, cosine: float = 0.9, blocks: int = BLOCKS, dims: int = GRID_DIMS, part: int = PART) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of vectors(vec_id, embedding)."""
    kind = "<f8" if vectors.schema["embedding"].dataType.elementType.simpleString() == "double" else "<f4"
    rows = staged(vectors.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(_prepare(kind), "vec_id long, v binary"), "vectors", ARROW)
    same = staged(rows.where("v is not null").groupBy("v").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("weight")).withColumn("rep", F.monotonically_increasing_id()), "classes")
    cells = staged(same.mapInArrow(_cells(kind, cosine, blocks, dims), "size int, block int, cell array<int>, rep long, weight long, v binary"), "cells", ARROW)
    full = cells.groupBy("size", "block", "cell").agg(F.count(F.lit(1)).alias("n")).withColumn("parts", F.ceil(F.col("n") / part).cast("int"))
    # each cell with itself and with the half of its neighbours that come after it in order
    steps = [[]]
    for _ in range(dims):
        steps = [s + [d] for s in steps for d in (-1, 0, 1)]
    steps = [s for s in steps if s >= [0] * dims]
    shift = lambda s, sign: F.zip_with("cell", F.array(*[F.lit(d) for d in s]), lambda a, b: a + sign * b)
    width = F.size("cell")
    # of every neighbour: is it there, and in how many parts
    links = full.select("size", "block", "cell", "parts", F.explode(F.array(*[F.struct(F.array(*[F.lit(d) for d in s]).alias("s"), F.slice(shift(s, 1), 1, width).alias("to")) for s in steps])).alias("x")).select("size", "block", "cell", "parts", "x.to").distinct()  # steps in a dimension that a block lacks are one
    other = full.select("size", "block", F.col("cell").alias("to"), F.col("parts").alias("to_parts"))
    links = links.join(other, ["size", "block", "to"])
    cut = F.pmod(F.xxhash64("rep", F.lit(5)), F.col("parts").cast("long")).cast("int")
    own = cells.join(full.select("size", "block", "cell", "parts"), ["size", "block", "cell"]).withColumn("part", cut)
    as_left = own.join(links.select("size", "block", "cell", "to", "to_parts"), ["size", "block", "cell"]).select("size", "block", F.col("cell").alias("a"), F.col("to").alias("b"), "part", F.col("to_parts").alias("others"), F.lit(True).alias("left"), "rep", "weight", "v")
    as_right = own.join(links.where("cell <> to").select("size", "block", F.col("cell").alias("from"), F.col("to").alias("cell"), F.col("parts").alias("from_parts")), ["size", "block", "cell"]).select("size", "block", F.col("from").alias("a"), F.col("cell").alias("b"), "part", F.col("from_parts").alias("others"), F.lit(False).alias("left"), "rep", "weight", "v")
    both = as_left.unionByName(as_right).withColumn("inner", F.col("a") == F.col("b"))
    # a left row of part p meets every part q of b; within one cell, the parts q >= p, and each row is right for the parts before its own
    both = both.select("*", F.explode(F.sequence(F.lit(0), F.col("others") - 1)).alias("q"))
    tile = both.select(
        "size", "block", "a", "b",
        F.when(F.col("inner"), F.least("part", "q")).when(F.col("left"), F.col("part")).otherwise(F.col("q")).alias("pa"),
        F.when(F.col("inner"), F.greatest("part", "q")).when(F.col("left"), F.col("q")).otherwise(F.col("part")).alias("pb"),
        F.when(F.col("inner"), F.col("part") <= F.col("q")).otherwise(F.col("left")).alias("left"), "rep", "weight", "v", "inner")
    tile = tile.withColumn("within", F.col("inner") & (F.col("pa") == F.col("pb"))).drop("inner")
    found = staged(tile.groupBy("size", "block", "a", "b", "pa", "pb", "within").applyInArrow(_tile(kind, cosine, blocks), "rep long, links long, to long"), "links")
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    comp = staged(components(found.select(F.col("rep").alias("a"), F.col("to").alias("b"))).withColumnRenamed("id", "rep").join(same.select("rep", "least"), "rep"), "members")
    # a component's smallest vec_id; one that holds many classes is dealt into parts
    least = staged(comp.groupBy("comp").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n")), "components")
    comp = spread_join(comp.select("rep", "comp"), least.select("comp", "component_id"), ["comp"], heavy_keys(least, ["comp"], comp.count())).drop("comp")
    reps = same.join(counts, "rep", "left").join(comp, "rep", "left")
    reps = reps.select("v", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component_id", "least").alias("component_id"), F.lit(True).alias("met"))
    out = rows.join(reps, "v", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("met"), F.col("component_id")).otherwise(F.col("vec_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, embedding, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS norm FROM embeddings),
o AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE / norm) AS u FROM v WHERE isfinite(norm) AND norm > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM o a, o b WHERE a.vec_id <> b.vec_id AND list_dot_product(a.u, b.u) >= 0.9),
r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT vec_id, (SELECT count(*) FROM l WHERE a = vec_id) AS n_links, (SELECT min(b) FROM r WHERE a = vec_id) AS component_id, (SELECT min(b) FROM r WHERE a = vec_id) = vec_id AS kept FROM v
"""
