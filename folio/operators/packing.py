"""Greedy packing of documents in order into parts of bounded bytes, as one fold over all documents, done in parallel.

The fold's state is the bytes in the open part. What a run of documents does to it depends on the incoming fill only up to the
first cut; from there all is the same, whatever came in. So a run is a map from fill to fill and number of cuts with a piece for each place
that the first cut can have, which lies in the first `target` bytes of the run: the map of a run of any length has no more pieces
than documents fit in a part. Runs come from a range partitioning by doc_id; their maps are composed, FAN at a time, up to one map of all; then
each run is told the fill and the part that it begins with, FAN at a time again; and all runs are packed at once. A task holds one run
of documents, or FAN maps.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .stage import staged

#: Documents of a run, and maps composed by a task.
RUN, FAN = 4096, 64
_MAP = "total long, zero_fill long, zero_cuts long, over_fill long, over_cuts long, above array<long>, fill array<long>, cuts array<long>"
_FIELDS = [x.split()[0] for x in _MAP.split(", ")]


def following(sizes: np.ndarray, target: int) -> np.ndarray:
    """For a part that begins at each document, the document that begins the next one."""
    ends = np.concatenate([[0], np.cumsum(sizes)])
    begin = ends[:-1]
    # the first document that doesn't fit; where nothing lies before it in the part, it is in the part all the same
    out = np.searchsorted(ends[1:], begin + target, "right")
    return np.where(begin[np.minimum(out, len(sizes) - 1)] > begin, out, out + 1).clip(max=len(sizes)) if len(sizes) else out


def run_map(sizes: np.ndarray, target: int) -> dict:
    """The map of a run: what a fill of 0 becomes; what one over target becomes, the first document being cut off; for a fill from 1 to target, that of
    the first piece whose `above` (descending) it exceeds, or without such a piece the fill and the run's total, no cut."""
    n, after = len(sizes), following(sizes, target)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    fill, cuts = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in range(n - 1, -1, -1):  # of a part that begins at i: what is open at the end, and the cuts until then
        j = after[i]
        fill[i], cuts[i] = (ends[n] - ends[i], 0) if j >= n else (fill[j], cuts[j] + 1)
    first = np.flatnonzero((sizes > 0) & (ends[:-1] < target))
    return {"total": int(ends[n]), "zero_fill": int(fill[0]), "zero_cuts": int(cuts[0]), "over_fill": int(fill[0]), "over_cuts": int(cuts[0] + 1), "above": np.maximum(target - ends[first + 1], 0), "fill": fill[first], "cuts": cuts[first] + 1}


def applied(m: dict, fill: int, target: int) -> tuple[int, int]:
    """(fill, cuts) after a run that begins with fill."""
    if fill == 0:
        return m["zero_fill"], m["zero_cuts"]
    if fill > target:
        return m["over_fill"], m["over_cuts"]
    k = len(m["above"]) - int(np.searchsorted(m["above"][::-1], fill, "left"))
    return (int(m["fill"][k]), int(m["cuts"][k])) if k < len(m["above"]) else (fill + m["total"], 0)


def composed(a: dict, b: dict, target: int) -> dict:
    """The map of a's run followed by b's."""

    def after(fill, cuts):
        f, c = applied(b, int(fill), target)
        return f, c + int(cuts)

    zero, over = after(a["zero_fill"], a["zero_cuts"]), after(a["over_fill"], a["over_cuts"])
    each = np.array([after(f, c) for f, c in zip(a["fill"], a["cuts"])], np.int64).reshape(-1, 2)
    # what a passes without a cut meets b's pieces, lowered by a's bytes; those under a piece at 0 are out of reach
    reach = np.concatenate([[target], b["above"][:-1]]) > a["total"] if len(b["above"]) else np.zeros(0, bool)
    join = lambda x, y: np.concatenate([x, y[reach]])
    return {"total": a["total"] + b["total"], "zero_fill": zero[0], "zero_cuts": zero[1], "over_fill": over[0], "over_cuts": over[1],
            "above": join(a["above"], np.maximum(b["above"] - a["total"], 0)), "fill": join(each[:, 0], b["fill"]), "cuts": join(each[:, 1], b["cuts"])}


def packed(sizes: np.ndarray, fill: int, part: int, target: int) -> np.ndarray:
    """The part of each document of a run that begins with an open part of this fill."""
    n, after = len(sizes), following(sizes, target)
    cut = np.zeros(n, np.int64)
    i = 0 if fill == 0 or fill > target else int(np.searchsorted(fill + np.cumsum(sizes), target, "right"))
    if fill and i < n:
        cut[i] = 1
    while i < n and (i := after[i]) < n:
        cut[i] = 1
    return part + np.cumsum(cut)


def _row(m: dict) -> list:
    return [pa.array([m[c]], pa.list_(pa.int64()) if c in _FIELDS[5:] else pa.int64()) for c in _FIELDS]


def _maps(table: pa.Table) -> list[dict]:
    return [{c: np.array(r[c], np.int64) if c in _FIELDS[5:] else r[c] for c in _FIELDS} for r in table.select(_FIELDS).to_pylist()]


def _runs(run: int, target: int):
    """p, k, ids, sizes and the map of every run of a sorted partition p."""

    def cut(batches):
        p, k, ids, sizes = None, 0, np.zeros(0, object), np.zeros(0, np.int64)

        def out(x, y):
            return pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([k], pa.int64()), pa.array([x.tolist()], pa.list_(pa.int64())), pa.array([y], pa.list_(pa.int64())), *_row(run_map(y, target))], ["p", "k", "ids", "sizes", *_FIELDS])

        for b in batches:
            if not b.num_rows:
                continue
            p = b.column("p")[0].as_py()
            ids, sizes = np.concatenate([ids, np.array(b.column("doc_id").to_pylist(), object)]), np.concatenate([sizes, b.column("bytes").to_numpy()])
            while len(ids) > run:
                yield out(ids[:run], sizes[:run])
                ids, sizes, k = ids[run:], sizes[run:], k + 1
        if len(ids):
            yield out(ids, sizes)

    return cut


def _composed(target: int):
    def run(key, t):
        t = t.sort_by("seq")
        first, *rest = _maps(t)
        for m in rest:
            first = composed(first, m, target)
        return pa.Table.from_arrays([pa.array([key[0].as_py()], pa.int64()), *_row(first)], ["seq", *_FIELDS])

    return run


def _told(target: int):
    def run(key, t):
        t = t.sort_by("seq")
        fill, part, out = t.column("in_fill")[0].as_py(), t.column("in_part")[0].as_py(), []
        for m in _maps(t):
            out.append((fill, part))
            fill, cuts = applied(m, fill, target)
            part += cuts
        return pa.Table.from_arrays([t.column("seq"), *[pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)]], ["seq", "in_fill", "in_part"])

    return run


def _packed(target: int):
    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                sizes = np.array(r["sizes"], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(r["ids"], pa.int64()), pa.array(packed(sizes, r["in_fill"], r["in_part"], target)), pa.array(sizes)], ["doc_id", "part", "bytes"])

    return run


def pack_in_order(docs: DataFrame, target: int, run: int = RUN, fan: int = FAN) -> DataFrame:
    """doc_id, part, bytes of every row of docs(doc_id, text) in the order of doc_id: a new part where the open one has bytes and would exceed target.

    Null text has no bytes; a document over target is a part of its own, with the empty ones before it; null doc_ids come first; rows of one doc_id
    ascend by bytes, and equal rows are packed each; however many there are, they are dealt over partitions. Extra columns are ignored; an
    empty table gives no rows.
    """
    size = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"), F.monotonically_increasing_id().alias("row"))
    order = ["doc_id", "bytes", "row"]
    cut = size.repartitionByRange(*order).sortWithinPartitions(*order).select(F.spark_partition_id().alias("p"), "doc_id", "bytes")
    cut = staged(cut.mapInArrow(_runs(run, target), f"p int, k long, ids array<long>, sizes array<long>, {_MAP}"), "runs")
    # a row for each partition of the sort
    starts = cut.groupBy("p").agg(F.count(F.lit(1)).alias("n"))
    starts = starts.select("p", F.coalesce(F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    runs = cut.join(F.broadcast(starts), "p").withColumn("seq", F.col("before") + F.col("k"))
    levels, n = [runs.select("seq", *_FIELDS)], cut.count()
    while n > 1:
        n = -(-n // fan)
        levels.append(staged(levels[-1].groupBy(F.floor(F.col("seq") / fan).cast("long").alias("up")).applyInArrow(_composed(target), f"seq long, {_MAP}"), "maps"))
    told = docs.sparkSession.createDataFrame([(0, 0, 0)], "seq long, in_fill long, in_part long")
    for level in reversed(levels[:-1]):
        below = level.withColumn("up", F.floor(F.col("seq") / fan).cast("long")).join(told.withColumnRenamed("seq", "up"), "up")
        told = staged(below.groupBy("up").applyInArrow(_told(target), "seq long, in_fill long, in_part long"), "told")
    return runs.join(told, "seq").select("ids", "sizes", "in_fill", "in_part").mapInArrow(_packed(target), "doc_id long, part long, bytes long")


def parts(rows: DataFrame) -> DataFrame:
    """part, first_doc_id, last_doc_id, n_docs, bytes of pack_in_order(): what each part holds; null ids are counted, but are no first or last."""
    return rows.groupBy("part").agg(F.min("doc_id").alias("first_doc_id"), F.max("doc_id").alias("last_doc_id"), F.count(F.lit(1)).alias("n_docs"), F.sum("bytes").alias("bytes"))
