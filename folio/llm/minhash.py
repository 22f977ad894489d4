"""MinHash near-dedup: BagMinHash signatures over multisets of word shingles, bands, and exact verification.

A text's shingle counts are the weights. Every shingle drives Poisson processes over the discretised weight axis [0, 1), [1, 2),
[2, 4), [4, 8) ...: points come in order of arrival, each with a signature slot and, in the interval that the weight ends in, a
place on the weight axis that must lie below the weight. A slot's value is its earliest point, so two texts agree in a slot with a probability
equal to their weighted Jaccard similarity. Processes are followed only while they can still lower a slot.

Texts of equal words are one class (a hash aggregate). Class representatives with an equal band are candidates: first every
bucket's member with the fullest buckets is compared with the others (a star, linear in the bucket); then buckets that are still
in several components are dealt into tiles of bounded size, where pairs of different components whose estimate is not far
below the threshold are verified, best first, until their ends are connected. Verification takes the whole multisets:
|intersection| / |union| counting repeats. So every link counts for the classes, and no table of all pairs is made.

Defined results: null text has no class mates and is kept; texts of fewer than five words are one shingle of all words; texts
without words are copies of each other; a null doc_id is a document of its own; repeated rows are copies; ties go to the
smaller doc_id; the class id is the smallest doc_id linked; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.skew import heavy_keys, spread_join
from .common import components, discard, flat, hashed, mix, shingles, staged, table, words_of

WIDTH, SIMILARITY, BANDS, ROWS, TILE = 5, 0.8, 26, 5, 512
#: Estimates below the threshold by more than this (6 standard deviations at 130 slots) are not followed; at similarity 0.8 that is 2 pairs in 10^8.
MARGIN = 0.21
ONE = np.uint64(1)


def counted(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, shingle) with counts, ordered by row and shingle."""
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    return h[at], row[at], np.diff(np.append(at, len(h)))


def signatures(h: np.ndarray, row: np.ndarray, count: np.ndarray, rows: int, slots: int) -> np.ndarray:
    """rows x slots hashes: the identity of each slot's earliest point."""
    best = np.full(rows * slots, np.inf)
    who = np.zeros(rows * slots, np.uint64)
    # the processes: for each element one per level of the weight axis that begins below its weight
    levels = [np.flatnonzero(count > (0 if k == 0 else 1 << (k - 1))) for k in range(int(count.max(initial=1) - 1).bit_length() + 1)]
    el = np.concatenate(levels)
    level = np.concatenate([np.full(len(x), k) for k, x in enumerate(levels)])
    low = np.where(level == 0, 0, 1 << np.maximum(level - 1, 0)).astype(np.float64)
    width = np.where(level == 0, 1, 1 << np.maximum(level - 1, 0)).astype(np.float64)
    seed = mix(h[el] ^ mix(level.astype(np.uint64) + np.uint64(1000)))
    owner, top = row[el], count[el].astype(np.float64)
    time = np.zeros(len(el))
    k = 0
    while len(seed):
        k += 1
        a = mix(seed + np.uint64(2 * k))
        b = mix(a ^ seed)
        time = time - np.log(((a >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / width
        slot = owner * slots + (((b & np.uint64(0xFFFFFFFF)) * np.uint64(slots)) >> np.uint64(32)).astype(np.int64)
        place = low + width * ((b >> np.uint64(32)).astype(np.float64) * 2.0**-32)
        hit = np.flatnonzero((place < top) & (time < best[slot]))
        if len(hit):
            s, t = slot[hit], time[hit]
            np.minimum.at(best, s, t)
            won = best[s] == t
            who[s[won]] = b[hit[won]]
        worst = best.reshape(rows, slots).max(1)
        go = time < worst[owner]
        seed, owner, top, time, low, width = seed[go], owner[go], top[go], time[go], low[go], width[go]
    return who.reshape(rows, slots)


def text_keys(words: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The whole sequence of words of each text, as 128 bits."""
    n = len(off) - 1
    key = np.zeros((n, 2), np.uint64)
    r = np.repeat(np.arange(n), np.diff(off))
    place = (np.arange(len(words)) - off[:-1][r]).astype(np.uint64) if len(words) else np.zeros(0, np.uint64)
    for j in range(2):
        np.add.at(key[:, j], r, mix(words.astype(np.uint64) ^ mix(place * np.uint64(2) + np.uint64(j + 77))))
    return key.view(np.int64)


def _sketch(width: int, bands: int, rows: int):
    slots = bands * rows

    def run(batches):
        for b in batches:
            words, off = flat(b.column("w"))
            n = b.num_rows
            h, row = shingles(words, off, width)
            key = text_keys(words, off)
            x, at, c = counted(h, row)
            sig = np.zeros((n, slots), np.uint64)
            step = 200  # rows at a time: 200 x slots doubles
            for lo in range(0, n, step):
                i, j = np.searchsorted(at, [lo, min(lo + step, n)])
                if j > i:
                    sig[lo : lo + step] = signatures(x[i:j], at[i:j] - lo, c[i:j], min(step, n - lo), slots)
            band = np.zeros((n, bands), np.uint64)
            for k in range(bands):
                v = np.full(n, k + 1, np.uint64)
                for q in range(rows):
                    v = mix(v ^ sig[:, k * rows + q])
                band[:, k] = v
            size = np.bincount(row, minlength=n)
            short = (sig & np.uint64(0xFFFF)).astype("<u2")
            yield pa.RecordBatch.from_arrays([
                b.column("doc_id"), pa.array(key[:, 0]), pa.array(key[:, 1]), pa.array(size.astype(np.int64)),
                pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * bands, pa.int32()), pa.array(band.reshape(-1).view(np.int64))),
                pa.array([x.tobytes() for x in short], pa.binary()),
            ], ["doc_id", "k1", "k2", "size", "bands", "sig"])

    return run


SKETCH = "doc_id long, k1 long, k2 long, size long, bands array<long>, sig binary"


def _bags(width: int):
    """Each text's shingles, the n-th repeat of one as an element of its own: multiset overlap becomes set overlap."""

    def run(batches):
        for b in batches:
            words, off = flat(b.column("w"))
            h, row = shingles(words, off, width)
            order = np.lexsort((h, row))
            h, row = h[order], row[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
            first = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0)) if len(h) else np.zeros(0, np.int64)
            h = mix(h ^ mix((np.arange(len(h)) - first).astype(np.uint64))).view(np.int64)
            h = h[np.lexsort((h, row))]
            cut = np.searchsorted(row, np.arange(b.num_rows + 1))
            key = text_keys(words, off)
            yield pa.RecordBatch.from_arrays([pa.array(key[:, 0]), pa.array(key[:, 1]), pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(h))], ["k1", "k2", "bag"])

    return run


def _links(floor: float, similarity: float):
    """Of a tile of one bucket: links that connect different components, each verified over the whole multisets.

    Pairs go in order of falling estimate; one whose ends are already connected needs no test.
    """

    def run(key, t):
        within = key[-1].as_py()
        mine = np.array(t.column("left").to_pylist(), bool)
        ids, comp, size = (t.column(c).to_numpy() for c in ("id", "comp", "size"))
        sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), "<u2").reshape(len(ids), -1)
        bags, cut = flat(t.column("bag"))
        parent: dict[int, int] = {}

        def root(x):
            while parent.get(x, x) != x:
                parent[x] = x = parent.get(parent[x], parent[x])
            return x

        a = np.flatnonzero(mine)
        c = a if within else np.flatnonzero(~mine)
        found = [np.zeros((0, 3), np.int64)]
        for i in a.tolist():
            j = c[c > i] if within else c
            j = j[(comp[j] != comp[i]) & (np.minimum(size[j], size[i]) >= similarity * np.maximum(size[j], size[i]))]
            if len(j):
                e = (sig[j] == sig[i]).mean(1)
                ok = e >= floor
                found.append(np.stack([np.full(ok.sum(), i), j[ok], (e[ok] * 1e6).astype(np.int64)], 1))
        found = np.concatenate(found)
        out = []
        for k in np.argsort(-found[:, 2], kind="stable").tolist():
            i, j = int(found[k, 0]), int(found[k, 1])
            u, v = root(int(comp[i])), root(int(comp[j]))
            if u == v:
                continue
            x, y = sorted((bags[cut[i] : cut[i + 1]], bags[cut[j] : cut[j + 1]]), key=len)
            at = np.minimum(np.searchsorted(y, x), len(y) - 1)
            both = int((y[at] == x).sum())
            if both >= similarity * (len(x) + len(y) - both):
                parent[u] = v
                out.append((ids[i], ids[j]))
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([x for _, x in out], pa.int64())})

    return run


def near_duplicates(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, tile: int = TILE) -> DataFrame:
    """doc_id, class_id, copies_of (the smallest doc_id of equal words), kept of every row of docs(doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    real = docs.where("text is not null and doc_id is not null")
    worded = lambda d: d.select("doc_id", hashed(words_of(F.col("text"))).alias("w"))
    sketch = staged(worded(real).mapInArrow(_sketch(width, bands, rows), SKETCH), "sketch", 250)
    # a doc_id may stand in several rows of different texts: classes have ids of their own, and are joined by the text's key;
    # rows of equal words have equal sketches, so a map-side aggregate takes one of them
    same = sketch.groupBy("k1", "k2").agg(F.min("doc_id").alias("doc"), F.count(F.lit(1)).alias("n"), *[F.first(c).alias(c) for c in ("size", "bands", "sig")])
    first = staged(same.withColumn("id", F.monotonically_increasing_id()), "first")
    reps = first.select("k1", "k2", "doc", "n", "id")
    banded = staged(first.where("size > 0").select("id", F.explode("bands").alias("bucket")), "bands")
    full = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = staged(banded.join(full, "bucket"), "shared")
    score = shared.groupBy("id").agg(F.sum("n").alias("score"))
    ranked = shared.join(score, "id")
    hubs = ranked.groupBy("bucket").agg(F.max_by("id", F.struct("score", -F.col("id"))).alias("hub"))
    star = shared.join(hubs, "bucket").where("id <> hub").select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()
    wanted = staged(reps.join(score.select("id"), "id"), "wanted")
    texts = worded(real.join(wanted.select(F.col("doc").alias("doc_id")).hint("merge"), "doc_id", "left_semi"))
    bags = texts.mapInArrow(_bags(width), "k1 long, k2 long, bag array<long>").dropDuplicates(["k1", "k2"])
    bags = staged(bags.join(wanted.select("k1", "k2", "id"), ["k1", "k2"]).select("id", "bag"), "bags", 250)
    discard(banded, wanted)

    def verified(pairs: DataFrame) -> DataFrame:
        x = pairs.join(bags.select(F.col("id").alias("a"), F.col("bag").alias("x")), "a").join(bags.select(F.col("id").alias("b"), F.col("bag").alias("y")), "b")
        both = F.size(F.array_intersect("x", "y"))
        return x.where(F.least(F.size("x"), F.size("y")) >= similarity * F.greatest(F.size("x"), F.size("y"))).where(both >= similarity * (F.size("x") + F.size("y") - both)).select("a", "b")

    links = staged(verified(star), "links")
    comp = staged(components(links), "comp")
    labelled = shared.select("bucket", "id").join(comp, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    open_ = labelled.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("n"), F.min("id").alias("i"), F.max("id").alias("j"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y")).where("lo < hi")
    # buckets of the same members, which bands of similar texts give, are one
    open_ = open_.groupBy("n", "i", "j", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket", F.ceil(F.col("n") / tile).cast("int").alias("parts"))
    rest = labelled.join(open_, "bucket").join(first.select("id", "size", "sig").join(bags, "id"), "id").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts").cast("long")).cast("int"))
    rest = rest.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("q"))
    rest = rest.select("bucket", F.least("part", "q").alias("pa"), F.greatest("part", "q").alias("pb"), (F.col("part") <= F.col("q")).alias("left"), (F.col("part") == F.col("q")).alias("within"), "id", "comp", "size", "sig", "bag")
    more = staged(rest.groupBy("bucket", "pa", "pb", "within").applyInArrow(_links(similarity - MARGIN, similarity), "a long, b long"), "links")
    comp = staged(components(links.unionByName(more)), "comp")
    discard(shared, bags, links, more)
    of = reps.join(comp, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    least = of.groupBy("comp").agg(F.min("doc").alias("class_id"))
    of = of.join(least, "comp").select("k1", "k2", F.col("doc").alias("copies_of"), "class_id")
    heavy = heavy_keys(reps, ["k1", "k2"], sketch.count())
    known = spread_join(sketch.select("k1", "k2", "doc_id"), of, ["k1", "k2"], heavy, F.monotonically_increasing_id()).select("doc_id", "class_id", "copies_of")
    lone = docs.where("text is null or doc_id is null").select("doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("copies_of"))
    return known.unionByName(lone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)))


def survivors(docs: DataFrame) -> DataFrame:
    """docs' own rows, the first of each class in reading order; a null text or doc_id has no class mates.

    Rows get ids of their own and are written with them, so that repeated doc_ids or rows can't be taken for one another.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = dict(zip(docs.columns, names))
    rows = staged(docs.toDF(*names).withColumn("row", F.monotonically_increasing_id()), "rows")
    gone = near_duplicates(rows.select(F.col("row").alias("doc_id"), F.col(at["text"]).alias("text"))).where("not kept").select(F.col("doc_id").alias("row"))
    return rows.join(gone, "row", "left_anti").select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns)])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
