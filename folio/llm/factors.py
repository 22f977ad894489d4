"""Substring dedup by relative Lempel-Ziv factors against indexed reference blocks.

Every text is reference and document at once. Anchors, places picked by content, index it: of the word 8-grams that a run of `width` words holds,
the leftmost one of least hash is the run's anchor, so equal runs have equal anchors at the same offset, and about one word in
14 is an anchor. The reference block of an anchor is all that runs with this anchor can reach: the 8-gram with width - 8 words on either
side. A document is factored greedily at its anchors: an anchor's factor is the longest piece of its block that is made of runs found
in another indexed block of the same 8-gram. Where the whole block occurs twice (most anchors inside a repeated passage), that is
the block. Only at the boundaries of a passage, where blocks of one 8-gram differ, are the runs through the anchor compared one by one, once for
all equal blocks; each run belongs to one anchor, so none is counted twice. Overlapping factors of a document make its duplicate spans.

So what is shuffled is anchors, and runs of boundary blocks only. Counts are aggregates with map-side combine and joins back deal the
rows of a heavy 8-gram, block or run into parts; no two occurrences are ever paired. Words are compared as 64-bit hashes, blocks and runs as
128-bit hashes of those.

Defined results: null text has no words; a text under `width` words has no run; runs are compared across and within texts, equal texts
and repeated rows included, each row being a text of its own; a null doc_id is kept; extra columns are ignored; texts of any length are
read whole; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.skew import heavy_keys, spread_join
from .common import BLANKS, discard, flat, mix, staged, table

WIDTH, GRAM = 35, 8
#: Words that a worker hashes at once, or one text if that has more.
MOST_WORDS = 1 << 20
_MASK = (1 << 64) - 1
#: Multipliers of the two 64-bit hashes of a run, and what stands beyond a text's ends.
_LANES, _END = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


class Runs:
    """Texts of hashed words in one array with `pad` end marks around each, and hashes of the runs of words in it."""

    def __init__(self, values: np.ndarray, offsets: np.ndarray, pad: int):
        lengths = np.diff(offsets)
        self.text = np.repeat(np.arange(len(lengths)), lengths)
        self.at = np.arange(len(values)) + pad * (self.text + 1)
        self.first = offsets[:-1] + pad * np.arange(1, len(lengths) + 1)
        self.left = offsets[1:][self.text] - np.arange(len(values))  # words from here to the end of the text
        words = np.full(len(values) + pad * (len(lengths) + 1), _END)
        words[self.at] = values.astype(np.uint64)
        self.doubled = [[words], [mix(words)]]

    def hashes(self, lane: int, length: int, start: np.ndarray) -> np.ndarray:
        """Polynomial hashes (modulo 2 ** 64) of the runs of `length` words at start, from those of 1, 2, 4, ... words."""
        have, out, ahead = self.doubled[lane], np.zeros(len(start), np.uint64), 0
        for k in range(length.bit_length()):
            while len(have) <= k:
                step = 1 << len(have) - 1
                longer = have[-1].copy()
                longer[:-step] += np.uint64(pow(_LANES[lane], step, 1 << 64)) * have[-1][step:]
                have.append(longer)
            if length >> k & 1:
                out += np.uint64(pow(_LANES[lane], ahead, 1 << 64)) * have[k][start + ahead]
                ahead += 1 << k
        return out


def slices(offsets: np.ndarray, most: int):
    """Ranges of rows with `most` words together at most, or of one row."""
    lo = 0
    while lo < len(offsets) - 1:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, hi
        lo = hi


def least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours."""
    size, out = 1, x
    while 2 * size <= width:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    return np.minimum(out[: len(x) - width + 1], out[width - size :]) if size < width else out


def _anchors(width: int, gram: int):
    """row, pos, hi and lo, gram and block hashes of every anchor: its runs start hi to lo words before it."""
    pad = width - gram

    def run(batches):
        for b in batches:
            rows = b.column("row").to_numpy()
            values, offsets = flat(b.column("words"))
            for lo, hi in slices(offsets, MOST_WORDS):
                runs = Runs(values[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], pad)
                grams = mix(runs.hashes(0, gram, np.arange(len(runs.doubled[0][0]) - gram + 1)))
                low = np.uint64(0xFFFFFFFF)
                picked = least(grams & ~low | np.arange(len(grams), dtype=np.uint64), pad + 1)
                whole = runs.left >= width
                start, text = runs.at[whole], runs.text[whole]
                at = (picked[start] & low).astype(np.int64)
                head = np.flatnonzero(np.diff(at, prepend=-1))
                tail = np.append(head[1:], len(at)) - 1
                anchor, text = at[head], text[head]
                one, two = (runs.hashes(lane, width + pad, anchor - pad) for lane in (0, 1))
                yield pa.RecordBatch.from_arrays([
                    pa.array(rows[lo:hi][text]), pa.array((anchor - runs.first[text]).astype(np.int32)), pa.array((anchor - start[head]).astype(np.int16)), pa.array((anchor - start[tail]).astype(np.int16)),
                    *[pa.array(x.view(np.int64)) for x in (grams[anchor], one, two)]], ["row", "pos", "hi", "lo", "gram", "b1", "b2"])

    return run


def _boundary_runs(width: int, gram: int):
    """row, pos, i, n and the run hashes of every run of the given anchors; i: the words from its start to the anchor."""
    pad = width - gram

    def run(batches):
        for b in batches:
            rows = b.column("row").to_numpy()
            values, offsets = flat(b.column("words"))
            pos, per = flat(b.column("pos"))
            more = {c: flat(b.column(c))[0] for c in ("hi", "lo", "n")}
            for lo, hi in slices(offsets, MOST_WORDS):
                runs = Runs(values[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], pad)
                here = slice(per[lo], per[hi])
                p, most, fewest, n = pos[here].astype(np.int64), more["hi"][here].astype(np.int64), more["lo"][here].astype(np.int64), more["n"][here]
                text = np.repeat(np.arange(hi - lo), np.diff(per[lo : hi + 1]))
                count = most - fewest + 1
                each = np.repeat(np.arange(len(p)), count)
                i = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + fewest[each]
                start = runs.first[text[each]] + p[each] - i
                yield pa.RecordBatch.from_arrays([
                    pa.array(rows[lo:hi][text[each]]), pa.array(p[each].astype(np.int32)), pa.array(i.astype(np.int16)), pa.array(n[each].astype(np.int64)),
                    *[pa.array(runs.hashes(lane, width, start).view(np.int64)) for lane in (0, 1)]], ["row", "pos", "i", "n", "r1", "r2"])

    return run


def factors(texts: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """row, start, stop (words from 0) of the factors of texts(row, text), a staged table: their union is what runs of `width` words that start elsewhere too cover."""
    gram = min(gram, width)
    words = F.array_remove(F.split("text", f"[{BLANKS}]+"), "")
    hashed = texts.select("row", F.transform(words, lambda w: F.xxhash64(w)).alias("words")).where(F.size("words") >= width)
    anchors = staged(hashed.mapInArrow(_anchors(width, gram), "row long, pos int, hi short, lo short, gram long, b1 long, b2 long"), "anchors")
    block = ["b1", "b2"]
    # 8-grams that occur again, and whether their blocks differ
    ends = [f(c).alias(f"{f.__name__}_{c}") for c in block for f in (F.min, F.max)]
    again = anchors.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), *ends).where("n > 1").select("gram", "n", F.expr("min_b1 <> max_b1 or min_b2 <> max_b2").alias("differ"))
    again = staged(again, "grams")
    met = staged(spread_join(anchors, again.select("gram", "differ"), ["gram"], heavy_keys(again, ["gram"], anchors.count())), "met")
    whole = lambda df: df.select("row", (F.col("pos") - F.col("hi")).alias("start"), (F.col("pos") - F.col("lo") + width).alias("stop"))
    out = whole(met.where("not differ"))
    mixed = met.where("differ")
    blocks = staged(mixed.groupBy(*block).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("row", "pos", "hi", "lo")).alias("at")), "blocks")
    out = out.unionByName(whole(spread_join(mixed, blocks.where("n > 1").select(*block), block, heavy_keys(blocks, block, mixed.count()))))
    # the boundaries: a block of each kind, in its text
    of = blocks.select("at.*", "n").groupBy(F.col("row").alias("_row")).agg(F.collect_list(F.struct("pos", "hi", "lo", "n")).alias("x"))
    there = texts.join(of, F.col("row") == F.col("_row")).select("row", F.transform(words, lambda w: F.xxhash64(w)).alias("words"), "x.pos", "x.hi", "x.lo", "x.n")
    runs = staged(there.mapInArrow(_boundary_runs(width, gram), "row long, pos int, i short, n long, r1 long, r2 long"), "runs")
    same = staged(runs.groupBy("r1", "r2").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("m")).where("n > 1"), "same")
    found = spread_join(runs.where("n = 1"), same.select("r1", "r2"), ["r1", "r2"], heavy_keys(same, ["r1", "r2"], runs.count(), "m"))
    found = found.groupBy("row", "pos").agg(F.max("i").alias("hi"), F.min("i").alias("lo"))
    discard(anchors)
    return out.unionByName(whole(found))


def _kept(batches):
    """doc_id, n_words, n_removed, kept_text, spans (merged) of every text, given its factors."""
    for b in batches:
        words_of, removed, texts, spans = [], [], [], []
        start, per = flat(b.column("start"))
        stop = flat(b.column("stop"))[0]
        for k, text in enumerate(b.column("text").to_pylist()):
            words = text.encode("utf-8", "surrogatepass").split()  # bytes split at \x20 and \x09-\x0D alone
            s, e = start[per[k] : per[k + 1]], stop[per[k] : per[k + 1]]
            edge = np.zeros(len(words) + 1, np.int64)
            np.add.at(edge, s, 1)
            np.add.at(edge, e, -1)
            gone = np.append(np.cumsum(edge)[:-1] > 0, False)
            turn = np.flatnonzero(np.diff(gone, prepend=False)).reshape(-1, 2)
            at, kept = 0, []
            for lo, hi in turn.tolist():
                kept += words[at:lo]
                at = hi
            texts.append(b" ".join(kept + words[at:]))
            words_of.append(len(words))
            removed.append(int(gone.sum()))
            spans.append([{"start": lo, "stop": hi} for lo, hi in turn.tolist()])
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(words_of, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))], ["doc_id", "n_words", "n_removed", "kept_text", "spans"])


def without_repeats(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text, spans of every row of docs(doc_id, text): the words outside its duplicate spans, joined by one space."""
    texts = staged(docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")), "texts")
    of = factors(texts.select("row", "text"), width, gram).groupBy(F.col("row").alias("_row")).agg(F.collect_list(F.struct("start", "stop")).alias("x"))
    none = F.array().cast("array<int>")
    met = texts.join(of, F.col("row") == F.col("_row"), "left").select("doc_id", "text", *[F.coalesce(F.col("x")[c], none).alias(c) for c in ("start", "stop")])
    return met.mapInArrow(_kept, "doc_id long, n_words long, n_removed long, kept_text string, spans array<struct<start:int,stop:int>>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH w AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT r, i, array_to_string(w[i:i + 34], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM w)),
d AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY g) AS n FROM s) WHERE n > 1),
c AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS k FROM d),
x AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS k FROM w),
y AS (SELECT x.r, count(c.k) AS n_removed, coalesce(string_agg(CASE WHEN c.k IS NULL THEN word END, ' ' ORDER BY x.k), '') AS t FROM x LEFT JOIN c ON x.r = c.r AND x.k = c.k GROUP BY x.r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN y USING (r)
"""
