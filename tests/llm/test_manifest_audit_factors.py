"""op11, op12 and op13 against plain Python, with nulls, repeats, ties, long texts, clashing columns, empty tables and hot keys."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from folio.llm import audit, factors, merkle
from folio.llm.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, part string, flags string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def table(spark, rows):
    """rows: (doc_id, text, lang, source, n_chars)."""
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)


@pytest.mark.parametrize("name", ["op11_audit", "op12_manifest", "op13_substrings"])
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    rows = lambda frame: sorted(map(str, frame[sorted(frame.columns)].itertuples(index=False, name=None)))
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(con.sql(ORACLES[name]).df())


def plain_audit(rows, labels):
    good, toxic = {d for d, q, _ in labels if q == 1}, {d for d, _, t in labels if t == 1}
    least = {}
    for r in rows:
        if r[0] is not None:
            least[r[1] or ""] = min(r[0], least.get(r[1] or "", r[0]))
    parts = collections.defaultdict(list)
    for doc_id, text, _, source, _ in rows:
        text = text or ""
        w = WORD.findall(text)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), "D": bool(re.search(r"[#$%&*|]", text)), "E": doc_id is not None and doc_id > least[text]}
        parts[source or ""].append(({f for f in fails if fails[f]}, doc_id is not None and doc_id in good, doc_id is not None and doc_id in toxic))
    out = {}
    for part, docs in parts.items():
        shapley = collections.Counter()
        for order in itertools.permutations("ABCDE"):
            left = list(docs)
            for k, f in enumerate(order):
                gone = [d for d in left if f in d[0]]
                left = [d for d in left if f not in d[0]]
                out[part, "".join(order), k + 1] = [len(left), len(gone), sum(f in d[0] for d in docs) - len(gone), sum(d[0] == {f} for d in docs), sum(d[1] for d in gone), sum(d[2] for d in gone)]
                shapley[f] += len(gone)
        for (p, order, k), x in out.items():
            if p == part:
                x.append(shapley[order[k - 1]])
    return out


def test_audit(spark):
    rng = random.Random(3)
    texts = [None, "", "one", "A B C D", "a|b", "word " * 300, " ".join(f"w{i}" for i in range(250)), " ".join(f"w{i}" for i in range(199)) + " $", "x\x1cy \x0b z", "É " * 10 + "Q", " ".join(f"L{i}" for i in range(5000))]
    rows = [(i if i % 17 else None, rng.choice(texts), "en", rng.choice([None, "", "a", "b"]), 1) for i in range(300)] + [(7, "one", "en", "a", 1)] * 3
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 300, 2)] + [(2, 1, 0), (None, 1, 1)]
    said = spark.createDataFrame([(*r, "u") for r in labels], "doc_id long, quality int, toxic int, part string")
    got = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in audit.audit(table(spark, rows), said).collect()}
    assert got == plain_audit(rows, labels)
    assert audit.audit(table(spark, rows[:0]), said).count() == 0
    assert audit.audit(table(spark, rows), said.limit(0)).agg(F.sum("good_lost")).first()[0] == 0


def test_audit_many_parts_and_hot_copies(spark):
    """More parts than a worker holds at once, and one text in a third of all rows."""
    rows = [(i, "same" if i % 3 else f"text {i}", "en", f"s{i}", 1) for i in range(2500)]
    docs = table(spark, rows).coalesce(1)
    out = audit.audit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).where("filter_order = 'EABCD' and step = 1").agg(F.sum("removed"), F.count(F.lit(1))).first()
    assert tuple(out) == (sum(i % 3 > 0 for i in range(2500)) - 1, 2500)


def test_bitsets(rng=np.random.default_rng(5)):
    part = np.sort(rng.integers(0, 4, 500))
    flags = rng.integers(0, 128, 500).astype(np.int32)
    x = audit.counted(*audit.index(flags, part))
    for k, (before, f) in enumerate(audit.PAIRS):
        for p in range(4):
            mine = flags[part == p]
            gone = mine[(mine & before == 0) & (mine >> f & 1 == 1)]
            assert x[p, k].tolist() == [int(((mine & (before | 1 << f)) == 0).sum()), len(gone), int((gone >> audit.GOOD & 1).sum()), int((gone >> audit.TOXIC & 1).sum())]


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][k : k + 2]) for k in range(0, len(levels[-1]), 2)])
    return levels


def plain_manifest(rows):
    field = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    leaf = lambda r, more=0: H(*map(field, (r[0], r[3], r[2], None if r[4] is None else r[4] + more, r[1])))
    groups = collections.defaultdict(list)
    for r in rows:
        odd = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
        groups[r[2]].append((r[0] is not None, r[0] or 0, leaf(r), leaf(r, odd), r[0]))
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {g: plain_tree([x[2] for x in sorted(groups[g])]) for g in names}
    forest, out = plain_tree([trees[g][-1][0] for g in names]), []
    for at, g in enumerate(names):
        for k, (_, _, original, given, doc_id) in enumerate(sorted(groups[g])):
            sibs, node = [], given
            for levels, i in ((trees[g], k), (forest, at)):
                for nodes in levels[:-1]:
                    run = nodes[i // 2 * 2 : i // 2 * 2 + 2]
                    sibs += run[: i % 2] + run[i % 2 + 1 :]
                    run[i % 2] = node
                    node, i = H(*run), i // 2
            out.append((doc_id, original, trees[g][-1][0], forest[-1][0], H(*sibs), node, node == forest[-1][0]))
    return sorted(map(str, out))


def manifest(docs, **given):
    ids = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    return sorted(map(str, map(tuple, merkle.manifest(docs, F.coalesce(ids % 7 == 0, F.lit(False)), **given).collect())))


def test_manifest(spark):
    """One group holds two thirds of the rows; blocks of 4 leaves make many supersteps, those of 1024 one or two."""
    rows = [(i * 3 % 1401 if i % 50 else None, [None, "", "text é 🙂", "long " * 2000][i % 4], ["en"] * 6 + [None, "de", "é"], "s" if i % 3 else None, [None, 5, 2**62][i % 3]) for i in range(1401)]
    rows = [(d, t, langs[k % 9], s, n) for k, (d, t, langs, s, n) in enumerate(rows)]
    rows += [rows[5]] * 3 + [(9001, "x", f"l{k}", "s", 2**63 - 1) for k in range(9)]
    want = plain_manifest(rows)
    docs = table(spark, rows)
    assert manifest(docs) == want
    assert manifest(docs, height=2) == want


@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_small_manifests(spark, n):
    rows = [(7 * i + 5, "t", "en", "s", i) for i in range(n)]
    assert manifest(table(spark, rows)) == plain_manifest(rows)


def plain_repeats(texts, width):
    words = [WORD.findall(t or "") for t in texts]
    runs = collections.Counter(tuple(w[i : i + width]) for w in words for i in range(len(w) - width + 1))
    out = []
    for w in words:
        gone = {k for i in range(len(w) - width + 1) if runs[tuple(w[i : i + width])] > 1 for k in range(i, i + width)}
        out.append((len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def got_repeats(docs, **given):
    return {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in factors.without_repeats(docs, **given).collect()}


def test_substrings(spark):
    rng = random.Random(8)
    some = lambda n, of=10**6: [f"w{rng.randrange(of)}" for _ in range(n)]
    a, b, c = some(60), some(35), some(34)
    twice = some(50)
    texts = [None, "", "one", " ".join(a), " ".join(some(10) + a + some(5)), " ".join(a[:40] + some(30) + b), " \n".join(some(3) + b), "\t".join(c + some(9)), "  ".join(some(2) + c), " ".join(twice + some(7) + twice),
             "same " * 35, "same " * 36, "a b " * 40, " ".join(some(20000) + a + some(20000)), " ".join(a[:50]) + "\x1c", " ".join(a[20:]) + " \x0b", " ".join(some(400, 2)), " ".join(some(400, 2)), "é " * 50, "x" * 100_000]
    # a common line of 8 to 40 words in many texts with other neighbours, and exact copies
    line = some(40)
    texts += [" ".join(some(9) + line[: 8 + i % 33] + some(9)) for i in range(150)] + [" ".join(a + b)] * 60
    docs = table(spark, [(i, t, "en", "s", 1) for i, t in enumerate(texts)])
    assert got_repeats(docs) == dict(enumerate(plain_repeats(texts, 35)))
    small = [" ".join(some(rng.randrange(0, 40), 3)) for _ in range(120)]
    docs = table(spark, [(i, t, "en", "s", 1) for i, t in enumerate(small)])
    for width, gram in ((5, 2), (12, 12), (3, 8), (9, 1)):
        assert got_repeats(docs, width=width, gram=gram) == dict(enumerate(plain_repeats(small, width)))


def test_substrings_edges(spark):
    rows = [(None, "w " * 50, None, None, None), (1, "w " * 50, "en", "s", 1), (1, "w " * 50, "en", "s", 1), (2, " ".join(map(str, range(80))), "en", "s", 1)]
    out = factors.without_repeats(table(spark, rows))
    assert sorted((str(r.doc_id), r.n_removed, [(s.start, s.stop) for s in r.spans]) for r in out.collect()) == [("1", 50, [(0, 50)]), ("1", 50, [(0, 50)]), ("2", 0, []), ("None", 50, [(0, 50)])]
    assert factors.without_repeats(table(spark, rows[:0])).count() == 0


def test_slices_and_least():
    """A worker hashes a batch in slices of bounded words; the least of neighbours."""
    assert list(factors.slices(np.array([0, 5, 9, 30, 31]), 10)) == [(0, 2), (2, 3), (3, 4)]
    x = np.random.default_rng(1).integers(0, 50, 200).astype(np.uint64)
    for width in (1, 2, 5, 28):
        assert factors.least(x, width).tolist() == [min(x[i : i + width]) for i in range(200 - width + 1)]
