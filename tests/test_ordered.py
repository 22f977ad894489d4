"""As-of joins, runs and identities against plain Python, with hot keys over many partitions, ties, nulls and repeats."""

import random
import re

import pytest
from pyspark.sql import functions as F

from folio.operators import ordered, sweep, topk


def rows_of(rng, n, hot):
    return [(None if i % 31 == 0 else "hot" if rng.random() < hot else f"k{rng.randrange(6)}", None if i % 37 == 0 else rng.randrange(n), i) for i in range(n)]


def plain_asof(left, right, direction, within):
    out = []
    for k, t, i in left:
        best = None
        for q, u, j in right:
            if k is None or t is None or q != k or u is None:
                continue
            if direction == "backward" and u > t or direction == "forward" and u < t or within is not None and abs(u - t) > within:
                continue
            score = (abs(u - t), u > t, -j)
            best = min(best, (score, u, j)) if best else (score, u, j)
        out.append((k, t, i, *(best[1:] if best else (None, None))))
    return out


@pytest.mark.parametrize("direction", ["backward", "forward", "nearest"])
def test_asof(spark, direction):
    rng = random.Random(7)
    left, right = rows_of(rng, 300, 0.6), rows_of(rng, 200, 0.5)
    left += [("hot", 100, 900)] * 3 + [("none", 5, 901)]
    right += [("hot", 100, 902), ("hot", 100, 903), ("other", 1, 904)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the hot key lies in several partitions
    try:
        a = spark.createDataFrame([(*r, "x") for r in left], "k string, t long, i long, j string")
        b = spark.createDataFrame(right, "k string, t long, j long")
        for within in (None, 20):
            got = ordered.asof(a, b, ["k"], "t", direction, within)
            assert got.columns == ["k", "t", "i", "given_j", "matched_at", "j"]
            assert sorted(str((r.k, r.t, r.i, r.matched_at, r.j)) for r in got.collect()) == sorted(map(str, plain_asof(left, right, direction, within)))
        assert ordered.asof(a.limit(0), b, ["k"], "t", direction).count() == 0
        assert ordered.asof(a, b.limit(0), ["k"], "t", direction).where("matched_at is not null").count() == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_runs(spark):
    rng = random.Random(9)
    rows = rows_of(rng, 400, 0.5) + [("hot", 5, 1)] * 20
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        docs = spark.createDataFrame(rows, "k string, t long, n long")
        for gap in (0, 1, 4, 1000):
            want = []
            for k in {r[0] for r in rows}:
                at = sorted(r[1] for r in rows if r[0] == k and r[1] is not None)
                number, begin = 0, 0
                for i in range(len(at)):
                    if i + 1 == len(at) or at[i + 1] - at[i] > gap:
                        number += 1
                        want.append((k, number, at[begin], at[i], i + 1 - begin))
                        begin = i + 1
            assert sorted(map(str, map(tuple, ordered.runs(docs, ["k"], "t", gap).collect()))) == sorted(map(str, want))
        assert ordered.runs(docs.limit(0), ["k"], "t", 1).count() == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_line_runs(spark):
    texts = ["a|b|\n|c|\nno\n|d|", "|x|y|", None, "", "\n|a|\n|b|\n\n|c|\n|d|\n|e|", "|1|\n" * 3000]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)] + [(4, texts[4], 0), (None, texts[0], 0)], "doc_id long, text string, line int")
    got = sorted(str(tuple(r)) for r in ordered.line_runs(docs, "[|].*[|]").collect())
    assert got == sorted(map(str, [(0, 0, 2, 7), (None, 0, 2, 7), *[(4, 1, 2, 6), (4, 4, 3, 9)] * 2, (5, 0, 3000, 9000)]))
    assert ordered.line_runs(docs.limit(0), "[|].*[|]").count() == 0


def test_identities(spark):
    sums = spark.createDataFrame([(1.0, 1.0, 2), (5.0, 4.0, None), (None, 1.0, 3)], "a double, b double, c int")
    got = [tuple(r) for r in ordered.identities(sums, [("ab", "a", "b", "0.5"), ("wide", "a", "b", "1"), ("c", "c", "a + b", "0")]).collect()]
    assert got == [("ab", 3, 2, 1, 1.0), ("wide", 3, 2, 2, 1.0), ("c", 3, 1, 1, 0.0)]
    assert [tuple(r) for r in ordered.identities(sums.limit(0), [("ab", "a", "b", "0")]).collect()] == [("ab", 0, 0, 0, None)]


def test_sweep(spark):
    """What one text declares is masked in all, a token of a third of all texts too; other tokens stay."""
    a, b, c = "A" * 16, "b1" * 10, "c" * 17
    texts = [f'token = "{a}"', f"has {a}, and {a}x", f"Password: {b} {c}", f"{c} {b}{b}", None, "", "short token = abc"] + [f"t{i} {a} {c}{i}" for i in range(300)]
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)] + [(1, texts[1], "s")], "doc_id long, text string, swept string")
    known = sweep.declared(docs, "(?i:token|password) ?[=:] ?\"?([0-9A-Za-z]{16,})")
    assert sorted(r.term for r in known.collect()) == [a, b]
    out = sweep.sweep(docs, known, "[0-9A-Za-z]{16,}", "[S]")
    got = sorted((r.doc_id, r.swept, r.n_swept, r.given_swept) for r in out.collect())
    want = {0: ('token = "[S]"', 1), 1: (f"has [S], and {a}x", 1), 2: (f"Password: [S] {c}", 1), 3: (texts[3], 0), 4: ("", 0), 5: ("", 0), 6: (texts[6], 0)}
    assert got == sorted([(i, *want.get(i, (f"t{i - 7} [S] {c}{i - 7}", 1)), "s") for i in range(len(texts))] + [(1, *want[1], "s")])
    assert sweep.sweep(docs.limit(0), known, "[0-9A-Za-z]{16,}", "[S]").count() == 0
    assert sweep.sweep(docs, known.limit(0), "[0-9A-Za-z]{16,}", "[S]").where("n_swept > 0").count() == 0


def test_top_and_capped_index(spark):
    rows = [("hot" if i % 3 else None, i % 50, i) for i in range(3000)] + [("one", 1, 1)]
    got = topk.top(spark.createDataFrame(rows, "k string, n int, i int"), ["k"], [F.desc("n"), F.col("i")], 4).collect()
    for k in ("hot", None, "one"):
        mine = sorted((r for r in rows if r[0] == k), key=lambda r: (-r[1], r[2]))[:4]
        assert sorted((r.rank, r.n, r.i) for r in got if r.k == k) == [(j + 1, n, i) for j, (_, n, i) in enumerate(mine)]
    text = " ".join(f"m{i}@x.org http://h{i}.org" for i in (3, 1, 3, 2, 4, 5)) + " 2024-01-31 2024-01-31 2024-19-01"
    docs = spark.createDataFrame([(1, text, 0), (1, text, 0), (None, text, 0), (2, None, 0), (3, "", 0)], "doc_id long, text string, kind int")
    out = sorted(str((r.doc_id, r.place, r.kind, r.value, r.seq)) for r in topk.capped_index(docs, 3, 5).collect())
    one = [(1, "date", "2024-01-31", 0), (2, "email", "m3@x.org", 0), (3, "url", "http://h3.org", 0), (4, "email", "m1@x.org", 1), (5, "url", "http://h1.org", 1)]
    assert out == sorted(str((d, *r)) for d in (1, 1, None) for r in one)
    assert topk.capped_index(docs.limit(0), 3, 5).count() == 0


def test_classified(spark):
    lists = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), ("b", "z"), (None, "q"), ("c", None), ("b", "z")], "label string, word string")
    docs = spark.createDataFrame([(1, "x Y\nz\nno"), (2, "x"), (3, None), (4, ""), (5, "z\nz x\ny"), (5, "z\nz x\ny"), (None, "x y")], "doc_id long, text string")
    out = topk.classified(docs, lists, "[a-z]+", 2, 0.6)
    got = sorted(str((r.doc_id, r.label, r.score, r.n_parts, r.n_votes, r.vote, r.settled)) for r in out.collect())
    assert got == sorted(map(str, [(1, "a", 2, 2, 1, "a", False), (2, None, 1, 1, 1, "a", False), (3, None, 0, 0, 0, None, False), (4, None, 0, 0, 0, None, False), *[(5, "a", 2, 3, 2, "b", False)] * 2, (None, "a", 2, 1, 1, "a", True)]))
    assert topk.classified(docs.limit(0), lists, "[a-z]+", 2, 0.6).count() == 0
    with pytest.raises(ValueError):
        topk.classified(docs, lists, "[a-z]+", 2, 0.6, most_terms=2)


def test_dominant_series(spark):
    """Against plain Python: a hot key, ties by numbers and by name, nulls, repeats, long numbers and keys without labels."""
    rng = random.Random(3)
    rows = [("hot" if i % 3 else None if i % 2 else f"k{i % 7}", " ".join(f"{rng.choice(['Page ', 'page ', 'No-', 'ref'])}{rng.randrange(40):0{rng.randrange(1, 6)}d}" for _ in range(rng.randrange(4)))) for i in range(600)]
    rows += [("tie", "aa1 aa1 bb1 bb2"), ("name", "bb7 aa9"), ("long", "cc1234567890 dd5"), ("only", "cc1234567890"), ("none", None), ("none", ""), ("plain", "x 5 and 6"), ("zero", "aa007 aa7"), ("zero", "aa007 aa7")]
    want = {}
    for k in {r[0] for r in rows}:
        each = [re.fullmatch("(.*?)([0-9]+)", x).groups() for q, t in rows if q == k for x in re.findall("[A-Za-z]{2,}[ #-]?[0-9]+", t or "")]
        each = [(s.lower(), int(n)) for s, n in each if len(n) <= 9]
        numbers = {s: {n for t, n in each if t == s} for s, _ in each}
        count = {s: sum(t == s for t, _ in each) for s in numbers}
        if not each:
            want[k] = (0, None, 0, 0, None, None, None, None, False)
            continue
        s = min(numbers, key=lambda s: (-count[s], -len(numbers[s]), s))
        lo, hi = min(numbers[s]), max(numbers[s])
        want[k] = (len(each), s, count[s], len(numbers[s]), lo, hi, hi - lo + 1 - len(numbers[s]), len(numbers[s]) / (hi - lo + 1), count[s] >= 0.5 * len(each))
    docs = spark.createDataFrame([(*r, "x") for r in rows], "key string, text string, series string").repartition(7)
    got = topk.dominant_series(docs, "key", "[A-Za-z]{2,}[ #-]?[0-9]+", 0.5)
    assert {r[0]: tuple(r[1:]) for r in got.collect()} == want and got.count() == len(want)
    assert want["tie"][1] == "bb" and want["name"][1] == "aa" and want["zero"][3] == 1
    assert topk.dominant_series(docs.limit(0), "key", "[a-z]+[0-9]+", 0.5).count() == 0
