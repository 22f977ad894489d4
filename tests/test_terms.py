"""Term replacement against plain Python, in one pass and in shards."""

import random
import re

import pytest

from folio.operators import terms


def plain(text, rules, whole):
    """Leftmost, then longest, without overlaps, by trying every place."""
    text, out, at, hits = text or "", [], 0, {}
    inside = lambda k: 0 <= k < len(text) and text[k] in terms._WORD
    while at < len(text):
        here = [t for t in rules if text.startswith(t, at) and not (whole and (inside(at - 1) or inside(at + len(t))))]
        if here:
            t = max(here, key=len)
            out.append(rules[t])
            hits[t] = hits.get(t, 0) + 1
            at += len(t)
        else:
            out.append(text[at])
            at += 1
    return "".join(out), sorted(hits.items())


@pytest.mark.parametrize("whole", [False, True])
@pytest.mark.parametrize("most_bytes", [terms.MOST_BYTES, 30])
def test_replace(spark, whole, most_bytes):
    rng = random.Random(4)
    given = [("ab", "1"), ("abc", "2"), ("bcd", None), ("b", "$1 \\2"), ("c d", "é"), ("日本", "x"), ("a.b", "dot"), ("ab", "0"), ("", "no"), (None, "no"), ("aa", "aaa"), ("same" * 9, "long")]
    texts = [None, "", "abcd", "a.b ab abc", "aab", "日本語", "same" * 20] + ["".join(rng.choice(["a", "b", "c", " ", "d", ".", "日本", "_"]) for _ in range(rng.randrange(60))) for _ in range(80)] + ["ab c d " * 3000]
    docs = spark.createDataFrame([(i if i % 9 else None, t, "h", "r") for i, t in enumerate(texts)] + [(3, "a.b ab abc", "h", "r")] * 2, "doc_id long, text string, hits string, _row string")
    rules = spark.createDataFrame(given, "term string, replacement string")
    to = {"ab": "0", "abc": "2", "bcd": "", "b": "$1 \\2", "c d": "é", "日本": "x", "a.b": "dot", "aa": "aaa", "same" * 9: "long"}
    out = terms.replace(docs, rules, whole, most_bytes)
    got = sorted(str((r.doc_id, r.text, r.replaced, [(h.term, h.n) for h in r.hits], r.given_hits)) for r in out.collect())
    assert got == sorted(str((r.doc_id, r.text, *plain(r.text, to, whole), "h")) for r in docs.collect())
    counts = {r.term: (r.n_docs, r.n) for r in terms.counts(out, rules).collect()}
    each = [dict(plain(r.text, to, whole)[1]) for r in docs.collect()]
    assert counts == {t: (sum(t in x for x in each), sum(x.get(t, 0) for x in each)) for t in to}


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "ab")], "doc_id long, text string")
    rules = spark.createDataFrame([("ab", "x")], "term string, replacement string")
    assert terms.replace(docs.limit(0), rules).count() == 0
    assert terms.replace(docs, rules.limit(0)).first().replaced == "ab"
    assert terms.counts(terms.replace(docs.limit(0), rules), rules).first().n == 0


def test_automaton_equals_alternation():
    rng = random.Random(6)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randrange(1, 6))) for _ in range(12)}, key=len, reverse=True)
    found = terms.automaton(words)
    for _ in range(100):
        text = "".join(rng.choice("abc") for _ in range(50))
        assert [(s, t) for s, t in terms.resolved(terms.matches(found, text, False))] == [(m.start(), m.group()) for m in re.finditer("|".join(words), text)]
