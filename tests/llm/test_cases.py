"""Hot groups, clashing columns, empty tables, very long texts, and plain-Python versions of whole operators and stages."""

import collections
import math
import re
import zlib
from hashlib import md5

import numpy as np
import pytest
from pyspark.sql import functions as F

from folio.llm import bpe, chat, embeddings, html, licenses, minhash, packing, quality, sharding, toxicity
from folio.llm.common import components, staged

public_tokenizers = pytest.importorskip("public_tokenizers")
WORD = re.compile(licenses.WORD)
SF = "/root/testdata/sf0.001"


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def pages_of(spark, pages):
    return spark.createDataFrame([(k, u, h, 1) for k, (u, h) in enumerate(pages)], "page_id long, url string, html string, text int")


def texts_of(spark, pages):
    return [r.text for r in html.extract(pages_of(spark, pages)).orderBy("page_id").collect()]


def test_html_tags_cut_off_leave_no_markup():
    blocks = lambda page: "|".join(t for _, t in html.parse(page)[1])
    assert blocks('<p>hello <a href="http://x.org/abc') == "hello"
    assert blocks('<p>it <a href="abc>link</a> more</p>') == "it link more"
    assert blocks("<p title=it's>yes</p> it's <b c=\"x>y\">z</b>") == "yes|it's z"
    assert blocks("a < b &lt; c") == "a < b < c"


def test_html_hot_host_and_what_induction_does(spark):
    """A host of many different trees is dealt into parts; on hosts of one page, where nothing is induced, its template stays."""
    page = lambda k: "<body><div class=top>Same for all</div><div class=text>" + "".join(f"<p>p {k} {i}</p><ul><li>l {k} {i}</ul>" for i in range(1 + k)) + "</div><div class=end>Also the same</div></body>"
    want = ["\n".join(f"p {k} {i}\nl {k} {i}" for i in range(1 + k)) for k in range(40)]
    assert texts_of(spark, [("http://hot.org", page(k)) for k in range(40)] + [("http://b.org", "<p>x</p>")])[:40] == want
    assert texts_of(spark, [(f"http://h{k}.org", page(k)) for k in range(3)]) == [f"Same for all\n{want[k]}\nAlso the same" for k in range(3)]


def test_html_edges(spark):
    deep = lambda k: "<body><p>Same</p>" + "<div>" * 5000 + f"text {k}" + "</div>" * 5000
    equal = "<body><div>menu</div><main><p>one</p></main></body>"
    got = texts_of(spark, [("http://d.org", deep(k)) for k in range(2)] + [("http://e.org", equal)] * 4 + [("http://one.org", "<p>a</p><p>b</p>"), (None, None), (None, "")])
    assert got == ["text 0", "text 1", *["one"] * 4, "a\nb", "", ""]
    assert html.extract(pages_of(spark, []).limit(0)).count() == 0
    small = html.extract(pages_of(spark, [("http://d.org", f"<p>Same</p><div>text {k}</div>") for k in range(3)]), most_broadcast=0)
    assert sorted(r.text for r in small.collect()) == [f"text {k}" for k in range(3)]


def mixed(x):
    m = (1 << 64) - 1
    x = (x + 0x9E3779B97F4A7C15) & m
    x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & m
    x = ((x ^ x >> 27) * 0x94D049BB133111EB) & m
    return x ^ x >> 31


def plain_features(text):
    import xxhash

    h, w = xxhash.xxh64_intdigest, words(text)
    out = set()
    for x in w:
        out.add(h(x) >> 44)
        out |= {h(x[:n] + "-") >> 44 for n in toxicity.STEMS if len(x) > n}
    for gap, salt in ((1, 0x51), (2, 0xA7)):
        out |= {mixed((h(a) * 3 + h(b) * 7 + salt) % (1 << 64)) >> 44 for a, b in zip(w, w[gap:])}
    return out


def plain_model(rows, epochs=toxicity.EPOCHS, alpha=0.2, beta=1.0, l1=2.0, l2=0.5):
    """FTRL-proximal, a coordinate at a time; the intercept is None and has no L1."""
    z, n = collections.Counter(), collections.Counter()

    def weight(i):
        shrink = 0 if i is None else l1
        return 0.0 if abs(z[i]) <= shrink else -(z[i] - math.copysign(shrink, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for e in range(epochs):
        for k in np.random.default_rng(e).permutation(len(rows)):
            features, y = rows[k]
            w = {i: weight(i) for i in [*features, None]}
            g = 1 / (1 + math.exp(-max(-35, min(35, sum(w.values()))))) - y
            for i in w:
                sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha
                n[i] += g * g
                z[i] += g - sigma * w[i]
    return {i: weight(i) for i in list(z) if weight(i)}


def plain_scores(docs, labels):
    """score by place in docs.collect(), as the docstring of toxicity says."""
    known = {}
    for r in labels.collect():
        known[r.doc_id] = max(known.get(r.doc_id, 0), r.toxic)
    rows = docs.select("doc_id", "text", F.xxhash64("doc_id", F.lit(7)).alias("k")).collect()
    least = {}
    for r in rows:
        if r.doc_id in known and zlib.crc32(str(r.doc_id).encode()) % 5:
            least[r.doc_id] = min(least.get(r.doc_id, (r.k, r.text or "")), (r.k, r.text or ""))
    model = plain_model([(plain_features(t), known[d]) for d, (k, t) in sorted(least.items(), key=lambda x: x[1][0])])
    return [1 / (1 + math.exp(-max(-35, min(35, sum(model.get(i, 0) for i in [*plain_features(r.text), None]))))) for r in rows]


def test_toxicity_equals_plain_ftrl(spark):
    """Same rows, same weights: scores agree; copies of a labelled doc_id train once; repeated and clashing columns stay."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("score", F.lit("own"))
    docs = docs.unionByName(docs.where("doc_id < 30")).unionByName(docs.limit(1).withColumn("text", F.lit(None).cast("string")))
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    out = toxicity.scored(docs, toxicity.train(docs, labels))
    assert [r.given_score for r in out.limit(2).collect()] == ["own"] * 2
    want = collections.Counter((r.doc_id, r.text, round(s, 9)) for r, s in zip(docs.collect(), plain_scores(docs, labels)))
    assert collections.Counter((r.doc_id, r.text, round(r.score, 9)) for r in out.collect()) == want
    kept = toxicity.accepted(docs, labels)
    assert kept.columns == docs.columns and set(r.score for r in kept.collect()) == {"own"}
    assert toxicity.accepted(docs.limit(0), labels).count() == 0


def classes(texts):
    """For each text the place of the first one linked to it at 0.8 over five-word shingles with repeats; null texts alone."""
    bags, cls = {}, list(range(len(texts)))
    for i, t in enumerate(texts):
        if t is not None:
            w = words(t)
            bags[i] = collections.Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else collections.Counter([()])
    holds = collections.defaultdict(set)
    for i, b in bags.items():
        for x in b:
            holds[x].add(i)
    near = set()
    for i, b in bags.items():
        both = collections.Counter(j for x in b for j in holds[x] if j < i)
        near |= {(j, i) for j in both if (s := sum((b & bags[j]).values())) >= 0.8 * (b.total() + bags[j].total() - s)}
    while any(cls[i] != cls[j] for i, j in near):
        for i, j in near:
            cls[i] = cls[j] = min(cls[i], cls[j])
    return cls


def test_pipeline_equals_plain_stages(spark):
    """The toxicity and near-duplicate stages keep what plain Python keeps; columns named like the stages' own, nulls and repeats stay whole."""
    pipeline = pytest.importorskip("corpus_pipeline")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = {"score": F.lit("own"), "kept": F.lit(3), "row": F.lit("r"), "n_words": F.lit(None).cast("int"), "id": F.col("doc_id") % 2}
    docs = docs.withColumns(extra)
    docs = staged(docs.unionByName(docs.where("doc_id in (5, 6)")).unionByName(docs.where("doc_id = 7").withColumn("text", F.lit(None).cast("string"))).unionByName(docs.where("doc_id = 8").withColumn("doc_id", F.lit(None).cast("long"))), "given")
    stages = dict(pipeline.STAGES)
    empty = docs.limit(0)
    for name in ("quality", "toxicity", "near_dedup", "packing"):
        assert stages[name](spark, empty, SF).count() == 0
    count = lambda rows: collections.Counter(map(str, rows))
    clean = staged(stages["toxicity"](spark, docs, SF), "clean")
    assert clean.columns == docs.columns
    assert count(clean.collect()) == count(r for r, s in zip(docs.collect(), plain_scores(docs, labels)) if s < 0.5)
    rows = clean.collect()
    lone = classes([r.text for r in rows])
    got = stages["near_dedup"](spark, clean, SF)
    assert got.columns == docs.columns
    assert count(got.collect()) == count(r for i, r in enumerate(rows) if lone[i] == i)
    assert not count(stages["quality"](spark, docs, SF).collect()) - count(docs.collect())


def test_minhash_heavy_classes_and_hubs(spark):
    """A third of all rows under one text, and a vertex of many edges."""
    texts = [" ".join(f"w{k}" for k in range(60))] * 150 + [" ".join(f"x{i}y{k}" for k in range(30)) for i in range(100)]
    docs = spark.createDataFrame([(i, t, "a", 1) for i, t in enumerate(texts)], "doc_id long, text string, bands string, k1 int")
    got = minhash.near_duplicates(docs)
    assert got.where("class_id = 0").count() == 150 and got.where("kept").count() == 101
    assert minhash.near_duplicates(docs.limit(0)).count() == 0
    edges = [(0, i) for i in range(1, 300)] + [(i, 1000) for i in range(400, 500)] + [(299, 300), (2000, 2000)]
    comp = {r.id: r.comp for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert comp == {**{i: 0 for i in range(301)}, **{i: 400 for i in [*range(400, 500), 1000]}}


def test_sharding_equals_plain(spark):
    """Places by fractional rank, with null ids, one doc_id under many texts, and more copies of a row than a run holds."""
    rows = [(None, "same", "s")] * 1300 + [(7, f"t{i}", "s") for i in range(100)] + [(i, f"u{i % 5}", None if i % 3 else "z") for i in range(200)] + [(1, None, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    known = []
    for d, t, s in rows:
        b = (t or "").encode()
        m = md5(f"{sharding.SEED}:{'null' if d is None else d}:{len(b) + 8}:{zlib.crc32(b)}".encode()).hexdigest()
        known.append((s, m, d, len(b) + 8, zlib.crc32(b)))
    low = lambda x: (x is not None, x if x is not None else 0)
    known.sort(key=lambda r: (r[0] or "", r[1], low(r[2]), r[4], r[3]))
    of, seen, placed = collections.Counter(r[0] for r in known), collections.Counter(), []
    for r in known:
        seen[r[0]] += 1
        placed.append(((2 * seen[r[0]] - 1) / (2 * of[r[0]]), r[0] is not None, r[0] or "", r[1], r))
    placed.sort(key=lambda x: x[:4])
    n, want, at = len(placed), collections.Counter(), collections.Counter()
    for pos, (*_, r) in enumerate(placed):
        k = pos * 24 // n
        want[r[2], r[3], r[4], "rows", k, at[k], None] += 1
        at[k] += 1
    got = sharding.interleave(docs.withColumn("m", F.lit(1)).withColumn("c", F.lit("x")), bucket_rows=50)
    assert collections.Counter(map(tuple, got.collect())) == want
    assert sharding.interleave(docs.limit(0)).count() == 0


def test_chat_equals_plain(spark):
    """Positions and starts, with equal rows beyond a run, many rows of one turn, null turns, conversations and roles, clashing columns."""
    rows = [(1, 3, "ann", "again")] * 2500 + [(1, 3, "bob", f"b{i}") for i in range(300)] + [(1, None, "bob", None)] * 3 + [(1, 90, None, "x<|y"), (1, -70, "system", "s"), (None, 2, "cy", "")] + [(5, 1, None, "no one")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, perspective string, first int")
    want = collections.Counter()
    for conv in (1, None, 5):
        mine = [r for r in rows if r[0] == conv]
        for who in {r[2] for r in mine} - {None, "system"}:
            said = []
            for _, turn, role, text in mine:
                body = (text or "").replace("<|", "<||")
                kind = "assistant" if role == who else "system" if role == "system" else "user"
                head = f"<|{kind}{f' name={role}' if kind == 'user' and role is not None else ''}|>\n"
                said.append(((turn is not None, turn or 0), md5(f"{role or ''}:{body}".encode()).hexdigest(), head + body + "<|end|>\n", turn, kind, role if kind == "user" else None, len(head)))
            start = 0
            for k, (_, _, segment, turn, kind, name, head) in enumerate(sorted(said, key=lambda x: x[:3])):
                on = kind == "assistant"
                want[conv, who, turn, k, kind, name, segment, on, start, start + head if on else None, start + len(segment) - 1 if on else None] += 1
                start += len(segment)
    assert collections.Counter(map(tuple, chat.rotate(docs).collect())) == want
    assert chat.rotate(docs.limit(0)).count() == 0


def test_quality_joined_cutoffs(spark):
    """The verdicts are the same whether the cutoffs are broadcast or dealt out; a null language has its own."""
    texts = [" ".join(f"w{(i * 7 + k * 13) % 4999}" + "!" * (i % 10 == 0) for k in range(60)) for i in range(2600)]
    docs = spark.createDataFrame([(i, t, None if i % 2 else "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 10 != 0), 0) for i in range(2600)], "doc_id long, quality int, toxic int")
    counts = staged(quality.measured(docs).drop("text"), "counts")
    cut = quality.thresholds(counts, labels)
    a, b = ({r.doc_id for r in quality.judged(counts, cut, n).where("kept").collect()} for n in (200_000, 0))
    assert a == b == {i for i in range(2600) if i % 10}
    assert quality.assess(docs.limit(0), labels).count() == 0


def test_licenses_long_template(spark):
    """A template of 200 words is met with a few words changed, and not by half of it."""
    w = [f"term{k}" for k in range(200)]
    near = [*w[:50], "other", *w[51:120], *w[121:]]
    rows = [(1, "start " + " ".join(near) + " end"), (2, " ".join(w[:100])), (3, None), (1, "x")]
    got = [(r.doc_id, r.n_words, r.labels) for r in licenses.scan(spark.createDataFrame([(*r, "b") for r in rows], "doc_id long, text string, label string"), templates=[(" ".join(w), "long")]).collect()]
    assert sorted(got) == [(1, 1, ""), (1, 201, "long"), (2, 100, ""), (3, 0, "")]
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_embeddings_empty_and_repeated(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (None, [0.0, 1.0])]
    vectors = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, rep string")
    assert sorted((str(r.vec_id), r.n_links) for r in embeddings.near_duplicates(vectors).collect()) == [("1", 1), ("1", 1), ("2", 1), ("None", 1)]
    assert embeddings.near_duplicates(vectors.limit(0)).count() == 0


def test_texts_of_millions_of_characters(spark):
    from tokenizers import Tokenizer

    text = "".join(f"alpha{k % 977} beta gamma.\n" for k in range(80_000))
    docs = spark.createDataFrame([(1, text, "en"), (2, text + "x", "en"), (3, "short", "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    n = len(words(text))
    assert [r.n_words for r in licenses.scan(docs).orderBy("doc_id").collect()] == [n, n + 1, 1]
    assert [r.n_words for r in quality.assess(docs, labels).orderBy("doc_id").collect()] == [n, n + 1, 1]
    assert [r.class_id for r in minhash.near_duplicates(docs).orderBy("doc_id").collect()] == [1, 1, 3]
    assert toxicity.scored(docs, toxicity.train(docs, labels)).count() == 3
    for name, run in (("word_bpe_49k.json", lambda p: bpe.encode_decode(docs, p)), ("byte_bpe_50k.json", lambda p: packing.pack(docs, p))):
        path = public_tokenizers.path(name)
        ids = Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
        got = run(path).where("doc_id = 1").collect()
        assert (got[0].n_tokens == len(ids)) if "n_tokens" in got[0] else (sum(r.length for r in got) == len(ids) + 1 == got[0].doc_tokens)


def test_operators_leave_the_session_as_it_is(spark):
    docs = spark.createDataFrame([(i, f"plain words number {i} here") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    vectors = spark.createDataFrame([(i, [float(i), 1.0, 2.0]) for i in range(9)], "vec_id long, embedding array<float>")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    toxicity.accepted(docs, labels).collect()
    embeddings.near_duplicates(vectors).collect()
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_scores_do_not_depend_on_slices(spark, monkeypatch):
    docs = spark.createDataFrame([(i, None if i % 7 == 0 else f"w{i % 5} word{i} " * (i % 4)) for i in range(50)], "doc_id long, text string").coalesce(1)
    weights = np.arange(1 << toxicity.BITS, dtype=np.int64), np.sin(np.arange(1 << toxicity.BITS))
    whole = sorted(map(tuple, toxicity.scored(docs, weights).select("doc_id", "score").collect()))
    monkeypatch.setattr(toxicity, "SOME", 3)
    cut = sorted(map(tuple, toxicity.scored(docs, weights).select("doc_id", "score").collect()))
    assert [d for d, _ in cut] == [d for d, _ in whole] and np.allclose([s for _, s in cut], [s for _, s in whole], atol=1e-12)


def test_quality_sequence(spark):
    """The admitted cutoffs equal a plain-Python fixed sequence with exact binomial tails; strata of under a thousand labels, one of them null, get cutoffs."""
    import random

    rng = random.Random(3)
    rows, labels = [], []
    for i in range(2400):
        lang, good = ("aa", "bb", "cc", None)[i % 4], rng.random() < 0.8
        marks = rng.choice([0, 3, 9, 40]) if good and lang != "cc" else rng.choice([0, 40, 120, 300, 700])
        caps = rng.randrange(0, 60) if good else rng.randrange(20, 300)
        rows.append((i, lang, 100, 1000, marks, 0, 0, 10, rng.choice([0, 0, 0, 60]), 0, caps, False))
        labels.append((i, int(good), 0))
    counts = spark.createDataFrame(rows, "doc_id long, lang string, " + ", ".join(f"{c} long" for c in quality.COUNTS) + ", base_failed boolean")
    got = {tuple(r) for r in quality.thresholds(counts, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}

    rates = [{m: 1000 * r[2 + quality.COUNTS.index(a)] // max(r[2 + quality.COUNTS.index(b)], 1) for m, (a, b) in quality.MEASURES.items()} for r in rows]
    want = set()
    for lang in ("aa", "bb", "cc", None):
        mine = [(labels[i][1], rates[i], md5(str(i).encode()).hexdigest() < "8") for i in range(len(rows)) if rows[i][1] == lang]
        learn, test = [(q, x) for q, x, l in mine if l], [x for q, x, l in mine if not l and q]
        n = sum(q for q, _ in learn)
        chain = []
        for m in quality.MEASURES:
            tried = [(sum(x[m] > g for q, x in learn if not q), sum(x[m] > g for q, x in learn if q), g) for g in quality.GRID]
            tried = [(b - k, g, k, b) for b, k, g in tried if k <= n * (quality.ALPHA / len(quality.MEASURES)) and b > k]
            if tried:
                _, g, k, b = max(tried)
                chain.append((k, -b, m, g))
        chain.sort()
        first = [(q, next((j for j, (_, _, m, g) in enumerate(chain) if x[m] > g), None)) for q, x in learn]
        chain = [c for j, c in enumerate(chain) if sum(1 - 2 * q for q, f in first if f == j) > 0]
        for j in range(len(chain)):
            k = sum(any(x[m] > g for _, _, m, g in chain[: j + 1]) for x in test)
            p = sum(math.comb(len(test), i) * quality.ALPHA**i * (1 - quality.ALPHA) ** (len(test) - i) for i in range(k + 1))
            if p > quality.DELTA / 4:
                break
            want.add((lang, chain[j][2], chain[j][3]))
    assert got == want
    assert {x[0] for x in want} >= {"aa", "bb", None}
