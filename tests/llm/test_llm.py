"""Each operator against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and extra columns."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from folio.llm import bpe, chat, embeddings, html, licenses, minhash, packing, quality, sharding, toxicity
from folio.llm.common import components, staged

public_tokenizers = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, score string, row string, kept string"
HARD = [None, "", " ", "one", "All rights reserved. cc by", "Σίσυφος ΣΑΣ İstanbul é x\x1cq\x85w's 'LL", "a<|endoftext|>B", "日本語 🙂 ½", "word " * 3000, "\n\n|", "".join(map(chr, range(0x250)))]


def table(spark, texts, twice=True):
    rows = [(i, t, "en", "s" if i % 3 else None, "x", "y", "z") for i, t in enumerate(texts)]
    rows += [(None, "null id", None, None, None, None, None)]
    return spark.createDataFrame(rows + rows[: 3 if twice else 0], SCHEMA)


def test_bpe(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    docs = table(spark, HARD)
    got = collections.Counter(tuple(r) for r in bpe.encode_decode(docs, path, most_words=50).collect())
    want = collections.Counter()
    for r in docs.collect():
        ids = tok.encode(r.text or "", add_special_tokens=False).ids
        want[r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert got == want
    assert bpe.encode_decode(docs.limit(0), path).count() == 0


def test_packing(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    docs = table(spark, HARD, twice=False)
    got = packing.pack(docs, path, group_rows=4).collect()
    by, seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
        seq[r.sequence_id].append(r)
    for d in docs.collect():
        ids, at = [*tok.encode(d.text or "", add_special_tokens=False).ids, 1], 0
        for r in sorted(by[d.doc_id], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for rows in seq.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert packing.pack(docs.limit(0), path).count() == 0


def test_first_fit(rng=np.random.default_rng(1)):
    sizes, bins = sorted(rng.integers(1, 100, 300).tolist(), reverse=True), []
    tree = packing.Tree(len(sizes), 100)
    for n in sizes:
        k = next((i for i, b in enumerate(bins) if b + n <= 100), len(bins))
        bins += [0] * (k == len(bins))
        assert tree.place(n) == (k, bins[k])
        bins[k] += n


def test_sharding(spark):
    docs = table(spark, [*HARD, *(f"t{i % 7}" for i in range(200))])
    got = sharding.interleave(docs, bucket_rows=20).toPandas()
    sizes = got.groupby("shard").size()
    assert len(got) == docs.count() and sizes.max() - sizes.min() <= 1
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    assert set(got[got.doc_id == 0]["size"]) == {8}


def test_quality_counts(spark):
    docs = table(spark, HARD)
    labels = spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int")
    for r, d in zip(sorted(quality.assess(docs, labels).collect(), key=lambda r: str(r.doc_id)), sorted(docs.collect(), key=lambda r: str(r.doc_id))):
        w = re.findall(r"[^\x20\x09-\x0D]+", d.text or "")
        tri = collections.Counter(zip(w, w[1:], w[2:]))
        inside = {i + k for i in range(len(w) - 2) if tri[w[i], w[i + 1], w[i + 2]] > 1 for k in range(3)}
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(w), sum(map(len, w)), len(inside))
        assert r.base_failed == (len(w) < 50 or 100 * len(inside) > 50 * len(w)) and r.kept == (not r.base_failed)


def test_quality_thresholds(spark):
    rng, texts = np.random.default_rng(0), []
    for i in range(3000):
        texts.append(" ".join(f"w{x}" + "!" * (i % 10 == 0) for x in rng.integers(0, 5000, 60)))
    labels = spark.createDataFrame([(i, int(i % 10 != 0), 0) for i in range(3000)], "doc_id long, quality int, toxic int")
    docs = table(spark, texts, twice=False)
    kept = {r.doc_id for r in quality.assess(docs, labels).where("kept").collect()}
    assert kept == {i for i in range(3000) if i % 10}
    out = quality.accepted(docs, labels)
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == kept


def test_toxicity(spark):
    rng = np.random.default_rng(0)
    bad = [i % 5 == 0 for i in range(900)]
    texts = [" ".join([f"w{x}" for x in rng.integers(0, 300, 30)] + ["vile", "slur"] * b) for b in bad]
    docs = table(spark, texts, twice=False)
    labels = spark.createDataFrame([(i, 1, int(b)) for i, b in enumerate(bad)], "doc_id long, quality int, toxic int")
    out = toxicity.scored(docs, toxicity.train(docs, labels))
    assert out.columns[:4] == docs.columns[:4]
    wrong = [r.doc_id for r in out.where("doc_id is not null").collect() if (r.score >= 0.5) != bad[r.doc_id]]
    assert len(wrong) < 10
    hard = table(spark, HARD)
    assert toxicity.scored(hard, toxicity.train(docs.limit(0), labels)).where("score = 0").count() == hard.count()


def test_licenses(spark):
    got = {r.doc_id: r for r in licenses.scan(table(spark, [*HARD, "x Released under the MIT License.", "general public license general public license"], twice=False)).collect()}
    assert (got[4].n_words, got[4].n_base, got[4].first_word, got[4].last_word, got[4].base_labels) == (5, 2, 0, 3, "cc-by,reserved")
    assert got[0].n_words == 0 and got[0].labels == "" and got[0].first_word is None and got[0].score == 0
    assert got[11].labels == "mit" and got[11].n_base == 0 and got[12].n_base == 2 and got[12].last_word == 3


def test_chat(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "ann", "hi <|x"), (1, 2, "bob", None), (1, 2, "bob", None), (2, 0, None, "?"), (None, None, "ann", "")]
    got = chat.rotate(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).toPandas()
    for (conv, who), g in got.groupby(["conv_id", "perspective"], dropna=False):
        text = "".join(g.sort_values("position").segment)
        for r in g.itertuples():
            assert text[r.start :].startswith(r.segment)
            assert r.trained == (r.speaker == "assistant")
            if r.trained:
                assert text[int(r.mask_start) : int(r.mask_end)].endswith("<|end|>")
    assert len(got) == 9 and "<||x" in "".join(got.segment)


def test_minhash_unbiased():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 9, 200), rng.integers(0, 9, 200)
    h = minhash.mix(np.arange(200).astype(np.uint64))
    el = [(h[x > 0], x[x > 0]) for x in (a, b)]
    sig = minhash.signatures(np.concatenate([e[0] for e in el]), np.repeat([0, 1], [len(e[0]) for e in el]), np.concatenate([e[1] for e in el]), 2, 6000)
    assert abs((sig[0] == sig[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.03


def test_minhash(spark):
    rng = np.random.default_rng(3)
    base = [[f"w{x}" for x in rng.integers(0, 9000, 200)] for _ in range(4)]
    texts = [*HARD[:8]]
    for b in base:
        for _ in range(25):
            w = list(b)
            for k in rng.integers(0, 200, int(rng.integers(0, 7))):
                w[k] = "changed"
            texts.append(" ".join(w))
    docs = table(spark, texts, twice=False)
    bags = {}
    for r in docs.where("text is not null and doc_id is not null").collect():
        w = re.findall(licenses.WORD, "".join(c.lower() if c.isascii() else c for c in r.text))
        bags[r.doc_id] = collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))
    cls = {r.doc_id: r.doc_id for r in docs.collect()}
    for _ in bags:
        for i in bags:
            for j in bags:
                both, all_ = sum((bags[i] & bags[j]).values()), sum((bags[i] | bags[j]).values())
                if both >= 0.8 * all_:
                    cls[i] = cls[j] = min(cls[i], cls[j])
        if all(cls[cls[i]] == cls[i] for i in bags):
            break
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(docs, tile=16).collect()}
    assert got == cls
    kept = minhash.survivors(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(cls.values()))


def test_embeddings(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(12, 16))
    x = [base[i % 12] + rng.normal(size=16) * (0.05 + 0.25 * (i % 3)) for i in range(150)]
    rows = [(i, [float(v) for v in e], "l") for i, e in enumerate(x)]
    rows += [(200, rows[0][1], None), (201, None, None), (202, [0.0] * 16, None), (203, [float("nan")] * 16, None), (204, [None] * 16, None), (205, [], None)]
    got = {r.vec_id: r for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string"), part=20).collect()}
    ids = [*range(150), 200]
    u = np.array([*x, x[0]], np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    comp = np.array(ids)
    for _ in ids:
        comp = np.where(near, comp[None, :], 10**9).min(1)
    for k, i in enumerate(ids):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (near[k].sum() - 1, comp[k], comp[k] == i)
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i in range(201, 206))


def test_minhash_follows_low_estimates():
    """Two texts of similarity 0.8 whose signatures agree in 80 of 130 slots only are verified and linked."""
    import pyarrow as pa

    a, b = np.arange(130, dtype="<u2"), np.arange(130, dtype="<u2")
    b[80:] += 1000
    t = pa.table({"left": [True, True], "id": [1, 2], "comp": [1, 2], "size": [90, 90], "sig": [a.tobytes(), b.tobytes()], "bag": pa.array([list(range(90)), list(range(10, 100))], pa.list_(pa.int64()))})
    got = minhash._links(minhash.SIMILARITY - minhash.MARGIN, minhash.SIMILARITY)([pa.scalar(True)], t)
    assert got.to_pylist() == [{"a": 1, "b": 2}]


def test_minhash_texts_of_one_doc_id(spark):
    """Different texts under one doc_id keep their own links and classes."""
    a, b, c = ([f"{x}{k}" for k in range(100)] for x in "abc")
    near = lambda w: [*w[:-1], "changed"]
    docs = [(5, a), (5, b), (0, near(b)), (7, near(a)), (6, c), (6, a), (8, near(c)), (6, c)]
    out = minhash.near_duplicates(spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string").repartition(3))
    assert sorted((r.doc_id, r.copies_of, r.class_id, r.kept) for r in out.collect()) == sorted([(5, 5, 5, True), (5, 5, 0, False), (0, 0, 0, True), (7, 7, 5, False), (6, 6, 6, True), (6, 5, 5, False), (8, 8, 6, False), (6, 6, 6, True)])


def test_toxicity_trains_on_ten_thousand_rows(spark, monkeypatch):
    """All labelled rows outside the held-out fold are trained on where they are at most 10,000."""
    import pyarrow as pa

    monkeypatch.setattr(toxicity, "_train", lambda bits, epochs: lambda key, t: pa.table({"slot": pa.array([0], pa.int64()), "w": [float(t.num_rows)]}))
    docs = spark.range(11_500).selectExpr("id AS doc_id", "'a b' AS text", "0 AS toxic")
    outside = docs.where(~toxicity.held_out()).count()
    assert 8_000 < outside <= 10_000
    assert toxicity.train(docs, docs)[1].tolist() == [outside]


def test_html(spark):
    page = "<html><head><title>t</title><script>x('</p>')</script></head><body><nav>menu</nav><div class='ad'>buy</div><article><h1>A &amp; B</h1><p>one <b>two</b><p>three<div class=comments>no</div></article><footer>f</footer>"
    plain = "<body><div class=top>Same</div><div class=x><p>text {}</p></div></body>"
    rows = [(1, "http://a.org/1", page, 0), (2, None, None, 0), (3, "http://a.org/2", "", 0), *((k, f"http://b.org/{k}", plain.format(k), 0) for k in range(10, 13)), (20, "http://c.org", "cut <p>off <a hre", 0)]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string, block int")).collect()}
    assert got[1] == "A & B\none two\nthree"
    assert got[2] == got[3] == ""
    assert got[11] == "text 11"
    assert got[20] == "cut\noff"


def extracted(spark, pages):
    """Texts of pages given as (url, html), in order."""
    rows = [(k, u, h) for k, (u, h) in enumerate(pages)]
    return [r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("page_id").collect()]


def test_html_alignment_decides_where_there_are_articles(spark):
    """Text outside teasers stays, template inside an article goes; copies of an article and hosts of one page are kept whole."""
    teasers = "<body><div class=top>Same</div><div class=text><p>body {0} of some length</p></div><div class=cards><article class=card>card {0}</article></div></body>"
    fixed = "<body><div class=top>Same</div><article><h1>title {0}</h1><p>text {0}</p><div class=policy>Our policy</div></article></body>"
    copy = "<body><div class=top>Same</div><article><h1>one</h1><table><tr><td>two</td></tr></table></article></body>"
    other = "<body><div class=top>Same</div><article><h1>title {0}</h1><p>text {0}</p></article></body>"
    pages = [("http://a.org", teasers.format(k)) for k in range(3)] + [("http://b.org", fixed.format(k)) for k in range(3)]
    pages += [("http://c.org", copy)] * 3 + [("http://c.org", other.format(k)) for k in range(4)] + [("http://d.org", fixed.format(9))]
    got = extracted(spark, pages)
    assert got[:3] == [f"body {k} of some length\ncard {k}" for k in range(3)]
    assert got[3:6] == [f"title {k}\ntext {k}" for k in range(3)]
    assert got[6:9] == ["one\ntwo"] * 3
    assert got[9:13] == [f"title {k}\ntext {k}" for k in range(4)]
    assert got[13] == "title 9\ntext 9\nOur policy"


def test_html_words_in_attributes_are_evidence_only(spark):
    """A word in class or id drops neither what holds the article or most of the text nor varying text inside it."""
    page = "<body><div class='ad'>buy {0}</div><div class='{1}'><article><h2 id=search>search {0}</h2><p>long text {0}</p><section id=related>related {0}</section><div class=share>Share</div></article></div></body>"
    plain = "<body><div class=promo>offer {0}</div><div class='layout-sidebar-right'><div><p>long text {0} without an article</p></div></div></body>"
    pages = [("http://a.org", page.format(k, "has-sidebar")) for k in range(3)] + [("http://b.org", plain.format(k)) for k in range(3)] + [("http://c.org", page.format(9, "layout-sidebar-right"))]
    got = extracted(spark, pages)
    assert got[:3] == [f"search {k}\nlong text {k}\nrelated {k}" for k in range(3)]
    assert got[3:6] == [f"long text {k} without an article" for k in range(3)]
    assert got[6] == "search 9\nlong text 9\nrelated 9"


def test_html_aligns_large_and_deep_trees(spark):
    """Trees of thousands of nodes, or a thousand deep, follow the rule of small ones."""
    long = lambda k: "<body><div class=top>Same</div><div class=text>" + "".join(f"<h2>h {k} {i}</h2><p>p {k} {i}</p>" for i in range(1100 + k)) + "</div><div class=end>Same too</div></body>"
    deep = lambda k: "<body><div class=top>Same</div>" + "<div>" * (1200 + k) + f"text {k}" + "</div>" * (1200 + k) + "</body>"
    got = extracted(spark, [("http://a.org", long(k)) for k in range(3)] + [("http://b.org", deep(k)) for k in range(3)])
    assert got[:3] == ["\n".join(f"h {k} {i}\np {k} {i}" for i in range(1100 + k)) for k in range(3)]
    assert got[3:] == [f"text {k}" for k in range(3)]


def test_html_match_is_largest():
    """The alignment is as large as plain recursion finds it, keeps order and pairs children of paired parents only."""
    rng = np.random.default_rng(5)

    def tree(n):
        return [(-1, "", 0)] + [(int(rng.integers(max(0, k - 5), k)), "abc"[rng.integers(3)], 0) for k in range(1, n)]

    def plain(a, b, i=0, j=0):
        if a[i][1] != b[j][1]:
            return 0
        x, y = ([k for k, v in enumerate(t) if v[0] == p] for t, p in ((a, i), (b, j)))
        m = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for p, c in enumerate(x):
            for q, d in enumerate(y):
                m[p + 1][q + 1] = max(m[p][q + 1], m[p + 1][q], m[p][q] + plain(a, b, c, d))
        return 1 + m[-1][-1]

    for _ in range(100):
        a, b = tree(rng.integers(1, 25)), tree(rng.integers(1, 25))
        to = html.match(a, b)
        assert len(to) == plain(a, b)
        assert all(a[p][1] == b[q][1] and (q == 0 or to[b[q][0]] == a[p][0]) for q, p in to.items())
        for parent in to:
            partners = [to[q] for q in sorted(to) if b[q][0] == parent]
            assert partners == sorted(set(partners))


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 99), (99, 98)]
    got = {r.id: r.comp for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 98: 98, 99: 98, 100: 98}


def test_pipeline(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and out.count() > 50


def test_pipeline_stages_take_effect(spark):
    """Each stage keeps whole rows of its predecessor; the packed pieces cover exactly the last documents, without overlap."""
    pipeline = pytest.importorskip("corpus_pipeline")
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, {r.doc_id: r for r in docs.collect()}
    for name, stage in pipeline.STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"test-{name}")
        rows = docs.collect()
        after = {r.doc_id: r for r in rows}
        assert docs.columns == columns and len(after) == len(rows), name
        assert after and all(before[k] == r for k, r in after.items()), name
        before = after
    pieces = pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    ids, room = {}, {}
    for r in sorted(pieces, key=lambda r: (r.doc_id, r.start)):
        assert ids.get(r.doc_id, 0) == r.start
        ids[r.doc_id] = r.start + r.length
    assert set(ids) == set(before) and all(ids[r.doc_id] == r.doc_tokens for r in pieces)
    for r in sorted(pieces, key=lambda r: (r.sequence_id, r.offset)):
        assert room.get(r.sequence_id, 0) == r.offset
        room[r.sequence_id] = r.offset + r.length
    assert max(room.values()) <= 2048


def test_quality_stage_keeps_what_the_verdicts_keep(spark):
    """accepted() against assess() on all documents, with nulls, repeated rows and columns that clash with the measures."""
    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", F.lit("x").alias("n_words"), F.lit(1).alias("kept"), F.lit("r").alias("rate"))
    docs = docs.unionByName(docs.where("doc_id < 20")).unionByName(docs.where("doc_id = 3").withColumn("text", F.lit(None).cast("string")))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    verdicts = sorted(r.doc_id for r in quality.assess(docs, labels).where("kept").collect())
    out = quality.accepted(docs, labels)
    assert out.columns == docs.columns
    rows = out.collect()
    assert sorted(r.doc_id for r in rows) == verdicts
    assert 0 < len(rows) < docs.count()
    assert not {tuple(r) for r in rows} - {tuple(r) for r in docs.collect()}
    assert quality.accepted(docs.limit(0), labels).count() == 0
