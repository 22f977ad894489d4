"""op2: whole license texts as templates, and templates beyond the size that is broadcast."""

import random

from folio.llm import licenses


def test_whole_terms_and_shuffled_templates(spark):
    rng = random.Random(2)
    filler = lambda n: " ".join(rng.choice("the software is provided and in of with any rain sun".split()) for _ in range(n))
    texts = [f"{filler(40)}. {t.upper() if k % 2 else t} {filler(40)}" for k, (t, _) in enumerate(licenses.TERMS)]
    w = licenses.TERMS[0][0].split()
    texts += [" ".join(w[: len(w) // 2]), " ".join(x for i, x in enumerate(w) if i % 25), filler(3000), "All rights reserved", "", None, texts[0], "word"]
    docs = spark.createDataFrame([(i if i != 3 else None, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, hash string").repartition(3)
    as_rows = lambda **more: sorted(str(tuple(r)) for r in licenses.scan(docs, **more).collect())
    got = as_rows()
    labels = {r.doc_id: set(r.labels.split(",")) - {""} for r in licenses.scan(docs).collect()}
    for k, (_, label) in enumerate(licenses.TERMS):
        assert label in labels[k if k != 3 else None]
    assert "mit" in labels[5] and not labels[6] and labels[7] == {"reserved"}
    assert len(got) == len(texts) and as_rows(most_bytes=0) == got
    assert licenses.scan(docs.limit(0), most_bytes=0).count() == 0
