"""op5: copies of a text are one trial of the holdout, in one half."""

from hashlib import md5

from folio.llm import quality
from folio.llm.common import staged


def test_copies_are_one_trial(spark):
    """Cutoffs are those of the different texts, however often each is copied; copies of one label a text don't buy significance."""
    texts = [" ".join(f"w{(i * 7 + k * 13) % 4999}" + "!" * (i % 10 == 0) for k in range(60)) for i in range(2600)]
    one = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    labels = [(i, int(i % 10 != 0), 0) for i in range(2600)]
    more = [(10_000 + i, texts[i % 2600], "en") for i in range(2600)]
    many = one.unionByName(spark.createDataFrame(more, "doc_id long, text string, lang string"))
    said = spark.createDataFrame(labels + [(10_000 + i, int(i % 10 != 0), 0) for i in range(2600)], "doc_id long, quality int, toxic int")
    cut = lambda docs, known: sorted(map(tuple, quality.thresholds(staged(quality.measured(docs).drop("text"), "counts"), known).collect()))
    plain = cut(one, said)
    assert plain and plain == cut(many, said)
    # forty texts copied fifty times are forty trials: too few for a cutoff
    few = spark.createDataFrame([(j * 100 + i, texts[i], "en") for i in range(40) for j in range(50)], "doc_id long, text string, lang string")
    known = spark.createDataFrame([(j * 100 + i, int(i % 10 != 0), 0) for i in range(40) for j in range(50)], "doc_id long, quality int, toxic int")
    assert cut(few, known) == []


def test_the_lowest_label_of_a_text_counts(spark):
    text = " ".join(f"w{k}" for k in range(60))
    docs = spark.createDataFrame([(1, text, "en"), (2, text, "en"), (2, text, "en"), (3, text, None)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.assess(docs, labels).where("kept").count() == 4
    assert quality.measured(docs).first().text_md5 == md5(text.encode()).hexdigest()
