"""Masking at match positions: candidates, tests, cues, offsets, and texts of any shape."""

import random

from pyspark.sql import functions as F

from folio.operators import masking

SCHEMA = "doc_id long, text string"


def masked(spark, texts, mode="full"):
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    return [r.masked for r in masking.mask(docs, mode).orderBy("doc_id").collect()]


def test_cards_runs_and_guards(spark):
    texts = ["pay 4111 1111 1111 1111, 4111-1111-1111-1111;3782 822463 10005.", "4111 1111 1111 1112", "9" * 25 + " " + "8" * 12 + "," + "7" * 11, "99345-555-12345678", "345-555-1234 345-555-1234,(415) 555-0199 +1 415.555.0199", "1 (415) 555-01999", "12-345-555-1234"]
    assert masked(spark, texts) == ["pay [CARD], [CARD];[CARD].", "4111 1111 1111 1112", "[NUMBER] [NUMBER]," + "7" * 11, "99345-555-12345678", "[PHONE] [PHONE],[PHONE] [PHONE]", "1 (415) 555-01999", "12-[PHONE]"]
    assert masked(spark, texts[:1] + texts[2:3], "partial") == ["pay ****1111, ****1111;****0005.", "****9999 ****8888," + "7" * 11]


def test_cues(spark):
    texts = ["SSN: 123456789", "no cue 123456789", "ssn 000456789", "aba 021000021", "aba 021000022", "my Account no. is 1234567 and 7654321", "acct 12345", "ssn or rather account 123456789", "kaba 021000021", "ssn" + " " * 40 + "123456789", "routing 021000021, ssn 123456789"]
    assert masked(spark, texts) == ["SSN: [SSN]", texts[1], texts[2], "aba [ROUTING]", texts[4], "my Account no. is [ACCOUNT] and 7654321", texts[6], "ssn or rather account [ACCOUNT]", texts[8], texts[9], "routing [ROUTING], ssn [SSN]"]


def test_mails_and_numbers_meet(spark):
    texts = ["4111111111111111@x.org123456789012", "a@b.c @ 1234", "é a.b@c-d.org, 🙂123456789012🙂", "", None, "\n123-45-6789\n"]
    assert masked(spark, texts) == ["[EMAIL][NUMBER]", "a@b.c @ 1234", "é [EMAIL], 🙂[NUMBER]🙂", "", "", "\n[SSN]\n"]
    assert masked(spark, texts[:3], "partial") == ["****@x.org****9012", "a@b.c @ 1234", "é ****@c-d.org, 🙂****9012🙂"]


def test_segments_give_the_text_again(spark):
    rng = random.Random(5)
    bits = ["4111 1111 1111 1111", "123-45-6789", "(415) 555-0199", "a@b.org", "ssn ", "account", "123456789", "1" * 30, " ", "-", ".", "é", "\n", "x1", "(", "+1 "]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(30))) for _ in range(300)] + ["no digits " * 5000, "12 " * 20000]
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    back = docs.select("text", F.array_join(F.transform(masking.segments(F.col("text")), lambda s: s["value"]), "").alias("again"))
    assert back.where("text <> again").count() == 0
    for r in masking.findings(docs).collect():
        assert texts[r.doc_id][r.start : r.start + r.length] == r.value
    counts = masking.mask(docs).agg(*[F.sum(c).alias(c) for c in masking.COUNTS]).first().asDict()
    assert {f"n_{r.label.lower()}": r.n for r in masking.findings(docs).groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()} == {k: v for k, v in counts.items() if v}


def test_findings_nulls_repeats_and_clashes(spark):
    rows = [(None, "x a@b.org", "u"), (1, "a@b.org a@b.org", "u"), (1, "a@b.org a@b.org", "u"), (2, None, "u"), (3, "", "u")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label string")
    got = sorted((str(r.doc_id), r.seq, r.label, r.start) for r in masking.findings(docs).collect())
    assert got == [("1", 0, "EMAIL", 0), ("1", 0, "EMAIL", 0), ("1", 1, "EMAIL", 8), ("1", 1, "EMAIL", 8), ("None", 0, "EMAIL", 2)]
    assert masking.findings(docs.limit(0)).count() == 0
    assert masking.mask(docs.withColumn("_segments", F.lit(1)).withColumn("n_card", F.lit(2))).where("given_n_card = 2 and _segments = 1").count() == 5
