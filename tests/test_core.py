"""The library's own queries against their SQL, and operators on small fixtures."""

import duckdb
import pytest

from pyspark.sql import functions as F

from folio.operators import dedup, entities, masking, numbers, packing
from folio.operators.skew import heavy_keys, spread_join
from folio.plans.registry import ORACLES, QUERIES
from folio.sources.tables import text_files

SF = "/root/testdata/sf0.001"


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return [columns[k] for k in order], sorted(str(tuple(r[k] for k in order)) for r in values)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "orders", "benchmark", "lineitem", "events", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = QUERIES[name](spark, SF), con.sql(ORACLES[name])
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


def test_masks_count_and_keep(spark):
    docs = spark.createDataFrame([(1, "a.b@c.org 123-45-6789 (415) 555-0199 4111111111111111"), (2, None), (3, "")], "doc_id long, text string")
    full = {r.doc_id: r for r in masking.mask(docs).collect()}
    assert full[1].masked == "[EMAIL] [SSN] [PHONE] [NUMBER]"
    assert (full[1].n_email, full[1].n_ssn, full[1].n_phone, full[1].n_number) == (1, 1, 1, 1)
    assert full[2].masked == "" and full[3].n_email == 0
    assert masking.mask(docs, "partial").where("doc_id = 1").first().masked == "****@c.org ****6789 ****0199 ****1111"
    assert [r.valid for r in numbers.luhn_numbers(docs).collect()] == [True]


def test_copies_packing_survival(spark):
    docs = spark.createDataFrame([(1, "aa"), (2, "bb"), (3, "aa"), (4, None), (5, "x" * 50)], "doc_id long, text string")
    assert {r.doc_id: r.first_doc_id for r in dedup.exact_copies(docs).collect()} == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5}
    assert {r.doc_id: r.part for r in packing.pack_in_order(docs, 4).collect()} == {1: 0, 2: 0, 3: 1, 4: 1, 5: 2}
    pairs = spark.createDataFrame([(1, "12 and 3,400 and 12", "12 and 3400"), (2, None, None)], "doc_id long, before string, after string")
    assert [(r.total, r.preserved, r.missing) for r in entities.survival(pairs).orderBy("doc_id").collect()] == [(2, 1, 1), (0, 0, 0)]


def test_text_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("é".encode())
    (tmp_path / "b.md").write_bytes(b"\xe9")
    (tmp_path / "c.bin").write_bytes(b"no")
    assert sorted(r.text for r in text_files(spark, str(tmp_path)).collect()) == ["é", "é"]


def test_ssn_guards_and_validity(spark):
    texts = ["9123-45-67890", "123-45-6789 123-45-6789,123 45 6789", "000-45-6789 666-45-6789 900-45-6789 123-00-6789 123-45-0000", "x123-45-6789"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in masking.mask(docs).collect()}
    assert [got[k].n_ssn for k in range(4)] == [0, 3, 0, 1]
    assert got[1].masked == "[SSN] [SSN],[SSN]" and got[0].masked == texts[0] and got[3].masked == "x[SSN]"
    assert masking.mask(docs, "partial").where("doc_id = 1").first().masked == "****6789 ****6789,****6789"
    assert [r.valid for r in numbers.ssn_numbers(docs.where("doc_id <> 1")).orderBy("doc_id", "seq").collect()] == [False] * 5 + [True]


def test_numbers_with_check_digits_and_dates(spark):
    rows = [(1, "4111 1111 1111 1111, 4111-1111-1111-1112; 3782 822463 10005 4111111111111111"), (2, "021000021 021000022 990000000"), (3, "2024-02-29 2023-02-29,2000-02-29 1900-02-29;2024-19-39.2024-04-31 2024-04-30"), (4, "4" * 25), (None, None), (5, "")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, valid string")
    cards = numbers.card_numbers(docs).where("doc_id = 1").orderBy("seq").collect()
    assert [(r.digits, r.valid) for r in cards] == [("4111111111111111", True), ("4111111111111112", False), ("378282246310005", True), ("4111111111111111", True)]
    assert [r.valid for r in numbers.routing_numbers(docs).collect()] == [True, False, False]
    assert [r.valid for r in numbers.calendar_dates(docs).orderBy("seq").collect()] == [True, False, True, False, False, False, True]
    assert numbers.luhn_numbers(docs).where("doc_id = 4").count() == 0
    for f in (numbers.luhn_numbers, numbers.card_numbers, numbers.ssn_numbers, numbers.routing_numbers, numbers.calendar_dates, entities.entities):
        assert f(docs.limit(0)).count() == 0 and f(docs.where("doc_id is null or doc_id = 5")).count() == 0


def test_nulls_repeats_clashes_and_empty_tables(spark):
    rows = [(None, "aa", "m", 7), (1, "aa", "m", 7), (1, "aa", "m", 7), (None, None, None, None), (None, None, None, None), (3, "bb a.b@c.org", "m", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, masked string, n_email int")
    out = masking.mask(docs)
    assert {"given_masked", "given_n_email"} <= set(out.columns) and out.where("given_n_email = 7").count() == 4
    assert out.where("doc_id = 3").first().masked == "bb [EMAIL]"
    copies = sorted((str(r.doc_id), str(r.first_doc_id), r.n_copies, r.is_copy) for r in dedup.exact_copies(docs).collect())
    assert copies == [("1", "1", 3, False), ("1", "1", 3, False), ("3", "3", 1, False), ("None", "1", 3, True), ("None", "None", 2, False), ("None", "None", 2, False)]
    pairs = docs.select("doc_id", F.col("text").alias("before"), F.lit(None).cast("string").alias("after"))
    assert entities.survival(pairs, True).where("total = 0").count() == 6
    for f in (masking.mask, dedup.exact_copies, entities.kinds, lambda d: packing.pack_in_order(d, 4)):
        assert f(docs.limit(0)).count() == 0


def test_survival_of_reformatted_numbers(spark):
    pairs = spark.createDataFrame([(1, "12 and 3,400", "12 and 3400"), (2, "1,234.50", "11,234.50")], "doc_id long, before string, after string")
    assert [(r.total, r.preserved) for r in entities.survival(pairs, True).orderBy("doc_id").collect()] == [(2, 2), (1, 0)]


def test_spread_join(spark):
    """Heavy keys are dealt into parts; rows, nulls and repeats come out as in a plain join."""
    big = spark.range(5000).selectExpr("if(id % 3 = 0, null, if(id % 3 = 1, 7, id)) AS k", "id % 2 AS v").cache()
    small = spark.createDataFrame([(None, "n"), (7, "s"), (2, "t"), (-1, "u")], "k long, w string")
    got = sorted(map(str, spread_join(big, small, ["k"], how="left").collect()))
    want = sorted(map(str, big.join(small.withColumnRenamed("k", "q"), F.expr("k <=> q"), "left").drop("q").collect()))
    assert got == want
    assert heavy_keys(big.groupBy("k").agg(F.count(F.lit(1)).alias("n")), ["k"], 5000).count() == 2
