"""Numbers with a structure or a check digit, and dates, read from texts by public rules.

All take docs(doc_id, text) and give a row per item: doc_id, seq (its place among the text's candidates, from 0), the item and what
holds of it. Null and empty texts have none; repeated rows each give their items; a null doc_id is kept; extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import CARDS, DATES, SSN, SSNS, shapes
from .masking import routing


def _items(docs: DataFrame, pattern: str, name: str) -> DataFrame:
    found = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(pattern), F.lit(0))
    return docs.select("doc_id", F.posexplode(found).alias("seq", name)).withColumn("seq", F.col("seq").cast("long"))


def _joined(docs: DataFrame, pattern: str) -> DataFrame:
    """Items of shapes(): found in the text with its other characters doubled, and given with single ones."""
    twice = docs.select("doc_id", F.regexp_replace("text", "([^0-9])", "$1$1").alias("text"))
    found = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(pattern), F.lit(2))
    items = twice.select("doc_id", F.posexplode(found).alias("seq", "item")).withColumn("seq", F.col("seq").cast("long"))
    return items.withColumn("item", F.replace(F.replace("item", F.lit("--"), F.lit("-")), F.lit("  "), F.lit(" ")))


def luhn_numbers(docs: DataFrame) -> DataFrame:
    """Whole digit runs of card length (12 to 19) with whether the check digit holds (ISO/IEC 7812-1, annex B); a longer run is none."""
    runs = _items(docs, "[0-9]+", "digits").where(F.length("digits").between(12, 19))
    return runs.withColumn("valid", F.call_function("luhn_check", "digits"))


def card_numbers(docs: DataFrame) -> DataFrame:
    """Items printed like card numbers (13 to 19 digits in a row, 4-4-4-4, 4-6-5), their digits, and whether the check digit holds."""
    items = _joined(docs, shapes(CARDS, " -")).withColumn("digits", F.translate("item", " -", ""))
    return items.withColumn("valid", F.call_function("luhn_check", "digits"))


def ssn_numbers(docs: DataFrame) -> DataFrame:
    """Items of three, two and four digits joined by dashes or spaces, and whether SSA issues such a number."""
    return _joined(docs, shapes(SSNS, " -")).withColumn("valid", F.col("item").rlike(f"^(?:{SSN})$"))


def routing_numbers(docs: DataFrame) -> DataFrame:
    """Whole runs of nine digits, and whether they can be an ABA routing number."""
    runs = _items(docs, "[0-9]+", "digits").where(F.length("digits") == 9)
    return runs.withColumn("valid", routing(F.col("digits")))


def calendar_dates(docs: DataFrame) -> DataFrame:
    """Items written like ISO 8601 dates that touch no other digit, and whether the calendar has them."""
    items = _joined(docs, shapes(DATES, "-"))
    part = lambda at, n: F.substring("item", at, n).cast("int")
    year, month, day = part(1, 4), part(6, 2), part(9, 2)
    leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
    most = F.when(month == 2, F.when(leap, 29).otherwise(28)).when(month.isin(4, 6, 9, 11), 30).otherwise(31)
    return items.withColumn("valid", month.between(1, 12) & (day >= 1) & (day <= most))
