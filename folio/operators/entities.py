"""Entities by pattern, and survival of numbers through a change of the text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import ENTITIES, NUMBER_TOKEN


def entities(docs: DataFrame) -> DataFrame:
    """doc_id, kind, seq, value of every match, in one scan.

    Null and empty texts have none; repeated rows each give their matches; extra columns are ignored; an empty table gives no rows.
    """
    text = F.coalesce("text", F.lit(""))
    found = docs.select("doc_id", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.regexp_extract_all(text, F.lit(p), F.lit(0)).alias("values")) for k, p in ENTITIES])).alias("e"))
    return found.where(F.size("e.values") > 0).select("doc_id", "e.kind", F.posexplode("e.values").alias("seq", "value")).withColumn("seq", F.col("seq").cast("long"))


def kinds(docs: DataFrame) -> DataFrame:
    """kind, n, n_values of entities(): how many of each kind there are, and how many different ones."""
    return entities(docs).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("value").alias("n_values"))


def survival(pairs: DataFrame, reformatted: bool = False) -> DataFrame:
    """pairs(doc_id, before, after): distinct numbers of two digits or more before, and how many are numbers after.

    As written, commas and all; reformatted reads 3,400 and 3400 as one number. Null texts have no numbers; repeated rows
    each give a row; extra columns are ignored; an empty table gives no rows.
    """

    def tokens(c):
        found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(NUMBER_TOKEN), F.lit(0))
        return F.array_distinct(F.transform(found, lambda x: F.translate(x, ",", "")) if reformatted else found)

    out = pairs.select("doc_id", tokens(F.col("before")).alias("b"), tokens(F.col("after")).alias("a"))
    return out.select("doc_id", F.size("b").cast("long").alias("total"), F.size(F.array_intersect("b", "a")).cast("long").alias("preserved")).withColumn("missing", F.col("total") - F.col("preserved"))
