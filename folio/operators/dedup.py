"""Exact duplicates with a pointer to the first copy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .skew import heavy_keys, spread_join


def exact_copies(docs: DataFrame) -> DataFrame:
    """doc_id, digest, first_doc_id, n_copies, is_copy of every row of docs(doc_id, text).

    A hash aggregate with map-side combine counts the copies, so a text that a third of all rows share costs one row a task; the
    rows of a heavy text are dealt into parts where they meet its count.

    Null text is the empty text; a null doc_id is a copy where its text stands under a doc_id too, and its text's first_doc_id is
    null where it doesn't; rows of one doc_id and text are no copies of each other; extra columns are ignored; an empty table
    gives no rows.
    """
    rows = docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("first_doc_id"), F.count(F.lit(1)).alias("n_copies"))
    heavy = heavy_keys(first, ["digest"], docs.count(), "n_copies")
    out = spread_join(rows, first, ["digest"], heavy)
    return out.withColumn("is_copy", F.coalesce(F.col("doc_id") > F.col("first_doc_id"), F.col("first_doc_id").isNotNull()))
