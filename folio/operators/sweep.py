"""A corpus-wide sweep: what one document declares is masked wherever it stands in any other.

Terms are values found in context (a declared secret, a number after a cue) in one pass over all texts; the set of them is a
table as large as the corpus makes it and is never broadcast. Documents meet it by their tokens: the distinct tokens of the shape that terms
have are semi-joined to the terms, with the rows of a token that very many documents hold dealt into parts, and only documents with a hit
are rewritten. Texts without a token of that shape are passed on without a shuffle.

Defined results: null text is the empty text; a token is swept only if it equals a term whole; repeated rows are swept each; columns of docs named
like the new ones are returned as given_<name>, all others as they are; empty tables of docs or terms give no rows or no change.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .skew import aside, heavy_keys, spread_join
from .stage import staged


def declared(docs: DataFrame, pattern: str, group: int = 1) -> DataFrame:
    """term: the distinct values that pattern's group takes in docs(text)."""
    found = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(pattern), F.lit(group))
    return docs.select(F.explode(found).alias("term")).where("term <> ''").distinct()


def _rewritten(pattern: str, mask: str):
    def run(batches):
        token = re.compile(pattern, re.ASCII)
        for b in batches:
            texts, counts = [], []
            for text, found in zip(b.column("text").to_pylist(), b.column("_found").to_pylist()):
                found, n = frozenset(found), 0

                def swap(m):
                    nonlocal n
                    if m.group() not in found:
                        return m.group()
                    n += 1
                    return mask

                texts.append(token.sub(swap, text))
                counts.append(n)
            kept = [c for c in b.schema.names if c not in ("_found", "_row")]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], pa.array(texts, pa.string()), pa.array(counts, pa.int64())], [*kept, "swept", "n_swept"])

    return run


def sweep(docs: DataFrame, terms: DataFrame, token: str, mask: str) -> DataFrame:
    """docs with `swept`, the text with every token equal to a term of terms(term) replaced by mask, and n_swept, their number.

    token: pattern of what can be a term; it has the same matches in Java and in Python (classes of ASCII characters and counts)."""
    docs = aside(docs, ["swept", "n_swept", "_found", "_row", "_tokens"])
    text = F.coalesce("text", F.lit(""))
    none = docs.where(~text.rlike(token)).withColumns({"swept": text, "n_swept": F.lit(0).cast("long")})
    some = staged(docs.where(text.rlike(token)).withColumns({"_row": F.monotonically_increasing_id(), "_tokens": F.array_distinct(F.regexp_extract_all(text, F.lit(token), F.lit(0)))}), "candidates")
    tokens = some.select("_row", F.explode("_tokens").alias("term"))
    counts = staged(tokens.groupBy("term").agg(F.count(F.lit(1)).alias("n")), "tokens")
    known = terms.select("term").distinct()
    hits = spread_join(tokens, known, ["term"], heavy_keys(counts, ["term"], tokens.count()))
    hits = staged(hits.groupBy(F.col("_row").alias("_at")).agg(F.collect_list("term").alias("_found")), "hits")
    some = some.drop("_tokens").join(hits, F.col("_row") == F.col("_at"), "left").drop("_at")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + ", swept string, n_swept long"
    hit = some.where("_found is not null").mapInArrow(_rewritten(token, mask), schema)
    return none.unionByName(some.where("_found is null").drop("_found", "_row").withColumns({"swept": text, "n_swept": F.lit(0).cast("long")})).unionByName(hit)
