"""The corpus pipeline: quality rules, toxicity, near-duplicates, packing; each stage's rows are written and read by the next.

Every stage but the last returns whole rows of its input with all its columns, extra ones and ones named like a stage's own
(score, kept, n_words, row) too. Null text: the quality rules reject it. Null doc_id: kept by quality (without a label) and
toxicity (fold of the text "null", no label), judged by its text in near-duplicates like any row, packed under a null doc_id.
Repeated rows: judged alike by the first two stages; of equal texts near-duplicates keep the first in reading order, which is
also how ties are decided; packing gives every row its pieces. An empty table: every stage returns no rows. Nulls in other
columns stay as they are; a null lang is a stratum of its own in the quality rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folio.llm import minhash, packing, quality, toxicity
from folio.llm.common import staged, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality rules keep."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents scored below 0.5 by a model trained on the labelled ones among them."""
    return toxicity.accepted(docs, table(spark, sf_dir, "labels"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return minhash.survivors(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, packed into sequences."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", quality_stage), ("toxicity", toxicity_stage), ("near_dedup", dedup_stage), ("packing", packing_stage)]
#: A trained model and a tokenizer library can't be expressed in SQL; tests/llm holds the stages against a brute-force pipeline.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs, f"stage-{name}")
    return docs
