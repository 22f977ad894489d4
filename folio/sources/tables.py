"""Reading a corpus: Parquet tables, and files of a folder as whole texts or bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, length, sha256, text of a folder's .txt and .md files; bytes that aren't UTF-8 are read as Latin-1."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.{txt,md}").load(folder)
    return raw.select("path", "length", F.sha2("content", 256).alias("sha256"), F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string")).otherwise(F.decode("content", "ISO-8859-1")).alias("text"))
