"""Readers for the tables that queries run on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table by name."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def paragraphs(documents: DataFrame) -> DataFrame:
    """doc_id, idx (from 0) and text of each line of each document."""
    return documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("idx", "text"))
