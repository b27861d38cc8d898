"""Queries of the encoding of the corpus (p6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewise.llm import encoding
from sitewise.session import table


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.encode(table(spark, sf_dir, "documents"), "doc_id", "text")


def p6_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by whether their ids decode to their text, with tokens in all."""
    found = encoding.round_trip(table(spark, sf_dir, "documents"), "doc_id", "text")
    return found.groupBy("same").agg(F.count("*").alias("n_documents"), F.sum("n_tokens").alias("n_tokens"), F.count_if(F.col("n_tokens") == 0).alias("n_empty"))


QUERIES = {"p6_ids": p6_ids, "p6_round_trip": p6_round_trip}
ORACLE: dict[str, str] = {}
