"""Queries of the content score (p8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sitewise.llm import content_score as cs
from sitewise.session import table


def p8_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cs.score_texts(table(spark, sf_dir, "documents"), ["doc_id", "source"], "text")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_scores(spark, sf_dir).where("is_case").select("doc_id")


def p8_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cs.rates(p8_scores(spark, sf_dir), "source")


QUERIES = {"p8_found": p8_found, "p8_scores": p8_scores, "p8_rates": p8_rates}
ORACLE: dict[str, str] = {}
