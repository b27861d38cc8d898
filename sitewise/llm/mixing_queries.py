"""Queries of the mixing of sources (p7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewise.llm import encoding, mixing
from sitewise.session import table


def _mixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, int]:
    """Documents with tokens and copies; the texts themselves are encoded once."""
    sized = encoding.token_counts(table(spark, sf_dir, "documents"), ["doc_id", "source"], "text").withColumn("u", mixing.uniform(F.col("doc_id"), mixing.SEED)).persist()
    solved, total = mixing.solve(sized, mixing.read_targets(table(spark, sf_dir, "mix_targets")))
    return mixing.with_copies(sized, solved), solved, total


def p7_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document is used."""
    return _mixed(spark, sf_dir)[0].select("doc_id", "source", "n_tokens", "n_copies")


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share each source of mix_targets really gets, of the tokens of all documents."""
    return mixing.report(*_mixed(spark, sf_dir))


def p7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture itself: one row per copy, in global random order."""
    return mixing.shuffled(_mixed(spark, sf_dir)[0], "doc_id", mixing.SEED).select("order_key", "doc_id", "copy_no", "source", "n_tokens")


QUERIES = {"p7_copies": p7_copies, "p7_shares": p7_shares, "p7_mixture": p7_mixture}
ORACLE: dict[str, str] = {}
