"""Queries of the file intake: schema drift (p1) and rows that fail to parse (p4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewise.operators import schema_drift as sd
from sitewise.operators import strict_load as sl
from sitewise.session import cut_lineage, table
from sitewise.sources import raw_csv as rc


def intake(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Headers, columns, parse specs and loaded rows of a data directory."""
    files, lines, domains = (table(spark, sf_dir, t) for t in ("raw_files", "raw_lines", "field_domains"))
    headers = cut_lineage(rc.file_headers(files, lines))  # one row per file
    _, cols = sd.learn_names(lines, headers, domains)
    specs = sl.parse_specs(headers, cols, domains)
    return {"lines": lines, "domains": domains, "headers": headers, "cols": cols, "specs": specs, "loaded": sl.strict_load(lines, specs)}


def _prints(x: dict[str, DataFrame]) -> DataFrame:
    return sd.fingerprints(x["cols"], sd.column_types(x["loaded"]))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of the steps that routing applied."""
    prints = _prints(intake(spark, sf_dir))
    return sd.route(prints, sd.migrations(prints))


def p1_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file with the version of its schema and the number of steps that led to it."""
    prints = _prints(intake(spark, sf_dir))
    return sd.version_log(prints, sd.versions(prints), sd.route(prints, sd.migrations(prints)))


def _table_of(dataset: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        x = intake(spark, sf_dir)
        prints = _prints(x)
        out = sd.consistent_table(x["loaded"], prints, sd.rules_of(sd.versions(prints), x["domains"], dataset), x["domains"], dataset)
        return out.withColumn("extras", F.to_json("extras"))

    return run


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = intake(spark, sf_dir)
    return sl.rejected(x["lines"], x["specs"], x["loaded"]).select("file_id", "line_no", "reason")


def p4_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rejected and loaded lines of each dataset by outcome."""
    x = intake(spark, sf_dir)
    of = x["headers"].select("file_id", "dataset")
    bad = sl.rejected(x["lines"], x["specs"], x["loaded"]).select("file_id", F.col("reason").alias("outcome"))
    both = bad.unionByName(x["loaded"].select("file_id", F.lit("loaded").alias("outcome")))
    return both.groupBy("file_id", "outcome").count().join(of, "file_id", "left").groupBy("dataset", "outcome").agg(F.sum("count").alias("n_lines"))


QUERIES = {
    "p1_found": p1_found,
    "p1_versions": p1_versions,
    "p1_heart_table": _table_of("heart_disease_cleveland"),
    "p1_gbsg_table": _table_of("breast_cancer_gbsg"),
    "p4_found": p4_found,
    "p4_reasons": p4_reasons,
}
ORACLE: dict[str, str] = {}
