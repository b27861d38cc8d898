"""Datasets as directories of sites: listing, choice of files, delimiters and CSV reading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitewise.functions import scalars as sc
from sitewise.sources import raw_csv as rc

# File types by the end of the name, first match wins.
FILE_TYPES = [
    ("csv", (".csv",)), ("excel", (".xlsx",)), ("txt", (".txt",)), ("json", (".json",)), ("image", (".png", ".jpg", ".jpeg")),
    ("fastq", (".fastq", ".fastq.gz", ".fq", ".fq.gz")), ("alignment", (".bam", ".sam", ".cram")), ("vcf", (".vcf", ".vcf.gz")), ("fasta", (".fasta", ".fa", ".fasta.gz")),
]


def ends_with(name: Column, suffixes: tuple[str, ...]) -> Column:
    hit = F.lit(False)
    for s in suffixes:
        hit = hit | name.endswith(s)
    return hit


def file_type(name: Column) -> Column:
    low = F.lower(name)
    out = F.lit(None).cast("string")
    for kind, suffixes in reversed(FILE_TYPES):
        out = F.when(ends_with(low, suffixes), kind).otherwise(out)
    return out


def file_listing(spark: SparkSession, root: str) -> DataFrame:
    """Files below a dataset directory: node_id (the directory they are in), file_name, path, length.

    Only names and sizes are read: the content column is pruned from the scan.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    parts = F.split("path", "/")
    return files.select(F.try_element_at(parts, F.lit(-2)).alias("node_id"), F.element_at(parts, -1).alias("file_name"), "path", "length")


def load_all(spark: SparkSession, root: str) -> DataFrame:
    """The same for a directory of datasets: adds the dataset's name."""
    return file_listing(spark, root).withColumn("dataset", F.try_element_at(F.split("path", "/"), F.lit(-3)))


def chosen_files(files: DataFrame) -> DataFrame:
    """One CSV per site: an unlabeled one, else one without 'labeled' in its name, else any; by name on ties.

    Sites without a CSV have no row; callers that need one per site check with ``sites_without_csv``.
    """
    low = F.lower("file_name")
    rank = F.when(low.endswith("unlabeled.csv"), 0).when(low.endswith(".csv") & ~low.contains("labeled"), 1).when(low.endswith(".csv"), 2)
    w = Window.partitionBy("node_id").orderBy("rank", "file_name")
    return files.withColumn("rank", rank).where("rank is not null").withColumn("place", F.row_number().over(w)).where("place = 1").drop("place")


def sites_without_csv(files: DataFrame) -> list[str]:
    return [r.node_id for r in files.select("node_id").distinct().join(chosen_files(files), "node_id", "left_anti").orderBy("node_id").collect()]


def read_site(spark: SparkSession, path: str, delimiter: str | None = None, tokens: tuple[str, ...] = sc.NULL_TOKENS) -> DataFrame:
    """A site's CSV with its delimiter sniffed from the header, cleaned names, missing tokens as null, and inferred types.

    Types are inferred per site, since the same column may be a number here and text there.
    """
    if delimiter is None:
        head = spark.read.text(path).limit(1).select(rc.detect_delimiter(rc.clean_line(F.col("value"))).alias("d")).first()
        delimiter = head.d if head else ","
    text = spark.read.csv(path, header=True, sep=delimiter, quote='"', escape='"', multiLine=True, inferSchema=False)
    names = sc.clean_names([c.replace("﻿", "") for c in text.columns])
    text = text.toDF(*names).select(*[sc.null_tokens(F.col(f"`{c}`"), tokens).alias(c) for c in names])
    return typed(text)


def typed(text: DataFrame) -> DataFrame:
    """Text columns all of whose values are numbers become int, bigint or double (one aggregation)."""
    cols = text.columns
    q = {c: F.col(f"`{c}`") for c in cols}
    plain = {c: F.trim(q[c]).rlike(r"^[+-]?[0-9]{1,18}$") for c in cols}
    r = text.agg(*[x for i, c in enumerate(cols) for x in (F.count(q[c]).alias(f"n{i}"), F.count(sc.as_number(q[c])).alias(f"u{i}"), F.count_if(plain[c]).alias(f"w{i}"), F.max(F.abs(q[c].try_cast("bigint").cast("double"))).alias(f"m{i}"))]).first()
    out = []
    for i, c in enumerate(cols):
        n, u, w, m = r[f"n{i}"], r[f"u{i}"], r[f"w{i}"], r[f"m{i}"] or 0.0
        kind = None if n == 0 or u < n else "double" if w < n else "int" if m < 2**31 else "bigint"
        out.append(F.trim(q[c]).try_cast(kind).alias(c) if kind else q[c])
    return text.select(*out)


def read_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    """A CSV with header, or None if it is missing, unreadable or without rows."""
    try:
        df = spark.read.csv(path, header=True, inferSchema=True)
        return None if not df.columns or df.isEmpty() else df
    except Exception:  # a missing or damaged result file degrades to an empty section
        return None
