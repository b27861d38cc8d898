"""Top-k views, small-slice merging and display projections of result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitewise.functions import scalars as sc


def top_by(df: DataFrame, column: str, k: int | None = 10, ties: list[str] | None = None, absolute: bool = False) -> DataFrame:
    """The k rows with the largest value, nulls last; ``ties`` makes the order unique."""
    by = F.abs(F.col(column)) if absolute else F.col(column)
    ranked = df.orderBy(by.desc_nulls_last(), *(ties or []))
    return ranked.limit(k) if k is not None else ranked


def top_per_group(df: DataFrame, group: list[str], column: str, k: int, ties: list[str]) -> DataFrame:
    w = Window.partitionBy(*group).orderBy(F.col(column).desc_nulls_last(), *ties)
    return df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def merge_small(df: DataFrame, group: list[str], label: str, value: str, threshold: float = 0.03) -> DataFrame:
    """Slices below ``threshold`` of their group's total become 'Other'."""
    total = F.sum(value).over(Window.partitionBy(*group) if group else Window.partitionBy(F.lit(1)))
    named = df.withColumn("slice", F.when(sc.safe_ratio(F.col(value), total) < threshold, "Other").otherwise(F.col(label)))
    return named.groupBy(*group, "slice").agg(F.sum(value).alias(value))


def volcano(df: DataFrame, p: str, effect: str) -> DataFrame:
    return df.withColumn("minus_log10_p", -F.log10(F.greatest(F.col(p), F.lit(1e-30)))).withColumn("abs_effect", F.abs(F.col(effect)))


def vector_length(x: str, y: str) -> Column:
    return F.sqrt(F.col(x) * F.col(x) + F.col(y) * F.col(y))


def first_effect(df: DataFrame, columns: list[str]) -> DataFrame:
    """The first effect size that is there; rows without any drop."""
    return df.withColumn("effect_size", F.coalesce(*columns)).where("effect_size is not null")


def truncation_note(shown: int, total: int, criterion: str) -> str | None:
    return f"Showing {shown} of {total} rows, by {criterion}." if shown < total else None


def numeric_display(profile: DataFrame) -> DataFrame:
    """Without shape figures; minimum and maximum folded into a range."""
    keep = [c for c in profile.columns if c not in ("skewness", "kurtosis", "min", "max")]
    return profile.select(*keep, sc.range_display(F.col("min"), F.col("max")).alias("range"))


def without_internal(df: DataFrame) -> DataFrame:
    """Columns whose name starts with an underscore are left out."""
    return df.select(*[c for c in df.columns if not c.startswith("_")])


# Parts of names that mark identifiers in reports.
IDENTIFIER_PARTS = ("id", "identifier", "patient_id", "identifikator")


def identifier_features(df: DataFrame, column: str) -> DataFrame:
    hit = F.lit(False)
    for part in IDENTIFIER_PARTS:
        hit = hit | F.lower(F.col(column)).contains(part)
    return df.where(hit).select(column).distinct().orderBy(column)
