"""Synthetic outcome labels from symptom flags, for tables that lack one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewise.functions import scalars as sc

# Parts of names of symptom columns.
SYMPTOM_PARTS = [
    "fatigue", "tired", "dyspnea", "shortness_of_breath", "breath", "cough",
    "anosmia", "ageusia", "smell", "taste", "headache", "migraine",
    "brain", "fog", "cognitive", "memory", "concentration",
    "chest_pain", "chest", "palpit", "tachy", "arrhythm",
    "sleep", "insomnia", "anxiety", "depress", "mood",
    "myalgia", "muscle", "joint", "pain", "arthral",
    "fever", "nausea", "diarr", "gi_",
]


def symptom_columns(columns: list[str]) -> list[str]:
    return [c for c in columns if any(p in c.lower() for p in SYMPTOM_PARTS)]


def flag(c: Column) -> Column:
    """Yes/no words as 1 and 0, other text as its number."""
    t = F.lower(F.trim(c.cast("string")))
    return F.when(t.isin("1", "true", "yes", "y", "t"), 1.0).when(t.isin("0", "false", "no", "n", "f"), 0.0).otherwise(sc.as_number(c.cast("string")))


def probability(columns: list[str]) -> Column:
    """Logistic model of the share of positive symptoms, hospitalisation and intensive care."""
    symptoms = symptom_columns(columns) or [c for c in columns if any(w in c.lower() for w in ("symptom", "complaint", "score"))][:25]
    burden = F.lit(0.0)
    for c in symptoms:
        burden = burden + F.greatest(F.coalesce(flag(F.col(f"`{c}`")), F.lit(0.0)), F.lit(0.0))
    burden = burden / max(1, len(symptoms))
    extra = lambda c: F.coalesce(sc.as_number(F.col(c).cast("string")), F.lit(0.0)) if c in columns else F.lit(0.0)
    score = -1.2 + 2.6 * burden + 0.6 * extra("hospitalization") + 0.8 * extra("icu")
    return 1.0 / (1.0 + F.exp(-score))


def add_label(df: DataFrame, label: str = "pasc", seed: int = 42, noise: float = 0.05) -> DataFrame:
    """A 0/1 label drawn from ``probability`` with noise; an existing column is left as it is."""
    if label in df.columns:
        return df
    p = F.least(F.greatest(probability(df.columns) + F.randn(seed) * noise, F.lit(0.0)), F.lit(1.0))
    return df.withColumn(label, (F.rand(seed + 1) < p).cast("int"))
