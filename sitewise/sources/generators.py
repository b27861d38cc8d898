"""Synthetic tables of a hospital, its visits, events and monthly figures, made by the executors.

The same seed and number of partitions give the same table. They serve as fixtures.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _pick(u: Column, options: list[tuple[str | None, float]]) -> Column:
    """An option by its share of a uniform number."""
    out, edge = F.lit(options[-1][0]), 1.0
    for value, share in reversed(options[:-1]):
        edge = sum(s for _, s in options[: options.index((value, share)) + 1])
        out = F.when(u < edge, value).otherwise(out)
    return out


def hospital(spark: SparkSession, n: int = 450, seed: int = 1, drop: tuple[str, ...] = ()) -> DataFrame:
    """Patients with demographics, vitals, labs, diagnoses and dates; correlated where medicine says so."""
    s = iter(range(seed * 1000, seed * 1000 + 100))
    g = lambda mean, sd: F.randn(next(s)) * sd + mean
    hit = lambda p: (F.rand(next(s)) < p).cast("int")
    df = spark.range(0, n, 1, 2).select(F.format_string("patient_%05d", F.col("id")).alias("patient_id"), F.round(F.least(F.greatest(g(58, 16), F.lit(18.0)), F.lit(95.0)), 1).alias("age"), _pick(F.rand(next(s)), [("male", 0.48), ("female", 0.5), ("non-binary", 0.02)]).alias("sex"))
    df = df.withColumns({
        "region": _pick(F.rand(next(s)), [("north", 0.3), ("south", 0.3), ("east", 0.2), ("west", 0.2)]), "insurance_type": _pick(F.rand(next(s)), [("public", 0.8), ("private", 0.2)]), "blood_type": _pick(F.rand(next(s)), [("A", 0.4), ("B", 0.15), ("AB", 0.05), ("0", 0.4)]), "referral_source": _pick(F.rand(next(s)), [("gp", 0.6), ("emergency", 0.3), ("transfer", 0.1)]),
        "height_cm": F.round(g(171, 9), 1), "bmi": F.round(F.greatest(g(27, 4.5), F.lit(16.0)), 1), "glucose_mg_dl": F.round(g(105, 22), 1), "heart_rate": F.round(g(76, 11), 0), "temperature_c": F.round(g(36.9, 0.5), 1), "wbc_count": F.round(F.exp(g(2, 0.3)), 2), "crp_level": F.round(F.exp(g(1.2, 1.0)), 2), "ldl_cholesterol": F.round(g(120, 30), 1),
    })
    df = df.withColumns({
        "weight_kg": F.round(F.col("bmi") * F.pow(F.col("height_cm") / 100, 2), 1), "waist_circumference_cm": F.round(F.col("bmi") * 2.6 + 22 + g(0, 5), 1), "systolic_bp": F.round(105 + F.col("age") * 0.4 + g(0, 12), 0), "diastolic_bp": F.round(62 + F.col("age") * 0.2 + g(0, 8), 0), "hba1c_percent": F.round(3.8 + F.col("glucose_mg_dl") * 0.017 + g(0, 0.4), 2),
        "diabetes": (F.col("glucose_mg_dl") + g(0, 12) > 126).cast("int"), "hypertension": (F.col("age") + g(0, 15) > 62).cast("int"), "obesity": (F.col("bmi") >= 30).cast("int"), "current_smoker": hit(0.22), "copd": hit(0.1), "smoking_status": _pick(F.rand(next(s)), [("never", 0.5), ("former", 0.3), ("current", 0.2)]), "respiratory_diagnosis": _pick(F.rand(next(s)), [("none", 0.7), ("asthma", 0.2), ("copd", 0.1)]), "diagnosis_category": _pick(F.rand(next(s)), [("cardiac", 0.4), ("respiratory", 0.3), ("other", 0.3)]),
        "length_of_stay_days": F.greatest(F.lit(1), F.round(F.exp(g(1.5, 0.7)), 0).cast("int")), "admission_date": F.date_add(F.lit("2022-01-01").cast("date"), F.floor(F.rand(next(s)) * 730).cast("int")), "icu_admission": hit(0.12),
    })
    df = df.withColumns({"discharge_date": F.date_add("admission_date", F.col("length_of_stay_days")), "followup_date": F.date_add("admission_date", F.col("length_of_stay_days") + 30), "mortality": (F.rand(next(s)) < 0.02 + 0.15 * F.col("icu_admission")).cast("int")})
    return df.drop(*drop)


def missing_blocks(df: DataFrame, columns: list[str], share: float, seed: int) -> DataFrame:
    """Whole blocks of columns missing together in a share of the rows."""
    gone = F.rand(seed) < share
    return df.withColumn("_gone", gone).withColumns({c: F.when(~F.col("_gone"), F.col(c)) for c in columns}).drop("_gone")


def visits(spark: SparkSession, n: int = 100, seed: int = 2) -> DataFrame:
    """Three to six visits of each patient."""
    p = spark.range(0, n, 1, 2).select(F.format_string("patient_%05d", F.col("id")).alias("patient_id"), F.round(F.randn(seed) * 14 + 60, 1).alias("age"), _pick(F.rand(seed + 1), [("male", 0.5), ("female", 0.5)]).alias("sex"), (F.randn(seed + 2) * 12 + 78).alias("w"), (3 + F.floor(F.rand(seed + 3) * 4)).cast("int").alias("k"))
    v = p.select("*", F.explode(F.sequence(F.lit(1), F.col("k"))).alias("visit_number"))
    return v.select("patient_id", "age", "sex", "visit_number", F.date_add(F.lit("2022-01-01").cast("date"), F.col("visit_number") * 60 + F.floor(F.rand(seed + 4) * 20).cast("int")).alias("visit_date"), F.round(F.col("w") - F.col("visit_number") * 0.4 + F.randn(seed + 5), 1).alias("weight_kg"), F.round(F.randn(seed + 6) * 15 + 108, 1).alias("glucose_mg_dl"), F.round(F.randn(seed + 7) * 10 + 128, 0).alias("systolic_bp"))


def event_log(spark: SparkSession, n: int = 100, seed: int = 3) -> DataFrame:
    """One to eight events of each patient."""
    p = spark.range(0, n, 1, 2).select(F.format_string("patient_%05d", F.col("id")).alias("patient_id"), F.round(F.randn(seed) * 14 + 60, 1).alias("age"), _pick(F.rand(seed + 1), [("male", 0.5), ("female", 0.5)]).alias("sex"), (1 + F.floor(F.rand(seed + 2) * 8)).cast("int").alias("k"))
    e = p.select("*", F.explode(F.sequence(F.lit(1), F.col("k"))).alias("i"))
    return e.select("patient_id", "age", "sex", F.date_add(F.lit("2022-01-01").cast("date"), F.floor(F.rand(seed + 3) * 365).cast("int")).alias("event_date"), _pick(F.rand(seed + 4), [("admission", 0.3), ("surgery", 0.15), ("infection", 0.2), ("fall", 0.1), ("follow-up", 0.25)]).alias("event_type"), (1 + F.floor(F.rand(seed + 5) * 5)).cast("int").alias("severity_score"))


def panel(spark: SparkSession, n: int = 3, months: int = 36, seed: int = 4) -> DataFrame:
    """Monthly figures of hospitals with trend and season."""
    m = spark.range(0, n * months, 1, 2).select((F.col("id") / months).cast("int").alias("h"), (F.col("id") % months).cast("int").alias("i"))
    season = F.sin(F.col("i") * 2 * 3.141592653589793 / 12)
    return m.select(F.format_string("hospital_%02d", F.col("h") + 1).alias("hospital_id"), F.add_months(F.lit("2020-01-01").cast("date"), F.col("i")).alias("month"), F.round(400 + 50 * F.col("h") + 2 * F.col("i") + 30 * season + F.randn(seed) * 10, 0).cast("int").alias("admissions"), F.round(6 + season * 0.5 + F.randn(seed + 1) * 0.3, 2).alias("avg_los_days"), F.round(0.8 + season * 0.05 + F.randn(seed + 2) * 0.02, 3).alias("bed_occupancy_rate"), F.round(F.abs(0.03 + F.randn(seed + 3) * 0.005), 4).alias("mortality_rate"))
