"""Linear and logistic regression from sums over the rows; the driver solves systems of the size of the columns."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewise.functions import distributions as dist
from sitewise.functions import scalars as sc


def _design(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """Complete rows with x0 = 1, x1.., y."""
    cols = [F.lit(1.0).alias("x0"), *[sc.as_number(F.col(c)).alias(f"x{i + 1}") for i, c in enumerate(features)], sc.as_number(F.col(target)).alias("y")]
    return df.select(*cols).na.drop()


def _linear(beta: np.ndarray) -> Column:
    out = F.lit(0.0)
    for i, b in enumerate(beta):
        out = out + F.col(f"x{i}") * float(b)
    return out


def linear(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """term, coefficient, std_error, t, p_value, r2 and n of least squares over complete rows."""
    x, k = _design(df, features, target), len(features) + 1
    sums = x.agg(F.count("*").alias("n"), F.sum("y").alias("sy"), F.sum(F.col("y") * F.col("y")).alias("syy"), *[F.sum(F.col(f"x{i}") * F.col("y")).alias(f"b{i}") for i in range(k)], *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"a{i}_{j}") for i in range(k) for j in range(i, k)]).first()
    n = sums.n
    if n <= k:
        raise ValueError("fewer complete rows than terms")
    a = np.array([[sums[f"a{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
    b = np.array([sums[f"b{i}"] for i in range(k)])
    beta = np.linalg.pinv(a) @ b
    rss = x.agg(F.sum(F.pow(F.col("y") - _linear(beta), 2))).first()[0]  # a second pass instead of a difference of large sums
    tss = sums.syy - sums.sy**2 / n
    se = np.sqrt(np.clip(np.diag(np.linalg.pinv(a)) * rss / (n - k), 0, None))
    rows = [(t, float(c), float(s), float(c / s) if s else None, float(dist.t_two_sided(float(c / s), n - k)) if s else None, float(1 - rss / tss) if tss > 0 else None, n) for t, c, s in zip(["intercept", *features], beta, se)]
    return df.sparkSession.createDataFrame(rows, "term string, coefficient double, std_error double, t double, p_value double, r2 double, n long")


def residuals(df: DataFrame, features: list[str], target: str, model: DataFrame) -> DataFrame:
    """fitted and residual of every complete row."""
    found = {r.term: r.coefficient for r in model.collect()}
    return _design(df, features, target).select(_linear(np.array([found[t] for t in ["intercept", *features]])).alias("fitted"), "y").withColumn("residual", F.col("y") - F.col("fitted"))


def logistic(df: DataFrame, features: list[str], target: str, passes: int = 25, tolerance: float = 1e-9) -> DataFrame:
    """term, coefficient, odds_ratio of a 0/1 target, by Newton steps of one aggregation each."""
    x, k = _design(df, features, target).where("y in (0, 1)").persist(), len(features) + 1
    beta = np.zeros(k)
    for _ in range(passes):
        p = 1.0 / (1.0 + F.exp(-_linear(beta)))
        r = x.withColumn("p", p).withColumn("w", F.col("p") * (1 - F.col("p"))).agg(*[F.sum(F.col(f"x{i}") * (F.col("y") - F.col("p"))).alias(f"g{i}") for i in range(k)], *[F.sum(F.col("w") * F.col(f"x{i}") * F.col(f"x{j}")).alias(f"h{i}_{j}") for i in range(k) for j in range(i, k)]).first()
        if r.g0 is None:
            raise ValueError("no complete rows")
        step = np.linalg.pinv(np.array([[r[f"h{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])) @ np.array([r[f"g{i}"] for i in range(k)])
        beta = beta + np.clip(step, -5, 5)
        if np.abs(step).max() < tolerance:
            break
    x.unpersist()
    return df.sparkSession.createDataFrame([(t, float(b), float(np.exp(b))) for t, b in zip(["intercept", *features], beta)], "term string, coefficient double, odds_ratio double")
