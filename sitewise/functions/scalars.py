"""Scalar expressions shared by the operators: missing tokens, names, labels and displays."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

NULL_TOKENS = ("", "NULL", "null", "NaN")


def null_tokens(c: Column, tokens: tuple[str, ...] = NULL_TOKENS) -> Column:
    """Null where the text is exactly one of the tokens (case-sensitive, not trimmed)."""
    return F.when(~c.isin(*tokens), c)


def clean_names(names: list[str]) -> list[str]:
    """Trimmed, lower-cased, blanks as underscores; repeated names get the suffixes _1, _2, ..."""
    out: list[str] = []
    taken: set[str] = set()
    for raw in names:
        base = raw.strip().lower().replace(" ", "_")
        name, k = base, 0
        while name in taken:
            k += 1
            name = f"{base}_{k}"
        taken.add(name)
        out.append(name)
    return out


def name_tokens(name: str) -> set[str]:
    return {t for t in re.split(r"[^a-z0-9]+", name.lower()) if t}


def as_number(c: Column) -> Column:
    """The value as a double, null where it is no number or NaN."""
    n = c.try_cast("double")
    return F.when(~F.isnan(n), n)


def significance_label(p: Column) -> Column:
    return F.when(p.isNull(), "n.s.").when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("n.s.")


def p_display(p: Column) -> Column:
    """How a p-value is printed."""
    return F.when(p.isNull(), None).when(p == 0, "0").when(p < 0.001, "< 0.001").otherwise(F.round(p, 3).cast("string"))


def number_display(x: Column) -> Column:
    """Whole numbers without point, others with three significant digits (plain notation)."""
    digits = F.greatest(F.lit(0), F.lit(2) - F.floor(F.log10(F.when(x != 0, F.abs(x))))).cast("int")
    scale = F.pow(F.lit(10.0), digits)
    rounded = F.round(x * scale) / scale
    return F.when(x.isNull(), None).when(x == F.floor(x), F.format_string("%.0f", x)).otherwise(F.regexp_replace(F.format_string("%.12f", rounded), r"\.?0+$", ""))


def range_display(lo: Column, hi: Column) -> Column:
    return F.concat(F.lit("["), number_display(lo), F.lit(", "), number_display(hi), F.lit("]"))


def or_unknown(c: Column) -> Column:
    """'Unknown' for null and empty tags."""
    return F.coalesce(F.nullif(F.trim(c.cast("string")), F.lit("")), F.lit("Unknown"))


PERIOD_FORMATS = {"D": "yyyy-MM-dd", "M": "yyyy-MM", "Y": "yyyy"}
PERIOD_UNITS = {"D": "day", "W": "week", "M": "month", "Y": "year"}


def period_label(c: Column, freq: str) -> Column:
    """Text of the period a date lies in; weeks are named by their Monday."""
    return F.date_format(F.date_trunc("week", c), "yyyy-MM-dd") if freq == "W" else F.date_format(c, PERIOD_FORMATS[freq])


def safe_ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def correlation(x: Column, y: Column) -> Column:
    """Pearson over the rows where both are there; null (not an error) for a constant side."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def corrected_skewness(g1: Column, n: Column, var: Column) -> Column:
    """Sample skewness from the population one; 0 for a constant, null below three values."""
    n = n.cast("double")
    return F.when(n < 3, None).when(var == 0, 0.0).otherwise(g1 * F.sqrt(n * (n - 1)) / (n - 2))


def corrected_kurtosis(g2: Column, n: Column, var: Column) -> Column:
    """Sample excess kurtosis from the population one; 0 for a constant, null below four values."""
    n = n.cast("double")
    return F.when(n < 4, None).when(var == 0, 0.0).otherwise((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))
