"""Ordered analytics: time series, longitudinal records, event logs, panels, spectra, peaks.

Series over all rows are reduced to periods first, so that windows without a partition only ever see
one row per period. Per-subject figures are aggregates with an explicit tie-break instead of windows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitewise.functions import scalars as sc


def period_series(df: DataFrame, time: str, value: Column, freq: str = "M", keys: list[str] | None = None) -> DataFrame:
    """keys, period, value: one row per period (null times drop)."""
    return df.where(F.col(time).isNotNull()).groupBy(*(keys or []), sc.period_label(F.col(time), freq).alias("period")).agg(value.alias("value"))


def rolling(series: DataFrame, keys: list[str] | None = None, width: int = 3) -> DataFrame:
    """Rolling mean (null until ``width`` values) and relative change of period series."""
    w = Window.partitionBy(*(keys or [F.lit(1)])).orderBy("period")
    frame = w.rowsBetween(1 - width, 0)
    prev = F.lag("value").over(w)
    return series.withColumn("rolling_mean", F.when(F.count("value").over(frame) == width, F.avg("value").over(frame))).withColumn("growth_rate", F.try_divide(F.col("value") - prev, prev))


def trend(series: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """min, max, range, mean, slope and R^2 on the order of the periods."""
    keys = keys or []
    w = Window.partitionBy(*(keys or [F.lit(1)])).orderBy("period")
    x = series.withColumn("x", (F.row_number().over(w) - 1).cast("double"))
    g = x.groupBy(*keys).agg(F.count("value").alias("n"), F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"), F.regr_slope("value", "x").alias("slope"), F.regr_r2("value", "x").alias("r2"), F.var_pop("value").alias("v"))
    more = F.col("n") > 1
    return g.select(*keys, "n", "min", "max", (F.col("max") - F.col("min")).alias("range"), "mean", F.when(more, F.col("slope")).alias("trend_slope"), F.when(more, F.when(F.col("v") > 0, F.col("r2")).otherwise(0.0)).alias("trend_r2"))


def _days(c: Column, kind: str) -> Column:
    """Time as a number: days for dates and timestamps, the value itself for numbers."""
    if kind == "date":
        return F.unix_date(c).cast("double")
    if kind.startswith("timestamp"):
        return F.unix_micros(c.cast("timestamp")) / 86_400_000_000.0
    return c.cast("double")


def _subjects(df: DataFrame, subject: str, time: str, value: str, ties: list[str]) -> DataFrame:
    v = sc.as_number(F.col(value))
    x = df.where(F.col(subject).isNotNull() & F.col(time).isNotNull()).select(F.col(subject).alias("subject"), _days(F.col(time), dict(df.dtypes)[time]).alias("day"), v.alias("v"), F.struct(F.col(time).alias("t"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(ties)], v.alias("v")).alias("at")).where("v is not null")
    # slopes are fitted on days since a fixed day to keep sums small
    return x.groupBy("subject").agg(F.count("*").alias("n_observations"), F.avg("v").alias("mean"), F.min("at").alias("first"), F.max("at").alias("last"), F.var_samp("v").alias("within_var"), F.regr_slope("v", "day").alias("slope")).where("n_observations >= 2")


def longitudinal(df: DataFrame, subject: str, time: str, value: str, ties: list[str] | None = None) -> DataFrame:
    """Per subject with two values or more: first, last, change, slope per day, variance within."""
    g = _subjects(df, subject, time, value, ties or [])
    change = F.col("last.v") - F.col("first.v")
    return g.select("subject", "n_observations", F.col("first.v").alias("baseline"), F.col("last.v").alias("last_value"), change.alias("absolute_change"), (F.try_divide(change, F.col("first.v")) * 100).alias("relative_change"), "slope", "within_var")


def panel(df: DataFrame, entity: str, time: str, value: str, ties: list[str] | None = None) -> DataFrame:
    """Per entity with two values or more: mean, growth, slope per day."""
    return _subjects(df, entity, time, value, ties or []).select(F.col("subject").alias("entity"), "n_observations", "mean", (F.col("last.v") - F.col("first.v")).alias("growth"), "slope")


def daily_counts(df: DataFrame, time: str) -> DataFrame:
    return df.where(F.col(time).isNotNull()).groupBy(F.to_date(time).alias("day")).agg(F.count("*").alias("cnt"))


def event_measures(df: DataFrame, time: str) -> DataFrame:
    """Density by day, peak day (the earliest on ties), bursts, and the gaps between events.

    Gaps within a day are found inside that day, those across days from each day's first and last event.
    """
    x = df.where(F.col(time).isNotNull()).select(F.to_date(time).alias("day"), F.unix_micros(F.col(time).cast("timestamp")).alias("us"))
    inner = x.withColumn("gap", (F.col("us") - F.lag("us").over(Window.partitionBy("day").orderBy("us"))) / 1e6)
    per_day = inner.groupBy("day").agg(F.count("*").alias("cnt"), F.min("us").alias("first"), F.max("us").alias("last"), F.count("gap").alias("gn"), F.sum("gap").alias("gs"), F.sum(F.col("gap") * F.col("gap")).alias("gq")).persist()
    across = (F.col("first") - F.lag("last").over(Window.partitionBy(F.lit(1)).orderBy("day"))) / 1e6  # one row per day
    d = per_day.withColumn("ag", across)
    stats = d.agg(
        F.sum("cnt").alias("event_count"), F.count("*").alias("n_days"), F.avg("cnt").alias("event_density_mean"), F.stddev_samp("cnt").alias("event_density_std"), F.min(F.struct((-F.col("cnt")).alias("k"), "day")).alias("peak"),
        (F.sum("gn") + F.count("ag")).alias("gn"), (F.coalesce(F.sum("gs"), F.lit(0.0)) + F.coalesce(F.sum("ag"), F.lit(0.0))).alias("gs"), (F.coalesce(F.sum("gq"), F.lit(0.0)) + F.coalesce(F.sum(F.col("ag") * F.col("ag")), F.lit(0.0))).alias("gq"),
    )
    limit = F.col("event_density_mean") + 2 * F.col("event_density_std")
    bursts = per_day.select("cnt", F.lit(1).alias("_k")).join(F.broadcast(stats.select(limit.alias("limit"), F.lit(1).alias("_k"))), "_k").agg(F.count_if(F.col("cnt") > F.col("limit")).alias("unusual_high_activity_days"), F.lit(1).alias("_k"))
    mean = F.try_divide("gs", "gn")
    spread = F.sqrt(F.try_divide(F.greatest(F.col("gq") - F.col("gn") * mean * mean, F.lit(0.0)), F.col("gn") - 1))
    return stats.withColumn("_k", F.lit(1)).join(bursts, "_k").select("event_count", "event_density_mean", "event_density_std", F.col("peak.day").alias("peak_day"), (-F.col("peak.k")).alias("peak_day_count"), "unusual_high_activity_days", mean.alias("avg_time_between_events"), spread.alias("time_between_events_spread"))


def event_columns(df: DataFrame, member: str, columns: list[str]) -> DataFrame:
    """Scores of text columns that may record events: diversity overall and within members; 3 or more qualifies."""
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("v")) for c in columns])
    x = df.select(F.col(member).alias("m"), F.inline(cells))
    n = x.groupBy("column_name").agg(F.count("*").alias("n_rows"))
    distinct = x.where("v is not null").groupBy("column_name", "v").agg(F.lit(1).alias("one")).groupBy("column_name").agg(F.count("*").alias("n_unique"))
    pairs = x.where("m is not null").groupBy("column_name", "m", "v").agg(F.lit(1).alias("one"))
    per = pairs.groupBy("column_name", "m").agg(F.count("v").alias("u")).groupBy("column_name").agg(F.avg("u").alias("avg_unique_per_patient"), F.avg((F.col("u") > 1).cast("double")).alias("patient_diversity"))
    both = n.join(per, "column_name").join(distinct, "column_name", "left")
    ratio = F.try_divide(F.coalesce("n_unique", F.lit(0)).cast("double"), F.col("n_rows"))
    score = F.when((ratio > 0.01) & (ratio < 0.5), 1).otherwise(0) + F.when(F.col("avg_unique_per_patient") > 1.2, 2).otherwise(0) + F.when(F.col("patient_diversity") > 0.3, 2).otherwise(0)
    return both.select("column_name", score.alias("score"), "avg_unique_per_patient", "patient_diversity").where("score >= 3")


def repeat_structure(df: DataFrame, member: str) -> DataFrame:
    """Variation of rows per member and the share of members with more than one."""
    per = df.where(F.col(member).isNotNull()).groupBy(member).agg(F.count("*").alias("k"))
    return per.agg(F.try_divide(F.stddev_samp("k"), F.avg("k")).alias("row_variability"), F.avg((F.col("k") > 1).cast("double")).alias("repeat_ratio"))


def dataset_kind(repeat: dict, n_event_columns: int, n_entities: int) -> str:
    """A plain classification from the scores: cross-sectional, event log, panel or longitudinal."""
    if (repeat["repeat_ratio"] or 0.0) < 0.05:
        return "cross-sectional"
    if n_event_columns and (repeat["row_variability"] or 0.0) > 0.5:
        return "event log"
    return "panel" if n_entities <= 50 and (repeat["row_variability"] or 0.0) < 0.05 else "longitudinal"


def spectrum(values: np.ndarray, times: np.ndarray | None = None, least: int = 8, top: int = 3) -> dict | None:
    """Dominant period of one series: linear detrend, Blackman window, amplitude spectrum without its constant part.

    None for fewer than ``least`` values or irregular times (deviation of the steps above half their median).
    """
    ok = ~np.isnan(values)
    v, rate = values[ok], 1.0
    if len(v) < least:
        return None
    if times is not None:
        steps = np.diff(times[ok].astype(float))
        steps = steps[steps > 0]
        if len(steps):
            if np.std(steps) / (np.median(steps) + 1e-8) > 0.5:
                return None
            rate = 1.0 / np.median(steps)
    x = np.arange(len(v))
    v = v - np.polyval(np.polyfit(x, v, 1), x)
    power = np.abs(np.fft.rfft(v * np.blackman(len(v))))[1:]
    freq = np.fft.rfftfreq(len(v), d=1.0 / rate)[1:]
    order = np.argsort(power, kind="stable")[::-1][:top]
    return {"dominant_frequency": float(freq[order[0]]), "dominant_period": float(1 / freq[order[0]]), "seasonality_strength": float(power[order[0]]), "top_frequencies": [float(f) for f in freq[order]], "top_periods": [float(1 / f) for f in freq[order]], "top_powers": [float(p) for p in power[order]], "frequencies": [float(f) for f in freq], "power_spectrum": [float(p) for p in power]}


SPECTRUM_SCHEMA = "key string, dominant_frequency double, dominant_period double, seasonality_strength double, top_frequencies array<double>, top_periods array<double>, top_powers array<double>, frequencies array<double>, power_spectrum array<double>"


def seasonality(series: DataFrame, key: str, x: str = "x", value: str = "value") -> DataFrame:
    """Spectrum of each period series (key, x in order, value); series without one have no row."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(x, kind="stable")
        s = spectrum(pdf[value].to_numpy(dtype=float), pdf[x].to_numpy(dtype=float))
        names = [c.split()[0] for c in SPECTRUM_SCHEMA.split(", ")]
        return pd.DataFrame([] if s is None else [{"key": str(pdf[key].iloc[0]), **s}], columns=names)

    return series.groupBy(key).applyInPandas(run, SPECTRUM_SCHEMA)


def peaks(df: DataFrame, keys: list[str], x: str, y: str, k: int, least: float | None = None) -> DataFrame:
    """The k highest local maxima of each curve; the highest point where there is none, or if k is 1."""
    w = Window.partitionBy(*keys).orderBy(x)
    tall = F.lit(True) if least is None else F.col(y) >= least
    p = df.withColumn("_p", (F.lag(y).over(w) < F.col(y)) & (F.lead(y).over(w) < F.col(y)) & tall & F.lit(k > 1))
    every = Window.partitionBy(*keys)
    p = p.withColumn("_p", F.coalesce("_p", F.lit(False)).cast("int")).withColumn("_any", F.max("_p").over(every))
    p = p.withColumn("place", F.row_number().over(every.orderBy(F.desc("_p"), F.desc(y), x)))
    return p.where((F.col("_p") == 1) & (F.col("place") <= k) | (F.col("_any") == 0) & (F.col("place") == 1)).select(*keys, x, y, "place")


def periods_to_dates(df: DataFrame, period: str) -> DataFrame:
    """Period texts as dates in order; texts that are none drop."""
    day = F.coalesce(F.try_to_timestamp(F.col(period), F.lit("yyyy-MM-dd")), F.try_to_timestamp(F.col(period), F.lit("yyyy-MM")), F.try_to_timestamp(F.col(period), F.lit("yyyy")))
    return df.withColumn("day", day.cast("date")).where("day is not null").orderBy("day")


def running_share(df: DataFrame, keys: list[str], order: str, value: str, threshold: float = 0.9) -> DataFrame:
    """Cumulative share and the first place (from 1) at which it reaches the threshold."""
    w = Window.partitionBy(*(keys or [F.lit(1)])).orderBy(order)
    every = Window.partitionBy(*(keys or [F.lit(1)]))
    x = df.withColumn("cum", sc.safe_ratio(F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.sum(value).over(every))).withColumn("place", F.row_number().over(w))
    return x.withColumn("n_needed", F.min(F.when(F.col("cum") >= threshold - 1e-12, F.col("place"))).over(every))


def fit_line(df: DataFrame, x: str, y: str, keys: list[str] | None = None) -> DataFrame:
    """Least-squares line over complete pairs, for more than two of them."""
    a, b = sc.as_number(F.col(x)), sc.as_number(F.col(y))
    g = df.where(a.isNotNull() & b.isNotNull()).groupBy(*(keys or [])).agg(F.count("*").alias("n"), F.regr_slope(b, a).alias("slope"), F.regr_intercept(b, a).alias("intercept"))
    return g.where("n > 2")
