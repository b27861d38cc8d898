"""Descriptive statistics of one or many sites, all columns at once.

Tables are melted inside the job (one row per value) and aggregated by site and column, with partial
aggregation before every shuffle; nothing loops over columns on the driver. Quantiles, modes and
outliers come from counts by value: a sorted running sum (``running``), which spills and is split
for large inputs, instead of an aggregate that holds every value of a group in memory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitewise.functions import scalars as sc
from sitewise.operators.running import running

KEY = ["node_id", "column_name"]


def melt(df: DataFrame, node: Column, columns: list[str], kind: str = "double") -> DataFrame:
    """node_id, column_name, value; NaN becomes null for numbers."""
    cast = (lambda c: sc.as_number(F.col(c))) if kind == "double" else (lambda c: F.col(c).cast(kind))
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), cast(c).alias("value")) for c in columns])
    return df.select(node.alias("node_id"), F.inline(cells))


def value_counts(melted: DataFrame) -> DataFrame:
    return melted.where("value is not null").groupBy(*KEY, "value").agg(F.count("*").alias("cnt"))


def quantiles(counts: DataFrame, points: dict[str, float], keys: list[str] = KEY) -> DataFrame:
    """Linearly interpolated quantiles of each group of value counts."""
    aggs = []
    for name, p in points.items():
        at = f"(n - 1) * {p!r}d"
        aggs += [f"min(case when upto > floor({at}) then value end) as {name}_lo", f"min(case when upto > ceil({at}) then value end) as {name}_hi", f"max({at} - floor({at})) as {name}_f"]
    got = running(counts, keys).groupBy(*keys).agg(*[F.expr(a) for a in aggs])
    return got.selectExpr(*keys, *[f"{q}_lo + ({q}_hi - {q}_lo) * {q}_f as {q}" for q in points])


def numeric_profile(melted: DataFrame) -> DataFrame:
    """One row per site and numeric column: moments, quartiles, mode, outliers, shape, missing values."""
    v = F.col("value")
    base = melted.groupBy(*KEY).agg(
        F.count("value").alias("count"), F.count_if(v.isNull()).alias("missing_values"), F.avg("value").alias("mean"), F.min("value").alias("min"), F.max("value").alias("max"),
        F.var_samp("value").alias("variance"), F.stddev_samp("value").alias("std_dev"), F.skewness("value").alias("g1"), F.kurtosis("value").alias("g2"),
    )
    counts = value_counts(melted)
    q = quantiles(counts, {"q25": 0.25, "median": 0.5, "q75": 0.75})
    top = counts.groupBy(*KEY).agg(F.max(F.struct(F.col("cnt"), (-F.col("value")).alias("neg"))).alias("t")).select(*KEY, (-F.col("t.neg")).alias("mode"), F.col("t.cnt").alias("frequency"))
    iqr = F.col("q75") - F.col("q25")
    far = (v < F.col("q25") - 1.5 * iqr) | (v > F.col("q75") + 1.5 * iqr)
    outliers = counts.join(q, KEY).groupBy(*KEY).agg(F.coalesce(F.sum(F.when(far, F.col("cnt"))), F.lit(0)).alias("outliers"))
    both = base.join(q, KEY, "left").join(top, KEY, "left").join(outliers, KEY, "left")
    return both.select(
        *KEY, "count", "missing_values", "mean", "median", "mode", "min", "max", "variance", "std_dev", "q25", "q75", iqr.alias("iqr"), "outliers", "frequency",
        (sc.safe_ratio(F.col("frequency"), F.col("count")) * 100).alias("relative_frequency"),
        sc.corrected_skewness(F.col("g1"), F.col("count"), F.col("variance")).alias("skewness"), sc.corrected_kurtosis(F.col("g2"), F.col("count"), F.col("variance")).alias("kurtosis"),
    )


def box_numbers(profile: DataFrame) -> DataFrame:
    """Five numbers with whiskers clipped to the data."""
    return profile.select(*KEY, F.greatest("min", F.col("q25") - 1.5 * F.col("iqr")).alias("whisker_low"), "q25", "median", "q75", F.least("max", F.col("q75") + 1.5 * F.col("iqr")).alias("whisker_high"))


def category_counts(melted: DataFrame) -> DataFrame:
    """Counts and shares (%) per site, column and category."""
    counts = value_counts(melted)
    return counts.withColumn("share", sc.safe_ratio(F.col("cnt"), F.sum("cnt").over(Window.partitionBy(*KEY))) * 100)


def categorical_profile(melted: DataFrame) -> DataFrame:
    """One row per site and categorical column; the smaller label wins ties."""
    base = melted.groupBy(*KEY).agg(F.count("value").alias("count"), F.count_if(F.col("value").isNull()).alias("missing_values"))
    c = value_counts(melted)
    per = c.groupBy(*KEY).agg(
        F.count("*").alias("number_of_categories"), F.min(F.struct((-F.col("cnt")).alias("k"), F.col("value"))).alias("most"), F.min(F.struct(F.col("cnt").alias("k"), F.col("value"))).alias("least"), F.max("cnt").alias("hi"), F.min("cnt").alias("lo"),
    )
    return base.join(per, KEY, "left").select(*KEY, "count", "missing_values", F.coalesce("number_of_categories", F.lit(0)).alias("number_of_categories"), F.col("most.value").alias("most_frequent"), F.col("least.value").alias("least_frequent"), sc.safe_ratio(F.col("hi"), F.col("lo")).alias("class_imbalance_ratio"))


def category_maps(melted: DataFrame, max_categories: int = 1000) -> DataFrame:
    """Counts of a column as a map, for columns with at most ``max_categories`` categories (others: null)."""
    c = value_counts(melted)
    few = c.groupBy(*KEY).agg(F.count("*").alias("k")).where(F.col("k") <= max_categories)
    packed = c.join(few, KEY).groupBy(*KEY).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("value", "cnt")))).alias("category_counts"))
    return c.select(*KEY).distinct().join(packed, KEY, "left")


def period_counts(melted: DataFrame, freq: str = "M") -> DataFrame:
    """Counts per site, column and period; ``value`` is a date or timestamp."""
    return melted.where("value is not null").groupBy(*KEY, sc.period_label(F.col("value"), freq).alias("period")).agg(F.count("*").alias("cnt"))


def missing_periods(melted: DataFrame, freq: str = "M") -> DataFrame:
    """Periods between the first and the last observation without any."""
    unit = sc.PERIOD_UNITS[freq]
    span = melted.where("value is not null").groupBy(*KEY).agg(F.date_trunc(unit, F.min("value")).alias("a"), F.date_trunc(unit, F.max("value")).alias("b"))
    every = span.select(*KEY, F.explode(F.sequence(F.col("a"), F.col("b"), F.expr(f"interval 1 {unit}"))).alias("p")).select(*KEY, sc.period_label(F.col("p"), freq).alias("period"))
    return every.join(period_counts(melted, freq), [*KEY, "period"], "left_anti")


def temporal_profile(melted: DataFrame, freq: str = "M") -> DataFrame:
    """One row per site and date column; the earliest of equally active periods."""
    base = melted.groupBy(*KEY).agg(F.count("value").alias("count"), F.count_if(F.col("value").isNull()).alias("missing_values"), F.min("value").alias("min"), F.max("value").alias("max"))
    p = period_counts(melted, freq).groupBy(*KEY).agg(F.min(F.struct((-F.col("cnt")).alias("k"), F.col("period"))).alias("top"), F.count("*").alias("n_periods"))
    gaps = missing_periods(melted, freq).groupBy(*KEY).agg(F.count("*").alias("n_missing_periods"))
    both = base.join(p, KEY, "left").join(gaps, KEY, "left")
    return both.select(*KEY, "count", "missing_values", "min", "max", F.datediff("max", "min").alias("range_days"), "n_periods", F.col("top.period").alias("most_active_period"), F.coalesce("n_missing_periods", F.lit(0)).alias("n_missing_periods"))


def observations_per_member(df: DataFrame, member: str, time: str) -> DataFrame:
    return df.where(F.col(time).isNotNull()).groupBy(member).agg(F.count("*").alias("n_observations"))


def fixed_histogram(df: DataFrame, column: str, width: float = 5.0, top: float = 100.0) -> DataFrame:
    """Counts in [a, a + width) from 0 to ``top``, the last bin closed; empty bins stay, values outside drop."""
    k = int(top / width)
    v = sc.as_number(F.col(column))
    got = df.select(v.alias("v")).where((F.col("v") >= 0) & (F.col("v") <= top)).groupBy(F.least(F.floor(F.col("v") / width), F.lit(k - 1)).cast("int").alias("bin")).agg(F.count("*").alias("cnt"))
    bins = df.sparkSession.range(k).select(F.col("id").cast("int").alias("bin"))
    return bins.join(F.broadcast(got), "bin", "left").select("bin", (F.col("bin") * width).alias("lower"), ((F.col("bin") + 1) * width).alias("upper"), F.coalesce("cnt", F.lit(0)).alias("cnt"))


def out_of_range(df: DataFrame, column: str, top: float = 100.0) -> DataFrame:
    v = sc.as_number(F.col(column))
    return df.agg(F.count_if((v < 0) | (v > top)).alias("n_out_of_range"), F.count(v).alias("n_values"))


def missing_by_column(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column_name, n_rows, n_missing of every column (NaN counts as missing)."""
    columns = columns or df.columns
    kinds = dict(df.dtypes)
    gone = {c: (F.col(f"`{c}`").isNull() | F.isnan(F.col(f"`{c}`"))) if kinds[c] in ("double", "float") else F.col(f"`{c}`").isNull() for c in columns}
    one = df.agg(F.count("*").alias("n_rows"), *[F.count_if(g).alias(f"m{i}") for i, g in enumerate(gone.values())])
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"m{i}").alias("n_missing")) for i, c in enumerate(gone)])
    return one.select("n_rows", F.inline(cells)).select("column_name", "n_rows", "n_missing")


def missing_share(df: DataFrame, identifiers: list[str]) -> DataFrame:
    """Missing values of all columns over the cells of the analytical ones (identifiers left out below only)."""
    m = missing_by_column(df)
    cells = len([c for c in df.columns if c not in identifiers])
    return m.agg(F.sum("n_missing").alias("total_missing"), F.max("n_rows").alias("n_rows")).select("total_missing", (F.col("n_rows") * cells).alias("n_cells"), (sc.safe_ratio(F.col("total_missing"), F.col("n_rows") * cells) * 100).alias("missing_percent"))


def completeness(df: DataFrame, top: int = 50, chunk: int = 20) -> DataFrame:
    """The least complete columns with their place and the chunk they are shown in."""
    m = missing_by_column(df).withColumn("missing_percent", sc.safe_ratio(F.col("n_missing"), F.col("n_rows")) * 100).orderBy(F.desc("missing_percent"), "column_name").limit(top)
    rank = F.row_number().over(Window.orderBy(F.desc("missing_percent"), "column_name"))  # at most ``top`` rows
    return m.withColumn("place", rank).withColumn("chunk", F.floor((F.col("place") - 1) / chunk).cast("int")).withColumn("present_percent", 100 - F.col("missing_percent"))


def most_missing(df: DataFrame, top: int = 10) -> DataFrame:
    """The columns with most missing values, or simply the first ones if nothing is missing."""
    m = missing_by_column(df)
    order = F.create_map(*[x for i, c in enumerate(df.columns) for x in (F.lit(c), F.lit(i))])
    m = m.withColumn("pos", order[F.col("column_name")]).withColumn("hit", (F.col("n_missing") > 0).cast("int"))
    ranked = m.withColumn("any_hit", F.max("hit").over(Window.partitionBy(F.lit(1)))).where("hit = any_hit")  # one row per column
    return ranked.orderBy(F.desc("n_missing"), "pos").limit(top).select("column_name", "n_missing")


def duplicate_rows(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows after the first of equal ones; null equals null."""
    columns = columns or df.columns
    groups = df.groupBy(*[F.col(f"`{c}`") for c in columns]).agg(F.count("*").alias("k"))
    return groups.agg(F.sum("k").alias("n_rows"), F.count("*").alias("n_distinct")).select(F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.coalesce(F.col("n_rows") - F.col("n_distinct"), F.lit(0)).alias("n_duplicates"))


def counts_with_missing(df: DataFrame, column: str) -> DataFrame:
    """Value counts with missing values as 'nan'."""
    return df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("nan")).alias("value")).agg(F.count("*").alias("cnt"))


SEX_LABELS = {"m": "male", "male": "male", "f": "female", "female": "female", "nb": "non-binary", "nonbinary": "non-binary", "non-binary": "non-binary"}


def sex_label(c: Column) -> Column:
    """male, female or non-binary; null for anything else."""
    known = F.create_map(*[F.lit(x) for kv in SEX_LABELS.items() for x in kv])
    return F.try_element_at(known, F.lower(F.trim(c.cast("string"))))


def sex_column(columns: list[str]) -> str | None:
    """The first column whose name contains sex or gender."""
    return next((c for c in columns if "sex" in c.lower() or "gender" in c.lower()), None)


def auto_bins(profile: DataFrame) -> DataFrame:
    """Number of display bins per column: Freedman-Diaconis within [5, 50], Sturges without spread, few values as they are."""
    n, span = F.col("count").cast("double"), F.col("max") - F.col("min")
    fd = F.ceil(F.try_divide(span, 2 * F.col("iqr") / F.cbrt(n)))
    sturges = F.ceil(F.log2(n) + 1)
    bins = F.when(F.col("count") < 4, F.greatest(F.col("count"), F.lit(1))).when(span == 0, 1).when(F.col("iqr") == 0, sturges).otherwise(F.least(F.greatest(fd, F.lit(5)), F.lit(50)))
    return profile.select(*KEY, bins.cast("int").alias("n_bins"))


def auto_histogram(melted: DataFrame, profile: DataFrame) -> DataFrame:
    """Equal bins of the narrower of the Freedman-Diaconis and Sturges widths, for columns with two values or more."""
    n, span = F.col("count").cast("double"), F.col("max") - F.col("min")
    sturges = span / (F.log2(n) + 1)
    fd = 2 * F.col("iqr") / F.cbrt(n)
    width = F.when(fd > 0, F.least(fd, sturges)).otherwise(sturges)
    plan = profile.where("count >= 2").select(*KEY, "min", "max", F.when(span > 0, F.ceil(span / width)).otherwise(1).cast("int").alias("k"))
    c = value_counts(melted).join(plan, KEY)
    at = F.when(F.col("max") > F.col("min"), F.least(F.floor((F.col("value") - F.col("min")) / (F.col("max") - F.col("min")) * F.col("k")), F.col("k") - 1)).otherwise(0)
    return c.groupBy(*KEY, "k", at.cast("int").alias("bin")).agg(F.sum("cnt").alias("cnt")).withColumnRenamed("k", "n_bins")


def pair_cells(columns: list[str]) -> list[tuple[str, str]]:
    return [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]


def nullity_correlation(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson of the missing masks of each pair of columns; null for a column with nothing (or all) missing."""
    kinds = dict(df.dtypes)
    masks = df.select(*[(F.col(c).isNull() | F.isnan(c) if kinds[c] in ("double", "float") else F.col(c).isNull()).cast("double").alias(c) for c in columns])
    return correlation_pairs(masks, columns)


def correlation_pairs(df: DataFrame, columns: list[str], chunk: int = 150) -> DataFrame:
    """var1, var2, n, r of every pair, pairwise complete; pairs are computed ``chunk`` to a job stage."""
    out = None
    pairs = pair_cells(columns)
    for i in range(0, len(pairs), chunk):
        part = pairs[i : i + chunk]
        v = {c: sc.as_number(F.col(c)) for p in part for c in p}
        one = df.agg(*[x for k, (a, b) in enumerate(part) for x in (F.count_if(v[a].isNotNull() & v[b].isNotNull()).alias(f"n{k}"), sc.correlation(v[a], v[b]).alias(f"r{k}"))])
        cells = F.array(*[F.struct(F.lit(a).alias("var1"), F.lit(b).alias("var2"), F.col(f"n{k}").alias("n"), F.col(f"r{k}").alias("r")) for k, (a, b) in enumerate(part)])
        rows = one.select(F.inline(cells))
        out = rows if out is None else out.unionByName(rows)
    return out if out is not None else df.sparkSession.createDataFrame([], "var1 string, var2 string, n long, r double")


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts of the combinations of two columns, missing values dropped."""
    return df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).agg(F.count("*").alias("cnt"))


def year_month(df: DataFrame, time: str) -> DataFrame:
    """Counts by year and month as a wide table; empty without at least two years."""
    months = [f"{m:02d}" for m in range(1, 13)]
    wide = df.where(F.col(time).isNotNull()).select(F.date_format(time, "yyyy").alias("year"), F.date_format(time, "MM").alias("month")).groupBy("year").pivot("month", months)
    table = wide.count().na.fill(0)
    return table.withColumn("_n", F.count("*").over(Window.partitionBy(F.lit(1)))).where("_n >= 2").drop("_n").select("year", *[F.col(m).alias(f"m{m}") for m in months])
