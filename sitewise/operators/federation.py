"""Merging of per-site summaries into those of the whole, and each site's place in it.

Two routes give the same figures: from summaries (``pooled_numeric`` and the other merges, which only
see one row per site and column) and natively from all rows. Everything below works on summaries, so
its size is sites times columns, whatever the tables hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitewise.functions import scalars as sc
from sitewise.operators import descriptive as ds


def site_overview(df: DataFrame, node: str, columns: list[str], identifiers: list[str]) -> DataFrame:
    """node_id, n_rows, n_cols, n_missing, n_cells of every site."""
    kinds = dict(df.dtypes)
    gone = [(F.col(c).isNull() | F.isnan(c)) if kinds[c] in ("double", "float") else F.col(c).isNull() for c in columns]
    missing = sum((g.cast("long") for g in gone[1:]), gone[0].cast("long"))
    cells = len([c for c in columns if c not in identifiers])
    return df.groupBy(F.col(node).alias("node_id")).agg(F.count("*").alias("n_rows"), F.sum(missing).alias("n_missing")).withColumn("n_cols", F.lit(len(columns))).withColumn("n_cells", F.col("n_rows") * cells)


def overview_totals(overview: DataFrame) -> DataFrame:
    t = overview.agg(F.count("*").alias("n_nodes"), F.sum("n_rows").alias("total_rows"), F.max("n_cols").alias("n_cols"), F.sum("n_missing").alias("total_missing"), F.sum("n_cells").alias("total_cells"))
    return t.withColumn("missing_percent", sc.safe_ratio(F.col("total_missing"), F.col("total_cells")) * 100)


def column_catalogue(melted: DataFrame, least_present: float = 0.0) -> DataFrame:
    """The columns each site has: those whose share of values is above ``least_present``."""
    share = melted.groupBy(*ds.KEY).agg(F.avg(F.col("value").isNotNull().cast("double")).alias("present"))
    return share.where(F.col("present") > least_present).select(*ds.KEY)


def column_coverage(catalogue: DataFrame, n_nodes: int) -> DataFrame:
    """In how many sites a column is, and its label."""
    n = F.col("n_nodes")
    label = F.when(n == n_nodes, "common_all").when(n > 1, "common_partial").otherwise("unique")
    counted = catalogue.groupBy("column_name").agg(F.countDistinct("node_id").alias("n_nodes"))
    return counted.withColumn("coverage", label).withColumn("availability", F.when(n == n_nodes, "common_all").otherwise("not_common_all"))


def local_coverage(catalogue: DataFrame, coverage: DataFrame) -> DataFrame:
    """Every site's columns with their label from its point of view."""
    label = F.when(F.col("coverage") == "unique", "unique_local").otherwise(F.col("coverage"))
    return catalogue.join(coverage, "column_name").select("node_id", "column_name", label.alias("label"))


def coverage_counts(local: DataFrame) -> DataFrame:
    return local.groupBy("node_id", "label").agg(F.count("*").alias("n_columns"))


def missing_total(melted: DataFrame) -> DataFrame:
    return melted.groupBy("column_name").agg(F.count_if(F.col("value").isNull()).alias("n_missing"))


def numeric_partials(melted: DataFrame, digits: int | None = None) -> DataFrame:
    """What a site shares of its numeric columns; ``digits`` rounds before sharing."""
    r = (lambda c: F.round(c, digits)) if digits is not None else (lambda c: c)
    p = melted.groupBy(*ds.KEY).agg(F.count("value").alias("n"), r(F.avg("value")).alias("mean"), r(F.var_samp("value")).alias("variance"), F.min("value").alias("min"), F.max("value").alias("max"))
    return p.where("n > 0")


def pooled_numeric(partials: DataFrame) -> DataFrame:
    """Weighted mean and pooled variance sum((n-1) s^2 + n (m-M)^2) / (N-1); 0 for N <= 1; one-row sites add no s^2."""
    total = partials.groupBy("column_name").agg(F.sum("n").alias("count"), F.sum(F.col("n") * F.col("mean")).alias("s"), F.min("min").alias("min"), F.max("max").alias("max"))
    total = total.withColumn("mean", sc.safe_ratio(F.col("s"), F.col("count")))
    within = F.when(F.col("n") > 1, (F.col("n") - 1) * F.coalesce("variance", F.lit(0.0))).otherwise(0.0)
    both = partials.join(total.select("column_name", F.col("mean").alias("M")), "column_name")
    spread = both.groupBy("column_name").agg(F.sum(within + F.col("n") * F.pow(F.col("mean") - F.col("M"), 2)).alias("ss"))
    variance = F.when(F.col("count") > 1, F.col("ss") / (F.col("count") - 1)).otherwise(0.0)
    return total.join(spread, "column_name").select("column_name", "count", "mean", variance.alias("variance"), F.sqrt(variance).alias("std_dev"), "min", "max")


def native_numeric(melted: DataFrame) -> DataFrame:
    """The same figures from all rows at once."""
    return melted.where("value is not null").groupBy("column_name").agg(F.count("*").alias("count"), F.avg("value").alias("mean"), F.coalesce(F.var_samp("value"), F.lit(0.0)).alias("variance"), F.min("value").alias("min"), F.max("value").alias("max"))


def merged_categories(counts: DataFrame, leave_out: tuple[str, ...] = ("patient_id",)) -> DataFrame:
    """Counts and fractions of every category over all sites; labels merge only if spelled alike."""
    c = counts.where(~F.col("column_name").isin(*leave_out)).groupBy("column_name", "value").agg(F.sum("cnt").alias("cnt"))
    return c.withColumn("fraction", sc.safe_ratio(F.col("cnt"), F.sum("cnt").over(Window.partitionBy("column_name"))))


def merged_modes(merged: DataFrame) -> DataFrame:
    """Most frequent category (smaller label on ties) and number of categories."""
    g = merged.groupBy("column_name").agg(F.count("*").alias("num_categories"), F.min(F.struct((-F.col("cnt")).alias("k"), F.col("value"))).alias("t"))
    return g.select("column_name", "num_categories", F.col("t.value").alias("mode"))


def merged_periods(periods: DataFrame) -> DataFrame:
    return periods.groupBy("column_name", "period").agg(F.sum("cnt").alias("cnt"))


def most_active(merged: DataFrame) -> DataFrame:
    """The period with most observations, the earliest on ties."""
    g = merged.groupBy("column_name").agg(F.min(F.struct((-F.col("cnt")).alias("k"), F.col("period"))).alias("t"), F.sum("cnt").alias("total"))
    return g.select("column_name", F.col("t.period").alias("most_active_period"), "total")


def site_histograms(df: DataFrame, node: str, column: str, width: float = 5.0, top: float = 100.0) -> DataFrame:
    v = sc.as_number(F.col(column))
    last = int(top / width) - 1
    return df.select(F.col(node).alias("node_id"), v.alias("v")).where((F.col("v") >= 0) & (F.col("v") <= top)).groupBy("node_id", F.least(F.floor(F.col("v") / width), F.lit(last)).cast("int").alias("bin")).agg(F.count("*").alias("cnt"))


def merged_histogram(parts: DataFrame) -> DataFrame:
    return parts.groupBy("bin").agg(F.sum("cnt").alias("cnt"))


def contributions(overview: DataFrame) -> DataFrame:
    """Each site's share of rows, cells and values, and its missingness against the whole."""
    # one row per site: the window over all of them is small
    every = Window.partitionBy(F.lit(1))
    t = overview.select("*", *[F.sum(c).over(every).alias(f"t_{c}") for c in ("n_rows", "n_cells", "n_missing")])
    z = lambda a, b: F.coalesce(sc.safe_ratio(a, b), F.lit(0.0))
    have = F.col("n_cells") - F.col("n_missing")
    rate, overall = z(F.col("n_missing"), F.col("n_cells")), z(F.col("t_n_missing"), F.col("t_n_cells"))
    relative = F.coalesce(F.try_divide(rate, overall), F.lit(0.0))
    return t.select(
        "node_id", (z(F.col("n_rows"), F.col("t_n_rows")) * 100).alias("patient_contribution"), z(have, F.col("t_n_cells")).alias("completeness"), z(have, F.col("t_n_cells") - F.col("t_n_missing")).alias("usable_data_contribution"),
        rate.alias("local_missing_rate"), relative.alias("relative_missing"), z(F.col("n_cells"), F.col("t_n_cells")).alias("total_value_contribution"),
        F.when(F.round(relative, 3) > 1, "above federation average").when(F.round(relative, 3) < 1, "below federation average").otherwise("equal to federation average").alias("missing_label"),
    )


def mean_alignment(partials: DataFrame, pooled: DataFrame, digits: int = 3) -> DataFrame:
    """Whether a site's mean lies above, below or at the pooled one (both rounded)."""
    both = partials.join(pooled.select("column_name", F.col("mean").alias("global_mean")), "column_name")
    diff = F.round("mean", digits) - F.round("global_mean", digits)
    return both.select("node_id", "column_name", F.when(F.abs(diff) < 1e-6, "aligned").when(diff > 0, "above_global").otherwise("below_global").alias("alignment"))


def trends(merged: DataFrame, key: str = "column_name", least: int = 3) -> DataFrame:
    """Slope and R^2 of period counts on their order, for series of ``least`` periods or more."""
    x = merged.withColumn("x", (F.row_number().over(Window.partitionBy(key).orderBy("period")) - 1).cast("double"))
    g = x.groupBy(key).agg(F.count("*").alias("n_periods"), F.regr_slope("cnt", "x").alias("slope"), F.regr_r2("cnt", "x").alias("r2"), F.var_pop("cnt").alias("v"))
    return g.where(F.col("n_periods") >= least).select(key, "n_periods", "slope", F.when(F.col("v") > 0, F.col("r2")).otherwise(0.0).alias("r2"))


def type_counts(types: DataFrame) -> DataFrame:
    return types.groupBy("kind").agg(F.count("*").alias("n_columns"))


def top_categories(merged: DataFrame, k: int = 20, more_than: int = 2) -> DataFrame:
    """The ``k`` most frequent categories of columns that have more than ``more_than``."""
    w = Window.partitionBy("column_name")
    r = merged.withColumn("num", F.count("*").over(w)).withColumn("place", F.row_number().over(w.orderBy(F.desc("cnt"), "value")))
    return r.where((F.col("num") > more_than) & (F.col("place") <= k)).select("column_name", "value", "cnt", "place")


def has_converged(result: DataFrame | None = None, last: DataFrame | None = None) -> bool:
    """One pass is always enough: every merge is exact."""
    return True


def against(threshold: float, local: Column, whole: Column) -> tuple[Column, Column]:
    """Label and absolute relative difference of a local figure against that of the whole."""
    rel = F.try_divide(local - whole, whole)
    label = F.when(whole.isNull(), "n/a").when(rel > threshold, "above_average").when(rel < -threshold, "below_average").otherwise("similar")
    return label, F.abs(rel)


def compare_to_whole(local: DataFrame, whole: DataFrame, key: str, value: str, threshold: float = 0.1, whole_value: str | None = None) -> DataFrame:
    """Left join on ``key`` adding <value>_global, vs_global and rel_diff_abs; a whole of 0 is 'similar', none is 'n/a'."""
    g = whole.select(key, F.col(whole_value or value).alias(f"{value}_global"))
    both = local.join(g, key, "left")
    label, rel = against(threshold, F.col(value).cast("double"), F.col(f"{value}_global").cast("double"))
    return both.withColumn("vs_global", label).withColumn("rel_diff_abs", rel)


def compare_categories(local_counts: DataFrame, merged: DataFrame, threshold: float = 0.1) -> DataFrame:
    """The share of a site's top category against the same category's share in the whole."""
    w = Window.partitionBy(*ds.KEY)
    top = local_counts.withColumn("share", sc.safe_ratio(F.col("cnt"), F.sum("cnt").over(w)) * 100).withColumn("place", F.row_number().over(w.orderBy(F.desc("cnt"), "value"))).where("place = 1")
    both = top.join(merged.select("column_name", "value", (F.col("fraction") * 100).alias("global_share")), ["column_name", "value"], "left")
    label, rel = against(threshold, F.col("share"), F.nullif("global_share", F.lit(0.0)))
    return both.select(*ds.KEY, F.col("value").alias("top_category"), F.col("share").alias("local_share"), "global_share", label.alias("vs_global"), rel.alias("rel_diff_abs"))


def with_availability(local: DataFrame, coverage: DataFrame) -> DataFrame:
    """The coverage label of each column, 'unknown' for columns without one."""
    return local.join(coverage.select("column_name", F.col("coverage").alias("availability")), "column_name", "left").withColumn("availability", F.coalesce("availability", F.lit("unknown")))


def column_pairs(columns: DataFrame, kind_a: str, kind_b: str, max_levels: int | None = None) -> DataFrame:
    """Unordered pairs of the column catalogue (column_name, kind, n_levels): a join of names, not of rows."""
    c = columns if max_levels is None else columns.where((F.col("kind") == "numeric") | (F.col("n_levels") <= max_levels))
    a = c.where(F.col("kind") == kind_a).select(F.col("column_name").alias("var1"), F.lit(1).alias("_k"))
    b = c.where(F.col("kind") == kind_b).select(F.col("column_name").alias("var2"), F.lit(1).alias("_k"))
    pairs = a.join(b, "_k")
    return (pairs.where("var1 < var2") if kind_a == kind_b else pairs).select("var1", "var2")
