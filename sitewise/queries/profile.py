"""Queries of the descriptive statistics, per site."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewise.functions import scalars as sc
from sitewise.operators import descriptive as ds
from sitewise.session import nan_to_null, table

MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
VITALS = ["age", "trestbps", "chol", "thalach", "oldpeak"]


def lineitem_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ds.melt(table(spark, sf_dir, "lineitem"), F.col("l_returnflag"), MEASURES)


def heart_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ds.melt(table(spark, sf_dir, "heart_disease_cleveland"), F.col("node_id"), VITALS)


def _rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def order_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with the site of their customer."""
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    return o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).withColumn("node", F.col("n_regionkey").cast("string"))


def order_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ds.melt(order_labels(spark, sf_dir), F.col("node"), ["o_orderstatus", "o_orderpriority", "c_mktsegment"], "string")


def date_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ds.melt(table(spark, sf_dir, "longitudinal"), F.col("node_id"), ["visit_date", "recorded_at"], "timestamp_ntz")


def a1(spark, d):
    return _rounded(ds.numeric_profile(lineitem_cells(spark, d)))


def a1_heart(spark, d):
    return _rounded(ds.numeric_profile(heart_cells(spark, d)))


def a2(spark, d):
    return _rounded(ds.categorical_profile(order_cells(spark, d)))


def a2_counts(spark, d):
    return _rounded(ds.category_counts(order_cells(spark, d)))


def a2_maps(spark, d):
    return ds.category_maps(order_cells(spark, d)).select(*ds.KEY, F.to_json("category_counts").alias("category_counts"))


def a3(spark, d):
    t = ds.temporal_profile(date_cells(spark, d))
    return t.select(*[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) if c in ("min", "max") else F.col(c) for c in t.columns])


def a3_missing(spark, d):
    return ds.missing_periods(ds.melt(table(spark, d, "documents").where("source is not null"), F.col("source"), ["written_at"], "timestamp_ntz"), "D")


def a3_members(spark, d):
    return ds.observations_per_member(table(spark, d, "longitudinal"), "patient_id", "visit_date").groupBy("n_observations").agg(F.count("*").alias("n_patients"))


def a4(spark, d):
    return ds.fixed_histogram(table(spark, d, "heart_disease_cleveland"), "age")


def a4_sizes(spark, d):
    return ds.fixed_histogram(table(spark, d, "part"), "p_size", 5, 50)


def a5(spark, d):
    return ds.out_of_range(table(spark, d, "heart_disease_cleveland"), "age")


def a6(spark, d):
    return ds.missing_by_column(table(spark, d, "heart_disease_cleveland"))


def a7(spark, d):
    return _rounded(ds.missing_share(table(spark, d, "breast_cancer_gbsg"), ["record_id", "pid", "rownames"]))


def a8(spark, d):
    h = table(spark, d, "heart_disease_cleveland")
    return ds.duplicate_rows(nan_to_null(h), [c for c in h.columns if c != "record_id"])


def a9(spark, d):
    return ds.counts_with_missing(table(spark, d, "breast_cancer_gbsg"), "grade")


def a10(spark, d):
    return ds.counts_with_missing(table(spark, d, "longitudinal"), "sex")


def a11(spark, d):
    return ds.counts_with_missing(table(spark, d, "review_labels"), "abusive")


def a12(spark, d):
    x = table(spark, d, "longitudinal")
    return x.groupBy("node_id", ds.sex_label(F.col(ds.sex_column(x.columns))).alias("sex")).agg(F.count("*").alias("cnt"))


def a13(spark, d):
    cells = lineitem_cells(spark, d).where("column_name in ('l_quantity', 'l_discount', 'l_tax')")
    return ds.auto_histogram(cells, ds.numeric_profile(cells))


def a14(spark, d):
    return ds.auto_bins(ds.numeric_profile(heart_cells(spark, d)))


def a15(spark, d):
    return _rounded(ds.nullity_correlation(table(spark, d, "heart_disease_cleveland"), ["chol", "slope", "ca", "thal", "fbs"]))


def a16(spark, d):
    x = ds.completeness(table(spark, d, "heart_disease_cleveland"), 50)
    return x.select("column_name", F.round(100 - F.col("missing_percent"), 4).alias("completeness"), "place")


def a17(spark, d):
    return _rounded(ds.completeness(table(spark, d, "breast_cancer_gbsg"), 50, 5).select("column_name", "missing_percent", "present_percent", "chunk"))


def a18(spark, d):
    return ds.crosstab(order_labels(spark, d), "o_orderstatus", "o_orderpriority")


def a19(spark, d):
    return ds.year_month(table(spark, d, "orders"), "o_orderdate")


def a20(spark, d):
    return _rounded(ds.correlation_pairs(table(spark, d, "heart_disease_cleveland"), VITALS), 6)


def a21(spark, d):
    return _rounded(ds.box_numbers(ds.numeric_profile(heart_cells(spark, d))))


def f16_series(spark, d):
    p = ds.numeric_profile(lineitem_cells(spark, d))
    return _rounded(p.select(*ds.KEY, "mean", (F.col("mean") - F.col("std_dev")).alias("low"), (F.col("mean") + F.col("std_dev")).alias("high")))


def k13(spark, d):
    return ds.most_missing(table(spark, d, "heart_disease_cleveland"), 10)


QUERIES = {
    "A1_numeric_profile": a1, "A1_numeric_profile_heart": a1_heart, "A2_categorical_profile": a2, "A2_category_counts": a2_counts, "A2_category_maps": a2_maps, "A3_temporal_profile": a3, "A3_missing_periods": a3_missing, "A3b_observations_per_patient": a3_members,
    "A4_age_histogram": a4, "A4_fixed_histogram": a4_sizes, "A5_out_of_range_ages": a5, "A6_missing_by_column": a6, "A7_missing_share": a7, "A8_duplicate_rows": a8, "A9_value_counts": a9, "A10_sex_distribution": a10, "A11_label_distribution": a11, "A12_sex_counts": a12,
    "A13_auto_histogram": a13, "A14_auto_bins": a14, "A15_nullity_correlation": a15, "A16_completeness": a16, "A17_missing_chunks": a17, "A18_contingency": a18, "A19_year_month": a19, "A20_pearson_matrix": a20, "A21_box_numbers": a21, "F16_mean_bands": f16_series, "K13_most_missing": k13,
}


def _melt_sql(tab: str, node: str, cols: list[str], num: bool = True) -> str:
    v = lambda c: f"CASE WHEN isnan(CAST({c} AS DOUBLE)) THEN NULL ELSE CAST({c} AS DOUBLE) END" if num else c
    return " UNION ALL ".join(f"SELECT {node} AS node_id, '{c}' AS column_name, {v(c)} AS value FROM {tab}" for c in cols)


_PROFILE = """c AS (SELECT node_id, column_name, value, count(*) AS cnt FROM m WHERE value IS NOT NULL GROUP BY ALL),
t AS (SELECT node_id, column_name, first(value ORDER BY cnt DESC, value) AS mode, max(cnt) AS frequency FROM c GROUP BY ALL),
b AS (SELECT node_id, column_name, count(value) AS count, count(*) - count(value) AS missing_values, avg(value) AS mean, median(value) AS median, min(value) AS min, max(value) AS max,
 var_samp(value) AS variance, stddev_samp(value) AS std_dev, quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.75) AS q75, skewness(value) AS skewness, kurtosis(value) AS kurtosis FROM m GROUP BY ALL),
o AS (SELECT m.node_id, m.column_name, count(*) FILTER (value < q25 - 1.5 * (q75 - q25) OR value > q75 + 1.5 * (q75 - q25)) AS outliers FROM m JOIN b USING (node_id, column_name) GROUP BY ALL),
p AS (SELECT b.*, q75 - q25 AS iqr, t.mode, t.frequency, o.outliers FROM b JOIN t USING (node_id, column_name) JOIN o USING (node_id, column_name))"""
_PROFILE_OUT = """SELECT node_id, column_name, count, missing_values, round(mean, 4) AS mean, round(median, 4) AS median, round(mode, 4) AS mode, round(min, 4) AS min, round(max, 4) AS max, round(variance, 4) AS variance, round(std_dev, 4) AS std_dev,
 round(q25, 4) AS q25, round(q75, 4) AS q75, round(iqr, 4) AS iqr, outliers, frequency, round(frequency * 100.0 / count, 4) AS relative_frequency, round(skewness, 4) AS skewness, round(kurtosis, 4) AS kurtosis FROM p"""
LINE_SQL = f"m AS ({_melt_sql('lineitem', 'l_returnflag', MEASURES)}), {_PROFILE}"
HEART_SQL = f"m AS ({_melt_sql('heart_disease_cleveland', 'node_id', VITALS)}), {_PROFILE}"
ORDERS_SQL = "x AS (SELECT o.*, c_mktsegment, CAST(n_regionkey AS VARCHAR) AS node FROM orders o JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"
LABEL_SQL = f"{ORDERS_SQL}, m AS ({_melt_sql('x', 'node', ['o_orderstatus', 'o_orderpriority', 'c_mktsegment'], False)}), c AS (SELECT node_id, column_name, value, count(*) AS cnt FROM m WHERE value IS NOT NULL GROUP BY ALL)"
_HEART_COLS = ["record_id", "patient_id", "node_id", "load_id", "visit_date", "age", "sex", "cp", "trestbps", "chol", "fbs", "restecg", "thalach", "exang", "oldpeak", "slope", "ca", "thal", "num"]
_HEART_DBL = _HEART_COLS[5:18]
_GBSG_COLS = ["record_id", "node_id", "load_id", "rownames", "pid", "age", "meno", "size", "grade", "nodes", "pgr", "er", "hormon", "rfstime", "status", "surgery_date"]


def _missing_sql(tab: str, cols: list[str], dbl: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS column_name, {i} AS pos, count(*) AS n_rows, count(*) FILTER ({c} IS NULL{f' OR isnan({c})' if c in dbl else ''}) AS n_missing FROM {tab}" for i, c in enumerate(cols))


def _corr_sql(tab: str, exprs: dict[str, str], digits: int, n: str) -> str:
    return " UNION ALL ".join(f"SELECT '{a}' AS var1, '{b}' AS var2, {n.format(a=exprs[a], b=exprs[b])} AS n, round(corr({exprs[a]}, {exprs[b]}), {digits}) AS r FROM {tab}" for a, b in ds.pair_cells(list(exprs)))


_clean = lambda c: f"CASE WHEN isnan({c}) THEN NULL ELSE {c} END"
_sex = "CASE lower(trim(sex)) WHEN 'm' THEN 'male' WHEN 'male' THEN 'male' WHEN 'f' THEN 'female' WHEN 'female' THEN 'female' WHEN 'nb' THEN 'non-binary' WHEN 'nonbinary' THEN 'non-binary' WHEN 'non-binary' THEN 'non-binary' END"
_hist = lambda tab, c, w, top: f"SELECT CAST(g.b AS INTEGER) AS bin, g.b * {w:.1f} AS lower, (g.b + 1) * {w:.1f} AS upper, count(h.b) AS cnt FROM range({int(top / w)}) g(b) LEFT JOIN (SELECT least(floor({c} / {w}), {int(top / w) - 1}) AS b FROM {tab} WHERE {c} >= 0 AND {c} <= {top}) h ON h.b = g.b GROUP BY g.b"

ORACLE = {
    "A1_numeric_profile": f"WITH {LINE_SQL} {_PROFILE_OUT}",
    "A1_numeric_profile_heart": f"WITH {HEART_SQL} {_PROFILE_OUT}",
    "A2_categorical_profile": f"""WITH {LABEL_SQL} SELECT node_id, column_name, CAST(sum(cnt) AS BIGINT) AS count, 0 AS missing_values, count(*) AS number_of_categories, first(value ORDER BY cnt DESC, value) AS most_frequent,
 first(value ORDER BY cnt, value) AS least_frequent, round(max(cnt) * 1.0 / min(cnt), 4) AS class_imbalance_ratio FROM c GROUP BY node_id, column_name""",
    "A2_category_counts": f"WITH {LABEL_SQL} SELECT node_id, column_name, value, cnt, round(cnt * 100.0 / sum(cnt) OVER (PARTITION BY node_id, column_name), 4) AS share FROM c",
    "A2_category_maps": f"""WITH {LABEL_SQL} SELECT node_id, column_name, '{{' || string_agg('"' || value || '":' || cnt, ',' ORDER BY value) || '}}' AS category_counts FROM c GROUP BY node_id, column_name""",
    "A3_temporal_profile": """WITH m AS (SELECT node_id, 'visit_date' AS column_name, CAST(visit_date AS TIMESTAMP) AS value FROM longitudinal UNION ALL SELECT node_id, 'recorded_at', recorded_at FROM longitudinal),
p AS (SELECT node_id, column_name, strftime(value, '%Y-%m') AS period, count(*) AS cnt FROM m WHERE value IS NOT NULL GROUP BY ALL),
s AS (SELECT node_id, column_name, count(value) AS count, count(*) - count(value) AS missing_values, min(value) AS lo, max(value) AS hi FROM m GROUP BY ALL),
t AS (SELECT node_id, column_name, first(period ORDER BY cnt DESC, period) AS most_active_period, count(*) AS n_periods FROM p GROUP BY ALL)
SELECT node_id, column_name, count, missing_values, strftime(lo, '%Y-%m-%d %H:%M:%S') AS min, strftime(hi, '%Y-%m-%d %H:%M:%S') AS max, date_diff('day', CAST(lo AS DATE), CAST(hi AS DATE)) AS range_days, n_periods, most_active_period,
 date_diff('month', date_trunc('month', lo), date_trunc('month', hi)) + 1 - n_periods AS n_missing_periods FROM s JOIN t USING (node_id, column_name)""",
    "A3_missing_periods": """WITH d AS (SELECT source AS node_id, CAST(written_at AS DATE) AS p FROM documents WHERE source IS NOT NULL AND written_at IS NOT NULL),
s AS (SELECT node_id, min(p) AS a, max(p) AS b FROM d GROUP BY ALL), e AS (SELECT node_id, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS p FROM s)
SELECT e.node_id, 'written_at' AS column_name, strftime(e.p, '%Y-%m-%d') AS period FROM e ANTI JOIN d ON d.node_id = e.node_id AND d.p = e.p""",
    "A3b_observations_per_patient": "SELECT n_observations, count(*) AS n_patients FROM (SELECT patient_id, count(*) AS n_observations FROM longitudinal WHERE visit_date IS NOT NULL GROUP BY ALL) GROUP BY ALL",
    "A4_age_histogram": _hist("heart_disease_cleveland", "age", 5, 100) .replace("WHERE age", "WHERE NOT isnan(age) AND age"),
    "A4_fixed_histogram": _hist("part", "p_size", 5, 50),
    "A5_out_of_range_ages": f"SELECT count(*) FILTER (v < 0 OR v > 100) AS n_out_of_range, count(v) AS n_values FROM (SELECT {_clean('age')} AS v FROM heart_disease_cleveland)",
    "A6_missing_by_column": f"SELECT column_name, n_rows, n_missing FROM ({_missing_sql('heart_disease_cleveland', _HEART_COLS, _HEART_DBL)})",
    "A7_missing_share": f"SELECT CAST(sum(n_missing) AS BIGINT) AS total_missing, max(n_rows) * 13 AS n_cells, round(sum(n_missing) * 100.0 / (max(n_rows) * 13), 4) AS missing_percent FROM ({_missing_sql('breast_cancer_gbsg', _GBSG_COLS, ['pgr'])})",
    "A8_duplicate_rows": f"SELECT CAST(sum(k) AS BIGINT) AS n_rows, CAST(sum(k - 1) AS BIGINT) AS n_duplicates FROM (SELECT count(*) AS k FROM (SELECT {', '.join(_clean(c) + ' AS ' + c if c in _HEART_DBL else c for c in _HEART_COLS if c != 'record_id')} FROM heart_disease_cleveland) GROUP BY ALL)".replace("SELECT count(*) AS k FROM", "SELECT COLUMNS(*), count(*) AS k FROM"),
    "A9_value_counts": "SELECT coalesce(grade, 'nan') AS value, count(*) AS cnt FROM breast_cancer_gbsg GROUP BY ALL",
    "A10_sex_distribution": "SELECT coalesce(sex, 'nan') AS value, count(*) AS cnt FROM longitudinal GROUP BY ALL",
    "A11_label_distribution": "SELECT coalesce(CAST(abusive AS VARCHAR), 'nan') AS value, count(*) AS cnt FROM review_labels GROUP BY ALL",
    "A12_sex_counts": f"SELECT node_id, {_sex} AS sex, count(*) AS cnt FROM longitudinal GROUP BY ALL",
    "A13_auto_histogram": f"""WITH {LINE_SQL}, k AS (SELECT *, CASE WHEN max > min THEN CAST(ceil((max - min) / CASE WHEN iqr > 0 THEN least(2 * iqr / cbrt(count), (max - min) / (log2(count) + 1)) ELSE (max - min) / (log2(count) + 1) END) AS INTEGER) ELSE 1 END AS n_bins FROM p WHERE count >= 2 AND column_name <> 'l_extendedprice')
SELECT k.node_id, k.column_name, n_bins, CAST(CASE WHEN max > min THEN least(floor((value - min) / (max - min) * n_bins), n_bins - 1) ELSE 0 END AS INTEGER) AS bin, count(*) AS cnt FROM k JOIN m USING (node_id, column_name) WHERE value IS NOT NULL GROUP BY ALL""",
    "A14_auto_bins": f"WITH {HEART_SQL} SELECT node_id, column_name, CAST(CASE WHEN count < 4 THEN greatest(count, 1) WHEN max = min THEN 1 WHEN iqr = 0 THEN ceil(log2(count) + 1) ELSE least(greatest(ceil((max - min) / (2 * iqr / cbrt(count))), 5), 50) END AS INTEGER) AS n_bins FROM p",
    "A15_nullity_correlation": _corr_sql("heart_disease_cleveland", {c: f"CAST({c} IS NULL OR isnan({c}) AS INTEGER)" for c in ["chol", "slope", "ca", "thal", "fbs"]}, 4, "count(*)"),
    "A16_completeness": f"SELECT column_name, round(100 - n_missing * 100.0 / n_rows, 4) AS completeness, row_number() OVER (ORDER BY n_missing DESC, column_name) AS place FROM ({_missing_sql('heart_disease_cleveland', _HEART_COLS, _HEART_DBL)})",
    "A17_missing_chunks": f"SELECT column_name, round(n_missing * 100.0 / n_rows, 4) AS missing_percent, round(100 - n_missing * 100.0 / n_rows, 4) AS present_percent, CAST((row_number() OVER (ORDER BY n_missing DESC, column_name) - 1) // 5 AS INTEGER) AS chunk FROM ({_missing_sql('breast_cancer_gbsg', _GBSG_COLS, ['pgr'])})",
    "A18_contingency": "SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS cnt FROM orders GROUP BY ALL",
    "A19_year_month": "SELECT strftime(o_orderdate, '%Y') AS year, " + ", ".join(f"count(*) FILTER (month(o_orderdate) = {m}) AS m{m:02d}" for m in range(1, 13)) + " FROM orders GROUP BY 1",
    "A20_pearson_matrix": _corr_sql("heart_disease_cleveland", {c: _clean(c) for c in VITALS}, 6, "count(*) FILTER (({a}) IS NOT NULL AND ({b}) IS NOT NULL)"),
    "A21_box_numbers": f"WITH {HEART_SQL} SELECT node_id, column_name, round(greatest(min, q25 - 1.5 * iqr), 4) AS whisker_low, round(q25, 4) AS q25, round(median, 4) AS median, round(q75, 4) AS q75, round(least(max, q75 + 1.5 * iqr), 4) AS whisker_high FROM p",
    "F16_mean_bands": f"WITH {LINE_SQL} SELECT node_id, column_name, round(mean, 4) AS mean, round(mean - std_dev, 4) AS low, round(mean + std_dev, 4) AS high FROM p",
    "K13_most_missing": f"SELECT column_name, n_missing FROM ({_missing_sql('heart_disease_cleveland', _HEART_COLS, _HEART_DBL)}) WHERE n_missing > 0 ORDER BY n_missing DESC, pos LIMIT 10",
}
