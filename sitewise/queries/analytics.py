"""Queries of series, group comparisons, associations and reductions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewise.operators import descriptive as ds
from sitewise.operators import federation as fed
from sitewise.operators import inference as inf
from sitewise.operators import reduction as rd
from sitewise.operators import regression as rg
from sitewise.operators import series as se
from sitewise.queries import inference_sql as isql
from sitewise.queries import profile as pf
from sitewise.session import nan_to_null, table

HEART = "heart_disease_cleveland"
NUMS = ["age", "trestbps", "chol", "thalach", "oldpeak"]
TWO = ["sex", "fbs", "exang"]
FEW = ["sex", "cp", "fbs", "restecg", "exang"]
_r = pf._rounded


def _heart(spark, d):
    """The examinations with impossible values of the measurements set to null."""
    h = nan_to_null(table(spark, d, HEART))
    ok = {"age": (0, 120), "trestbps": (40, 280), "chol": (80, 700), "thalach": (30, 240), "oldpeak": (-3, 10)}
    h = h.withColumns({c: F.when(F.col(c).between(*b), F.col(c)) for c, b in ok.items()})
    return h.withColumns({c: F.when(F.col(c).isin(0.0, 1.0), F.col(c)) for c in TWO})


def _months(spark, d):
    return se.period_series(table(spark, d, "orders"), "o_orderdate", F.sum("o_totalprice"))


def w1_rolling(spark, d):
    return _r(se.rolling(_months(spark, d)))


def w1_trend(spark, d):
    return _r(se.trend(_months(spark, d)), 2)


def w2(spark, d):
    x = table(spark, d, "longitudinal")
    return _r(se.longitudinal(x, "patient_id", "visit_date", "weight_kg", ["visit_number", "recorded_at"]))


def w3(spark, d):
    e = se.event_measures(table(spark, d, "events"), "ts")
    return _r(e.withColumn("peak_day", F.date_format("peak_day", "yyyy-MM-dd")), 3)


def w3_daily(spark, d):
    return se.daily_counts(table(spark, d, "events"), "ts").select(F.date_format("day", "yyyy-MM-dd").alias("day"), "cnt")


def w4(spark, d):
    o = pf.order_labels(spark, d)
    m = o.groupBy("n_name", F.to_date(F.date_trunc("month", "o_orderdate")).alias("month")).agg(F.sum("o_totalprice").alias("total"))
    return _r(se.panel(m, "n_name", "month", "total"), 1)


def w5(spark, d):
    return _r(se.event_columns(table(spark, d, "events"), "user_id", ["event_type", "props"]))


def w6(spark, d):
    return _r(se.repeat_structure(table(spark, d, "longitudinal"), "patient_id"))


def w6_kind(spark, d):
    x = table(spark, d, "longitudinal")
    r = se.repeat_structure(x, "patient_id").first().asDict()
    k = se.event_columns(x, "patient_id", ["sex", "node_id"]).count()
    return spark.createDataFrame([(se.dataset_kind(r, k, x.select("patient_id").distinct().count()),)], "kind string")


def _daily_by_node(spark, d):
    x = table(spark, d, "documents").where("node_id is not null and written_at is not null")
    return x.groupBy("node_id", F.to_date("written_at").alias("day")).agg(F.count("*").cast("double").alias("value"))


def w7(spark, d):
    """Seasonality of daily documents over all nodes together and of each busy node, gaps as zeros."""
    x = _daily_by_node(spark, d)
    every = x.groupBy("day").agg(F.sum("value").alias("value")).withColumn("node_id", F.lit("all")).unionByName(x)
    span = every.groupBy("node_id").agg(F.min("day").alias("a"), F.max("day").alias("b"))
    full = span.select("node_id", F.explode(F.sequence("a", "b")).alias("day")).join(every, ["node_id", "day"], "left").select("node_id", F.unix_date("day").alias("x"), F.coalesce("value", F.lit(0.0)).alias("value"))
    return se.seasonality(full, "node_id").select("key", F.round("dominant_period", 4).alias("dominant_period"), F.round("seasonality_strength", 4).alias("seasonality_strength"))


def w8(spark, d):
    m = _months(spark, d).withColumn("grp", F.lit("orders"))
    return _r(se.peaks(m, ["grp"], "period", "value", 5))


def w9(spark, d):
    m = _months(spark, d).select("period").unionByName(table(spark, d, "region").select(F.col("r_name").alias("period")))
    return se.periods_to_dates(m, "period").select("period", F.date_format("day", "yyyy-MM-dd").alias("day"))


def w11(spark, d):
    p = table(spark, d, "lineitem").groupBy("l_shipmode" if "l_shipmode" in table(spark, d, "lineitem").columns else "l_linestatus", "l_returnflag").agg(F.count("*").alias("cnt"))
    p = p.toDF("a", "b", "cnt").withColumn("label", F.concat_ws("/", "a", "b"))
    return _r(se.running_share(p, [], "label", "cnt", 0.8).select("label", "cum", "place", "n_needed"), 6)


def w12(spark, d):
    return _r(se.fit_line(_heart(spark, d), "age", "thalach", ["node_id"]))


# --- group comparisons ---
def _pairs():
    return [(v, g) for v in NUMS for g in TWO]


def _compared(spark, d):
    return inf.compared_groups(inf.comparison_counts(_heart(spark, d), _pairs()))


def _compared_many(spark, d):
    return inf.compared_groups(inf.comparison_counts(_heart(spark, d), [(v, g) for v in NUMS for g in ("cp", "restecg")]))


def i2(spark, d):
    g = inf.group_measures(inf.comparison_counts(_heart(spark, d), _pairs()))
    return _r(g.select("var1", "var2", "grp", "n", "mean", (F.col("m2") / (F.col("n") - 1)).alias("variance"), "q1", "med", "q3", "outliers"))


def i3(spark, d):
    return _r(inf.two_group_statistics(_compared(spark, d)).select("var1", "var2", "cohens_d", "hedges_g"))


def i5(spark, d):
    return _r(inf.two_group_statistics(_compared(spark, d)).select("var1", "var2", "u1", "rank_biserial"))


def i7(spark, d):
    return _r(inf.one_way_statistics(_compared_many(spark, d)).select("var1", "var2", "k", "n", "brown_forsythe_f"))


def i9(spark, d):
    return _r(inf.compare_two_groups(_heart(spark, d), _pairs()), 6)


def i10(spark, d):
    return _r(inf.two_group_statistics(_compared(spark, d)).select("var1", "var2", "n1", "n2", "student_t", "welch_t", "welch_df"))


def i11(spark, d):
    return _r(inf.compare_two_groups(_heart(spark, d), _pairs(), "mannwhitney").select("var1", "var2", "statistic", "p_value"), 6)


def i12(spark, d):
    return _r(inf.compare_groups(_heart(spark, d), [(v, g) for v in NUMS for g in ("cp", "restecg")]), 6)


def i13(spark, d):
    return _r(inf.one_way_statistics(_compared_many(spark, d)).select("var1", "var2", "welch_f", "welch_df2"))


def i14(spark, d):
    return _r(inf.one_way_statistics(_compared_many(spark, d)).select("var1", "var2", "kruskal_h"))


def _posthoc(method):
    return lambda spark, d: _r(inf.posthoc(_heart(spark, d).where("cp in (1, 2, 3, 4)"), "thalach", "cp", method), 6)


def i16(spark, d):
    m = inf.posthoc_matrix(inf.posthoc(_heart(spark, d).where("cp in (1, 2, 3, 4)"), "thalach", "cp", "kruskal"))
    return _r(m.toDF(*[c if c == "group_a" else "p_" + c.replace(".", "_") for c in m.columns]), 6)


def _p_values(spark, d) -> DataFrame:
    """p-values both engines make alike: fractions from part keys, some of them null."""
    return table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") != 7, (F.col("p_partkey") * 7919 % 997 + 1) / 1000000.0).alias("p"))


def i17(spark, d):
    return _r(inf.benjamini_hochberg(_p_values(spark, d), "p").select("p_partkey", "p_adj"), 10)


def i18(spark, d):
    return _r(inf.holm(_p_values(spark, d), "p").select("p_partkey", "p_adj"), 10)


def _tables(spark, d):
    return inf.table_counts(_heart(spark, d), ds.pair_cells(FEW))


def i19(spark, d):
    return _r(inf.association_statistics(_tables(spark, d)).select("var1", "var2", "n", "chi2", "dof", "cramers_v", "assumptions_ok"))


def i19_p(spark, d):
    return _r(inf.associations(_tables(spark, d)), 6)


def _corr(spark, d):
    return inf.correlation_counts(_heart(spark, d), ds.pair_cells(NUMS))


def i20(spark, d):
    return _r(inf.correlation_statistics(_corr(spark, d)).select("var1", "var2", "n", "pearson", "spearman"), 6)


def i20_auto(spark, d):
    return _r(inf.correlations(_corr(spark, d)), 6)


def i21(spark, d):
    h = _heart(spark, d)
    levels = h.agg(*[F.count_distinct(c).alias(c) for c in FEW]).first().asDict()
    return _r(inf.screen(h, NUMS, levels), 6)


def i13_outcome(spark, d):
    g = table(spark, d, "breast_cancer_gbsg")
    return spark.createDataFrame([(inf.outcome_column(g, ["meno", "hormon", "status", "grade"]),)], "outcome string")


def i22(spark, d):
    g = nan_to_null(table(spark, d, "breast_cancer_gbsg"))
    return _r(inf.outcome_comparison(g, ["age", "size", "nodes", "er"], inf.outcome_column(g, ["meno", "hormon", "status"])), 6)


def i1(spark, d):
    """Values and groups that enter the comparisons."""
    c = inf.comparison_counts(_heart(spark, d), _pairs())
    return c.groupBy("var1", "var2", "grp").agg(F.sum("cnt").alias("n"), F.count("*").alias("n_distinct"))


def i6(spark, d):
    """Which pairs call for ranks, by the test chosen."""
    return inf.compare_two_groups(_heart(spark, d), _pairs()).select("var1", "var2", (F.col("test") == "mannwhitney").alias("by_ranks"))


def k8(spark, d):
    a = inf.association_statistics(_tables(spark, d)).select("var1", "var2", "cramers_v")
    return _r(a.orderBy(F.desc_nulls_last("cramers_v"), "var1", "var2").limit(20))


def i23(spark, d):
    return _r(rg.linear(_heart(spark, d), ["age"], "thalach").select("term", "coefficient", "r2", "n"))


def i23_residuals(spark, d):
    h = _heart(spark, d)
    x = rg.residuals(h, ["age"], "thalach", rg.linear(h, ["age"], "thalach"))
    return x.agg(F.count("*").alias("n"), F.round(F.stddev_pop("residual"), 4).alias("sd_residual"))


def i23_logistic(spark, d):
    return _r(rg.logistic(_heart(spark, d).withColumn("sick", (F.col("num") > 0).cast("double")), ["age", "sex", "oldpeak"], "sick"))


def r6(spark, d):
    x = rd.as_categories(_heart(spark, d), FEW)
    return x.groupBy("cp").agg(F.count("*").alias("cnt"))


def f17(spark, d):
    return spark.createDataFrame([(fed.has_converged(),)], "converged boolean")


def r1(spark, d):
    return _r(rd.reduction_table(spark, rd.pca(_heart(spark, d), [*NUMS, "ca", "thal"])), 6)


def r1_matrix(spark, d):
    h = _heart(spark, d)
    stats = {r.column_name: (r.mean, r.sd) for r in rd.moments(h, NUMS).collect()}
    return _r(rd.correlation_matrix(h, NUMS, stats), 6)


def r1_rows(spark, d):
    h = _heart(spark, d)
    return _r(rd.pca_coordinates(h, rd.pca(h, NUMS), ["record_id"]), 6)


def r2(spark, d):
    return _r(rd.reduction_table(spark, rd.mca(_heart(spark, d), FEW)), 6)


def r2_burt(spark, d):
    return rd.level_pairs(_heart(spark, d), FEW)


def r2_rows(spark, d):
    h = _heart(spark, d)
    return _r(rd.mca_coordinates(h, rd.mca(h, FEW), ["record_id"]), 6)


def r3(spark, d):
    labels = spark.createDataFrame([("cp__1.0",), ("cp_max__2",), ("cp__max__2",), ("other__1",)], "label string")
    return rd.variables_of_labels(labels, spark.createDataFrame([("cp",), ("cp_max",), ("cp__max",)], "name string"))


def r4(spark, d):
    m = rd.mca(_heart(spark, d), FEW)
    return rd.loadings_table(spark, rd.subset(m, ["cp", "sex"])).select("label", "component", F.round(F.abs("loading"), 6).alias("abs_loading"))


def k10(spark, d):
    return _r(rd.longest_loadings(spark, rd.pca(_heart(spark, d), [*NUMS, "ca", "thal"])).select("label", "length"), 6)


QUERIES = {
    "W1_rolling_growth": w1_rolling, "W1_trend": w1_trend, "W2_longitudinal": w2, "W3_event_measures": w3, "W3_daily_counts": w3_daily, "W4_panel": w4, "W5_event_columns": w5, "W6_repeat_structure": w6, "X1_dataset_kind": w6_kind, "W7_seasonality": w7, "W8_peaks": w8, "W9_period_dates": w9, "W11_running_share": w11, "W12_fit_line": w12,
    "I2_group_measures": i2, "I3_I4_effect_sizes": i3, "I5_rank_biserial": i5, "I7_brown_forsythe": i7, "I9_two_group_tests": i9, "I10_t_statistics": i10, "I11_mann_whitney": i11, "I12_one_way_tests": i12, "I13_welch_anova": i13, "I14_kruskal": i14, "I15_posthoc_kruskal": _posthoc("kruskal"), "I15_posthoc_welch": _posthoc("welch"), "I16_posthoc_matrix": i16,
    "I17_benjamini_hochberg": i17, "I18_holm": i18, "I19_chi_square": i19, "I19_association_tests": i19_p, "I20_correlations": i20, "I20_auto_correlation": i20_auto, "I21_screen": i21, "P13_outcome_column": i13_outcome, "I22_outcome_comparison": i22,
    "I1_group_values": i1, "I6_rank_rule": i6, "K8_top_cramers_v": k8, "I23_linear_regression": i23, "I23_residuals": i23_residuals, "I23_logistic_regression": i23_logistic, "R6_category_recode": r6, "F17_converged": f17,
    "R1_pca": r1, "R1_correlation_matrix": r1_matrix, "R1_row_coordinates": r1_rows, "R2_mca": r2, "R2_burt_table": r2_burt, "R2_row_coordinates": r2_rows, "R3_label_variables": r3, "R4_mca_subset": r4, "K10_longest_loadings": k10,
}

_OK = {"age": (0, 120), "trestbps": (40, 280), "chol": (80, 700), "thalach": (30, 240), "oldpeak": (-3, 10)}
_HS = "h AS (SELECT record_id, node_id, " + ", ".join(f"CASE WHEN NOT isnan({c}) AND {c} BETWEEN {a} AND {b} THEN {c} END AS {c}" for c, (a, b) in _OK.items()) + ", " + ", ".join(f"CASE WHEN {c} IN (0, 1) THEN {c} END AS {c}" for c in TWO) + ", " + ", ".join(f"CASE WHEN NOT isnan({c}) THEN {c} END AS {c}" for c in ("cp", "restecg")) + f" FROM {HEART})"
_MON = "q AS (SELECT strftime(o_orderdate, '%Y-%m') AS period, sum(o_totalprice) AS value FROM orders WHERE o_orderdate IS NOT NULL GROUP BY ALL)"


def _long(pairs):
    return " UNION ALL ".join(f"SELECT '{v}' AS var1, '{g}' AS var2, CAST({g} AS VARCHAR) AS grp, {v} AS value FROM h WHERE {v} IS NOT NULL AND {g} IS NOT NULL" for v, g in pairs)


def _stats(pairs):
    return f"""{_HS}, m AS ({_long(pairs)}), rk AS (SELECT *, rank() OVER (PARTITION BY var1, var2 ORDER BY value) + (count(*) OVER (PARTITION BY var1, var2, value) - 1) / 2.0 AS r FROM m),
md AS (SELECT var1, var2, grp, median(value) AS med, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM m GROUP BY ALL),
gr AS (SELECT rk.var1, rk.var2, rk.grp, count(*) AS n, avg(value) AS mean, var_samp(value) AS v, sum(r) AS rs, any_value(med) AS med, any_value(q1) AS q1, any_value(q3) AS q3, sum(abs(value - med)) AS dev, sum((value - med) ** 2) AS dev2, count(*) FILTER (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS outliers FROM rk JOIN md USING (var1, var2, grp) GROUP BY ALL)"""


_TWO_SQL = f"""WITH {_stats(_pairs())}, ab AS (SELECT a.var1, a.var2, a.n AS n1, b.n AS n2, a.mean AS m1, b.mean AS m2, a.v AS v1, b.v AS v2, a.rs AS rs, sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2)) AS sp FROM gr a JOIN gr b ON a.var1 = b.var1 AND a.var2 = b.var2 AND a.grp = '0.0' AND b.grp = '1.0')"""
_MANY_SQL = f"""WITH {_stats([(v, g) for v in NUMS for g in ("cp", "restecg")])}, tot AS (SELECT var1, var2, count(*) AS k, CAST(sum(n) AS DOUBLE) AS nn, sum(n / v) AS sw, sum(n / v * mean) / sum(n / v) AS mw, sum(dev) / sum(n) AS dm FROM gr GROUP BY ALL),
ti AS (SELECT var1, var2, sum(t ** 3 - t) AS ties FROM (SELECT var1, var2, value, CAST(count(*) AS DOUBLE) AS t FROM m GROUP BY ALL) GROUP BY ALL)"""
_PV = "pv AS (SELECT p_partkey, CASE WHEN p_size <> 7 THEN CAST(p_partkey * 7919 % 997 + 1 AS DOUBLE) / CAST(1000000 AS DOUBLE) END AS p FROM part)"
_CTAB = f"{_HS}, x AS (" + " UNION ALL ".join(f"SELECT '{a}' AS var1, '{b}' AS var2, CAST({a} AS VARCHAR) AS a, CAST({b} AS VARCHAR) AS b FROM h WHERE {a} IS NOT NULL AND {b} IS NOT NULL" for a, b in ds.pair_cells(FEW)) + ")"
_SPEAR = " UNION ALL ".join(f"SELECT '{a}' AS var1, '{b}' AS var2, count(*) AS n, round(corr(x, y), 6) AS pearson, round(corr(rx, ry), 6) AS spearman FROM (SELECT x, y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM (SELECT {a} AS x, {b} AS y FROM h WHERE {a} IS NOT NULL AND {b} IS NOT NULL))" for a, b in ds.pair_cells(NUMS))
_Z = {c: f"coalesce(({c} - (SELECT avg({c}) FROM h)) / (SELECT sqrt(var_pop({c}) * count({c}) / count(*)) FROM h), 0)" for c in NUMS}
_CELLS = " UNION ALL ".join(f"SELECT record_id, '{c}__' || CAST({c} AS VARCHAR) AS l FROM h WHERE {c} IS NOT NULL" for c in FEW)

ORACLE = {
    "W1_rolling_growth": f"WITH {_MON} SELECT period, round(value, 4) AS value, round(CASE WHEN count(value) OVER f = 3 THEN avg(value) OVER f END, 4) AS rolling_mean, round((value - lag(value) OVER (ORDER BY period)) / lag(value) OVER (ORDER BY period), 4) AS growth_rate FROM q WINDOW f AS (ORDER BY period ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)",
    "W1_trend": f"WITH {_MON}, x AS (SELECT *, row_number() OVER (ORDER BY period) - 1 AS x FROM q) SELECT count(*) AS n, round(min(value), 2) AS min, round(max(value), 2) AS max, round(max(value) - min(value), 2) AS range, round(avg(value), 2) AS mean, round(regr_slope(value, x), 2) AS trend_slope, round(regr_r2(value, x), 2) AS trend_r2 FROM x",
    "W2_longitudinal": """WITH x AS (SELECT *, date_diff('day', DATE '1970-01-01', visit_date) AS day FROM longitudinal WHERE patient_id IS NOT NULL AND visit_date IS NOT NULL AND weight_kg IS NOT NULL AND NOT isnan(weight_kg)),
g AS (SELECT patient_id AS subject, count(*) AS n_observations, first(weight_kg ORDER BY visit_date, visit_number NULLS FIRST, recorded_at NULLS FIRST, weight_kg) AS b, last(weight_kg ORDER BY visit_date, visit_number NULLS FIRST, recorded_at NULLS FIRST, weight_kg) AS l, regr_slope(weight_kg, day) AS s, var_samp(weight_kg) AS v FROM x GROUP BY ALL HAVING count(*) >= 2)
SELECT subject, n_observations, round(b, 4) AS baseline, round(l, 4) AS last_value, round(l - b, 4) AS absolute_change, round((l - b) / b * 100, 4) AS relative_change, round(CASE WHEN isnan(s) THEN NULL ELSE s END, 4) + 0.0 AS slope, round(v, 4) AS within_var FROM g""",
    "W3_event_measures": """WITH d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS cnt FROM events GROUP BY ALL), s AS (SELECT sum(cnt) AS n, avg(cnt) AS a, stddev_samp(cnt) AS sd, first(day ORDER BY cnt DESC, day) AS pd, max(cnt) AS pc FROM d),
e AS (SELECT epoch_us(ts) - lag(epoch_us(ts)) OVER (ORDER BY ts) AS gap FROM events)
SELECT CAST(n AS BIGINT) AS event_count, round(a, 3) AS event_density_mean, round(sd, 3) AS event_density_std, strftime(pd, '%Y-%m-%d') AS peak_day, pc AS peak_day_count, (SELECT count(*) FROM d WHERE cnt > a + 2 * sd) AS unusual_high_activity_days, (SELECT round(avg(gap / 1e6), 3) FROM e) AS avg_time_between_events, (SELECT round(stddev_samp(gap / 1e6), 3) FROM e) AS time_between_events_spread FROM s""",
    "W3_daily_counts": "SELECT strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day, count(*) AS cnt FROM events GROUP BY ALL",
    "W4_panel": f"WITH {pf.ORDERS_SQL.replace('AS node FROM', 'AS node, n_name FROM')}, m AS (SELECT n_name, date_trunc('month', o_orderdate) AS month, sum(o_totalprice) AS total FROM x GROUP BY ALL) SELECT n_name AS entity, count(*) AS n_observations, round(avg(total), 1) AS mean, round(last(total ORDER BY month) - first(total ORDER BY month), 1) AS growth, round(regr_slope(total, date_diff('day', DATE '1970-01-01', CAST(month AS DATE))), 1) AS slope FROM m GROUP BY ALL HAVING count(*) >= 2",
    "W5_event_columns": " UNION ALL ".join(f"SELECT * FROM (SELECT '{c}' AS column_name, CAST((CASE WHEN r > 0.01 AND r < 0.5 THEN 1 ELSE 0 END) + (CASE WHEN a > 1.2 THEN 2 ELSE 0 END) + (CASE WHEN pd > 0.3 THEN 2 ELSE 0 END) AS INTEGER) AS score, round(a, 4) AS avg_unique_per_patient, round(pd, 4) AS patient_diversity FROM (SELECT (SELECT count(DISTINCT {c}) * 1.0 / count(*) FROM events) AS r, avg(u) AS a, avg(CAST(u > 1 AS INTEGER)) AS pd FROM (SELECT user_id, count(DISTINCT {c}) AS u FROM events WHERE user_id IS NOT NULL GROUP BY ALL))) WHERE score >= 3" for c in ("event_type", "props")),
    "W6_repeat_structure": "SELECT round(stddev_samp(k) / avg(k), 4) AS row_variability, round(avg(CAST(k > 1 AS INTEGER)), 4) AS repeat_ratio FROM (SELECT patient_id, count(*) AS k FROM longitudinal WHERE patient_id IS NOT NULL GROUP BY ALL)",
    "W8_peaks": f"WITH {_MON}, l AS (SELECT *, lag(value) OVER (ORDER BY period) < value AND lead(value) OVER (ORDER BY period) < value AS p FROM q) SELECT 'orders' AS grp, period, round(value, 4) AS value, row_number() OVER (ORDER BY value DESC, period) AS place FROM l WHERE p ORDER BY value DESC LIMIT 5",
    "W9_period_dates": f"WITH {_MON} SELECT period, period || '-01' AS day FROM q",
    "W11_running_share": "WITH p AS (SELECT l_linestatus || '/' || l_returnflag AS label, count(*) AS cnt FROM lineitem GROUP BY ALL), c AS (SELECT label, sum(cnt) OVER (ORDER BY label) * 1.0 / sum(cnt) OVER () AS cum, row_number() OVER (ORDER BY label) AS place FROM p) SELECT label, round(cum, 6) AS cum, place, min(place) FILTER (cum >= 0.8 - 1e-12) OVER () AS n_needed FROM c",
    "W12_fit_line": f"WITH {_HS} SELECT node_id, count(*) AS n, round(regr_slope(thalach, age), 4) AS slope, round(regr_intercept(thalach, age), 4) AS intercept FROM h WHERE age IS NOT NULL AND thalach IS NOT NULL GROUP BY ALL HAVING count(*) > 2",
    "I2_group_measures": f"WITH {_stats(_pairs())} SELECT var1, var2, grp, n, round(mean, 4) AS mean, round(v, 4) AS variance, round(q1, 4) AS q1, round(med, 4) AS med, round(q3, 4) AS q3, outliers FROM gr",
    "I3_I4_effect_sizes": f"{_TWO_SQL} SELECT var1, var2, round((m1 - m2) / sp, 4) AS cohens_d, round((m1 - m2) / sp * (1 - 3.0 / (4 * (n1 + n2) - 9)), 4) AS hedges_g FROM ab",
    "I5_rank_biserial": f"{_TWO_SQL} SELECT var1, var2, round(rs - n1 * (n1 + 1) / 2, 4) AS u1, round(1 - 2 * (rs - n1 * (n1 + 1) / 2) / (n1 * n2), 4) AS rank_biserial FROM ab",
    "I7_brown_forsythe": f"{_MANY_SQL} SELECT gr.var1, gr.var2, any_value(k) AS k, CAST(any_value(nn) AS BIGINT) AS n, round(sum(n * (dev / n - dm) ** 2) / (any_value(k) - 1) / (sum(dev2 - dev ** 2 / n) / (any_value(nn) - any_value(k))), 4) AS brown_forsythe_f FROM gr JOIN tot USING (var1, var2) GROUP BY gr.var1, gr.var2",
    "I10_t_statistics": f"{_TWO_SQL} SELECT var1, var2, n1, n2, round((m1 - m2) / (sp * sqrt(1.0 / n1 + 1.0 / n2)), 4) AS student_t, round((m1 - m2) / sqrt(v1 / n1 + v2 / n2), 4) AS welch_t, round((v1 / n1 + v2 / n2) ** 2 / ((v1 / n1) ** 2 / (n1 - 1) + (v2 / n2) ** 2 / (n2 - 1)), 4) AS welch_df FROM ab",
    "I13_welch_anova": f"{_MANY_SQL}, z AS (SELECT gr.var1, gr.var2, any_value(k) AS k, sum(n / v * (mean - mw) ** 2) AS a, sum((1 - n / v / sw) ** 2 / (n - 1)) AS l FROM gr JOIN tot USING (var1, var2) GROUP BY gr.var1, gr.var2) SELECT var1, var2, round(a / (k - 1) / (1 + 2 * (k - 2) * l / (k * k - 1)), 4) AS welch_f, round((k * k - 1) / (3 * l), 4) AS welch_df2 FROM z",
    "I14_kruskal": f"{_MANY_SQL} SELECT gr.var1, gr.var2, round((12 / (any_value(nn) * (any_value(nn) + 1)) * sum(rs ** 2 / n) - 3 * (any_value(nn) + 1)) / (1 - any_value(ties) / (any_value(nn) ** 3 - any_value(nn))), 4) AS kruskal_h FROM gr JOIN tot USING (var1, var2) JOIN ti USING (var1, var2) GROUP BY gr.var1, gr.var2",
    "I17_benjamini_hochberg": f"WITH {_PV}, r AS (SELECT *, p * count(*) OVER () / row_number() OVER (ORDER BY p, p_partkey) AS q FROM pv WHERE p IS NOT NULL), a AS (SELECT p_partkey, least(1, min(q) OVER (ORDER BY p DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS p_adj FROM r) SELECT pv.p_partkey, round(p_adj, 10) AS p_adj FROM pv LEFT JOIN a USING (p_partkey)",
    "I18_holm": f"WITH {_PV}, r AS (SELECT *, (count(*) OVER () - rank() OVER (ORDER BY p) + 1) * p AS q FROM pv WHERE p IS NOT NULL), a AS (SELECT p_partkey, least(1, max(q) OVER (ORDER BY p RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS p_adj FROM r) SELECT pv.p_partkey, round(p_adj, 10) AS p_adj FROM pv LEFT JOIN a USING (p_partkey)",
    "I19_chi_square": f"""WITH {_CTAB}, ra AS (SELECT var1, var2, a, count(*) AS ra FROM x GROUP BY ALL), cb AS (SELECT var1, var2, b, count(*) AS cb FROM x GROUP BY ALL), oo AS (SELECT var1, var2, a, b, count(*) AS o FROM x GROUP BY ALL),
dm AS (SELECT var1, var2, r, n, c FROM (SELECT var1, var2, count(*) AS r, sum(ra) AS n FROM ra GROUP BY ALL) JOIN (SELECT var1, var2, count(*) AS c FROM cb GROUP BY ALL) USING (var1, var2)),
f AS (SELECT ra.var1, ra.var2, r, c, n, CAST(ra AS DOUBLE) * cb / n AS e, coalesce(o, 0) AS o FROM ra JOIN cb USING (var1, var2) JOIN dm USING (var1, var2) LEFT JOIN oo ON oo.var1 = ra.var1 AND oo.var2 = ra.var2 AND oo.a = ra.a AND oo.b = cb.b),
y AS (SELECT *, abs(o - e) - CASE WHEN r = 2 AND c = 2 THEN least(0.5, abs(o - e)) ELSE 0 END AS g FROM f)
SELECT var1, var2, CAST(any_value(n) AS BIGINT) AS n, round(sum(g ** 2 / e), 4) AS chi2, (any_value(r) - 1) * (any_value(c) - 1) AS dof, round(sqrt(sum((o - e) ** 2 / e) / (any_value(n) * (least(any_value(r), any_value(c)) - 1))), 4) AS cramers_v, min(e) >= 1 AND avg(CAST(e < 5 AS INTEGER)) <= 0.2 AS assumptions_ok FROM y GROUP BY var1, var2""",
    "I20_correlations": f"WITH {_HS} {_SPEAR}",
    "K8_top_cramers_v": None,
    "I1_group_values": f"WITH {_stats(_pairs())} SELECT var1, var2, grp, count(*) AS n, count(DISTINCT value) AS n_distinct FROM m GROUP BY ALL",
    "I23_linear_regression": f"WITH {_HS}, x AS (SELECT age AS x, thalach AS y FROM h WHERE age IS NOT NULL AND thalach IS NOT NULL) SELECT 'intercept' AS term, round(regr_intercept(y, x), 4) AS coefficient, round(regr_r2(y, x), 4) AS r2, count(*) AS n FROM x UNION ALL SELECT 'age', round(regr_slope(y, x), 4), round(regr_r2(y, x), 4), count(*) FROM x",
    "I23_residuals": f"WITH {_HS}, x AS (SELECT age AS x, thalach AS y FROM h WHERE age IS NOT NULL AND thalach IS NOT NULL) SELECT count(*) AS n, round(sqrt(var_pop(y) * (1 - regr_r2(y, x))), 4) AS sd_residual FROM x",
    "R6_category_recode": f"WITH {_HS} SELECT CAST(cp AS VARCHAR) AS cp, count(*) AS cnt FROM h GROUP BY ALL",
    "F17_converged": "SELECT TRUE AS converged",
    "P13_outcome_column": "SELECT 'status' AS outcome",
    "R1_correlation_matrix": f"WITH {_HS}, z AS (SELECT {', '.join(f'{e} AS {c}' for c, e in _Z.items())} FROM h) " + " UNION ALL ".join(f"SELECT '{a}' AS var1, '{b}' AS var2, round(avg({a} * {b}), 6) AS r FROM z" for i, a in enumerate(NUMS) for b in NUMS[i:]),
    "R2_burt_table": f"WITH {_HS}, l AS ({_CELLS}) SELECT a.l AS level1, b.l AS level2, count(*) AS cnt FROM l a JOIN l b USING (record_id) GROUP BY ALL",
    "R3_label_variables": "SELECT * FROM (VALUES ('cp__1.0', 'cp'), ('cp_max__2', 'cp_max'), ('cp__max__2', 'cp__max'), ('other__1', NULL)) t(label, variable)",
}
ORACLE["K8_top_cramers_v"] = f"SELECT var1, var2, cramers_v FROM ({ORACLE['I19_chi_square']}) ORDER BY cramers_v DESC, var1, var2 LIMIT 20"

_TEST = "var1, var2, test, round(statistic, 6) AS statistic, round(p_value, 6) AS p_value, round(effect_size, 6) AS effect_size, effect_size_metric"
_TWO_M = f"{_HS}, m AS ({_long(_pairs())})"
_MANY_M = f"{_HS}, m AS ({_long([(v, g) for v in NUMS for g in ('cp', 'restecg')])})"
_LEVEL_M = f"""{_HS}, l AS (SELECT DISTINCT CAST(cp AS VARCHAR) AS grp FROM h WHERE cp IN (1, 2, 3, 4) AND thalach IS NOT NULL), p AS (SELECT a.grp AS ga, b.grp AS gb FROM l a JOIN l b ON a.grp < b.grp),
m AS (SELECT ga AS var1, gb AS var2, CAST(cp AS VARCHAR) AS grp, thalach AS value FROM p JOIN h ON CAST(cp AS VARCHAR) IN (ga, gb) WHERE thalach IS NOT NULL), {isql.two_groups("mannwhitney")},
ho AS (SELECT var1 AS group_a, var2 AS group_b, p_value, (count(*) OVER () - row_number() OVER (ORDER BY p_value) + 1) * p_value AS q FROM tt), pa AS (SELECT group_a, group_b, least(1, max(q) OVER (ORDER BY p_value RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS p_adj FROM ho)"""
_GBSG_M = "m AS (" + " UNION ALL ".join(f"SELECT '{c}' AS var1, 'status' AS var2, CAST(status AS VARCHAR) AS grp, CAST({c} AS DOUBLE) AS value FROM breast_cancer_gbsg WHERE status IS NOT NULL AND {c} IS NOT NULL AND NOT isnan(CAST({c} AS DOUBLE))" for c in ("age", "size", "nodes", "er")) + ")"
_SCREENED = f"""WITH {_TWO_M}, {isql.two_groups()}, {isql.associations(_CTAB.removeprefix(_HS + ", "))}, {isql.correlations(NUMS, "h")},
lv AS ({" UNION ALL ".join(f"SELECT '{c}' AS c, count(DISTINCT {c}) AS k FROM h" for c in FEW)}),
al AS (SELECT {{cols}}, 'num-num' AS pair_type FROM tc UNION ALL SELECT {{cols}}, 'cat-cat' FROM ta WHERE (SELECT k FROM lv WHERE c = var1) <= 6 AND (SELECT k FROM lv WHERE c = var2) <= 6 UNION ALL SELECT {{cols}}, 'num-cat' FROM tt),
bh AS (SELECT *, p_value * count(*) OVER () / row_number() OVER (ORDER BY p_value) AS q FROM al),
aj AS (SELECT *, least(1, min(q) OVER (ORDER BY p_value DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS p_adj FROM bh)
SELECT {_TEST}, pair_type, round(p_adj, 6) AS p_adj, p_adj < 0.05 AND effect_size >= CASE effect_size_metric WHEN 'cramers_v' THEN 0.1 ELSE 0.2 END AS significant FROM aj""".format(cols="var1, var2, test, statistic, p_value, abs(effect_size) AS effect_size, effect_size_metric")
ORACLE |= {
    "I6_rank_rule": f"WITH {_TWO_M}, {isql.two_groups()} SELECT var1, var2, by_ranks FROM tt",
    "I9_two_group_tests": f"WITH {_TWO_M}, {isql.two_groups()} SELECT {_TEST} FROM tt",
    "I11_mann_whitney": f"WITH {_TWO_M}, {isql.two_groups('mannwhitney')} SELECT var1, var2, round(statistic, 6) AS statistic, round(p_value, 6) AS p_value FROM tt",
    "I12_one_way_tests": f"WITH {_MANY_M}, {isql.one_way()} SELECT var1, var2, test, round(statistic, 6) AS statistic, round(p_value, 6) AS p_value FROM ow",
    "I15_posthoc_kruskal": f"WITH {_LEVEL_M} SELECT group_a, group_b, round(p_adj, 6) AS p_adj FROM pa",
    "I16_posthoc_matrix": f"WITH {_LEVEL_M}, b AS (SELECT group_a, group_b, p_adj FROM pa UNION ALL SELECT group_b, group_a, p_adj FROM pa) SELECT group_a, " + ", ".join(f"round(max(p_adj) FILTER (group_b = '{g}.0'), 6) AS p_{g}_0" for g in (1, 2, 3, 4)) + " FROM b GROUP BY group_a",
    "I19_association_tests": f"WITH {isql.associations(_CTAB)} SELECT {_TEST} FROM ta",
    "I20_auto_correlation": f"WITH {_HS}, {isql.correlations(NUMS, 'h')} SELECT {_TEST} FROM tc",
    "I21_screen": _SCREENED,
    "I22_outcome_comparison": f"WITH {_GBSG_M}, {isql.two_groups()} SELECT {_TEST} FROM tt",
}
