"""Queries of merging, comparing, ranking and wording of site summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewise.functions import scalars as sc
from sitewise.operators import descriptive as ds
from sitewise.operators import federation as fed
from sitewise.operators import narrative as nar
from sitewise.operators import ranking as rk
from sitewise.queries import profile as pf
from sitewise.session import table

HEART = "heart_disease_cleveland"
COLS = ["age", "sex", "cp", "trestbps", "chol", "fbs", "restecg", "thalach", "exang", "oldpeak", "slope", "ca", "thal"]
LEAST = 0.5


def _heart(spark, d):
    return ds.melt(table(spark, d, HEART), F.col("node_id"), COLS)


def _overview(spark, d):
    return fed.site_overview(table(spark, d, HEART), "node_id", ["record_id", "patient_id", *COLS], ["record_id", "patient_id"])


def _catalogue(spark, d):
    return fed.column_catalogue(_heart(spark, d), LEAST)


def _coverage(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, HEART).select("node_id").distinct().count()
    return fed.column_coverage(_catalogue(spark, d), n)


_r = pf._rounded


def f1(spark, d):
    return _r(fed.overview_totals(_overview(spark, d)))


def f2(spark, d):
    return _coverage(spark, d).select("column_name", "n_nodes", "coverage")


def f3(spark, d):
    return fed.local_coverage(_catalogue(spark, d), _coverage(spark, d))


def f4(spark, d):
    return _coverage(spark, d).select("column_name", "availability")


def f5(spark, d):
    return fed.missing_total(_heart(spark, d))


def f6(spark, d):
    return _r(fed.pooled_numeric(fed.numeric_partials(_heart(spark, d), 3)), 2)


def f7(spark, d):
    return _r(fed.pooled_numeric(fed.numeric_partials(_heart(spark, d))).select("column_name", "count", "variance", "std_dev"))


def f7_native(spark, d):
    return _r(fed.native_numeric(_heart(spark, d)))


def f8(spark, d):
    return _r(fed.merged_categories(ds.category_counts(pf.order_cells(spark, d)).select(*ds.KEY, "value", "cnt")), 6)


def f8_modes(spark, d):
    return fed.merged_modes(fed.merged_categories(ds.category_counts(pf.order_cells(spark, d))))


def f9(spark, d):
    return fed.merged_periods(ds.period_counts(pf.date_cells(spark, d)))


def f9_active(spark, d):
    return fed.most_active(fed.merged_periods(ds.period_counts(pf.date_cells(spark, d))))


def f10(spark, d):
    return fed.merged_histogram(fed.site_histograms(table(spark, d, HEART), "node_id", "age"))


def f11(spark, d):
    x = table(spark, d, "longitudinal")
    return x.groupBy("node_id", ds.sex_label(F.col("sex")).alias("sex")).agg(F.count("*").alias("cnt")).groupBy("sex").agg(F.sum("cnt").alias("cnt"))


def f12(spark, d):
    return _r(fed.contributions(_overview(spark, d)).drop("missing_label"))


def f13(spark, d):
    p = fed.numeric_partials(_heart(spark, d))
    return fed.mean_alignment(p, fed.pooled_numeric(p), 3)


def f14(spark, d):
    return fed.contributions(_overview(spark, d)).select("node_id", "missing_label")


def f15(spark, d):
    cells = ds.melt(table(spark, d, "documents").where("source is not null"), F.col("source"), ["written_at"], "timestamp_ntz")
    p = ds.period_counts(cells, "D").select(F.col("node_id").alias("column_name"), "period", "cnt")
    return _r(fed.trends(p), 6)


def f16(spark, d):
    return fed.top_categories(fed.merged_categories(ds.category_counts(pf.order_cells(spark, d))), 3)


def f18(spark, d):
    return fed.coverage_counts(fed.local_coverage(_catalogue(spark, d), _coverage(spark, d)))


def _vs(spark, d):
    p = fed.numeric_partials(_heart(spark, d))
    return fed.compare_to_whole(p.select(*ds.KEY, "n", "mean"), fed.pooled_numeric(p), "column_name", "mean")


def j1(spark, d):
    """Sites against the whole of the other half of the columns, so that some have no match."""
    p = fed.numeric_partials(_heart(spark, d))
    return _r(fed.compare_to_whole(p.select(*ds.KEY, "mean"), fed.pooled_numeric(p).where("column_name < 'oldpeak'"), "column_name", "mean"))


def j2(spark, d):
    return _r(_vs(spark, d))


def j3(spark, d):
    c = ds.category_counts(pf.order_cells(spark, d))
    return _r(fed.compare_categories(c.select(*ds.KEY, "value", "cnt"), fed.merged_categories(c)))


def j4(spark, d):
    cells = pf.date_cells(spark, d)
    whole = fed.most_active(fed.merged_periods(ds.period_counts(cells)))
    local = cells.groupBy(*ds.KEY).agg(F.count("value").alias("count"))
    return _r(fed.compare_to_whole(local, whole, "column_name", "count", whole_value="total"), 6)


def _catalog(spark, d):
    kinds = {"age": "numeric", "trestbps": "numeric", "chol": "numeric", "sex": "categorical", "cp": "categorical", "thal": "categorical", "exang": "categorical"}
    seen = ds.value_counts(_heart(spark, d)).where(F.col("column_name").isin(list(kinds))).groupBy("column_name").agg(F.countDistinct("value").alias("n_levels"))
    return seen.withColumn("kind", F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])[F.col("column_name")])


def j5(spark, d):
    c = _catalog(spark, d)
    parts = [("numeric", "numeric", "num-num"), ("categorical", "categorical", "cat-cat"), ("numeric", "categorical", "num-cat")]
    out = [fed.column_pairs(c, a, b, 8).withColumn("pair_type", F.lit(t)) for a, b, t in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


def j6(spark, d):
    return _r(_overview(spark, d).join(fed.contributions(_overview(spark, d)).select("node_id", "patient_contribution"), "node_id").select("node_id", "n_rows", "patient_contribution"))


def j7(spark, d):
    p = fed.numeric_partials(_heart(spark, d)).select(*ds.KEY, "n")
    return fed.with_availability(p, _coverage(spark, d).where("column_name <> 'thal'"))


def j8(spark, d):
    g = table(spark, d, "orders").where("o_orderpriority is not null").select("o_orderpriority").distinct()
    return g.alias("a").join(g.alias("b"), F.col("a.o_orderpriority") < F.col("b.o_orderpriority")).select(F.col("a.o_orderpriority").alias("group_a"), F.col("b.o_orderpriority").alias("group_b"))


def k1(spark, d):
    return _r(rk.top_by(_vs(spark, d).where("vs_global <> 'n/a'").select(*ds.KEY, "mean", "rel_diff_abs"), "rel_diff_abs", 10, ds.KEY))


def k2(spark, d):
    return _r(rk.top_by(ds.categorical_profile(pf.order_cells(spark, d)).select(*ds.KEY, "class_imbalance_ratio"), "class_imbalance_ratio", 10, ds.KEY))


def k3(spark, d):
    return rk.top_by(ds.temporal_profile(pf.date_cells(spark, d)).select(*ds.KEY, "count"), "count", 10, ds.KEY)


def k4(spark, d):
    r = ds.correlation_pairs(table(spark, d, HEART), ["age", "trestbps", "chol", "thalach", "oldpeak", "ca", "thal"])
    return _r(rk.top_by(r.select("var1", "var2", "r"), "r", 10, ["var1", "var2"], absolute=True), 6)


def k5(spark, d):
    c = table(spark, d, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("cnt"))
    return rk.top_per_group(c, ["p_brand"], "cnt", 3, ["p_type"])


def k6(spark, d):
    c = table(spark, d, "documents").where("source is not null").groupBy("source").agg(F.count("*").alias("cnt"))
    return rk.merge_small(c, [], "source", "cnt", 0.03)


def _screen(spark, d):
    """A table shaped like a screening result, from correlations."""
    r = ds.correlation_pairs(table(spark, d, HEART), ["age", "trestbps", "chol", "thalach", "oldpeak"])
    return r.withColumn("p", F.pow(1 - F.abs("r"), 8))


def k7(spark, d):
    return _r(rk.top_by(rk.volcano(_screen(spark, d), "p", "r").select("var1", "var2", "minus_log10_p", "abs_effect"), "abs_effect", 30, ["var1", "var2"]), 6)


def k9(spark, d):
    n = table(spark, d, "part").select("p_type").distinct().count()
    return spark.createDataFrame([(rk.truncation_note(20, n, "count") or "",)], "note string")


def k12(spark, d):
    p = ds.numeric_profile(_heart(spark, d)).select(*ds.KEY, F.when(F.col("skewness") > 1, F.col("skewness")).alias("effect_a"), F.when(F.col("kurtosis") > 3, F.col("kurtosis")).alias("effect_b"))
    return _r(rk.top_by(rk.first_effect(p, ["effect_a", "effect_b"]).select(*ds.KEY, "effect_size"), "effect_size", None, ds.KEY, absolute=True), 3)


def _sizes(spark, d):
    c = ds.category_counts(pf.order_cells(spark, d))
    n = c.groupBy(*ds.KEY).agg(F.sum("cnt").alias("count"))
    return nar.group_sizes(c.join(n, ds.KEY))


def n1(spark, d):
    return nar.smallest_group(_sizes(spark, d).withColumn("size", F.round("size", 4)))


def _grades(spark, d):
    c = ds.category_counts(ds.melt(table(spark, d, "breast_cancer_gbsg"), F.col("node_id"), ["grade"], "string"))
    n = c.groupBy(*ds.KEY).agg(F.sum("cnt").alias("count"))
    return nar.group_sizes(c.join(n, ds.KEY)).withColumn("size", F.round("size", 4))


def n1_flagged(spark, d):
    return nar.small_groups(_grades(spark, d)).select(*ds.KEY, "value", "size")


def n2(spark, d):
    return nar.small_group_warnings(_grades(spark, d)).select(*ds.KEY, "level", "text")


def n3(spark, d):
    cells = ds.melt(table(spark, d, "breast_cancer_gbsg"), F.col("node_id"), ["meno", "hormon"], "string")
    one = ds.melt(table(spark, d, "node_sites"), F.col("node_id"), ["area"], "string")
    return nar.single_category_notice(ds.categorical_profile(cells).unionByName(ds.categorical_profile(one)))


def n5(spark, d):
    return nar.numeric_summary(_vs(spark, d))


def n5_categories(spark, d):
    c = ds.category_counts(pf.order_cells(spark, d))
    return nar.categorical_summary(fed.compare_categories(c.select(*ds.KEY, "value", "cnt"), fed.merged_categories(c)))


def n6(spark, d):
    n = table(spark, d, HEART).select("node_id").distinct().count()
    lines = nar.privacy_notice(False, n, ["patient_id", "record_id"])
    return spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "line_no int, text string")


def n7(spark, d):
    o = _overview(spark, d)
    return nar.overview_strings(fed.contributions(o), o).select("node_id", "missingness", "missing_values")


def p16(spark, d):
    p = ds.numeric_profile(pf.lineitem_cells(spark, d)).select(*ds.KEY, "count", "min", "max", "skewness", "kurtosis")
    return rk.numeric_display(p)


def p17(spark, d):
    s = _screen(spark, d)
    return s.select("var1", "var2", sc.significance_label(F.col("p")).alias("label"), F.when(F.col("p") < 0.001, sc.p_display(F.col("p"))).otherwise("shown").alias("shown"))


def p15(spark, d):
    x = table(spark, d, "region").withColumn("_internal", F.lit(1))
    return rk.without_internal(x)


def p19(spark, d):
    return rk.identifier_features(ds.missing_by_column(table(spark, d, HEART)), "column_name")


def s2_set_ops(spark, d):
    """Union, union all, intersection and difference of the node sets of tables."""
    h, g = (table(spark, d, t).select("node_id") for t in (HEART, "breast_cancer_gbsg"))
    rows = [("union", h.union(g).distinct()), ("union_all", h.unionByName(g)), ("intersect", h.intersect(g)), ("except", h.subtract(g))]
    out = None
    for name, x in rows:
        one = x.agg(F.count("*").alias("n")).select(F.lit(name).alias("operation"), "n")
        out = one if out is None else out.unionByName(one)
    return out


QUERIES = {
    "F1_overview_totals": f1, "F2_column_coverage": f2, "F3_local_coverage": f3, "F4_availability": f4, "F5_missing_total": f5, "F6_pooled_numeric": f6, "F7_pooled_variance": f7, "F7_native_numeric": f7_native, "F8_merged_categories": f8, "F8_merged_modes": f8_modes,
    "F9_merged_periods": f9, "F9_most_active": f9_active, "F10_merged_histogram": f10, "F11_merged_sex": f11, "F12_contributions": f12, "F13_mean_alignment": f13, "F14_missing_label": f14, "F15_trends": f15, "F16_top_categories": f16, "F18_coverage_counts": f18,
    "J1_compare_left_join": j1, "J2_compare_numeric": j2, "J3_compare_categories": j3, "J4_compare_temporal": j4, "J5_column_pairs": j5, "J6_node_lookup": j6, "J7_availability_lookup": j7, "J8_group_pairs": j8,
    "K1_top_deviation": k1, "K2_top_imbalance": k2, "K3_top_activity": k3, "K4_top_effect": k4, "K5_top_per_group": k5, "K6_merge_small": k6, "K7_volcano": k7, "K9_truncation_note": k9, "K12_first_effect": k12,
    "N1_smallest_group": n1, "N1_small_groups": n1_flagged, "N2_small_group_warnings": n2, "N3_single_category": n3, "N5_numeric_summary": n5, "N5_categorical_summary": n5_categories, "N6_privacy_notice": n6, "N7_overview_strings": n7,
    "P15_drop_internal": p15, "P16_range_display": p16, "P17_P18_significance": p17, "P19_identifier_features": p19, "set_operations": s2_set_ops,
}

_M = pf._melt_sql(HEART, "node_id", COLS)
_HM = f"m AS ({_M}), part AS (SELECT node_id, column_name, count(value) AS n, avg(value) AS mean, var_samp(value) AS variance, min(value) AS min, max(value) AS max FROM m GROUP BY ALL HAVING count(value) > 0), g AS (SELECT column_name, count(value) AS count, avg(value) AS gmean FROM m GROUP BY ALL)"
_OV = f"o AS (SELECT node_id, count(*) AS n_rows, CAST(sum({' + '.join(f'CAST({c} IS NULL OR isnan({c}) AS INTEGER)' for c in COLS)}) AS BIGINT) + count(*) FILTER (record_id IS NULL) + count(*) FILTER (patient_id IS NULL) AS n_missing, count(*) * 13 AS n_cells FROM {HEART} GROUP BY ALL), t AS (SELECT sum(n_rows) AS tr, sum(n_missing) AS tm, sum(n_cells) AS tc FROM o)"
_CAT = f"m AS ({_M}), cat AS (SELECT node_id, column_name FROM m GROUP BY ALL HAVING avg(CAST(value IS NOT NULL AS DOUBLE)) > {LEAST}), cov AS (SELECT column_name, count(DISTINCT node_id) AS n_nodes, CASE WHEN count(DISTINCT node_id) = (SELECT count(DISTINCT node_id) FROM {HEART}) THEN 'common_all' WHEN count(DISTINCT node_id) > 1 THEN 'common_partial' ELSE 'unique' END AS coverage FROM cat GROUP BY ALL)"
_VS = "v AS (SELECT node_id, column_name, n, mean, gmean, (mean - gmean) / nullif(gmean, 0) AS rel, CASE WHEN gmean IS NULL THEN 'n/a' WHEN (mean - gmean) / nullif(gmean, 0) > 0.1 THEN 'above_average' WHEN (mean - gmean) / nullif(gmean, 0) < -0.1 THEN 'below_average' ELSE 'similar' END AS vs_global FROM part LEFT JOIN g USING (column_name))"
_REL = "tm * 1.0 / tc"
_MISS = f"CASE WHEN round((n_missing * 1.0 / n_cells) / ({_REL}), 3) > 1 THEN 'above federation average' WHEN round((n_missing * 1.0 / n_cells) / ({_REL}), 3) < 1 THEN 'below federation average' ELSE 'equal to federation average' END"
_MERGED = f"{pf.LABEL_SQL}, mc AS (SELECT column_name, value, CAST(sum(cnt) AS BIGINT) AS cnt, sum(cnt) / sum(sum(cnt)) OVER (PARTITION BY column_name) AS fraction FROM c GROUP BY column_name, value)"
_TOPC = f"{_MERGED}, tc AS (SELECT node_id, column_name, value, cnt * 100.0 / sum(cnt) OVER (PARTITION BY node_id, column_name) AS share, row_number() OVER (PARTITION BY node_id, column_name ORDER BY cnt DESC, value) AS place FROM c), vc AS (SELECT node_id, column_name, tc.value AS top_category, share, fraction * 100 AS gs, (share - fraction * 100) / (fraction * 100) AS rel FROM tc JOIN mc USING (column_name, value) WHERE place = 1)"
_LBL = "CASE WHEN rel > 0.1 THEN 'above_average' WHEN rel < -0.1 THEN 'below_average' ELSE 'similar' END"
_DATES = "dm AS (SELECT node_id, 'visit_date' AS column_name, CAST(visit_date AS TIMESTAMP) AS value FROM longitudinal UNION ALL SELECT node_id, 'recorded_at', recorded_at FROM longitudinal), mp AS (SELECT column_name, strftime(value, '%Y-%m') AS period, count(*) AS cnt FROM dm WHERE value IS NOT NULL GROUP BY ALL)"
_SCREEN = f"s AS (SELECT *, power(1 - abs(r), 8) AS p FROM ({pf._corr_sql(HEART, {c: pf._clean(c) for c in ['age', 'trestbps', 'chol', 'thalach', 'oldpeak']}, 15, 'count(*)')}))"
_GRADE = "gc AS (SELECT node_id, 'grade' AS column_name, grade AS value, count(*) AS cnt FROM breast_cancer_gbsg WHERE grade IS NOT NULL GROUP BY ALL), gs AS (SELECT node_id, column_name, value, round(CAST(cnt AS DOUBLE) / sum(cnt) OVER (PARTITION BY node_id) * 100 / 100 * sum(cnt) OVER (PARTITION BY node_id), 4) AS size FROM gc)"
_PAIRCAT = f"m AS ({_M}), k(column_name, kind) AS (VALUES ('age','numeric'),('trestbps','numeric'),('chol','numeric'),('sex','categorical'),('cp','categorical'),('thal','categorical'),('exang','categorical')), ct AS (SELECT column_name, kind, count(DISTINCT value) AS n_levels FROM m JOIN k USING (column_name) GROUP BY ALL), cc AS (SELECT * FROM ct WHERE kind = 'numeric' OR n_levels <= 8)"

ORACLE = {
    "F1_overview_totals": f"WITH {_OV} SELECT count(*) AS n_nodes, CAST(sum(n_rows) AS BIGINT) AS total_rows, 15 AS n_cols, CAST(sum(n_missing) AS BIGINT) AS total_missing, CAST(sum(n_cells) AS BIGINT) AS total_cells, round(sum(n_missing) * 100.0 / sum(n_cells), 4) AS missing_percent FROM o",
    "F2_column_coverage": f"WITH {_CAT} SELECT * FROM cov",
    "F3_local_coverage": f"WITH {_CAT} SELECT node_id, column_name, CASE coverage WHEN 'unique' THEN 'unique_local' ELSE coverage END AS label FROM cat JOIN cov USING (column_name)",
    "F4_availability": f"WITH {_CAT} SELECT column_name, CASE coverage WHEN 'common_all' THEN 'common_all' ELSE 'not_common_all' END AS availability FROM cov",
    "F5_missing_total": f"WITH m AS ({_M}) SELECT column_name, count(*) - count(value) AS n_missing FROM m GROUP BY ALL",
    "F6_pooled_numeric": f"""WITH {_HM}, q AS (SELECT column_name, n, round(mean, 3) AS mean, round(variance, 3) AS variance, min, max FROM part), w AS (SELECT column_name, sum(n) AS count, sum(n * mean) / sum(n) AS gm, min(min) AS min, max(max) AS max FROM q GROUP BY ALL),
z AS (SELECT column_name, any_value(w.count) AS count, any_value(gm) AS gm, any_value(w.min) AS min, any_value(w.max) AS max, sum(CASE WHEN n > 1 THEN (n - 1) * variance ELSE 0 END + n * (mean - gm) ** 2) / (any_value(w.count) - 1) AS v FROM q JOIN w USING (column_name) GROUP BY column_name)
SELECT column_name, CAST(count AS BIGINT) AS count, round(gm, 2) AS mean, round(v, 2) AS variance, round(sqrt(v), 2) AS std_dev, round(min, 2) AS min, round(max, 2) AS max FROM z""",
    "F7_pooled_variance": f"WITH m AS ({_M}) SELECT column_name, count(value) AS count, round(var_samp(value), 4) AS variance, round(stddev_samp(value), 4) AS std_dev FROM m GROUP BY ALL",
    "F7_native_numeric": f"WITH m AS ({_M}) SELECT column_name, count(value) AS count, round(avg(value), 4) AS mean, round(var_samp(value), 4) AS variance, round(min(value), 4) AS min, round(max(value), 4) AS max FROM m GROUP BY ALL",
    "F8_merged_categories": f"WITH {_MERGED} SELECT column_name, value, cnt, round(fraction, 6) AS fraction FROM mc",
    "F8_merged_modes": f"WITH {_MERGED} SELECT column_name, count(*) AS num_categories, first(value ORDER BY cnt DESC, value) AS mode FROM mc GROUP BY ALL",
    "F9_merged_periods": f"WITH {_DATES} SELECT * FROM mp",
    "F9_most_active": f"WITH {_DATES} SELECT column_name, first(period ORDER BY cnt DESC, period) AS most_active_period, CAST(sum(cnt) AS BIGINT) AS total FROM mp GROUP BY ALL",
    "F10_merged_histogram": f"SELECT CAST(least(floor(age / 5), 19) AS INTEGER) AS bin, count(*) AS cnt FROM {HEART} WHERE age >= 0 AND age <= 100 GROUP BY ALL",
    "F11_merged_sex": f"SELECT {pf._sex} AS sex, count(*) AS cnt FROM longitudinal GROUP BY ALL",
    "F12_contributions": f"WITH {_OV} SELECT node_id, round(n_rows * 100.0 / tr, 4) AS patient_contribution, round((n_cells - n_missing) * 1.0 / tc, 4) AS completeness, round((n_cells - n_missing) * 1.0 / (tc - tm), 4) AS usable_data_contribution, round(n_missing * 1.0 / n_cells, 4) AS local_missing_rate, round((n_missing * 1.0 / n_cells) / ({_REL}), 4) AS relative_missing, round(n_cells * 1.0 / tc, 4) AS total_value_contribution FROM o, t",
    "F13_mean_alignment": f"WITH {_HM} SELECT node_id, column_name, CASE WHEN abs(round(mean, 3) - round(gmean, 3)) < 1e-6 THEN 'aligned' WHEN round(mean, 3) > round(gmean, 3) THEN 'above_global' ELSE 'below_global' END AS alignment FROM part JOIN g USING (column_name)",
    "F14_missing_label": f"WITH {_OV} SELECT node_id, {_MISS} AS missing_label FROM o, t",
    "F15_trends": "WITH d AS (SELECT source AS column_name, CAST(written_at AS DATE) AS period, count(*) AS cnt FROM documents WHERE source IS NOT NULL AND written_at IS NOT NULL GROUP BY ALL), x AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY period) - 1 AS x FROM d) SELECT column_name, count(*) AS n_periods, round(regr_slope(cnt, x), 6) + 0.0 AS slope, round(CASE WHEN var_pop(cnt) > 0 THEN regr_r2(cnt, x) ELSE 0 END, 6) AS r2 FROM x GROUP BY ALL HAVING count(*) >= 3",
    "F16_top_categories": f"WITH {_MERGED}, r AS (SELECT *, count(*) OVER (PARTITION BY column_name) AS num, row_number() OVER (PARTITION BY column_name ORDER BY cnt DESC, value) AS place FROM mc) SELECT column_name, value, cnt, place FROM r WHERE num > 2 AND place <= 3",
    "F18_coverage_counts": f"WITH {_CAT} SELECT node_id, CASE coverage WHEN 'unique' THEN 'unique_local' ELSE coverage END AS label, count(*) AS n_columns FROM cat JOIN cov USING (column_name) GROUP BY ALL",
    "J1_compare_left_join": f"WITH {_HM}, h AS (SELECT * FROM g WHERE column_name < 'oldpeak'), {_VS.replace('JOIN g', 'JOIN h')} SELECT node_id, column_name, round(mean, 4) AS mean, round(gmean, 4) AS mean_global, vs_global, round(abs(rel), 4) AS rel_diff_abs FROM v",
    "J2_compare_numeric": f"WITH {_HM}, {_VS} SELECT node_id, column_name, n, round(mean, 4) AS mean, round(gmean, 4) AS mean_global, vs_global, round(abs(rel), 4) AS rel_diff_abs FROM v",
    "J3_compare_categories": f"WITH {_TOPC} SELECT node_id, column_name, top_category, round(share, 4) AS local_share, round(gs, 4) AS global_share, {_LBL} AS vs_global, round(abs(rel), 4) AS rel_diff_abs FROM vc",
    "J4_compare_temporal": f"WITH {_DATES}, w AS (SELECT column_name, CAST(sum(cnt) AS BIGINT) AS total FROM mp GROUP BY ALL), l AS (SELECT node_id, column_name, count(value) AS count FROM dm GROUP BY ALL), q AS (SELECT *, (count - total) * 1.0 / total AS rel FROM l JOIN w USING (column_name)) SELECT node_id, column_name, count, total AS count_global, {_LBL} AS vs_global, round(abs(rel), 6) AS rel_diff_abs FROM q",
    "J5_column_pairs": f"WITH {_PAIRCAT} SELECT a.column_name AS var1, b.column_name AS var2, CASE WHEN a.kind = 'numeric' AND b.kind = 'numeric' THEN 'num-num' WHEN a.kind = b.kind THEN 'cat-cat' ELSE 'num-cat' END AS pair_type FROM cc a JOIN cc b ON (a.kind = b.kind AND a.column_name < b.column_name) OR (a.kind = 'numeric' AND b.kind = 'categorical')",
    "J6_node_lookup": f"WITH {_OV} SELECT node_id, n_rows, round(n_rows * 100.0 / tr, 4) AS patient_contribution FROM o, t",
    "J7_availability_lookup": f"WITH {_CAT}, p AS (SELECT node_id, column_name, count(value) AS n FROM m GROUP BY ALL HAVING count(value) > 0) SELECT node_id, column_name, n, CASE WHEN column_name = 'thal' THEN 'unknown' ELSE coalesce(coverage, 'unknown') END AS availability FROM p LEFT JOIN cov USING (column_name)",
    "J8_group_pairs": "SELECT DISTINCT a.o_orderpriority AS group_a, b.o_orderpriority AS group_b FROM (SELECT DISTINCT o_orderpriority FROM orders) a JOIN (SELECT DISTINCT o_orderpriority FROM orders) b ON a.o_orderpriority < b.o_orderpriority",
    "K1_top_deviation": f"WITH {_HM}, {_VS} SELECT node_id, column_name, round(mean, 4) AS mean, round(abs(rel), 4) AS rel_diff_abs FROM v ORDER BY abs(rel) DESC NULLS LAST, node_id, column_name LIMIT 10",
    "K2_top_imbalance": f"WITH {pf.LABEL_SQL} SELECT node_id, column_name, round(max(cnt) * 1.0 / min(cnt), 4) AS class_imbalance_ratio FROM c GROUP BY ALL ORDER BY max(cnt) * 1.0 / min(cnt) DESC, node_id, column_name LIMIT 10",
    "K3_top_activity": f"WITH {_DATES} SELECT node_id, column_name, count(value) AS count FROM dm GROUP BY ALL ORDER BY count DESC, node_id, column_name LIMIT 10",
    "K4_top_effect": f"SELECT var1, var2, round(r, 6) AS r FROM ({pf._corr_sql(HEART, {c: pf._clean(c) for c in ['age', 'trestbps', 'chol', 'thalach', 'oldpeak', 'ca', 'thal']}, 15, '1')}) ORDER BY abs(r) DESC, var1, var2 LIMIT 10",
    "K5_top_per_group": "WITH c AS (SELECT p_brand, p_type, count(*) AS cnt FROM part GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY cnt DESC, p_type) AS place FROM c) SELECT * FROM r WHERE place <= 3",
    "K6_merge_small": "WITH c AS (SELECT source, count(*) AS cnt FROM documents WHERE source IS NOT NULL GROUP BY ALL), s AS (SELECT CASE WHEN cnt * 1.0 / sum(cnt) OVER () < 0.03 THEN 'Other' ELSE source END AS slice, cnt FROM c) SELECT slice, CAST(sum(cnt) AS BIGINT) AS cnt FROM s GROUP BY ALL",
    "K7_volcano": f"WITH {_SCREEN} SELECT var1, var2, round(-log10(greatest(p, 1e-30)), 6) AS minus_log10_p, round(abs(r), 6) AS abs_effect FROM s ORDER BY abs(r) DESC, var1, var2 LIMIT 30",
    "K9_truncation_note": "SELECT CASE WHEN count(DISTINCT p_type) > 20 THEN 'Showing 20 of ' || count(DISTINCT p_type) || ' rows, by count.' ELSE '' END AS note FROM part",
    "K12_first_effect": f"WITH m AS ({_M}), p AS (SELECT node_id, column_name, skewness(value) AS sk, kurtosis(value) AS ku FROM m GROUP BY ALL), e AS (SELECT node_id, column_name, coalesce(CASE WHEN sk > 1 AND NOT isnan(sk) THEN sk END, CASE WHEN ku > 3 AND NOT isnan(ku) THEN ku END) AS effect_size FROM p) SELECT node_id, column_name, round(effect_size, 3) AS effect_size FROM e WHERE effect_size IS NOT NULL",
    "N1_smallest_group": f"WITH {pf.LABEL_SQL}, z AS (SELECT node_id, column_name, value, round(CAST(cnt AS DOUBLE) / sum(cnt) OVER w * 100 / 100 * sum(cnt) OVER w, 4) AS size FROM c WINDOW w AS (PARTITION BY node_id, column_name)) SELECT node_id, min(size) AS size, first(column_name ORDER BY size, column_name, value) AS column_name, first(value ORDER BY size, column_name, value) AS value, count(*) FILTER (size < 5) AS n_flagged FROM z GROUP BY node_id",
    "N1_small_groups": f"WITH {_GRADE} SELECT node_id, column_name, value, size FROM gs WHERE size < 5",
    "N2_small_group_warnings": f"""WITH {_GRADE} SELECT node_id, column_name, 'warning' AS level, '"grade" holds a category ("' || first(value ORDER BY value) || '") of about ' || CAST(CAST(round(first(size ORDER BY value)) AS BIGINT) AS VARCHAR) || ' individuals, below the reporting threshold of 5.' AS text FROM gs WHERE size < 5 GROUP BY node_id, column_name""",
    "N3_single_category": """WITH m AS (SELECT node_id, 'meno' AS column_name, CAST(meno AS VARCHAR) AS value FROM breast_cancer_gbsg UNION ALL SELECT node_id, 'hormon', CAST(hormon AS VARCHAR) FROM breast_cancer_gbsg UNION ALL SELECT node_id, 'area', area FROM node_sites), k AS (SELECT node_id, column_name FROM m GROUP BY ALL HAVING count(DISTINCT value) <= 1)
SELECT node_id, 'Only one category observed, no distribution shown: ' || string_agg(column_name, ', ' ORDER BY column_name) || '.' AS text FROM k GROUP BY node_id""",
    "N5_numeric_summary": f"WITH {_HM}, {_VS} SELECT node_id, count(*) || ' numeric variable(s), ' || count(*) FILTER (vs_global = 'above_average') || ' above and ' || count(*) FILTER (vs_global = 'below_average') || ' below the federated average (>10% relative difference).' AS text FROM v GROUP BY node_id",
    "N5_categorical_summary": f"WITH {_TOPC} SELECT node_id, count(*) || ' categorical variable(s), ' || count(*) FILTER (rel > 0.1) || ' with a more and ' || count(*) FILTER (rel < -0.1) || ' with a less dominant top category than the federation.' AS text FROM vc GROUP BY node_id",
    "N6_privacy_notice": f"WITH n AS (SELECT count(DISTINCT node_id) AS k FROM {HEART}) SELECT 0 AS line_no, 'Aggregates over ' || k || ' sites only; no row of any patient is shared or shown.' AS text FROM n UNION ALL SELECT 1, 'Means, deviations and counts are merged from summaries, trends fitted on counts by period.' UNION ALL SELECT 2, 'Identifier-like columns (patient_id, record_id) are left out.'",
    "N7_overview_strings": f"WITH {_OV} SELECT node_id, {_MISS} AS missingness, format('{{:,}}', n_missing) || ' (' || printf('%.2f', round(n_missing * 100.0 / n_cells, 2)) || '%)' AS missing_values FROM o, t",
    "P15_drop_internal": "SELECT r_regionkey, r_name FROM region",
    "P16_range_display": None,
    "P17_P18_significance": f"WITH {_SCREEN} SELECT var1, var2, CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE 'n.s.' END AS label, CASE WHEN p < 0.001 THEN CASE WHEN p = 0 THEN '0' ELSE '< 0.001' END ELSE 'shown' END AS shown FROM s",
    "P19_identifier_features": "SELECT unnest(['load_id', 'node_id', 'patient_id', 'record_id']) AS column_name",
    "set_operations": f"SELECT 'union' AS operation, count(*) AS n FROM (SELECT node_id FROM {HEART} UNION SELECT node_id FROM breast_cancer_gbsg) UNION ALL SELECT 'union_all', (SELECT count(*) FROM {HEART}) + (SELECT count(*) FROM breast_cancer_gbsg) UNION ALL SELECT 'intersect', count(*) FROM (SELECT node_id FROM {HEART} INTERSECT SELECT node_id FROM breast_cancer_gbsg) UNION ALL SELECT 'except', count(*) FROM (SELECT node_id FROM {HEART} EXCEPT SELECT node_id FROM breast_cancer_gbsg)",
}
ORACLE = {k: v for k, v in ORACLE.items() if v}
