"""Queries of the filling of missing values (p5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewise.operators import impute
from sitewise.session import cut_lineage, table

DATASET, FIELDS = "heart_disease_cleveland", ["ca", "thal", "slope", "chol"]


def _filled(spark: SparkSession, sf_dir: str, only_gaps: bool) -> DataFrame:
    heart = table(spark, sf_dir, DATASET).select("record_id", "node_id", "patient_id", "visit_date", *FIELDS)
    return impute.fill_missing(heart, impute.Domains(table(spark, sf_dir, "field_domains"), DATASET, FIELDS), "record_id", "node_id", "patient_id", "visit_date", only_gaps)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The masks of the filled records as they are stored; a gap is listed whether or not something could be filled in."""
    stored = cut_lineage(_filled(spark, sf_dir, True))
    return impute.filled_fields(stored, "record_id", FIELDS).select("record_id", "field_name")


def p5_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record with its four fields complete and the masks of what was filled."""
    return _filled(spark, sf_dir, False).withColumn("chol", F.round("chol", 3)).drop("patient_id", "visit_date")


def p5_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filled fields of each node and the mean of what was filled in."""
    filled = _filled(spark, sf_dir, False)
    cells = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("value"), F.col(f + impute.MASK).alias("hit")) for f in FIELDS])
    x = filled.select("node_id", F.explode(cells).alias("x")).select("node_id", "x.*")
    return x.groupBy("node_id", "field_name").agg(F.count("*").alias("n_records"), F.count_if("hit").alias("n_filled"), F.count_if(F.col("value").isNull()).alias("n_open"), F.round(F.avg(F.when(F.col("hit"), F.col("value"))), 3).alias("mean_filled"))


QUERIES = {"p5_found": p5_found, "p5_filled": p5_filled, "p5_rates": p5_rates}

_IN = {"ca": "IN (0, 1, 2, 3)", "thal": "IN (3, 6, 7)", "slope": "IN (1, 2, 3)", "chol": "BETWEEN 80 AND 700"}
_CODES = {"ca": (0, 1, 2, 3), "thal": (3, 6, 7), "slope": (1, 2, 3)}


def _weight_sql(x: str, slack: str, degrees: str) -> str:
    return f"CASE WHEN ({x} - ({slack})) / ({degrees}) > 0 THEN greatest((1 - ({x} - ({slack})) / ({degrees})) / (({x} - ({slack})) / ({degrees})), {impute.LEAST_WEIGHT}) END"


def _category_sql(f: str) -> str:
    """CTEs of the multinomial model of one field: f_x<n> holds g, t and the shares p0.. after each round."""
    k = range(len(_CODES[f]))
    n = "(" + " + ".join(f"c{i}" for i in k) + ")"
    parts = [
        f"{f}_c AS (SELECT g, t, " + ", ".join(f"CAST(count(*) FILTER ({f} = {c}) AS DOUBLE) AS c{i}" for i, c in enumerate(_CODES[f])) + " FROM k GROUP BY ALL)",
        f"{f}_s AS (SELECT " + ", ".join(f"sum(c{i}) / sum({n}) AS s{i}" for i in k) + f" FROM {f}_c)",
    ]
    off = " + ".join(f"(c{i} - {n} * s{i}) ** 2 / ({n} * s{i})" for i in k)
    for by in "gt":
        per = f"(SELECT {by}, " + ", ".join(f"sum(c{i}) AS c{i}" for i in k) + f" FROM {f}_c GROUP BY {by})"
        parts.append(f"{f}_w{by} AS (SELECT {_weight_sql('x', 'l - 1', 'm - l - q / m + 1')} AS w FROM (SELECT sum({off}) FILTER ({n} > 0) / {len(k) - 1} AS x, count(*) FILTER ({n} > 0) AS l, sum({n}) AS m, sum({n} * {n}) AS q FROM {per}, {f}_s))")
    parts.append(f"{f}_x0 AS (SELECT g, t, {n} AS n, " + ", ".join(f"c{i}, s{i}, s{i} AS p{i}" for i in k) + f" FROM {f}_c, {f}_s)")
    step = 0
    for _ in range(impute.ROUNDS):
        for by in "gt":
            raw = ", ".join(f"CASE WHEN w IS NULL THEN p{i} ELSE p{i} * (sum(c{i}) OVER (PARTITION BY {by}) + w * s{i}) / (sum(n * p{i}) OVER (PARTITION BY {by}) + w * s{i}) END AS r{i}" for i in k)
            total = " + ".join(f"r{i}" for i in k)
            parts.append(f"{f}_x{step + 1} AS (SELECT g, t, n, " + ", ".join(f"c{i}, s{i}, r{i} / ({total}) AS p{i}" for i in k) + f" FROM (SELECT *, {raw} FROM {f}_x{step}, {f}_w{by}))")
            step += 1
    chi = " + ".join(f"(n{i} - e{i}) ** 2 / e{i}" for i in k)
    own = " + ".join(f"n{i}" for i in k)
    parts += [
        f"{f}_m AS (SELECT m, " + ", ".join(f"CAST(count(*) FILTER ({f} = {c}) AS DOUBLE) AS n{i}, sum(p{i}) FILTER ({f} IS NOT NULL) AS e{i}" for i, c in enumerate(_CODES[f])) + f" FROM k JOIN {f}_x{step} USING (g, t) WHERE m IS NOT NULL GROUP BY m)",
        f"{f}_wm AS (SELECT {_weight_sql('x', 'l', 'q - l')} AS w FROM (SELECT sum({chi}) / {len(k) - 1} AS x, count(*) FILTER ({own} > 0) AS l, sum({own}) AS q FROM {f}_m))",
    ]
    best = "greatest(" + ", ".join(f"round(coalesce(n{i} / w, 0) + p{i}, 9)" for i in k) + ")"
    pick = "CASE " + " ".join(f"WHEN round(coalesce(n{i} / w, 0) + p{i}, 9) = {best} THEN {c}.0" for i, c in enumerate(_CODES[f])) + " END"
    parts.append(f"{f}_f AS (SELECT record_id, {pick} AS v FROM k JOIN {f}_x{step} USING (g, t) LEFT JOIN {f}_m USING (m) CROSS JOIN {f}_wm WHERE k.{f} IS NULL)")
    return ",\n".join(parts)


def _effects_sql() -> str:
    """CTEs of the mixed model of chol: num_x<n> holds g, t and the effects ug and ut after each round."""
    parts = [f"num_{by} AS (SELECT rest / spread AS w FROM (SELECT avg((s / n - mean) ** 2) - any_value(rest) * avg(1 / n) AS spread, any_value(rest) AS rest FROM (SELECT {by}, sum(n) AS n, sum(s) AS s FROM num GROUP BY {by} HAVING sum(n) > 0), num_a) WHERE spread > 0)" for by in "gt"]
    parts.append("num_x0 AS (SELECT g, t, n, s - n * mean AS d, 0.0 AS ug, 0.0 AS ut FROM num, num_a)")
    step = 0
    for _ in range(impute.ROUNDS):
        for by, other in ("gt", "tg"):
            parts.append(f"num_x{step + 1} AS (SELECT g, t, n, d, u{other}, CASE WHEN w IS NULL THEN u{by} ELSE sum(d - n * u{other}) OVER (PARTITION BY {by}) / (sum(n) OVER (PARTITION BY {by}) + w) END AS u{by} FROM num_x{step} LEFT JOIN num_{by} ON TRUE)")
            step += 1
    return ",\n".join([*parts, f"base AS (SELECT g, t, mean + ug + ut AS b FROM num_x{step}, num_a)"])


_NUMBER = f"""num AS (SELECT g, t, CAST(count(chol) AS DOUBLE) AS n, coalesce(sum(chol), 0) AS s, coalesce(sum(chol * chol), 0) AS ss FROM k GROUP BY ALL),
num_a AS (SELECT sum(s) / sum(n) AS mean, greatest(sum(ss - s * s / n) FILTER (n > 0), 0) / greatest(sum(n) - count(*) FILTER (n > 0), 1) AS rest FROM num),
{_effects_sql()},
mem AS (SELECT m, CAST(count(chol) AS DOUBLE) AS n, coalesce(sum(chol - b), 0) AS s, coalesce(sum((chol - b) ** 2), 0) AS ss FROM k JOIN base USING (g, t) WHERE m IS NOT NULL GROUP BY m),
mem_a AS (SELECT greatest(sum(ss - s * s / n), 0) / (sum(n) - count(*)) AS w, (sum(s * s / n) - sum(s) * sum(s) / sum(n)) / (count(*) - 1) AS bt, (sum(n) - sum(n * n) / sum(n)) / (count(*) - 1) AS z FROM mem WHERE n > 0),
mem_r AS (SELECT CASE WHEN (bt - w) / z > 0 THEN w / ((bt - w) / z) END AS ratio FROM mem_a),
chol_f AS (SELECT record_id, least(greatest(b + coalesce(s / (n + ratio), 0), 80), 700) AS v FROM k JOIN base USING (g, t) LEFT JOIN mem USING (m) CROSS JOIN mem_r WHERE k.chol IS NULL)"""
_FILL = f"""WITH k AS (SELECT record_id, node_id, coalesce(node_id, '') AS g, coalesce(strftime(visit_date, '%Y-%m'), '') AS t, patient_id AS m, {", ".join(f"CASE WHEN NOT isnan({f}) AND {f} {r} THEN {f} END AS {f}" for f, r in _IN.items())} FROM {DATASET}),
{", ".join(_category_sql(f) for f in _CODES)},
{_NUMBER},
filled AS (SELECT record_id, node_id, {", ".join(f"{'round' if f == 'chol' else ''}(coalesce(k.{f}, {f}_f.v){', 3' if f == 'chol' else ''}) AS {f}, k.{f} IS NULL AS {f}__filled" for f in FIELDS)} FROM k {" ".join(f"LEFT JOIN {f}_f USING (record_id)" for f in FIELDS)}),
exact AS (SELECT record_id, node_id, {", ".join(f"coalesce(k.{f}, {f}_f.v) AS {f}, k.{f} IS NULL AS {f}_h" for f in FIELDS)} FROM k {" ".join(f"LEFT JOIN {f}_f USING (record_id)" for f in FIELDS)})"""
ORACLE = {
    "p5_found": " UNION ALL ".join(f"SELECT record_id, '{f}' AS field_name FROM heart_disease_cleveland WHERE {f} IS NULL OR isnan({f}) OR NOT ({f} {r})" for f, r in _IN.items()),
    "p5_filled": f"{_FILL} SELECT * FROM filled",
    "p5_rates": f"{_FILL} " + " UNION ALL ".join(f"SELECT node_id, '{f}' AS field_name, count(*) AS n_records, count(*) FILTER ({f}_h) AS n_filled, count(*) FILTER ({f} IS NULL) AS n_open, round(avg({f}) FILTER ({f}_h), 3) AS mean_filled FROM exact GROUP BY node_id" for f in FIELDS),
}
