"""Queries of the column quality profile (p3)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewise.operators import quality_profile as qp
from sitewise.session import table
from sitewise.sources import parquet_chunks as pc

WATCHED = {"heart_disease_cleveland": ["age", "oldpeak"], "breast_cancer_gbsg": ["nodes", "grade"]}
MEASURED = {
    "heart_disease_cleveland": ["age", "sex", "cp", "trestbps", "chol", "fbs", "restecg", "thalach", "exang", "oldpeak", "slope", "ca", "thal", "num"],
    "breast_cancer_gbsg": ["age", "meno", "size", "grade", "nodes", "pgr", "er", "hormon", "rfstime", "status"],
}
KEYS = {"heart_disease_cleveland": ["record_id", "patient_id", "node_id", "visit_date"], "breast_cancer_gbsg": ["record_id", "node_id", "rownames", "pid", "surgery_date"]}


def _both(make, columns: dict[str, list[str]]) -> DataFrame:
    return reduce(DataFrame.unionByName, [make(d, c) for d, c in columns.items()])


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qp.findings(qp.profile_tables(spark, sf_dir, WATCHED))


def p3_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every measured column of every load, with its change against the load before; ``p3_keys`` has the other columns."""
    return _described(qp.profile_tables(spark, sf_dir, MEASURED), "min_value", "max_value")


def p3_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for identifiers and dates: numbers exact, dates as days since 1970-01-01, texts by their order. load_id itself is the key."""
    return _described(qp.profile_tables(spark, sf_dir, KEYS, exact=True), "min_number", "max_number", "min_text", "max_text")


def _described(compared: DataFrame, *extrema: str) -> DataFrame:
    share = lambda a, b: F.round(F.try_divide(F.col(a), F.col(b)), 6)
    change = F.round(F.try_divide(F.col("distance").cast("double"), F.col("n_valid").cast("double") * F.col("prev_n_valid")), 6)

    return compared.select(
        "dataset", "load_id", "column_name", "n_rows", "n_missing", share("n_missing", "n_rows").alias("missing_share"), "n_distinct", *extrema, "n_bad_pattern", "n_out_of_range", "n_valid",
        F.round(F.try_divide(F.col("n_missing"), F.col("n_rows")) - F.try_divide(F.col("prev_n_missing"), F.col("prev_n_rows")), 6).alias("missing_change"), change.alias("distribution_change"),
    )


def p3_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole columns, identifiers and dates included: by footers and dictionaries, and by scans of the chunks they leave open."""

    def make(dataset: str, _: list[str]) -> DataFrame:
        return qp.whole_columns(spark, table(spark, sf_dir, dataset)).withColumn("dataset", F.lit(dataset))

    return _both(make, MEASURED)


def p3_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the chunks of the watched columns are answered."""
    made = lambda d, c: qp.chunk_decisions(pc.chunk_table(spark, table(spark, sf_dir, d), "load_id", c)).withColumn("dataset", F.lit(d))
    return _both(made, MEASURED).groupBy("dataset", "column_name", "answer").agg(F.count("*").alias("n_chunks"), F.sum("n_rows").alias("n_rows"), F.count("dictionary_size").alias("n_dictionaries"))


QUERIES = {"p3_found": p3_found, "p3_profile": p3_profile, "p3_keys": p3_keys, "p3_columns": p3_columns, "p3_chunks": p3_chunks}

_COUNTS = """
v AS (SELECT 'heart_disease_cleveland' AS dataset, load_id, 'age' AS column_name, CASE WHEN isnan(age) THEN NULL ELSE age END AS num, CAST(NULL AS VARCHAR) AS txt FROM heart_disease_cleveland
 UNION ALL SELECT 'heart_disease_cleveland', load_id, 'oldpeak', CASE WHEN isnan(oldpeak) THEN NULL ELSE oldpeak END, NULL FROM heart_disease_cleveland
 UNION ALL SELECT 'breast_cancer_gbsg', load_id, 'nodes', nodes, NULL FROM breast_cancer_gbsg
 UNION ALL SELECT 'breast_cancer_gbsg', load_id, 'grade', NULL, grade FROM breast_cancer_gbsg),
j AS (SELECT v.load_id, v.column_name, coalesce(CAST(num AS VARCHAR), txt) AS key, num IS NULL AND txt IS NULL AS missing,
  d.pattern IS NULL OR regexp_full_match(txt, d.pattern) AS fits, coalesce(num, TRY_CAST(txt AS DOUBLE)) AS val, d.min_value AS lo, d.max_value AS hi
  FROM v JOIN field_domains d ON d.dataset = v.dataset AND d.column_name = v.column_name),
k AS (SELECT *, NOT missing AND fits AND val BETWEEN lo AND hi AS valid FROM j),
m AS (SELECT load_id, column_name, count(*) AS n, count(*) FILTER (missing) AS nm, count(DISTINCT key) AS nd,
  count(*) FILTER (NOT missing AND NOT fits) AS nb, count(*) FILTER (NOT missing AND fits AND NOT valid) AS no, count(*) FILTER (valid) AS nv FROM k GROUP BY ALL),
b AS (SELECT m.*, l.prev_load_id, p.n AS pn, p.nm AS pnm, p.nd AS pnd, p.nv AS pnv FROM m JOIN loads l USING (load_id)
  LEFT JOIN m p ON p.load_id = l.prev_load_id AND p.column_name = m.column_name)"""

ORACLE = {
    "p3_found": f"""WITH {_COUNTS},
q AS (SELECT * FROM b WHERE nv >= 50 AND pnv >= 50),
e AS (SELECT q.load_id, q.column_name, k.val, 1 AS a, 0 AS z, q.nv, q.pnv FROM q JOIN k ON k.load_id = q.load_id AND k.column_name = q.column_name AND k.valid
  UNION ALL SELECT q.load_id, q.column_name, k.val, 0, 1, q.nv, q.pnv FROM q JOIN k ON k.load_id = q.prev_load_id AND k.column_name = q.column_name AND k.valid),
g AS (SELECT load_id, column_name, val, nv, pnv, sum(a) AS a, sum(z) AS z FROM e GROUP BY ALL),
c AS (SELECT load_id, column_name, nv, pnv, sum(a) OVER w AS ca, sum(z) OVER w AS cz FROM g WINDOW w AS (PARTITION BY load_id, column_name ORDER BY val))
SELECT load_id, column_name, 'bad_pattern' AS finding FROM b WHERE nb > 0
UNION ALL SELECT load_id, column_name, 'out_of_range' FROM b WHERE no > 0
UNION ALL SELECT load_id, column_name, 'null_share' FROM b WHERE abs(nm * pn - pnm * n) * 10 > n * pn
UNION ALL SELECT load_id, column_name, 'constant' FROM b WHERE nd = 1 AND pnd >= 2
UNION ALL SELECT DISTINCT load_id, column_name, 'shift' FROM c WHERE abs(ca * pnv - cz * nv) * 4 > nv * pnv""",
}

_DOUBLES = {"age", "sex", "cp", "trestbps", "chol", "fbs", "restecg", "thalach", "exang", "oldpeak", "slope", "ca", "thal"}


def _cells(dataset: str, column: str) -> str:
    if column == "grade":
        return f"SELECT '{dataset}' AS dataset, load_id, 'grade' AS column_name, CAST(NULL AS DOUBLE) AS num, grade AS txt FROM {dataset}"
    nan = dataset.startswith("heart") and column in _DOUBLES or column == "pgr"
    return f"SELECT '{dataset}' AS dataset, load_id, '{column}' AS column_name, {f'CASE WHEN isnan({column}) THEN NULL ELSE {column} END' if nan else f'CAST({column} AS DOUBLE)'} AS num, CAST(NULL AS VARCHAR) AS txt FROM {dataset}"


_ALL = " UNION ALL ".join(_cells(d, c) for d, cols in MEASURED.items() for c in cols)
_IN_DOMAIN = "coalesce(val >= lo, lo IS NULL) AND coalesce(val <= hi, hi IS NULL) AND (allowed_values IS NULL OR coalesce(list_contains([TRY_CAST(x AS DOUBLE) FOR x IN string_split(allowed_values, '|')], val), FALSE))"
ORACLE["p3_profile"] = f"""WITH v AS ({_ALL}),
w AS (SELECT dataset, load_id, column_name, num, txt, count(*) AS cnt FROM v GROUP BY ALL),
j AS (SELECT w.*, num IS NULL AND txt IS NULL AS missing, d.pattern IS NULL OR regexp_full_match(coalesce(txt, ''), d.pattern) AS fits, coalesce(num, TRY_CAST(txt AS DOUBLE)) AS val,
  CASE WHEN NOT isnan(d.min_value) THEN d.min_value END AS lo, CASE WHEN NOT isnan(d.max_value) THEN d.max_value END AS hi, d.allowed_values FROM w JOIN field_domains d USING (dataset, column_name)),
k AS (SELECT *, NOT missing AND fits AND {_IN_DOMAIN} AS valid FROM j),
m AS (SELECT dataset, load_id, column_name, CAST(sum(cnt) AS BIGINT) AS n, CAST(coalesce(sum(cnt) FILTER (missing), 0) AS BIGINT) AS nm, count(*) FILTER (NOT missing) AS nd, min(val) FILTER (NOT missing) AS mn, max(val) FILTER (NOT missing) AS mx,
  CAST(coalesce(sum(cnt) FILTER (NOT missing AND NOT fits), 0) AS BIGINT) AS nb, CAST(coalesce(sum(cnt) FILTER (NOT missing AND fits AND NOT valid), 0) AS BIGINT) AS no, CAST(coalesce(sum(cnt) FILTER (valid), 0) AS BIGINT) AS nv FROM k GROUP BY ALL),
b AS (SELECT m.*, l.prev_load_id, p.n AS pn, p.nm AS pnm, p.nv AS pnv FROM m LEFT JOIN loads l USING (load_id) LEFT JOIN m p ON p.load_id = l.prev_load_id AND p.column_name = m.column_name),
q AS (SELECT * FROM b WHERE nv >= 50 AND pnv >= 50),
e AS (SELECT q.load_id, q.column_name, k.val, k.cnt AS a, 0 AS z, q.nv, q.pnv FROM q JOIN k ON k.load_id = q.load_id AND k.column_name = q.column_name AND k.valid
  UNION ALL SELECT q.load_id, q.column_name, k.val, 0, k.cnt, q.nv, q.pnv FROM q JOIN k ON k.load_id = q.prev_load_id AND k.column_name = q.column_name AND k.valid),
g AS (SELECT load_id, column_name, val, nv, pnv, sum(a) AS a, sum(z) AS z FROM e GROUP BY ALL),
c AS (SELECT load_id, column_name, nv, pnv, sum(a) OVER w AS ca, sum(z) OVER w AS cz FROM g WINDOW w AS (PARTITION BY load_id, column_name ORDER BY val)),
d AS (SELECT load_id, column_name, max(abs(ca * pnv - cz * nv)) / (CAST(any_value(nv) AS DOUBLE) * any_value(pnv)) AS dist FROM c GROUP BY ALL)
SELECT b.dataset, b.load_id, b.column_name, n AS n_rows, nm AS n_missing, round(nm * 1.0 / n, 6) AS missing_share, nd AS n_distinct, mn AS min_value, mx AS max_value, nb AS n_bad_pattern, no AS n_out_of_range, nv AS n_valid,
 round(nm * 1.0 / n - pnm * 1.0 / pn, 6) AS missing_change, round(dist, 6) AS distribution_change FROM b LEFT JOIN d USING (load_id, column_name)"""


def _key_cells(dataset: str, column: str) -> str:
    num = "NULL" if column in ("patient_id", "node_id") else f"{column} - DATE '1970-01-01'" if column.endswith("_date") else column
    return f"SELECT '{dataset}' AS dataset, load_id, '{column}' AS column_name, CAST({num} AS BIGINT) AS num, {column if num == 'NULL' else 'CAST(NULL AS VARCHAR)'} AS txt FROM {dataset}"


_KEY_CELLS = " UNION ALL ".join(_key_cells(d, c) for d, cols in KEYS.items() for c in cols)
# No identifier or date has a pattern or a range in field_domains, so all values that are there are valid.
ORACLE["p3_keys"] = f"""WITH v AS ({_KEY_CELLS}),
k AS (SELECT dataset, load_id, column_name, num, txt, num IS NOT NULL OR txt IS NOT NULL AS valid, count(*) AS cnt FROM v GROUP BY ALL),
m AS (SELECT dataset, load_id, column_name, CAST(sum(cnt) AS BIGINT) AS n, CAST(coalesce(sum(cnt) FILTER (NOT valid), 0) AS BIGINT) AS nm, count(*) FILTER (valid) AS nd, min(num) AS mn, max(num) AS mx, min(txt) AS mnt, max(txt) AS mxt,
  CAST(coalesce(sum(cnt) FILTER (valid), 0) AS BIGINT) AS nv FROM k GROUP BY ALL),
b AS (SELECT m.*, l.prev_load_id, p.n AS pn, p.nm AS pnm, p.nv AS pnv FROM m LEFT JOIN loads l USING (load_id) LEFT JOIN m p ON p.load_id = l.prev_load_id AND p.column_name = m.column_name),
q AS (SELECT * FROM b WHERE nv >= 50 AND pnv >= 50),
e AS (SELECT q.load_id, q.column_name, k.num, k.txt, k.cnt AS a, 0 AS z, q.nv, q.pnv FROM q JOIN k ON k.load_id = q.load_id AND k.column_name = q.column_name AND k.valid
  UNION ALL SELECT q.load_id, q.column_name, k.num, k.txt, 0, k.cnt, q.nv, q.pnv FROM q JOIN k ON k.load_id = q.prev_load_id AND k.column_name = q.column_name AND k.valid),
g AS (SELECT load_id, column_name, num, txt, nv, pnv, sum(a) AS a, sum(z) AS z FROM e GROUP BY ALL),
c AS (SELECT load_id, column_name, nv, pnv, sum(a) OVER w AS ca, sum(z) OVER w AS cz FROM g WINDOW w AS (PARTITION BY load_id, column_name ORDER BY num, txt)),
d AS (SELECT load_id, column_name, max(abs(ca * pnv - cz * nv)) / (CAST(any_value(nv) AS DOUBLE) * any_value(pnv)) AS dist FROM c GROUP BY ALL)
SELECT b.dataset, b.load_id, b.column_name, n AS n_rows, nm AS n_missing, round(nm * 1.0 / n, 6) AS missing_share, nd AS n_distinct, mn AS min_number, mx AS max_number, mnt AS min_text, mxt AS max_text, 0 AS n_bad_pattern, 0 AS n_out_of_range, nv AS n_valid,
 round(nm * 1.0 / n - pnm * 1.0 / pn, 6) AS missing_change, round(dist, 6) AS distribution_change FROM b LEFT JOIN d USING (load_id, column_name)"""
