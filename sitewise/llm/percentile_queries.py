"""Queries of the percentile operator (p2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewise.llm import percentiles as pt
from sitewise.session import broadcast_if_small, table

COLUMNS = {"heart_disease_cleveland": ["chol", "trestbps"], "breast_cancer_gbsg": ["rfstime", "pgr"]}
NO_DAY = "0001-01-01"


def day_cells(spark: SparkSession, sf_dir: str, resolution: float = 0.0) -> DataFrame:
    """Cells by node and day of loaded_at for the four columns."""
    days = broadcast_if_small(table(spark, sf_dir, "loads").select("load_id", F.to_date("loaded_at").alias("day")).dropDuplicates(["load_id"]))
    parts = [pt.cells(table(spark, sf_dir, d).select("node_id", "load_id", *c).join(days, "load_id", "left"), ["node_id", "day"], c, resolution) for d, c in COLUMNS.items()]
    return parts[0].unionByName(parts[1])


def _levels(parts: DataFrame) -> DataFrame:
    """The cells of every node and day, and merged from them those of nodes, days and the whole."""
    node, day = F.coalesce("node_id", F.lit("")), F.coalesce("day", F.lit(NO_DAY).cast("date"))
    kinds = F.array(*[F.struct(F.lit(k).alias("level"), n.alias("g_node"), d.alias("g_day")) for k, n, d in (("node_day", node, day), ("node", node, F.lit(NO_DAY).cast("date")), ("day", F.lit(""), day), ("all", F.lit(""), F.lit(NO_DAY).cast("date")))])
    return pt.merged(parts.select("column_name", "value", "cnt", F.explode(kinds).alias("g")).select("column_name", "value", "cnt", "g.*"), ["level", "g_node", "g_day"])


def p2_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles by node and day, node, day and in all; error 0."""
    found = pt.bisect(_levels(day_cells(spark, sf_dir)), ["level", "g_node", "g_day"])
    return found.select("column_name", "level", F.nullif("g_node", F.lit("")).alias("node_id"), F.date_format(F.nullif("g_day", F.lit(NO_DAY).cast("date")), "yyyy-MM-dd").alias("day"), "n", *[f"p{p:02d}" for p in pt.PERCENTS])


def p2_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months of each node, merged from summaries of days kept at a resolution of 0.5 (error at most 0.25)."""
    parts = day_cells(spark, sf_dir, 0.5).withColumn("month", F.date_format("day", "yyyy-MM"))
    return pt.bisect(pt.merged(parts, ["node_id", "month"]), ["node_id", "month"])


QUERIES = {"p2_percentiles": p2_percentiles, "p2_monthly": p2_monthly}

_VALUES = """h AS (SELECT t.node_id, CAST(l.loaded_at AS DATE) AS day, t.chol, t.trestbps FROM heart_disease_cleveland t LEFT JOIN loads l USING (load_id)),
b AS (SELECT t.node_id, CAST(l.loaded_at AS DATE) AS day, t.rfstime, t.pgr FROM breast_cancer_gbsg t LEFT JOIN loads l USING (load_id)),
u AS (SELECT 'chol' AS column_name, node_id, day, chol AS v FROM h UNION ALL SELECT 'trestbps', node_id, day, trestbps FROM h
 UNION ALL SELECT 'rfstime', node_id, day, CAST(rfstime AS DOUBLE) FROM b UNION ALL SELECT 'pgr', node_id, day, pgr FROM b),
k AS (SELECT * FROM u WHERE v IS NOT NULL AND NOT isnan(v))"""
_PICK = ", ".join(f"min(v) FILTER (upto >= greatest(1, (n * {p} + 99) // 100)) AS p{p:02d}" for p in pt.PERCENTS)

ORACLE = {
    "p2_percentiles": f"""WITH {_VALUES},
g AS (SELECT column_name, 'node_day' AS level, node_id, day, v FROM k UNION ALL SELECT column_name, 'node', node_id, NULL, v FROM k
 UNION ALL SELECT column_name, 'day', NULL, day, v FROM k UNION ALL SELECT column_name, 'all', NULL, NULL, v FROM k),
c AS (SELECT column_name, level, node_id, day, v, count(*) AS cnt FROM g GROUP BY ALL),
o AS (SELECT *, sum(cnt) OVER (PARTITION BY column_name, level, node_id, day ORDER BY v) AS upto, sum(cnt) OVER (PARTITION BY column_name, level, node_id, day) AS n FROM c)
SELECT column_name, level, node_id, strftime(day, '%Y-%m-%d') AS day, CAST(max(n) AS BIGINT) AS n, {_PICK} FROM o GROUP BY column_name, level, node_id, o.day""",
    "p2_monthly": f"""WITH {_VALUES},
c AS (SELECT column_name, node_id, strftime(day, '%Y-%m') AS month, round(v / 0.5) * 0.5 AS v, count(*) AS cnt FROM k GROUP BY ALL),
o AS (SELECT *, sum(cnt) OVER (PARTITION BY column_name, node_id, month ORDER BY v) AS upto, sum(cnt) OVER (PARTITION BY column_name, node_id, month) AS n FROM c)
SELECT column_name, node_id, month, CAST(max(n) AS BIGINT) AS n, {_PICK} FROM o GROUP BY column_name, node_id, month""",
}
