"""Exact percentiles of very large numeric columns by bisection, mergeable across groups.

The mergeable summary of a column is its *cells*: counts by group and value, optionally with values
rounded to a resolution. Cells of several days or nodes add up to the cells of any larger group, and a
percentile is found on cells alone. For every group and percentile an interval of values is kept that
holds the target rank; a pass counts the rows below the midpoints of six halvings at once (63 of them),
and the interval shrinks to the part that holds the rank, with its ends moved to values that occur. It
ends when both ends agree.

Error: the value at rank ceil(p * n / 100) of the sorted values exactly; with a resolution r each value
is off by at most r / 2 and the rank stays exact for the rounded values. Passes: at most a sixth of the
bits of a double, usually log64(range / gap), so two to four.

Layout: counts are combined before every shuffle. Cells are cached once; while the open intervals are
few they go to the cells, and each pass moves only the counts between midpoints. Beyond that the cells are
laid out once by group, those of groups with many distinct values (a node with a third of all rows, the
total) split over several tasks by a salt of the value, and the intervals come to them.

Defined results: null and NaN are missing; a group without values has no row; -0.0 is 0.0; infinities
are values like others; empty input gives no rows; ties need no rule, as equal values are one cell.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitewise.session import broadcast_if_small, cut_lineage

PERCENTS = (5, 25, 50, 75, 95)
MAX_DOUBLE = 1.7976931348623157e308
SPLIT_VALUES = 500_000
PARTS = 64
FEW_GROUPS = 20_000


def cells(df: DataFrame, keys: list[str], columns: list[str], resolution: float = 0.0) -> DataFrame:
    """Counts by ``keys`` and value of each column: keys, column_name, value, cnt."""
    long = df.select(*keys, F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("value")) for c in columns])).alias("v")).select(*keys, "v.*")
    value = F.round(F.col("value") / resolution) * resolution if resolution else F.col("value")
    return long.where("value is not null and not isnan(value)").withColumn("value", value + F.lit(0.0)).groupBy(*keys, "column_name", "value").agg(F.count("*").alias("cnt"))


def merged(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Cells of a larger group from the cells of its parts."""
    return parts.groupBy(*keys, "column_name", "value").agg(F.sum("cnt").alias("cnt"))


def _part(low: str, high: str) -> str:
    """The number of midpoints of an interval at or below ``value``; its ends always fall apart."""
    half = lambda x: f"greatest(least({x}, {MAX_DOUBLE!r}d), -{MAX_DOUBLE!r}d) / 2"
    at = f"floor(({half('value')} - {half(low)}) / ({half(high)} - {half(low)}) * {PARTS})"
    return f"cast(case when value = {low} then 0 when value = {high} then {PARTS - 1} else least(greatest({at}, 0), {PARTS - 1}) end as int)"


def bisect(parts: DataFrame, keys: list[str], percents: tuple[int, ...] = PERCENTS) -> DataFrame:
    """Percentiles of each group of ``keys`` and column from its cells: keys, column_name, n, p<percent>..."""
    group = [*keys, "column_name"]
    parts = parts.persist()  # cells: read by the sizes and by every pass
    laid, on = parts, group
    try:
        sizes = cut_lineage(parts.groupBy(*group).agg(F.sum("cnt").alias("n"), F.count("*").alias("n_values"), F.min("value").alias("lo"), F.max("value").alias("hi")))
        ranks = ", ".join(f"struct({p} as p, greatest(1, (n * {p} + 99) div 100) as r)" for p in percents)
        state = sizes.selectExpr(*group, "n", "lo", "hi", "0L as c", f"inline(array({ranks}))")
        if sizes.limit(FEW_GROUPS + 1).count() > FEW_GROUPS:
            laid, on = _laid(parts, sizes, group), [*group, "salt"]
        done: list[DataFrame] = []
        while True:
            done.append(state.where("lo = hi"))
            active = state.where("lo < hi")
            if active.isEmpty():
                break
            state = cut_lineage(_pass(laid, active, group, on, sizes))
    finally:
        if laid is not parts:
            laid.unpersist()
        parts.unpersist()
    found = reduce(DataFrame.unionByName, done).groupBy(*group).agg(F.first("n").alias("n"), *[F.expr(f"max(case when p = {p} then lo end) as p{p:02d}") for p in percents])
    return found


def _laid(parts: DataFrame, sizes: DataFrame, group: list[str]) -> DataFrame:
    """The cells by group, with a salt for groups of many values."""
    spark = parts.sparkSession
    width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    hot = broadcast_if_small(sizes.selectExpr(*group, f"cast(ceil(n_values / {SPLIT_VALUES}) as int) as parts").where("parts > 1"))
    salted = parts.join(hot, group, "left").withColumn("salt", F.expr("cast(pmod(xxhash64(value), coalesce(parts, 1)) as int)")).drop("parts")
    return salted.repartition(width, *group, "salt").persist()


def _pass(laid: DataFrame, active: DataFrame, group: list[str], on: list[str], sizes: DataFrame) -> DataFrame:
    """One narrowing of every open interval; percentiles that share an interval are counted once."""
    open_ = active.select(*group, "lo", "hi").distinct()
    if "salt" in on:
        open_ = open_.join(sizes.select(*group, "n_values"), group).withColumn("salt", F.expr(f"explode(sequence(0, cast(ceil(n_values / {SPLIT_VALUES}) as int) - 1))")).drop("n_values").hint("shuffle_hash")
    else:
        open_ = F.broadcast(open_)  # at most one interval per percentile of FEW_GROUPS groups
    hit = laid.join(open_, on).where("value between lo and hi").withColumn("part", F.expr(_part("lo", "hi")))
    counted = hit.groupBy(*group, "lo", "hi", "part").agg(F.sum("cnt").alias("cnt"), F.min("value").alias("first"), F.max("value").alias("last"))
    run = Window.partitionBy(*group, "lo", "hi").orderBy("part")  # at most PARTS rows
    counted = counted.withColumn("upto", F.sum("cnt").over(run))
    both = active.join(counted, [*group, "lo", "hi"]).where("c + upto >= r and c + upto - cnt < r")
    return both.selectExpr(*group, "n", "first as lo", "last as hi", "c + upto - cnt as c", "p", "r")
