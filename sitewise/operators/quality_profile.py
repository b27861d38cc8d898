"""Column-level data quality of large tables, by load.

Footers come first: chunks whose footer (and dictionary) already fixes the distribution of a column
within one load are answered from it; the others are scanned by Spark's own reader, and only they.
Either way a chunk becomes counts (load, column, value, count), combined before anything is shuffled. All measures and findings are sums over those counts.

A load may hold a third of all rows: its counts are at most its distinct values, and the comparison of
distributions works on value ranges (``_range_of``) rather than on whole loads, so no task gets more
than one range of one load.

Defined results: null and NaN are missing; a column without a domain has no findings of pattern and
range; a load without rows, or whose previous load has none, is not compared; text in a number column
that has no pattern is out of range unless it is a number in range; -0.0 counts as 0.0.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitewise.session import cut_lineage, table
from sitewise.sources import parquet_chunks as pc
from sitewise.sources import raw_csv as rc

LIMITS = {"null_share": (1, 10), "shift": (1, 4), "least_valid": 50}  # shares as fractions, compared in whole numbers


def chunk_decisions(chunks: DataFrame) -> DataFrame:
    """Chunks with ``answer``: 'footer' if footer and dictionary fix the counts by load, else 'scan'.

    They do if the row group holds one load only and the column has, beside nulls of known number, at
    most one value: a dictionary of one entry, or for columns that cannot hold NaN equal extrema.
    """
    one_load = F.col("key_min") == F.col("key_max")
    all_null = F.col("n_null") == F.col("n_rows")
    one_value = (F.col("dictionary_size") == 1) | (~F.col("has_nan") & ((F.col("num_min") == F.col("num_max")) | (F.col("text_min") == F.col("text_max"))))
    fixed = one_load & F.col("n_null").isNotNull() & (all_null | one_value)
    return chunks.withColumn("answer", F.when(F.coalesce(fixed, F.lit(False)), "footer").otherwise("scan"))


def value_counts(spark: SparkSession, df: DataFrame, key: str, columns: list[str], exact: bool = False) -> DataFrame:
    """Counts by load and value: load_id, column_name, num, text, cnt (num and text null: missing).

    exact: also ``whole``, which holds whole numbers too large for a double; dates are day numbers.
    """
    chunks = chunk_decisions(pc.chunk_table(spark, df, key, columns, "single"))
    decided = cut_lineage(chunks.drop("dictionary_size", "text_max", "num_max").withColumns({"num_values": F.slice("num_values", 1, 1), "text_values": F.slice("text_values", 1, 1)}))  # one narrow row per chunk
    by_footer = decided.where("answer = 'footer'")
    value = F.when(~F.col("has_nan"), F.coalesce(F.get("num_values", F.lit(0)), F.col("num_min")))
    text = F.coalesce(F.get("text_values", F.lit(0)), F.col("text_min"))
    kept = by_footer.select(
        F.col("key_min").alias("key"), "column_name",
        F.explode(F.array(F.struct(value.alias("num"), text.alias("text"), (F.col("n_rows") - F.col("n_null")).alias("cnt")), F.struct(F.lit(None).cast("double").alias("num"), F.lit(None).cast("string").alias("text"), F.col("n_null").alias("cnt")))).alias("v"),
    ).select("key", "column_name", "v.num", "v.text", "v.cnt").where("cnt > 0")
    both = _scanned(df, key, decided, exact).unionByName(kept, allowMissingColumns=exact).withColumn("num", F.col("num") + 0.0)
    return both.groupBy(F.col("key").alias("load_id"), "column_name", "num", *(["whole"] if exact else []), "text").agg(F.sum("cnt").alias("cnt"))


def _lanes(column: str, kind: str, exact: bool) -> str:
    """A value as num, whole (if exact) and text: doubles, whole numbers that no double holds, texts; dates as day numbers."""
    c, whole = f"`{column}`", "cast(null as bigint)"
    if kind == "string":
        num, text = "cast(null as double)", c
    else:
        text = "cast(null as string)"
        if kind in ("double", "float"):
            num = f"case when not isnan({c}) then cast({c} as double) end"
        else:
            number = f"unix_date({c})" if kind == "date" else f"unix_micros(cast({c} as timestamp))" if kind.startswith("timestamp") else f"cast({c} as int)" if kind == "boolean" else c
            num = f"cast({number} as double)"
            if exact and (kind == "bigint" or kind.startswith("timestamp")):
                num, whole = (f"case when abs({number}) <= {pc.EXACT} then {num} end"), f"case when abs({number}) > {pc.EXACT} then {number} end"
    return f"struct('{column}' as column_name, {num} as num, {f'{whole} as whole, ' if exact else ''}{text} as text)"


def _scanned(df: DataFrame, key: str, decided: DataFrame, exact: bool) -> DataFrame:
    """The values of the chunks that footers leave open, with cnt 1, not yet summed: key, column_name, num, (whole,) text, cnt.

    Columns answered by footers everywhere are not read, row groups outside the keys in question are
    pruned by the reader, and of the others the rows of answered chunks are left out by their place.
    """
    kinds = dict(df.dtypes)
    per = decided.groupBy("column_name").agg(F.count_if(F.col("answer") == "scan").alias("open"), F.count_if(F.col("answer") == "footer").alias("told"), F.min(F.when(F.col("answer") == "scan", F.coalesce("key_min", F.lit(-(1 << 63))))).alias("lo"), F.max(F.when(F.col("answer") == "scan", F.coalesce("key_max", F.lit((1 << 63) - 1)))).alias("hi"))
    rows = [r for r in per.collect() if r.open]  # one row per column
    columns = sorted(r.column_name for r in rows)
    made = {c: _lanes(c, kinds[c], exact) for c in columns}
    if not rows:
        return df.limit(0).selectExpr(f"cast(`{key}` as bigint) as key", f"inline(array({_lanes(df.columns[0], 'string', exact)}))").withColumn("cnt", F.lit(0).cast("long"))
    x = df
    if any(r.told for r in rows):
        lo, hi = min(r.lo for r in rows), max(r.hi for r in rows)
        if lo > -(1 << 63) and hi < (1 << 63) - 1:
            x = x.where(F.col(f"`{key}`").between(lo, hi))
        place = Window.partitionBy("file", "column_name").orderBy("row_group").rowsBetween(Window.unboundedPreceding, -1)  # row groups of a file
        told = decided.withColumn("begin", F.coalesce(F.sum("n_rows").over(place), F.lit(0))).where("answer = 'footer'")
        told = told.groupBy("file").agg(F.collect_list(F.struct("column_name", "begin", (F.col("begin") + F.col("n_rows")).alias("end"))).alias("_told"))
        x = x.withColumns({"_file": F.col("_metadata.file_path"), "_row": F.col("_metadata.row_index")}).join(told, F.col("_file") == F.col("file"), "left")
        cells = ", ".join(f"case when not coalesce(exists(_told, t -> t.column_name = '{c}' and _row >= t.begin and _row < t.end), false) then {m} end" for c, m in made.items())
        x = x.selectExpr(f"cast(`{key}` as bigint) as key", f"explode(array_compact(array({cells}))) as v").select("key", "v.*")
    else:
        x = x.selectExpr(f"cast(`{key}` as bigint) as key", f"inline(array({', '.join(made.values())}))")
    return x.withColumn("cnt", F.lit(1).cast("long"))


def judged(counts: DataFrame, domains: DataFrame) -> DataFrame:
    """Counts (with their dataset) with value, missing, fits (the pattern) and valid."""
    rules = domains.select("dataset", "column_name", F.when(~F.isnan("min_value"), F.col("min_value")).alias("lo"), F.when(~F.isnan("max_value"), F.col("max_value")).alias("hi"), "allowed_values", "pattern")
    x = counts.join(F.broadcast(rules), ["dataset", "column_name"], "left")  # field_domains is a fixed, narrow table
    allowed = F.filter(F.transform(F.split("allowed_values", "\\|"), rc.number_of), lambda v: v.isNotNull())
    words = F.split("allowed_values", "\\|")
    large = [F.col("whole")] if "whole" in counts.columns else []
    x = x.withColumn("value", F.coalesce("num", *[c.cast("double") for c in large], rc.number_of(F.col("text")))).withColumn("missing", reduce(Column.__and__, [c.isNull() for c in (F.col("num"), F.col("text"), *large)]))
    written = F.coalesce("text", *[c.cast("string") for c in large], F.col("num").cast("string"))
    fits = F.col("pattern").isNull() | F.rlike(written, F.concat(F.lit("^(?:"), F.col("pattern"), F.lit(")\\z")))
    in_range = F.coalesce(F.col("value") >= F.col("lo"), F.col("lo").isNull()) & F.coalesce(F.col("value") <= F.col("hi"), F.col("hi").isNull())
    in_list = F.col("allowed_values").isNull() | F.coalesce(F.array_contains(allowed, F.col("value")), F.lit(False)) | F.coalesce(F.array_contains(words, F.col("text")), F.lit(False))
    x = x.withColumn("fits", fits).withColumn("valid", ~F.col("missing") & fits & in_range & in_list)
    return x.select("dataset", "load_id", "column_name", "num", *large, "text", "value", "cnt", "missing", "fits", "valid")


def load_measures(x: DataFrame) -> DataFrame:
    """One row per load and column of what its counts say."""
    sum_if = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("cnt"))), F.lit(0))
    seen = ~F.col("missing")
    number = F.coalesce("whole", F.col("num").try_cast("long")) if "whole" in x.columns else None
    exact = [f(c).alias(n) for f, at in ((F.min, "min"), (F.max, "max")) for c, n in ((number, f"{at}_number"), (F.col("text"), f"{at}_text"))] if number is not None else []
    return x.groupBy("dataset", "load_id", "column_name").agg(
        F.sum("cnt").alias("n_rows"), sum_if(F.col("missing")).alias("n_missing"), F.count(F.when(seen, 1)).alias("n_distinct"),
        F.min(F.when(seen, F.col("value"))).alias("min_value"), F.max(F.when(seen, F.col("value"))).alias("max_value"),
        sum_if(seen & ~F.col("fits")).alias("n_bad_pattern"), sum_if(seen & F.col("fits") & ~F.col("valid")).alias("n_out_of_range"), sum_if(F.col("valid")).alias("n_valid"), *exact,
    )


def _range_of(value: Column) -> Column:
    """An order-preserving range number that needs no knowledge of the data: 16 ranges per e-fold."""
    return F.floor(F.asinh(value) * 16)


def _text_range_of(value: Column, rest: Column) -> Column:
    """The same where ``rest`` holds texts that are no numbers: after all numbers, by their first characters."""
    return F.struct(F.coalesce(_range_of(value), F.lit(1 << 40)).alias("n"), F.coalesce(F.substring(rest, 1, 9), F.lit("")).alias("t"))


def distribution_distance(x: DataFrame, pairs: DataFrame) -> DataFrame:
    """Largest difference of the shares of valid values <= v between two loads, as whole numbers.

    pairs: load_id, prev_load_id, column_name, na, nb (valid values of each). Result: load_id,
    column_name, distance = max |A(v) * nb - B(v) * na|, to be divided by na * nb. Exact counts (with
    ``whole``) also order whole numbers that are the same as doubles, and texts that are no numbers.
    Every count is joined once, weighted by nb or -na; the sums run inside the ranges, and of a range
    only its total, largest and least sum go on.
    """
    fine = ["number", "rest"] if "whole" in x.columns else []
    if fine:
        x = x.withColumn("number", F.coalesce("whole", F.col("value").try_cast("long"))).withColumn("rest", F.when(F.col("value").isNull(), F.col("text")))
    order = ["value", *fine]
    big = lambda c: F.col(c).cast("decimal(19,0)")
    own, other = F.struct(F.col("load_id").alias("source"), F.col("nb").alias("weight")), F.struct(F.col("prev_load_id").alias("source"), (-F.col("na")).alias("weight"))
    sides = pairs.select("load_id", "column_name", F.explode(F.array(own, other)).alias("side")).select("load_id", "column_name", "side.*")
    valid = x.where("valid").select(F.col("load_id").alias("source"), "column_name", *order, "cnt")
    cells = valid.join(sides, ["source", "column_name"]).select("load_id", "column_name", *order, (big("cnt") * big("weight")).alias("w"))
    cells = cells.withColumn("r", _text_range_of(F.col("value"), F.col("rest")) if fine else _range_of(F.col("value")))
    inside = Window.partitionBy("load_id", "column_name", "r").orderBy(*order)  # equal values of both loads are peers
    ranges = cells.withColumn("run", F.sum("w").over(inside)).groupBy("load_id", "column_name", "r").agg(F.sum("w").alias("total"), F.max("run").alias("hi"), F.min("run").alias("lo"))
    before = Window.partitionBy("load_id", "column_name").orderBy(F.col("r").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("total").over(before), F.lit(0).cast("decimal(38,0)"))
    gap = ranges.select("load_id", "column_name", (start + F.col("hi")).alias("hi"), (start + F.col("lo")).alias("lo"))
    return gap.groupBy("load_id", "column_name").agg(F.max(F.greatest(F.abs("hi"), F.abs("lo"))).alias("distance"))


def compared(x: DataFrame, loads: DataFrame) -> DataFrame:
    """Measures of each load beside those of the load before it (prev_* null without one) and the distance.

    The plan of a cached table is repeated, in the driver's memory, wherever the table is read, and again
    with every update of a running plan: so the counts are read once by the measures, which are written,
    and once by the comparison.
    """
    x = x.persist()
    m = cut_lineage(load_measures(x))  # one row per load and column
    now = m.join(loads.select("load_id", "prev_load_id").dropDuplicates(["load_id"]), "load_id", "left")
    old = m.select(F.col("load_id").alias("prev_load_id"), "column_name", *[F.col(c).alias(f"prev_{c}") for c in ("n_rows", "n_missing", "n_distinct", "n_valid")])
    both = now.join(old, ["prev_load_id", "column_name"], "left")
    pairs = both.where(f"n_valid >= {LIMITS['least_valid']} and prev_n_valid >= {LIMITS['least_valid']}").select("load_id", "prev_load_id", "column_name", F.col("n_valid").alias("na"), F.col("prev_n_valid").alias("nb"))
    return both.join(distribution_distance(x, pairs), ["load_id", "column_name"], "left")


def findings(both: DataFrame) -> DataFrame:
    """One row per load, column and finding."""
    big = lambda c: F.col(c).cast("decimal(19,0)")
    n, d = LIMITS["null_share"]
    s, t = LIMITS["shift"]
    tests = {
        "bad_pattern": F.col("n_bad_pattern") > 0,
        "out_of_range": F.col("n_out_of_range") > 0,
        "null_share": F.abs(big("n_missing") * big("prev_n_rows") - big("prev_n_missing") * big("n_rows")) * d > big("n_rows") * big("prev_n_rows") * n,
        "constant": (F.col("n_distinct") == 1) & (F.col("prev_n_distinct") >= 2),
        "shift": F.col("distance") * t > big("n_valid") * big("prev_n_valid") * s,
    }
    hits = F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in tests.items()]))
    return both.select("load_id", "column_name", F.explode(hits).alias("finding"))


def column_summary(chunks: DataFrame) -> DataFrame:
    """Whole columns from footers and dictionaries alone; a figure they cannot give exactly is null.

    n_null needs footer counts everywhere and no possible NaN; the extrema need statistics or a
    dictionary in every chunk with values; n_distinct is the union of dictionaries.
    """
    lo = F.coalesce(F.array_min("num_values"), F.col("num_min"))
    hi = F.coalesce(F.array_max("num_values"), F.col("num_max"))
    empty = F.col("n_null") == F.col("n_rows")
    known = F.coalesce(empty, F.lit(False)) | lo.isNotNull() | F.col("text_min").isNotNull() | F.col("text_values").isNotNull()
    exact = F.col("n_null").isNotNull() & F.coalesce(~F.col("has_nan"), F.lit(False))
    all_of = lambda c: F.min(c.cast("int")) == 1
    whole = chunks.groupBy("column_name").agg(
        F.count("*").alias("n_chunks"), F.sum("n_rows").alias("n_rows"), F.when(all_of(exact), F.sum("n_null")).alias("n_null"),
        F.when(all_of(known), F.min(lo)).alias("min_value"), F.when(all_of(known), F.max(hi)).alias("max_value"),
        F.when(all_of(known), F.min(F.coalesce(F.array_min("text_values"), F.col("text_min")))).alias("min_text"), F.when(all_of(known), F.max(F.coalesce(F.array_max("text_values"), F.col("text_max")))).alias("max_text"),
        F.min((F.col("dictionary_size").isNotNull() | F.coalesce(empty, F.lit(False))).cast("int")).alias("all_dictionary"),
    )
    values = chunks.select("column_name", F.explode(F.coalesce(F.transform("num_values", lambda v: v.cast("string")), F.col("text_values"))).alias("v")).groupBy("column_name").agg(F.countDistinct("v").alias("n"))
    return whole.join(values, "column_name", "left").select("column_name", "n_chunks", "n_rows", "n_null", "min_value", "max_value", "min_text", "max_text", F.when(F.col("all_dictionary") == 1, F.coalesce("n", F.lit(0))).alias("n_distinct"))


def whole_columns(spark: SparkSession, df: DataFrame) -> DataFrame:
    """``column_summary`` without gaps: chunks whose footer and dictionary leave a figure open are scanned, and only they.

    n_null counts null and NaN.
    """
    chunks = pc.chunk_table(spark, df, df.columns[0], df.columns).persist()  # read by the sums, the dictionaries and the choice of scans
    empty = F.coalesce(F.col("n_null") == F.col("n_rows"), F.lit(False))
    told = F.col("n_null").isNotNull() & F.coalesce(~F.col("has_nan"), F.lit(False)) & F.col("dictionary_size").isNotNull()
    decided = chunks.withColumn("told", told | empty)
    units = decided.where("not told").groupBy("file", "row_group").agg(F.collect_set("column_name").alias("columns"))
    scanned = units.repartition(4 * spark.sparkContext.defaultParallelism).mapInArrow(pc.scan_counts(None, exact=True), pc.EXACT_SCHEMA).drop("key")
    by_dictionary = decided.where("told and n_null < n_rows").select("column_name", F.explode(F.arrays_zip(F.coalesce("num_values", F.transform("text_values", lambda v: F.lit(None).cast("double"))).alias("num"), F.coalesce("text_values", F.transform("num_values", lambda v: F.lit(None).cast("string"))).alias("text"))).alias("v"))
    values = scanned.unionByName(by_dictionary.select("column_name", "v.num", F.lit(None).cast("long").alias("whole"), "v.text", F.lit(0).cast("long").alias("cnt"))).withColumn("num", F.col("num") + 0.0)
    values = values.groupBy("column_name", "num", "whole", "text").agg(F.sum("cnt").alias("cnt"))
    missing = F.col("num").isNull() & F.col("whole").isNull() & F.col("text").isNull()
    number = F.coalesce("num", F.col("whole").cast("double"))
    seen = values.groupBy("column_name").agg(
        F.coalesce(F.sum(F.when(missing, F.col("cnt"))), F.lit(0)).alias("scanned_null"), F.count(F.when(~missing, 1)).alias("n"),
        F.min(number).alias("min_value"), F.max(number).alias("max_value"), F.min("text").alias("min_text"), F.max("text").alias("max_text"),
    )
    sums = decided.groupBy("column_name").agg(F.count("*").alias("n_chunks"), F.sum("n_rows").alias("n_rows"), F.coalesce(F.sum(F.when(F.col("told"), F.col("n_null"))), F.lit(0)).alias("told_null"))
    n_null = F.col("told_null") + F.coalesce("scanned_null", F.lit(0))
    return sums.join(seen, "column_name", "left").select("column_name", "n_chunks", "n_rows", n_null.alias("n_null"), "min_value", "max_value", "min_text", "max_text", F.coalesce("n", F.lit(0)).alias("n_distinct"))


def profile_tables(spark: SparkSession, sf_dir: str, columns: dict[str, list[str]], exact: bool = False) -> DataFrame:
    """``compared`` for the given columns of disease tables, in one pass over the counts of all of them."""
    made = [value_counts(spark, table(spark, sf_dir, d), "load_id", c, exact).withColumn("dataset", F.lit(d)) for d, c in columns.items()]
    counts = reduce(DataFrame.unionByName, made)
    return compared(judged(counts, table(spark, sf_dir, "field_domains")), table(spark, sf_dir, "loads"))
