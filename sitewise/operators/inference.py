"""Group comparisons, associations and correlations of many column pairs at once.

A pair's data is reduced to counts: (pair, group, value) for comparisons, (pair, a, b) for tables of
categories, (pair, x, y) for correlations. The pairs are spread out inside each row and combined before
the shuffle, so there is one job per kind of pair and no join of rows with rows. Moments, quantiles,
ranks and tie terms are sums and running sums over these counts; only the last step (choosing the test,
p-values) runs in Python, on one row per pair.

Defined results: null and NaN values and null groups are left out; a pair without enough groups or
values has no row; constants give statistics of null rather than errors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitewise.functions import distributions as dist
from sitewise.functions import scalars as sc
from sitewise.operators.descriptive import pair_cells, quantiles
from sitewise.operators.running import running

PAIR = ["var1", "var2"]


def _pair_counts(df: DataFrame, pairs: list[tuple[str, str]], left, right, names: tuple[str, str]) -> DataFrame:
    """var1, var2, the two values and cnt of every pair, over the rows where both are there.

    ``left`` and ``right`` make the value of a column. If the pairs are all combinations of some columns,
    or all of one list with another, each row is spread by two nested generators over arrays of its
    values, so that the plan grows with the columns and not with the pairs.
    """
    cells = lambda cols, make: F.array(*[F.struct(F.lit(i).alias("i"), make(F.col(c)).alias("v")) for i, c in enumerate(cols)])
    firsts, seconds = list(dict.fromkeys(a for a, _ in pairs)), list(dict.fromkeys(b for _, b in pairs))
    chain = [*firsts[:1], *[b for a, b in pairs if a == firsts[0]]] if pairs else []
    if pairs and len(pairs) == len(set(pairs)) and set(pairs) == set(pair_cells(chain)):
        firsts = seconds = chain
        x = df.select(cells(chain, left).alias("ls"), cells(chain, right).alias("rs")).select("rs", F.explode("ls").alias("l")).where("l.v is not null")
        x = x.select("l", F.explode(F.expr(f"slice(rs, l.i + 2, {len(chain)})")).alias("r"))
    elif pairs and len(pairs) == len(set(pairs)) == len(firsts) * len(seconds):
        x = df.select(cells(firsts, left).alias("ls"), cells(seconds, right).alias("rs")).select("rs", F.explode("ls").alias("l")).where("l.v is not null").select("l", F.explode("rs").alias("r"))
    else:
        at, bt = {c: i for i, c in enumerate(firsts)}, {c: i for i, c in enumerate(seconds)}
        made = F.array(*[F.struct(F.struct(F.lit(at[a]).alias("i"), left(F.col(a)).alias("v")).alias("l"), F.struct(F.lit(bt[b]).alias("i"), right(F.col(b)).alias("v")).alias("r")) for a, b in pairs])
        x = df.select(F.inline(made)).where("l.v is not null")
    counted = x.where("r.v is not null").groupBy(F.col("l.i").alias("i"), F.col("r.i").alias("j"), F.col("l.v").alias(names[0]), F.col("r.v").alias(names[1])).agg(F.count("*").alias("cnt"))
    label = lambda cols, at: F.element_at(F.array(*[F.lit(c) for c in cols]), F.col(at) + 1)
    return counted.select(label(firsts, "i").alias("var1"), label(seconds, "j").alias("var2"), *names, "cnt")


def _text(c: Column) -> Column:
    t = c.cast("string")
    return F.when(t != "NaN", t)


def comparison_counts(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """var1 (number), var2 (group column), grp, value, cnt."""
    return _pair_counts(df, pairs, sc.as_number, _text, ("value", "grp"))


def group_measures(counts: DataFrame) -> DataFrame:
    """Per pair and group: n, mean, variance, shape, quartiles, outliers, deviations from the median, rank sum."""
    key = [*PAIR, "grp"]
    base = counts.groupBy(*key).agg(F.sum("cnt").alias("n"), (F.sum(F.col("cnt") * F.col("value")) / F.sum("cnt")).alias("mean"))
    base = base.join(quantiles(counts, {"q1": 0.25, "med": 0.5, "q3": 0.75}, key), key)
    both = counts.join(base, key)
    d, c, iqr, dev = F.col("value") - F.col("mean"), F.col("cnt"), F.col("q3") - F.col("q1"), F.abs(F.col("value") - F.col("med"))
    far = (F.col("value") < F.col("q1") - 1.5 * iqr) | (F.col("value") > F.col("q3") + 1.5 * iqr)
    second = both.groupBy(*key).agg(
        F.sum(c * d * d).alias("m2"), F.sum(c * d * d * d).alias("m3"), F.sum(c * d * d * d * d).alias("m4"), F.sum(F.when(far, c).otherwise(0)).alias("outliers"), F.sum(c * dev).alias("dev"), F.sum(c * dev * dev).alias("dev2"),
    )
    ranked = counts.join(_ranks(counts, PAIR), [*PAIR, "value"]).groupBy(*key).agg(F.sum(c * F.col("avg_rank")).alias("rank_sum"))
    return base.join(second, key).join(ranked, key)


def _ranks(counts: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Average rank and number of ties of every value of a pair."""
    t = counts.groupBy(*keys, value).agg(F.sum("cnt").alias("ties"))
    return running(t, keys, value, "ties").withColumn("avg_rank", F.expr("upto - ties + (ties + 1) / 2")).drop("n", "upto")


def compared_groups(counts: DataFrame) -> DataFrame:
    """One row per pair: k, n, ties (sum of t^3 - t), groups (measures, in order of their label)."""
    counts = counts.persist()  # counts, not rows: read by moments, quantiles and ranks
    g = group_measures(counts).withColumn("variance", F.when(F.col("n") > 1, F.col("m2") / (F.col("n") - 1)))
    fields = ["grp", "n", "mean", "variance", "q1", "med", "q3", "m2", "m3", "m4", "outliers", "dev", "dev2", "rank_sum"]
    per = g.groupBy(*PAIR).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("groups"), F.sum("n").alias("n"), F.count("*").alias("k"))
    t = F.col("ties").cast("double")
    ties = _ranks(counts, PAIR).groupBy(*PAIR).agg(F.sum(t * t * t - t).alias("ties"))
    return per.join(ties, PAIR)


def small_samples(counts: DataFrame, most: int = 50) -> DataFrame:
    """The values themselves of groups of at most ``most`` values, for tests that need them."""
    n = counts.groupBy(*PAIR, "grp").agg(F.sum("cnt").alias("n")).where(F.col("n") <= most)
    rows = counts.join(n, [*PAIR, "grp"]).groupBy(*PAIR, "grp").agg(F.flatten(F.collect_list(F.array_repeat("value", F.col("cnt").cast("int")))).alias("values"))
    return rows.groupBy(*PAIR).agg(F.map_from_entries(F.collect_list(F.struct("grp", "values"))).alias("samples"))


# --- statistics as expressions over the array of groups ------------------------------------------------
def _g(i: int, f: str) -> Column:
    return F.get("groups", F.lit(i))[f]


def two_group_statistics(compared: DataFrame) -> DataFrame:
    """t (Student and Welch), effect sizes, U and rank-biserial of pairs with exactly two groups."""
    x = compared.where("k = 2")
    n1, n2, m1, m2, v1, v2 = _g(0, "n"), _g(1, "n"), _g(0, "mean"), _g(1, "mean"), _g(0, "variance"), _g(1, "variance")
    sp = F.sqrt(F.try_divide((n1 - 1) * F.coalesce(v1, F.lit(0.0)) + (n2 - 1) * F.coalesce(v2, F.lit(0.0)), n1 + n2 - 2))
    a1, a2 = v1 / n1, v2 / n2
    d = F.when(sp == 0, F.when(m1 == m2, 0.0).otherwise(float("inf"))).otherwise(F.try_divide(m1 - m2, sp))
    n = n1 + n2
    u = _g(0, "rank_sum") - n1 * (n1 + 1) / 2
    return x.select(
        *PAIR, n1.alias("n1"), n2.alias("n2"), F.try_divide(m1 - m2, sp * F.sqrt(1 / n1 + 1 / n2)).alias("student_t"), F.try_divide(m1 - m2, F.sqrt(a1 + a2)).alias("welch_t"),
        F.try_divide((a1 + a2) * (a1 + a2), F.try_divide(a1 * a1, n1 - 1) + F.try_divide(a2 * a2, n2 - 1)).alias("welch_df"), d.alias("cohens_d"),
        (d * F.when(4 * n - 9 > 0, 1 - 3 / (4 * n - 9)).otherwise(1.0)).alias("hedges_g"), u.alias("u1"), (1 - 2 * u / (n1 * n2)).alias("rank_biserial"),
    )


def _total(f) -> Column:
    return F.aggregate("groups", F.lit(0.0), lambda a, g: a + F.coalesce(f(g).cast("double"), F.lit(0.0)))


def one_way_statistics(compared: DataFrame) -> DataFrame:
    """Kruskal-Wallis H, Welch F with its degrees of freedom, and Brown-Forsythe F of two groups or more."""
    x = compared.where("k >= 2").withColumn("nd", F.col("n").cast("double"))
    nd, k = F.col("nd"), F.col("k").cast("double")
    x = x.withColumn("h_raw", 12 / (nd * (nd + 1)) * _total(lambda g: g["rank_sum"] * g["rank_sum"] / g["n"]) - 3 * (nd + 1))
    x = x.withColumn("h", F.try_divide("h_raw", 1 - F.try_divide(F.col("ties"), nd * nd * nd - nd)))
    usable = ~F.exists("groups", lambda g: F.coalesce(g["variance"], F.lit(0.0)) <= 0)
    w = lambda g: F.when(usable, F.try_divide(g["n"].cast("double"), g["variance"]))
    x = x.withColumn("w", _total(w)).withColumn("mw", F.try_divide(_total(lambda g: w(g) * g["mean"]), F.col("w")))
    x = x.withColumn("a", F.try_divide(_total(lambda g: w(g) * (g["mean"] - F.col("mw")) * (g["mean"] - F.col("mw"))), k - 1)).withColumn("lam", _total(lambda g: F.try_divide((1 - F.try_divide(w(g), F.col("w"))) * (1 - F.try_divide(w(g), F.col("w"))), (g["n"] - 1).cast("double"))))
    x = x.withColumn("dev_mean", _total(lambda g: g["dev"]) / nd)
    between = _total(lambda g: g["n"] * (g["dev"] / g["n"] - F.col("dev_mean")) * (g["dev"] / g["n"] - F.col("dev_mean")))
    within = _total(lambda g: g["dev2"] - g["dev"] * g["dev"] / g["n"])
    return x.select(
        *PAIR, "k", "n", F.col("h").alias("kruskal_h"), F.when(usable, F.try_divide(F.col("a"), 1 + 2 * (k - 2) * F.col("lam") / (k * k - 1))).alias("welch_f"), F.when(usable, F.try_divide(k * k - 1, 3 * F.col("lam"))).alias("welch_df2"),
        F.try_divide(F.try_divide(between, k - 1), F.try_divide(within, nd - k)).alias("brown_forsythe_f"),
    )


# --- choosing the test ----------------------------------------------------------------------------------
def _shape(g: dict, sample) -> dict:
    n = g["n"]
    if n < 3:
        return {"skew": math.nan, "kurt": math.nan, "normal": False, "outliers": False}
    m2, m3, m4 = g["m2"] / n, g["m3"] / n, g["m4"] / n
    skew = 0.0 if m2 <= 0 else m3 / m2**1.5 * math.sqrt(n * (n - 1)) / (n - 2)
    kurt = math.nan if n < 4 else 0.0 if m2 <= 0 else (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * (m4 / m2**2 - 3) + 6)
    p = dist.shapiro_wilk_p(sample) if n <= 50 and sample is not None else math.nan
    normal = p > 0.05 if n <= 50 and not math.isnan(p) else abs(skew) < 1 and abs(kurt) < 2
    return {"skew": skew, "kurt": kurt, "normal": bool(normal), "outliers": g["outliers"] > 0}


def prefers_ranks(groups: list[dict], samples: dict) -> bool:
    """Severe skewness, tails or outliers, unless every group looks normal and has 30 values."""
    s = [_shape(g, samples.get(g["grp"])) for g in groups]
    severe = any(abs(x["skew"]) > 2 or abs(x["kurt"]) > 4 or x["outliers"] for x in s)
    return severe and not (all(x["normal"] for x in s) and min(g["n"] for g in groups) >= 30)


def brown_forsythe_p(groups: list[dict]) -> float:
    n, k = sum(g["n"] for g in groups), len(groups)
    mean = sum(g["dev"] for g in groups) / n
    between = sum(g["n"] * (g["dev"] / g["n"] - mean) ** 2 for g in groups)
    within = sum(g["dev2"] - g["dev"] ** 2 / g["n"] for g in groups)
    if n <= k:
        return math.nan
    return 1.0 if within <= 0 and between <= 0 else 0.0 if within <= 0 else dist.f_upper(between / (k - 1) / (within / (n - k)), k - 1, n - k)


def two_group_test(groups: list[dict], ties: float, samples: dict, method: str = "auto") -> dict:
    """The chosen test of two groups with statistic, p-value and effect size."""
    a, b = groups
    n1, n2 = a["n"], b["n"]
    v1, v2 = a["variance"] or 0.0, b["variance"] or 0.0
    if method == "auto":
        method = "mannwhitney" if prefers_ranks(groups, samples) else "student_ttest" if brown_forsythe_p(groups) > 0.05 else "welch_ttest"
    if method == "mannwhitney":
        u = a["rank_sum"] - n1 * (n1 + 1) / 2
        return {"test": method, "statistic": u, "p_value": dist.mann_whitney_p(u, n1, n2, ties), "effect_size": 1 - 2 * u / (n1 * n2), "effect_size_metric": "rank_biserial"}
    diff = a["mean"] - b["mean"]
    sp = math.sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)) if n1 + n2 > 2 else 0.0
    d = (0.0 if diff == 0 else math.inf) if sp == 0 else diff / sp
    denom = 4 * (n1 + n2) - 9
    g = d * (1 - 3 / denom if denom > 0 else 1.0)
    if method == "student_ttest":
        se, df = sp * math.sqrt(1 / n1 + 1 / n2), n1 + n2 - 2
    else:
        se = math.sqrt(v1 / n1 + v2 / n2)
        low = (v1 / n1) ** 2 / max(n1 - 1, 1) + (v2 / n2) ** 2 / max(n2 - 1, 1)
        df = (v1 / n1 + v2 / n2) ** 2 / low if low > 0 else math.nan
    t = diff / se if se > 0 else math.nan
    return {"test": method, "statistic": t, "p_value": dist.t_two_sided(t, df), "effect_size": g, "effect_size_metric": "hedges_g"}


def one_way_test(groups: list[dict], ties: float, samples: dict, method: str = "auto") -> dict:
    """Kruskal-Wallis or Welch's analysis of variance."""
    k, n = len(groups), sum(g["n"] for g in groups)
    if method == "auto":
        method = "kruskal" if prefers_ranks(groups, samples) else "welch"
    if method == "kruskal":
        h = 12 / (n * (n + 1)) * sum(g["rank_sum"] ** 2 / g["n"] for g in groups) - 3 * (n + 1)
        tie = 1 - ties / (n**3 - n)
        h = h / tie if tie > 0 else math.nan
        return {"test": method, "statistic": h, "p_value": dist.chi2_upper(h, k - 1)}
    if any(not g["variance"] for g in groups):
        return {"test": method, "statistic": math.nan, "p_value": math.nan}
    w = [g["n"] / g["variance"] for g in groups]
    total = sum(w)
    mean = sum(x * g["mean"] for x, g in zip(w, groups)) / total
    lam = sum((1 - x / total) ** 2 / (g["n"] - 1) for x, g in zip(w, groups))
    f = sum(x * (g["mean"] - mean) ** 2 for x, g in zip(w, groups)) / (k - 1) / (1 + 2 * (k - 2) * lam / (k * k - 1))
    return {"test": method, "statistic": f, "p_value": dist.f_upper(f, k - 1, (k * k - 1) / (3 * lam))}


TEST_SCHEMA = "var1 string, var2 string, test string, statistic double, p_value double, effect_size double, effect_size_metric string"


def _with_samples(counts: DataFrame) -> DataFrame:
    return compared_groups(counts).join(small_samples(counts), PAIR, "left")


def _tests(kind: str, method: str = "auto", least: int = 1):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples():
                groups = [dict(g) if isinstance(g, dict) else g.asDict() for g in r.groups]
                if (kind == "two" and len(groups) != 2) or len(groups) < 2 or min(g["n"] for g in groups) < least:
                    continue
                samples = dict(r.samples) if r.samples is not None else {}
                out = (two_group_test if kind == "two" else one_way_test)(groups, r.ties, samples, method)
                rows.append((r.var1, r.var2, out["test"], out["statistic"], out["p_value"], out.get("effect_size"), out.get("effect_size_metric")))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in TEST_SCHEMA.split(", ")])

    return run


def compare_two_groups(df: DataFrame, pairs: list[tuple[str, str]], method: str = "auto", least: int = 1) -> DataFrame:
    """The test of every (number, two-level column) pair; pairs with other numbers of groups have no row."""
    return _nulls(_with_samples(comparison_counts(df, pairs)).mapInPandas(_tests("two", method, least), TEST_SCHEMA))


def compare_groups(df: DataFrame, pairs: list[tuple[str, str]], method: str = "auto") -> DataFrame:
    """The one-way test of every pair with two groups or more."""
    return _nulls(_with_samples(comparison_counts(df, pairs)).mapInPandas(_tests("one", method), TEST_SCHEMA)).drop("effect_size", "effect_size_metric")


def _nulls(df: DataFrame) -> DataFrame:
    return df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def posthoc(df: DataFrame, value: str, group: str, method: str) -> DataFrame:
    """Pairwise tests after a one-way test: Games-Howell after 'welch', Mann-Whitney with Holm after 'kruskal'.

    Long form: group_a, group_b, p_adj. The pairs are of group labels, so there are as many as levels allow.
    """
    if method not in ("welch", "kruskal"):
        raise ValueError(f"no post-hoc test for {method}")
    counts = comparison_counts(df, [(value, group)])
    if method == "kruskal":
        other = counts.select(F.col("grp").alias("g2"), *PAIR, "value", "cnt")
        labels = counts.select("grp").distinct()
        names = labels.join(labels.withColumnRenamed("grp", "g2"), F.col("grp") < F.col("g2"))
        key = F.concat_ws("\x01", "grp", "g2").alias("var2")
        a = names.join(counts, "grp").select("var1", key, "grp", "value", "cnt")
        b = names.join(other, "g2").select("var1", key, F.col("g2").alias("grp"), "value", "cnt")
        tested = _nulls(compared_groups(a.unionByName(b)).withColumn("samples", F.lit(None).cast("map<string,array<double>>")).mapInPandas(_tests("two", "mannwhitney"), TEST_SCHEMA))
        both = F.split("var2", "\x01")
        return holm(tested.select(both[0].alias("group_a"), both[1].alias("group_b"), "p_value"), "p_value").select("group_a", "group_b", "p_adj")

    def games_howell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples():
                g = [dict(x) if isinstance(x, dict) else x.asDict() for x in r.groups]
                for i, x in enumerate(g):
                    for y in g[i + 1 :]:
                        a1, a2 = (x["variance"] or 0.0) / x["n"], (y["variance"] or 0.0) / y["n"]
                        low = a1**2 / max(x["n"] - 1, 1) + a2**2 / max(y["n"] - 1, 1)
                        q = abs(x["mean"] - y["mean"]) / math.sqrt((a1 + a2) / 2) if a1 + a2 > 0 else math.nan
                        rows.append((x["grp"], y["grp"], dist.studentized_range_upper(q, len(g), (a1 + a2) ** 2 / low if low > 0 else math.nan)))
            yield pd.DataFrame(rows, columns=["group_a", "group_b", "p_adj"])

    return _nulls(compared_groups(counts).mapInPandas(games_howell, "group_a string, group_b string, p_adj double"))


def posthoc_matrix(long: DataFrame) -> DataFrame:
    """The symmetric wide form with an empty diagonal."""
    both = long.unionByName(long.select(F.col("group_b").alias("group_a"), F.col("group_a").alias("group_b"), "p_adj"))
    return both.groupBy("group_a").pivot("group_b").agg(F.first("p_adj")).orderBy("group_a")


# --- multiplicity ---------------------------------------------------------------------------------------
# one row per test: these windows hold the results of a screen, not data rows
def benjamini_hochberg(df: DataFrame, p: str, out: str = "p_adj") -> DataFrame:
    """Adjusted p-values over all that are not null; null stays null."""
    every = Window.partitionBy(F.col(p).isNull())
    m = F.count("*").over(every)
    rank = F.row_number().over(every.orderBy(p))
    x = df.withColumn("_q", F.col(p) * m / rank)
    back = Window.partitionBy(F.col(p).isNull()).orderBy(F.desc(p), F.asc("_q")).rowsBetween(Window.unboundedPreceding, 0)
    return x.withColumn(out, F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), F.min("_q").over(back)))).drop("_q")


def holm(df: DataFrame, p: str, out: str = "p_adj") -> DataFrame:
    """Step-down adjusted p-values over all that are not null."""
    every = Window.partitionBy(F.col(p).isNull())
    x = df.withColumn("_q", (F.count("*").over(every) - F.row_number().over(every.orderBy(p)) + 1) * F.col(p))
    up = Window.partitionBy(F.col(p).isNull()).orderBy(p, F.desc("_q")).rowsBetween(Window.unboundedPreceding, 0)
    return x.withColumn(out, F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), F.max("_q").over(up)))).drop("_q")


# --- tables of categories ---------------------------------------------------------------------------------
def table_counts(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """var1, var2, a, b, cnt of every pair of categorical columns."""
    return _pair_counts(df, pairs, _text, _text, ("a", "b"))


def association_statistics(counts: DataFrame) -> DataFrame:
    """Chi-square (with Yates' correction for 2x2), its degrees of freedom, Cramer's V, and whether it may be used."""
    counts = counts.persist()
    rows = counts.groupBy(*PAIR, "a").agg(F.sum("cnt").alias("ra"))
    cols = counts.groupBy(*PAIR, "b").agg(F.sum("cnt").alias("cb"))
    dims = rows.groupBy(*PAIR).agg(F.count("*").alias("r"), F.sum("ra").alias("n")).join(cols.groupBy(*PAIR).agg(F.count("*").alias("c")), PAIR)
    full = rows.join(cols, PAIR).join(counts, [*PAIR, "a", "b"], "left").join(dims, PAIR)  # every cell of a table, by level, within a pair
    e = F.col("ra").cast("double") * F.col("cb") / F.col("n")
    o = F.coalesce("cnt", F.lit(0)).cast("double")
    full = full.withColumn("e", e).withColumn("o", o).withColumn("gap", F.abs(o - e))
    small = (F.col("r") == 2) & (F.col("c") == 2)
    yates = F.col("gap") - F.when(small, F.least(F.lit(0.5), F.col("gap"))).otherwise(0.0)
    s = full.groupBy(*PAIR).agg(
        F.sum(F.col("gap") * F.col("gap") / F.col("e")).alias("raw"), F.sum(yates * yates / F.col("e")).alias("chi2"), F.first("r").alias("r"), F.first("c").alias("c"), F.first("n").alias("n"),
        F.min("e").alias("least_expected"), F.avg((F.col("e") < 5).cast("double")).alias("share_small"), F.array_sort(F.collect_list(F.when(small, F.struct("a", "b", F.col("o").cast("long").alias("o"))))).alias("cells"),
    )
    least = F.least("r", "c") - 1
    return s.select(*PAIR, "r", "c", "n", "chi2", ((F.col("r") - 1) * (F.col("c") - 1)).alias("dof"), F.when(least > 0, F.sqrt(F.col("raw") / (F.col("n") * least))).alias("cramers_v"), ((F.col("least_expected") >= 1) & (F.col("share_small") <= 0.2)).alias("assumptions_ok"), F.transform("cells", lambda x: x["o"]).alias("cells"))


def associations(counts: DataFrame) -> DataFrame:
    """Chi-square test, or Fisher's exact one for 2x2 tables that do not allow it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples():
                exact = r.r == 2 and r.c == 2 and not r.assumptions_ok
                p = dist.fisher_p(*[int(x) for x in r.cells]) if exact else dist.chi2_upper(r.chi2, r.dof)
                rows.append((r.var1, r.var2, "Fisher Exact Test" if exact else "Chi-Square Test", r.chi2, p, r.cramers_v, "cramers_v"))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in TEST_SCHEMA.split(", ")])

    return _nulls(association_statistics(counts).mapInPandas(run, TEST_SCHEMA))


# --- correlations -------------------------------------------------------------------------------------------
def correlation_counts(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """var1, var2, x, y, cnt over the rows where both are there."""
    return _pair_counts(df, pairs, sc.as_number, sc.as_number, ("x", "y"))


def _weighted_r(df: DataFrame, x: str, y: str, out: str) -> DataFrame:
    """Pearson of weighted points, two passes; with it the biased skewness of both sides."""
    w = F.col("cnt")
    mean = df.groupBy(*PAIR).agg(F.sum(w).alias("n"), (F.sum(w * F.col(x)) / F.sum(w)).alias("mx"), (F.sum(w * F.col(y)) / F.sum(w)).alias("my"))
    dx, dy = F.col(x) - F.col("mx"), F.col(y) - F.col("my")
    s = df.join(mean, PAIR).groupBy(*PAIR).agg(F.first("n").alias("n"), F.sum(w * dx * dy).alias("sxy"), F.sum(w * dx * dx).alias("sxx"), F.sum(w * dy * dy).alias("syy"), F.sum(w * dx * dx * dx).alias("x3"), F.sum(w * dy * dy * dy).alias("y3"))
    skew = lambda c3, c2: F.coalesce(F.try_divide(c3 / F.col("n"), F.pow(c2 / F.col("n"), 1.5)), F.lit(0.0))
    return s.select(*PAIR, "n", F.try_divide("sxy", F.sqrt(F.col("sxx") * F.col("syy"))).alias(out), skew(F.col("x3"), F.col("sxx")).alias("skew_x"), skew(F.col("y3"), F.col("syy")).alias("skew_y"))


def correlation_statistics(counts: DataFrame) -> DataFrame:
    """Pearson and Spearman of every pair, and which of them the data call for."""
    counts = counts.persist()
    pearson = _weighted_r(counts, "x", "y", "pearson")
    rx = _ranks(counts, PAIR, "x").select(*PAIR, "x", F.col("avg_rank").alias("rx"))
    ry = _ranks(counts, PAIR, "y").select(*PAIR, "y", F.col("avg_rank").alias("ry"))
    spearman = _weighted_r(counts.join(rx, [*PAIR, "x"]).join(ry, [*PAIR, "y"]), "rx", "ry", "spearman").select(*PAIR, "spearman")

    def outliers(side: str) -> DataFrame:
        c = counts.groupBy(*PAIR, F.col(side).alias("value")).agg(F.sum("cnt").alias("cnt"))
        q = quantiles(c, {"q1": 0.25, "q3": 0.75}, PAIR)
        iqr = F.col("q3") - F.col("q1")
        return c.join(q, PAIR).groupBy(*PAIR).agg(F.max(((F.col("value") < F.col("q1") - 1.5 * iqr) | (F.col("value") > F.col("q3") + 1.5 * iqr)).cast("int")).alias(f"out_{side}"))

    both = pearson.join(spearman, PAIR).join(outliers("x"), PAIR).join(outliers("y"), PAIR).where("n >= 3")
    use = (F.col("n") >= 30) & (F.abs("skew_x") < 2) & (F.abs("skew_y") < 2) & (F.col("out_x") + F.col("out_y") == 0)
    return both.select(*PAIR, "n", "pearson", "spearman", F.when(use, "pearson").otherwise("spearman").alias("method"))


def correlations(counts: DataFrame) -> DataFrame:
    """The correlation the data call for, with its p-value (t distribution)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples():
                c = r.pearson if r.method == "pearson" else r.spearman
                if c is None or math.isnan(c):
                    continue
                c = max(-1.0, min(1.0, c))
                p = 0.0 if abs(c) == 1 else dist.t_two_sided(c * math.sqrt((r.n - 2) / (1 - c * c)), r.n - 2)
                rows.append((r.var1, r.var2, r.method, c, p, abs(c), "correlation"))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in TEST_SCHEMA.split(", ")])

    return _nulls(correlation_statistics(counts).mapInPandas(run, TEST_SCHEMA))


# --- the whole screen -----------------------------------------------------------------------------------------
# Smallest effects worth reporting, by metric.
THRESHOLDS = {"correlation": 0.2, "cramers_v": 0.1, "hedges_g": 0.2, "rank_biserial": 0.2}


def screen(df: DataFrame, numeric: list[str], categorical: dict[str, int], alpha: float = 0.05, thresholds: dict[str, float] | None = None, max_levels: int = 6, least: int = 2) -> DataFrame:
    """All pairs of columns tested and corrected together.

    ``categorical`` gives the number of levels of each column. There is one job per kind of pair.
    """
    few = [c for c, k in categorical.items() if k <= max_levels]
    two = [c for c, k in categorical.items() if k == 2]
    kinds = [("num-num", pair_cells(numeric), lambda p: correlations(correlation_counts(df, p))), ("cat-cat", pair_cells(few), lambda p: associations(table_counts(df, p))), ("num-cat", [(v, g) for v in numeric for g in two], lambda p: compare_two_groups(df, p, least=least))]
    out = None
    for kind, pairs, test in kinds:
        if pairs:
            part = test(pairs).withColumn("pair_type", F.lit(kind))
            out = part if out is None else out.unionByName(part)
    if out is None:
        return df.sparkSession.createDataFrame([], TEST_SCHEMA + ", pair_type string, p_adj double, significant boolean")
    out = out.withColumn("effect_size", F.abs("effect_size"))
    limits = F.create_map(*[F.lit(x) for kv in (thresholds or THRESHOLDS).items() for x in kv])
    out = benjamini_hochberg(out, "p_value")
    return out.withColumn("significant", F.coalesce((F.col("p_adj") < alpha) & (F.col("effect_size") >= limits[F.col("effect_size_metric")]), F.lit(False)))


# Words of outcome columns, in order of priority.
OUTCOME_WORDS = [
    ["death", "died", "deceased", "mortality", "survival"],
    ["icu", "intensive_care", "ventilation", "intubation"],
    ["readmission", "re-admission", "admission"],
    ["outcome", "status", "diagnosis", "condition", "label", "pasc"],
    ["complication", "adverse"],
]


def outcome_column(df: DataFrame, categorical: list[str], words: list[list[str]] | None = None, least: int = 20, max_levels: int = 5) -> str | None:
    """The first column by keyword priority with 2 to ``max_levels`` levels of at least ``least`` rows each."""
    named = [c for c in categorical if any(w in c.lower() for tier in (words or OUTCOME_WORDS) for w in tier)]
    if not named:
        return None
    cells = F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in named])
    per = df.select(F.inline(cells)).where("v is not null").groupBy("c", "v").agg(F.count("*").alias("k")).groupBy("c").agg(F.count("*").alias("levels"), F.min("k").alias("least"))
    fit = {r.c for r in per.where((F.col("levels") >= 2) & (F.col("levels") <= max_levels) & (F.col("least") >= least)).collect()}
    return next((c for tier in (words or OUTCOME_WORDS) for c in categorical if c in fit and any(w in c.lower() for w in tier)), None)


def outcome_comparison(df: DataFrame, numeric: list[str], outcome: str) -> DataFrame:
    """Every numeric column compared by the outcome: the two-group test, or the one-way test for more levels."""
    two = compare_two_groups(df, [(v, outcome) for v in numeric])
    more = compare_groups(df, [(v, outcome) for v in numeric]).join(two.select(*PAIR), PAIR, "left_anti")
    return two.unionByName(more, allowMissingColumns=True)
