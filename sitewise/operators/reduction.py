"""Principal components and multiple correspondence analysis.

The data is read twice: once for the moments or the co-occurrence table, whose size depends on the
number of columns and levels only, and once to project rows, as plain expressions. The driver only
solves the small symmetric eigenproblem. Signs of axes are arbitrary.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewise.functions import scalars as sc
from sitewise.session import broadcast_if_small


@dataclass
class Reduction:
    names: list[str]
    values: np.ndarray
    ratio: np.ndarray
    loadings: np.ndarray
    n_recommended: int
    excluded: list[str]
    n: int
    extra: dict = field(default_factory=dict)


def _recommended(ratio: np.ndarray, threshold: float) -> int:
    return int(np.searchsorted(np.cumsum(ratio), threshold - 1e-12) + 1) if len(ratio) else 0


def moments(df: DataFrame, columns: list[str]) -> DataFrame:
    """column_name, n, mean, sd (population, with missing values set to the mean) of each column."""
    v = {c: sc.as_number(F.col(c)) for c in columns}
    one = df.agg(F.count("*").alias("n"), *[x for i, c in enumerate(columns) for x in (F.count(v[c]).alias(f"k{i}"), F.avg(v[c]).alias(f"m{i}"), F.var_pop(v[c]).alias(f"v{i}"))])
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col("n"), F.col(f"k{i}").alias("k"), F.col(f"m{i}").alias("mean"), F.sqrt(F.col(f"v{i}") * F.col(f"k{i}") / F.when(F.col("n") > 0, F.col("n"))).alias("sd")) for i, c in enumerate(columns)])
    return one.select(F.inline(cells))


def correlation_matrix(df: DataFrame, columns: list[str], stats: dict, chunk: int = 200) -> DataFrame:
    """var1, var2, r (var1 <= var2) of the standardised, mean-imputed columns."""
    z = {c: F.coalesce((sc.as_number(F.col(c)) - stats[c][0]) / stats[c][1], F.lit(0.0)) if stats[c][1] > 0 else F.lit(0.0) for c in columns}
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    out = None
    for i in range(0, len(pairs), chunk):
        part = pairs[i : i + chunk]
        one = df.agg(*[F.avg(z[a] * z[b]).alias(f"r{k}") for k, (a, b) in enumerate(part)])
        rows = one.select(F.inline(F.array(*[F.struct(F.lit(a).alias("var1"), F.lit(b).alias("var2"), F.col(f"r{k}").alias("r")) for k, (a, b) in enumerate(part)])))
        out = rows if out is None else out.unionByName(rows)
    return out


def pca(df: DataFrame, columns: list[str], threshold: float = 0.9) -> Reduction:
    """Components of the standardised, mean-imputed columns; columns without any value are left out."""
    kinds = dict(df.dtypes)
    bad = [c for c in columns if kinds[c] in ("string", "boolean", "date") or kinds[c].startswith(("timestamp", "array", "map", "struct"))]
    if bad:
        raise ValueError(f"not numeric: {', '.join(bad)}")
    rows = {r.column_name: r for r in moments(df, columns).collect()}
    used = [c for c in columns if rows[c].k]
    if len(used) < 2:
        raise ValueError("fewer than two columns with values")
    n = rows[used[0]].n
    stats = {c: (rows[c].mean, rows[c].sd or 0.0) for c in used}
    r = np.zeros((len(used), len(used)))
    at = {c: i for i, c in enumerate(used)}
    for x in correlation_matrix(df, used, stats).collect():
        r[at[x.var1], at[x.var2]] = r[at[x.var2], at[x.var1]] = x.r
    w, vec = np.linalg.eigh(r)
    w, vec = np.clip(w[::-1], 0, None), vec[:, ::-1]
    values = w * n / max(n - 1, 1)
    ratio = w / w.sum() if w.sum() > 0 else w
    return Reduction(used, values, ratio, vec * np.sqrt(values), _recommended(ratio, threshold), [c for c in columns if c not in used], n, {"vectors": vec, "stats": stats})


def pca_coordinates(df: DataFrame, model: Reduction, keep: list[str], k: int = 2) -> DataFrame:
    """Rows projected on the first k components."""
    z = [F.coalesce((sc.as_number(F.col(c)) - m) / s, F.lit(0.0)) if s > 0 else F.lit(0.0) for c, (m, s) in model.extra["stats"].items()]

    def axis(j: int) -> Column:
        out = F.lit(0.0)
        for i, x in enumerate(z):
            out = out + x * float(model.extra["vectors"][i, j])
        return out

    return df.select(*keep, *[axis(j).alias(f"pc{j + 1}") for j in range(min(k, len(model.values)))])


def level_pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    """The co-occurrence (Burt) table: level1, level2, cnt of levels named <column>__<value>."""
    cells = F.filter(F.array(*[F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != "NaN"), F.concat(F.lit(f"{c}__"), F.col(c).cast("string"))) for c in columns]), lambda x: x.isNotNull())
    x = df.select(cells.alias("l")).groupBy("l").agg(F.count("*").alias("cnt"))  # distinct profiles are far fewer than rows
    return x.select(F.explode("l").alias("level1"), "l", "cnt").select("level1", F.explode("l").alias("level2"), "cnt").groupBy("level1", "level2").agg(F.sum("cnt").alias("cnt"))


def mca(df: DataFrame, columns: list[str], threshold: float = 0.9, max_levels: int = 30) -> Reduction:
    """Axes of the indicator table; missing values belong to no level."""
    if len(columns) < 2:
        raise ValueError("at least two categorical columns are needed")
    sizes = df.agg(*[F.approx_count_distinct(F.col(c).cast("string")).alias(c) for c in columns]).first().asDict()
    wide = [c for c in columns if sizes[c] > 2 * max_levels]
    if wide:
        raise ValueError(f"more than {max_levels} levels: {', '.join(wide)}")
    table = level_pairs(df, columns).collect()  # at most (levels x columns) squared
    names = sorted({r.level1 for r in table})
    over = [c for c in columns if sum(x.startswith(f"{c}__") for x in names) > max_levels]
    if over:
        raise ValueError(f"more than {max_levels} levels: {', '.join(over)}")
    at = {x: i for i, x in enumerate(names)}
    burt = np.zeros((len(names), len(names)))
    for r in table:
        burt[at[r.level1], at[r.level2]] = r.cnt
    used = [c for c in columns if any(x.startswith(f"{c}__") for x in names)]
    n, p = df.count(), len(used)
    mass = np.diag(burt) / np.diag(burt).sum()
    # eigenvalues of the standardised Burt table are the squares of the indicator table's inertias' roots
    b = burt / burt.sum()
    col = b.sum(axis=1)
    s = (b - np.outer(col, col)) / np.sqrt(np.outer(col, col))
    w, vec = np.linalg.eigh((s + s.T) / 2)
    order = np.argsort(-w)[: max(len(names) - p, 1)]
    values = np.clip(w[order], 0, None)
    ratio = values / values.sum() if values.sum() > 0 else values
    coords = vec[:, order] / np.sqrt(col)[:, None] * np.sqrt(values)[None, :]
    return Reduction(names, values, ratio, coords, _recommended(ratio, threshold), [c for c in columns if c not in used], n, {"columns": used, "mass": mass})


def mca_coordinates(df: DataFrame, model: Reduction, keep: list[str], k: int = 2) -> DataFrame:
    """Rows placed at the mean of their levels, scaled by the axes."""
    axes = []
    for j in range(min(k, len(model.values))):
        total = F.lit(0.0)
        for c in model.extra["columns"]:
            pairs = [(n.removeprefix(f"{c}__"), float(model.loadings[i, j])) for i, n in enumerate(model.names) if n.startswith(f"{c}__")]
            lookup = F.create_map(*[F.lit(x) for kv in pairs for x in kv])
            total = total + F.coalesce(F.try_element_at(lookup, F.col(c).cast("string")), F.lit(0.0))
        root = float(np.sqrt(model.values[j])) or 1.0
        axes.append((total / len(model.extra["columns"]) / root).alias(f"dim{j + 1}"))
    return df.select(*keep, *axes)


def reduction_table(spark, model: Reduction) -> DataFrame:
    """component, eigenvalue, ratio, cumulative, recommended."""
    cum = np.cumsum(model.ratio)
    return spark.createDataFrame([(i + 1, float(v), float(r), float(c), model.n_recommended) for i, (v, r, c) in enumerate(zip(model.values, model.ratio, cum))], "component int, eigenvalue double, ratio double, cumulative double, n_recommended int")


def loadings_table(spark, model: Reduction, k: int = 2) -> DataFrame:
    """label, component, loading of the first k axes."""
    rows = [(n, j + 1, float(model.loadings[i, j])) for i, n in enumerate(model.names) for j in range(min(k, model.loadings.shape[1]))]
    return spark.createDataFrame(rows, "label string, component int, loading double")


def longest_loadings(spark, model: Reduction, k: int = 20) -> DataFrame:
    """Labels by distance from the origin on the first two axes."""
    rows = [(n, float(model.loadings[i, 0]), float(model.loadings[i, 1]) if model.loadings.shape[1] > 1 else 0.0) for i, n in enumerate(model.names)]
    return spark.createDataFrame(rows, "label string, x double, y double").withColumn("length", F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y"))).orderBy(F.desc("length"), "label").limit(k)


def variable_of(label: str, names: list[str], sep: str = "__") -> str | None:
    """The longest column name that a level label begins with."""
    fit = [n for n in names if label.startswith(n + sep)]
    return max(fit, key=len) if fit else None


def variables_of_labels(labels: DataFrame, names: DataFrame) -> DataFrame:
    """The same for tables: label, variable."""
    both = labels.join(broadcast_if_small(names), F.col("label").startswith(F.concat(F.col("name"), F.lit("__"))), "left")
    return both.groupBy("label").agg(F.max_by("name", F.length("name")).alias("variable"))


def subset(model: Reduction, variables: list[str]) -> Reduction:
    """The part of a correspondence analysis that belongs to some variables."""
    keep = [i for i, n in enumerate(model.names) if variable_of(n, model.extra["columns"]) in variables]
    return Reduction([model.names[i] for i in keep], model.values, model.ratio, model.loadings[keep], model.n_recommended, model.excluded, model.n, model.extra)


def excluded_table(spark, model: Reduction) -> DataFrame:
    return spark.createDataFrame([(c,) for c in model.excluded], "feature string")


def as_categories(df: DataFrame, columns: list[str]) -> DataFrame:
    """Binary and numeric columns as category labels."""
    return df.withColumns({c: F.when(F.col(c).cast("string") != "NaN", F.col(c).cast("string")) for c in columns})
