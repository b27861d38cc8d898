"""Distributions against published values, tests against brute force, planted signals, odd tables."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sitewise.functions import distributions as dist
from sitewise.operators import column_typing as ct
from sitewise.operators import descriptive as ds
from sitewise.operators import federation as fed
from sitewise.operators import inference as inf


@pytest.mark.parametrize(("got", "want", "tol"), [
    (lambda: dist.t_two_sided(2.228, 10), 0.05, 1e-4), (lambda: dist.f_upper(3.49, 2, 20), 0.05, 3e-4), (lambda: dist.chi2_upper(11.07, 5), 0.05, 1e-4), (lambda: dist.chi2_upper(5.0, 2), math.exp(-2.5), 1e-12),
    (lambda: dist.studentized_range_upper(3.877, 3, 10), 0.05, 2e-4), (lambda: dist.studentized_range_upper(3.958, 4, 20), 0.05, 2e-4), (lambda: dist.studentized_range_upper(4.02, 5, 1e6), 0.01 * 3.6, 0.02), (lambda: dist.normal_quantile(0.975), 1.959964, 1e-6),
    (lambda: dist.fisher_p(3, 1, 1, 3), 34 / 70, 1e-9), (lambda: dist.shapiro_wilk_p(np.array([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236])), 0.0067, 1e-4),
])
def test_distributions(got, want, tol):
    assert abs(got() - want) <= tol


@pytest.mark.parametrize(("n1", "n2"), [(2, 3), (3, 3), (4, 3), (5, 4), (8, 2)])
def test_exact_u_by_enumeration(n1, n2):
    ranks = range(1, n1 + n2 + 1)
    all_u = [sum(c) - n1 * (n1 + 1) / 2 for c in itertools.combinations(ranks, n1)]
    for u in {0, 1, n1 * n2 // 2, n1 * n2}:
        top = max(u, n1 * n2 - u)
        want = min(1.0, 2 * sum(x >= top for x in all_u) / len(all_u))
        assert abs(dist.mann_whitney_p(u, n1, n2, 0) - want) < 1e-12


def test_fisher_by_enumeration():
    for a, b, c, d in itertools.product(range(5), repeat=4):
        if min(a + b, c + d, a + c, b + d) == 0:
            continue
        n = a + b + c + d
        p = {k: math.comb(a + b, k) * math.comb(c + d, a + c - k) / math.comb(n, a + c) for k in range(max(0, a + c - c - d), min(a + b, a + c) + 1)}
        want = sum(v for v in p.values() if v <= p[a] * (1 + 1e-7))
        assert abs(dist.fisher_p(a, b, c, d) - want) < 1e-9


def planted(n=200, seed=4):
    rng = np.random.default_rng(seed)
    a = rng.normal(0, 1, n)
    x = rng.choice(["u", "v", "w"], n)
    return pd.DataFrame({"num_a": a, "num_b": a * 0.7 + rng.normal(0, 0.7, n), "num_noise": rng.normal(0, 1, n), "grp_strong": np.where(a + rng.normal(0, 0.5, n) > 0, "hi", "lo"), "grp_weak": rng.choice(["p", "q"], n), "cat_x": x, "cat_y": np.where(rng.random(n) < 0.85, x, rng.choice(["u", "v", "w"], n)), "cat_p": rng.choice(["1", "2"], n)})


def test_screen_finds_planted_pairs_only(spark):
    df = spark.createDataFrame(planted())
    got = inf.screen(df, ["num_a", "num_b", "num_noise"], {"grp_strong": 2, "grp_weak": 2, "cat_x": 3, "cat_y": 3, "cat_p": 2}).toPandas()
    hits = {(r.var1, r.var2) for r in got[got.significant].itertuples()}
    assert {("num_a", "num_b"), ("num_a", "grp_strong"), ("cat_x", "cat_y")} <= hits
    assert not hits & {("num_a", "num_noise"), ("num_a", "grp_weak"), ("cat_x", "cat_p")}
    assert len(got) == 3 + 10 + 9 and (got.p_adj >= got.p_value - 1e-12).all()


def test_singleton_groups_and_constants_are_skipped(spark):
    pdf = planted(60)
    pdf["single"] = ["only"] + ["rest"] * 59
    pdf["flat"] = 1.0
    pdf["empty"] = np.nan
    df = spark.createDataFrame(pdf)
    got = inf.screen(df, ["num_a", "flat", "empty"], {"single": 2, "grp_weak": 2}).toPandas()
    assert not ((got.var1 == "num_a") & (got.var2 == "single")).any()
    assert not (got.var1 == "empty").any()
    assert inf.screen(df.limit(0), ["num_a"], {"grp_weak": 2}).count() == 0


def test_four_groups_and_posthoc(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"value": np.concatenate([rng.normal(m, 0.5, 40) for m in (0, 1, 2.5, 4.5)]), "g": np.repeat(list("abcd"), 40)})
    df = spark.createDataFrame(pdf)
    r = inf.compare_groups(df, [("value", "g")]).first()
    assert r.p_value < 1e-6
    for method in ("welch", "kruskal"):
        long = inf.posthoc(df, "value", "g", method)
        assert long.count() == 6 and long.agg(F.max("p_adj")).first()[0] < 0.01
        wide = {x.group_a: x for x in inf.posthoc_matrix(long).collect()}
        assert all(wide[i][i] is None and wide[i][j] == wide[j][i] for i in "abcd" for j in "abcd")
    with pytest.raises(ValueError):
        inf.posthoc(df, "value", "g", "anova")


def test_multiplicity_literals(spark):
    df = spark.createDataFrame([(i, p) for i, p in enumerate([0.01, 0.04, 0.03, 0.005, 0.5, None])], "i int, p double")
    bh = {r.i: r.p_adj for r in inf.benjamini_hochberg(df, "p").collect()}
    ho = {r.i: r.p_adj for r in inf.holm(df, "p").collect()}
    assert [round(bh[i], 6) for i in range(5)] == [0.025, 0.05, 0.05, 0.025, 0.5] and bh[5] is None
    assert [round(ho[i], 6) for i in range(5)] == [0.04, 0.09, 0.09, 0.025, 0.5] and ho[5] is None


def test_pooled_variance_literal(spark):
    p = spark.createDataFrame([("a", "x", 2, 0.0, 0.0, 0.0, 0.0), ("b", "x", 2, 10.0, 0.0, 10.0, 10.0), ("c", "one", 1, 3.0, None, 3.0, 3.0)], "node_id string, column_name string, n long, mean double, variance double, min double, max double")
    got = {r.column_name: r for r in fed.pooled_numeric(p).collect()}
    assert abs(got["x"].variance - 100 / 3) < 1e-9 and got["x"].mean == 5 and got["one"].variance == 0


def test_column_kinds_of_literal_columns(spark):
    rows = [(f"patient_{i:03}", 20 + i, ["m", "f"][i % 2], i % 2, f"2022-01-{i % 28 + 1:02}", None, "yes" if i % 3 else "no", "12.5" if i % 4 else "<5", i % 3, True) for i in range(60)]
    df = spark.createDataFrame(rows, "code string, age int, sex string, diabetes int, visit string, gone string, smoker string, lab string, three int, flag boolean")
    k = {x.column: x for x in ct.column_kinds(ct.promote_dates(df))}
    assert {c: x.kind for c, x in k.items()} == {"code": "categorical", "age": "numeric", "sex": "categorical", "diabetes": "categorical", "visit": "temporal", "gone": "empty", "smoker": "categorical", "lab": "categorical", "three": "numeric", "flag": "categorical"}
    assert {c for c, x in k.items() if x.is_binary} == {"diabetes", "smoker", "flag"} and k["code"].is_identifier
    assert [r.column_name for r in ct.quasi_numeric(df, ["lab", "code", "visit"]).collect()] == ["lab"]


def test_sparse_flags_need_a_name(spark):
    df = spark.createDataFrame([(1, 1), (0, None), (None, 0)], "rash int, reading int")
    k = {x.column: x.is_binary for x in ct.column_kinds(df)}
    assert k == {"rash": True, "reading": False}


def test_profiles_of_odd_tables(spark):
    df = spark.createDataFrame([(None, 1.0, 5), ("a", None, 5), ("a", float("nan"), 5), ("a", 2.0, 5), ("a", 2.0, 5)], "node string, value double, cnt int")
    p = {r.node_id: r for r in ds.numeric_profile(ds.melt(df, F.col("node"), ["value", "cnt"])).where("column_name = 'value'").collect()}
    assert p["a"].asDict() | {} and (p["a"]["count"], p["a"].missing_values, p["a"].mode, p["a"].frequency) == (2, 2, 2.0, 2)
    assert ds.numeric_profile(ds.melt(df.limit(0), F.col("node"), ["value"])).count() == 0
    assert [r.cnt for r in ds.fixed_histogram(spark.createDataFrame([(-5.0,), (5.0,), (999.0,), (40.0,), (50.0,), (100.0,)], "age double"), "age").where("cnt > 0").orderBy("bin").collect()] == [1, 1, 1, 1]
