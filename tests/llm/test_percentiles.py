"""Percentiles by bisection against sorted values."""

import math

import numpy as np
import pandas as pd
import pytest

from sitewise.llm import percentiles as pt
from sitewise.llm.percentile_queries import QUERIES, day_cells


def nearest_rank(values, p):
    v = sorted(values)
    return v[max(1, (len(v) * p + 99) // 100) - 1]


def run(spark, rows, percents=(5, 50, 95), resolution=0.0):
    df = spark.createDataFrame(rows, "g string, x double")
    out = pt.bisect(pt.cells(df, ["g"], ["x"], resolution), ["g"], percents)
    return {r.g: r.asDict() for r in out.collect()}


def test_against_sorting_with_ties_tails_and_missing(spark):
    rng = np.random.default_rng(3)
    groups = {
        "ties": [1.0] * 500 + [2.0] * 3,
        "tail": [*rng.lognormal(3, 4, 700), 1e300, 5e-324],
        "signs": [*rng.normal(0, 1, 401), -0.0, 0.0],
        "one": [7.5],
        "inf": [float("-inf"), -1.7976931348623157e308, 0.0, 1.7976931348623157e308, float("inf")],
    }
    rows = [(g, float(x)) for g, v in groups.items() for x in v] + [("ties", None), ("ties", float("nan")), ("gone", None), (None, 3.0)]
    got = run(spark, rows)
    assert set(got) == {*groups, None}
    for g, v in groups.items():
        assert got[g]["n"] == len(v)
        for p in (5, 50, 95):
            assert got[g][f"p{p:02d}"] == nearest_rank(v, p), (g, p)


def test_hot_group_is_split_and_stays_exact(spark, monkeypatch):
    monkeypatch.setattr(pt, "SPLIT_VALUES", 50)
    monkeypatch.setattr(pt, "FEW_GROUPS", 0)
    v = list(np.random.default_rng(5).normal(0, 1, 3000))
    got = run(spark, [("hot", float(x)) for x in v] + [("small", 1.0), ("small", 2.0)])
    assert got["hot"]["p50"] == nearest_rank(v, 50)
    assert got["small"]["p95"] == 2.0


def test_parts_merge_to_the_whole_within_the_bound(spark):
    v = np.random.default_rng(7).uniform(0, 1000, 2000)
    df = spark.createDataFrame(pd.DataFrame({"day": np.arange(2000) % 7, "x": v}))
    for r in (0.0, 2.0):
        whole = pt.bisect(pt.merged(pt.cells(df, ["day"], ["x"], r), []), []).collect()[0]
        for p in pt.PERCENTS:
            assert math.isclose(whole[f"p{p:02d}"], nearest_rank(v, p), abs_tol=r / 2 + 1e-12)


def test_empty_and_clashing_columns(spark):
    assert run(spark, []) == {}
    df = spark.createDataFrame([("a", 1.0, 2.0, 3)], "node string, chol double, cnt double, value int")
    assert [tuple(r) for r in pt.cells(df, ["node"], ["chol"]).collect()] == [("a", "chol", 1.0, 1)]


@pytest.mark.parametrize("name", list(QUERIES))
def test_queries_on_the_smallest_tables(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0
    assert day_cells(spark, small).agg({"cnt": "sum"}).collect()[0][0] > 0
