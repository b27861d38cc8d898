"""Mixing: targets met within one document, caps, hopeless targets, order, odd tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitewise.llm import mixing
from sitewise.llm.mixing_queries import QUERIES


def world(spark, docs, targets):
    d = spark.createDataFrame(docs, "doc_id long, source string, n_tokens long").withColumn("u", mixing.uniform(F.col("doc_id"), 20)).persist()
    t = mixing.read_targets(spark.createDataFrame(targets, "source string, target_share double, max_repeats int"))
    t, total = mixing.solve(d, t)
    mixed = mixing.with_copies(d, t)
    return mixed, {r.source: r for r in mixing.report(mixed, t, total).collect()}, total


def corpus(n=4000):
    rng = np.random.default_rng(1)
    return [(i, ["a", "b", "c", "d", None][min(int(rng.exponential(1.2)), 4)], int(rng.lognormal(4, 0.6))) for i in range(n)]


def test_targets_caps_and_report(spark):
    mixed, rep, total = world(spark, corpus(), [("a", 0.3, 1), ("b", 0.2, 3), ("c", 0.3, 2), ("d", 0.1, 6), ("gone", 0.1, 2)])
    longest = max(n for _, _, n in corpus())
    for s in "abd":
        assert rep[s].outcome == "met"
        assert abs(rep[s].mixed_tokens - rep[s].target_tokens) <= longest
    assert rep["gone"].outcome == "no documents" and rep["gone"].actual_share == 0
    over = {s: rep[s] for s in rep if rep[s].outcome == "too few documents"}
    for r in over.values():
        assert r.mixed_tokens == r.source_tokens * r.max_repeats
    assert mixed.where("source is null and n_copies > 0").count() == 0
    caps = {r.source: r.m for r in mixed.groupBy("source").agg(F.max("n_copies").alias("m")).collect()}
    assert caps["a"] <= 1 and caps["b"] <= 3 and caps["c"] <= 2 and caps["d"] <= 6


@pytest.mark.parametrize("lam,most", [(1.7, 5), (0.01, 3), (60.0, 80), (900.0, 1000)])
def test_copies_follow_the_poisson_quantile(spark, lam, most):
    us = np.linspace(0.01, 0.99, 99)
    df = spark.createDataFrame([(float(u),) for u in us], "u double").selectExpr("u", f"{mixing.thresholds(f'{lam}d', str(most))} as at").selectExpr(f"{mixing.copies('u', 'at')} as k")
    logs = -lam + np.cumsum(np.concatenate([[0.0], np.log(lam / np.arange(1, most))]))
    p = np.cumsum(np.exp(logs))
    assert [r.k for r in df.collect()] == [int((u > p).sum()) for u in us]


def test_eighty_repetitions_and_equal_numbers(spark):
    docs = [(i, "few", 10 + i % 5) for i in range(40)] + [(i, "many", 30) for i in range(100, 3000)] + [(7, "same", 5)] * 20
    _, rep, total = world(spark, docs, [("few", 36_000 / 88_000, 100), ("many", 0.3, 1), ("same", 30 / 88_000, 3)])
    few = rep["few"]
    assert few.outcome == "met" and few.target_tokens > 60 * few.source_tokens and abs(few.mixed_tokens - few.target_tokens) <= 14
    assert rep["same"].outcome == "nearest" and rep["same"].mixed_tokens in (0, 100)


def test_shuffle_is_whole_and_unordered(spark):
    mixed, _, _ = world(spark, corpus(600), [("a", 0.5, 2), ("b", 0.5, 4)])
    rows = mixing.shuffled(mixed, "doc_id", 20).collect()
    assert len(rows) == mixed.agg(F.sum("n_copies")).first()[0]
    keys = [r.order_key for r in rows]
    assert keys == sorted(keys)
    ids = np.array([r.doc_id for r in rows])
    assert abs(np.corrcoef(np.arange(len(ids)), ids)[0, 1]) < 0.15


@pytest.mark.parametrize("docs", [[], [(1, "a", 0), (2, "a", 0)], [(1, None, 5)]])
def test_nothing_to_mix(spark, docs):
    mixed, rep, _ = world(spark, docs, [("a", 0.5, 1), ("b", None, 2), ("c", float("nan"), None)])
    assert mixed.agg(F.coalesce(F.sum(F.col("n_copies") * F.col("n_tokens")), F.lit(0))).first()[0] == 0
    assert {r.outcome for r in rep.values()} <= {"no documents", "no target"}


def test_one_source_holds_a_third(spark):
    docs = [(i, "hot" if i % 3 == 0 else f"s{i % 7}", 50) for i in range(3000)]
    _, rep, _ = world(spark, docs, [("hot", 0.2, 1), ("s1", 0.3, 5)])
    assert abs(rep["hot"].actual_share - 0.2) < 0.001 and abs(rep["s1"].actual_share - 0.3) < 0.001


def test_queries(spark, small):
    n = {k: f(spark, small).count() for k, f in QUERIES.items()}
    assert n["p7_copies"] == 100 or n["p7_copies"] > 0
    assert n["p7_shares"] == 19
