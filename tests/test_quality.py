"""Column profile: footers and dictionaries against the data, findings on literal loads, odd tables."""

import datetime as dt

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from sitewise.operators import quality_profile as qp
from sitewise.sources import parquet_chunks as pc

DOMAINS = [("t", "v", "number", 0.0, 100.0, None, None), ("t", "g", "number", 1.0, 3.0, None, "^[0-9]$")]
DOMAIN_SCHEMA = "dataset string, column_name string, kind string, min_value double, max_value double, allowed_values string, pattern string"


def world(spark, path, loads, group_rows=1000, **write):
    """Loads as {load_id: (v values, g values)}, one row after the other."""
    rows = [(k, v, g) for k, (vs, gs) in loads.items() for v, g in zip(vs, gs)]
    t = pa.table({"load_id": pa.array([r[0] for r in rows], pa.int64()), "v": pa.array([r[1] for r in rows], pa.float64()), "g": pa.array([r[2] for r in rows], pa.string())})
    pq.write_table(t, f"{path}/t.parquet", row_group_size=group_rows, **write)
    ids = sorted(loads)
    links = spark.createDataFrame([(k, "t", "n", dt.datetime(2020, 1, 1), ids[i - 1] if i else None, 0) for i, k in enumerate(ids)], "load_id long, dataset string, node_id string, loaded_at timestamp_ntz, prev_load_id long, declared_rows int")
    return spark.read.parquet(f"{path}/t.parquet"), links, spark.createDataFrame(DOMAINS, DOMAIN_SCHEMA)


def found(spark, path, loads, **kw):
    df, links, domains = world(spark, path, loads, **kw)
    counts = qp.value_counts(spark, df, "load_id", ["v", "g"]).withColumn("dataset", F.lit("t"))
    return {tuple(r) for r in qp.findings(qp.compared(qp.judged(counts, domains), links)).collect()}


CASES = {
    1: ([float(i % 50) for i in range(100)], ["1", "2"] * 50),
    2: ([float(i % 50) + 30 for i in range(100)], ["1"] * 100),
    3: ([float("nan") if i < 15 else float(i % 50) + 30 for i in range(100)], ["G2", " 1", "9", None, "2\n"] + ["2"] * 95),
    4: ([101.0, -0.5] + [float(i % 50) + 30 for i in range(98)], ["3"] * 100),
    5: ([float("nan")] * 10, [None] * 10),
    6: ([5.0] * 10, ["1"] * 10),
}
EXPECTED = {
    (2, "v", "shift"), (2, "g", "constant"), (2, "g", "shift"), (3, "v", "null_share"), (3, "g", "bad_pattern"), (3, "g", "out_of_range"), (3, "g", "shift"),
    (4, "v", "out_of_range"), (4, "v", "null_share"), (4, "g", "constant"), (4, "g", "shift"), (5, "v", "null_share"), (5, "g", "null_share"), (6, "v", "null_share"), (6, "g", "null_share"),
}


@pytest.mark.parametrize("group_rows", [7, 100, 1000])
@pytest.mark.parametrize("write", [{}, {"use_dictionary": False}, {"compression": "zstd", "data_page_version": "2.0"}, {"write_statistics": False}])
def test_findings_whatever_the_layout(spark, tmp_path, group_rows, write):
    assert found(spark, tmp_path, CASES, group_rows=group_rows, **write) == EXPECTED


def test_single_load_constant_chunks_are_not_scanned(spark, tmp_path):
    df, _, _ = world(spark, tmp_path, CASES, group_rows=10)
    d = qp.chunk_decisions(pc.chunk_table(spark, df, "load_id", ["v", "g"])).groupBy("answer").count().collect()
    assert {r.answer: r["count"] for r in d}["footer"] >= 10


def test_summary_from_footers_is_exact_or_null(spark, tmp_path):
    df, _, _ = world(spark, tmp_path, CASES, group_rows=50)
    got = {r.column_name: r for r in qp.column_summary(pc.chunk_table(spark, df, "load_id", df.columns)).collect()}
    assert got["v"].n_null is None  # NaN may hide in doubles
    assert (got["v"].min_value, got["v"].max_value) == (-0.5, 101.0)
    assert got["g"].n_null == 11 and got["g"].n_distinct == df.select("g").where("g is not null").distinct().count()
    assert got["load_id"].n_distinct == 6


def test_hot_load_and_repeated_rows(spark, tmp_path):
    loads = {1: ([float(i % 90) for i in range(3000)], ["1"] * 3000), 2: ([float(i * 3 // 2) for i in range(60)], ["2"] * 60)}
    assert found(spark, tmp_path, loads) == {(2, "g", "shift")}


def test_empty_table(spark, tmp_path):
    assert found(spark, tmp_path, {1: ([], [])}) == set()


def test_null_keys_and_clashing_columns(spark, tmp_path):
    t = pa.table({"load_id": pa.array([None, None, 1, 1], pa.int64()), "v": pa.array([1.0, None, 500.0, 2.0]), "g": pa.array(["1", "x", "1", "2"]), "key": [1, 2, 3, 4], "cnt": [5, 6, 7, 8], "value": ["a"] * 4})
    pq.write_table(t, f"{tmp_path}/t.parquet")
    counts = qp.value_counts(spark, spark.read.parquet(f"{tmp_path}/t.parquet"), "load_id", ["v", "g"]).withColumn("dataset", F.lit("t"))
    links = spark.createDataFrame([(1, "t", "n", None, None, None)], "load_id long, dataset string, node_id string, loaded_at timestamp_ntz, prev_load_id long, declared_rows int")
    got = {tuple(r) for r in qp.findings(qp.compared(qp.judged(counts, spark.createDataFrame(DOMAINS, DOMAIN_SCHEMA)), links)).collect()}
    assert got == {(1, "v", "out_of_range"), (None, "g", "bad_pattern")}


def test_every_column_of_every_load_is_described(spark, small):
    from sitewise.queries import quality
    from sitewise.session import table

    got = {k: {(r.dataset, r.column_name) for r in quality.QUERIES[k](spark, small).select("dataset", "column_name").distinct().collect()} for k in ("p3_profile", "p3_keys")}
    assert got["p3_profile"] | got["p3_keys"] == {(d, c) for d in quality.MEASURED for c in table(spark, small, d).columns if c != "load_id"}


@pytest.mark.parametrize("write", [{}, {"use_dictionary": False}, {"write_statistics": False}])
def test_large_numbers_dates_and_texts_by_load(spark, tmp_path, write):
    big, day = 1 << 60, dt.date(2020, 1, 1)
    ids = [big + i for i in range(60)] + [big + 30 + i for i in range(60)]
    t = pa.table({"load_id": [1] * 60 + [2] * 60, "id": pa.array(ids, pa.int64()), "day": pa.array([day] * 60 + [None] * 6 + [day + dt.timedelta(1)] * 54, pa.date32()), "who": [f"P{i:03}" for i in range(60)] + [f"P{i + 15:03}" for i in range(60)]})
    pq.write_table(t, f"{tmp_path}/t.parquet", row_group_size=60, **write)
    links = spark.createDataFrame([(1, "t", "n", None, None, None), (2, "t", "n", None, 1, None)], "load_id long, dataset string, node_id string, loaded_at timestamp_ntz, prev_load_id long, declared_rows int")
    counts = qp.value_counts(spark, spark.read.parquet(f"{tmp_path}/t.parquet"), "load_id", ["id", "day", "who"], exact=True).withColumn("dataset", F.lit("t"))
    got = {(r.load_id, r.column_name): r for r in qp.compared(qp.judged(counts, spark.createDataFrame(DOMAINS, DOMAIN_SCHEMA)), links).collect()}
    assert [(got[k, "id"].n_distinct, got[k, "id"].min_number, got[k, "id"].max_number) for k in (1, 2)] == [(60, big, big + 59), (60, big + 30, big + 89)]
    assert (got[2, "day"].n_missing, got[2, "day"].min_number, got[2, "day"].n_distinct) == (6, 18263, 1)
    assert (got[2, "who"].min_text, got[2, "who"].max_text) == ("P015", "P074")
    assert [int(got[2, c].distance) / (got[2, c].n_valid * 60) for c in ("id", "day", "who")] == [0.5, 1.0, 0.25]


@pytest.mark.parametrize("write", [{}, {"use_dictionary": ["g"], "write_statistics": False}])
def test_whole_columns_have_every_figure(spark, tmp_path, write):
    df, _, _ = world(spark, tmp_path, CASES, group_rows=50, **write)
    got = {r.column_name: r for r in qp.whole_columns(spark, df).collect()}
    v = {float(x) for vs, _ in CASES.values() for x in vs if x == x}
    assert (got["v"].n_null, got["v"].n_distinct, got["v"].min_value, got["v"].max_value) == (25, len(v), -0.5, 101.0)
    g = {x for _, gs in CASES.values() for x in gs if x is not None}
    assert (got["g"].n_null, got["g"].n_distinct, got["g"].min_text, got["g"].max_text) == (11, len(g), min(g), max(g))
    assert (got["load_id"].n_null, got["load_id"].n_distinct, got["load_id"].n_rows) == (0, 6, df.count())


def test_comparison_reads_the_counts_once(spark, tmp_path):
    """A cached table's plan is repeated in the driver wherever the table is read, and sent again with every update."""
    df, links, domains = world(spark, tmp_path, CASES)
    counts = qp.value_counts(spark, df, "load_id", ["v", "g"]).withColumn("dataset", F.lit("t"))
    plan = qp.findings(qp.compared(qp.judged(counts, domains), links))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("InMemoryTableScan") == 1


def test_distance_by_hand_with_ties_a_shared_load_before_and_texts_last(spark, tmp_path):
    loads = {
        1: ([float(i % 7 - 3) * 10 for i in range(90)], ["x"] * 30 + [str(i % 4) for i in range(60)]),
        2: ([-0.0] * 20 + [float(i % 5) for i in range(50)], [str(i % 3) for i in range(70)]),
        3: ([1e9, -1e9] + [float("nan")] * 20 + [30.0] * 60, ["x", "y"] * 41),
    }
    df, _, _ = world(spark, tmp_path, loads)
    links = spark.createDataFrame([(k, "t", "n", None, p, None) for k, p in ((1, None), (2, 1), (3, 1))], "load_id long, dataset string, node_id string, loaded_at timestamp_ntz, prev_load_id long, declared_rows int")
    counts = qp.value_counts(spark, df, "load_id", ["v", "g"]).withColumn("dataset", F.lit("t"))
    got = {(r.load_id, r.column_name): r.distance for r in qp.compared(qp.judged(counts, spark.createDataFrame([], DOMAIN_SCHEMA)), links).collect()}

    def by_hand(now, old):
        a, b = ([float(x) if str(x) not in "xy" else float("inf") for x in side if x == x] for side in (now, old))
        return max(abs(sum(x <= v for x in a) * len(b) - sum(x <= v for x in b) * len(a)) for v in {*a, *b})

    want = {(k, c): None if k == 1 else by_hand(loads[k][i], loads[1][i]) for k in loads for i, c in enumerate("vg")}
    assert {k: v if v is None else int(v) for k, v in got.items()} == want
