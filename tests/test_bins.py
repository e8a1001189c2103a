import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from visitstat.operators.bins import bin_counts, bin_plan, expand_bins, histogram, place_in_bins, sturges
from visitstat.sources.shards import number_series


def check_numpy(spark, values, log10=False):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    out = histogram(df, "x", log10=log10).collect()
    present = np.array([v for v in values if v is not None and v == v], dtype=float)
    k = math.ceil(1 + 3.32 * np.log10(len(present)))
    sample = np.log10(present[present > 0]) if log10 else present
    counts, edges = np.histogram(sample, bins=k)
    dens, _ = np.histogram(sample, bins=k, density=True)
    assert [r["count"] for r in out] == counts.tolist()
    assert np.allclose([r["bin_lo"] for r in out], edges[:-1], rtol=0, atol=0)
    assert np.allclose([r["bin_hi"] for r in out], edges[1:], rtol=0, atol=0)
    assert np.allclose([r["density"] for r in out], dens, rtol=1e-12)


def test_histogram_matches_numpy(spark):
    rnd = random.Random(11)
    check_numpy(spark, [rnd.lognormvariate(3, 1.5) for _ in range(5000)] + [None, float("nan")])
    check_numpy(spark, [float(rnd.randint(1, 30)) for _ in range(1234)])
    check_numpy(spark, [rnd.random() for _ in range(10)])


def test_histogram_log10_leaves_out_zero(spark):
    out = histogram(spark.createDataFrame([(0.0,), (1.0,), (10.0,)], "x double"), "x", log10=True).collect()
    assert sum(r["count"] for r in out) == 2 and len(out) == sturges(3)
    check_numpy(spark, [0.0, 1.0, 10.0, 100.0, 5.0], log10=True)


def test_histogram_all_equal_widens(spark):
    out = histogram(spark.createDataFrame([(5.0,)] * 3, "x double"), "x").collect()
    assert out[0]["bin_lo"] == 4.5 and out[-1]["bin_hi"] == 5.5
    assert sum(r["count"] for r in out) == 3
    check_numpy(spark, [5.0, 5.0, 5.0])


def test_histogram_max_in_last_bin(spark):
    out = histogram(spark.createDataFrame([(float(v),) for v in range(11)], "x double"), "x", bins=5).collect()
    assert [r["count"] for r in out] == [2, 2, 2, 2, 3]


def test_number_series(spark):
    s = number_series(spark, 1, math.ceil(6.4))
    assert s.count() == 7 and s.agg(F.sum("num")).first()[0] == 28


def test_bin_plan_and_expansion(spark):
    rnd = random.Random(2)
    data = [("a", rnd.random()) for _ in range(100)] + [("b", 1.0), ("b", 1.0)] + [("c", 3.0)]
    df = spark.createDataFrame(data, "g string, v double")
    plan = {r["g"]: r for r in bin_plan(df, ["g"], "v").collect()}
    ka = math.ceil(1 + 3.5 * math.log(100))
    assert plan["a"]["ceil"] == ka and plan["a"]["sum_another_teor"] == ka * (ka + 1) // 2
    assert math.isclose(plan["a"]["step"], (plan["a"]["over_test_max"] - plan["a"]["over_test_min"])
                        / (1 + 3.5 * math.log(100)), rel_tol=1e-12)
    assert plan["b"]["ceil"] == 1 and plan["b"]["step"] == 0.0  # zero range: one bin
    rows = expand_bins(df, bin_plan(df, ["g"], "v"), ["g"])
    assert rows.count() == 100 * ka + 2 + 1
    per = {r["g"]: r["m"] for r in rows.groupBy("g").agg(F.max("another_unnest").alias("m")).collect()}
    assert per == {"a": ka, "b": 1, "c": 1}


def test_histograms_many_columns_match_numpy(spark):
    from visitstat.operators.bins import histograms
    rnd = random.Random(21)
    rows = [(rnd.lognormvariate(2, 1), None if rnd.random() < 0.3 else float(rnd.randint(0, 40)), 7.0)
            for _ in range(2000)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    specs = [("a", False), ("a", True), ("b", False), ("b", True), ("c", False)]
    out = histograms(df, specs).collect()
    for col, lg in specs:
        got = [r for r in out if r["column"] == col and r["scale"] == ("log10" if lg else "raw")]
        vals = np.array([getattr(r, col) for r in df.select(col).collect() if getattr(r, col) is not None])
        k = math.ceil(1 + 3.32 * np.log10(len(vals)))
        sample = np.log10(vals[vals > 0]) if lg else vals
        counts, edges = np.histogram(sample, bins=k)
        dens, _ = np.histogram(sample, bins=k, density=True)
        assert [r["bin"] for r in got] == list(range(k))
        assert [r["count"] for r in got] == counts.tolist(), (col, lg)
        assert np.array_equal([r["bin_lo"] for r in got], edges[:-1])
        assert np.allclose([r["density"] for r in got], dens, rtol=1e-12)


def test_infinite_values_are_an_error_and_zeros_leave_the_logarithm(spark):
    for bad in (math.inf, -math.inf):
        with pytest.raises(ValueError):
            histogram(spark.createDataFrame([(1.0,), (2.0,), (bad,)], "x double"), "x")
    check_numpy(spark, [0.0, 0.0, 1.0, 10.0, 100.0, math.nan, None, 1000.0, 5.0], log10=True)
    check_numpy(spark, [0.0, math.nan, 3.0, 7.0])
    assert histogram(spark.createDataFrame([(math.nan,), (None,)], "x double"), "x").count() == 0


def test_every_row_lies_in_its_own_bin(spark):
    rnd = random.Random(3)
    data = [("a", rnd.lognormvariate(2, 1)) for _ in range(300)] + [("b", 4.0)] * 3 + [(None, float(i)) for i in range(20)]
    data += [("c", None)]
    df = spark.createDataFrame(data, "g string, v double")
    counts = bin_counts(df, ["g"], "v")
    plan = {r["g"]: r for r in counts.collect()}
    assert set(plan) == {"a", "b", None} and plan["b"]["ceil"] == 1
    full = {r["g"]: r for r in bin_plan(df, ["g"], "v").collect()}
    assert all((plan[g]["step"], plan[g]["ceil"]) == (full[g]["step"], full[g]["ceil"]) for g in plan)
    got = place_in_bins(df, counts, ["g"], "v").collect()
    assert len(got) == 323
    for r in got:
        p = plan[r["g"]]
        assert 1 <= r["bin"] <= p["ceil"]
        if p["step"] > 0:
            assert p["low"] + (r["bin"] - 1) * p["step"] <= r["v"] * (1 + 1e-12)
            assert r["v"] <= p["low"] + r["bin"] * p["step"] * (1 + 1e-12)
