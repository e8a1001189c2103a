import random

import numpy as np
import pandas as pd

from visitstat.operators.profile import describe, frequency, group_profile
from visitstat.operators.quantile import exact_quantiles


def test_median_skips_nulls(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("a", 4.0)], "g string, v double")
    assert group_profile(df, ["g"], "v", ["median"]).first()["median"] == 2.5


def test_variation_with_mean_zero_is_null(spark):
    df = spark.createDataFrame([("a", -1.0), ("a", 1.0)], "g string, v double")
    r = group_profile(df, ["g"], "v", ["avg", "sko", "koef_var"]).first()
    assert r["avg"] == 0.0 and r["koef_var"] is None


def test_quantiles_on_hot_group_match_numpy(spark):
    # One group holds most rows and spans many range partitions.
    rnd = random.Random(3)
    data = [("hot", rnd.lognormvariate(5, 2)) for _ in range(20000)]
    data += [(f"g{i % 40}", float(rnd.randint(0, 9))) for i in range(2000)]
    data += [(None, float(v)) for v in (3, 1, 2)]
    df = spark.createDataFrame(data, "g string, v double").repartition(16)
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        out = exact_quantiles(df, ["g"], ["v"], (0.1, 0.25, 0.5, 0.75, 0.9),
                              name=lambda c, q: f"q{int(q * 100)}").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    pdf = pd.DataFrame(data, columns=["g", "v"])
    assert len(out) == pdf["g"].nunique(dropna=False)
    for r in out:
        vals = pdf[pdf["g"].isna()]["v"] if r["g"] is None else pdf[pdf["g"] == r["g"]]["v"]
        for q in (10, 25, 50, 75, 90):
            assert np.isclose(r[f"q{q}"], np.quantile(vals.to_numpy(), q / 100), rtol=1e-12, atol=0)


def test_profile_methods_agree(spark):
    rnd = random.Random(5)
    df = spark.createDataFrame([(rnd.choice("xyz"), rnd.random()) for _ in range(3000)], "g string, v double")
    a = {r["g"]: r["median"] for r in group_profile(df, ["g"], "v", ["median"],
                                                     median_method="distributed").collect()}
    b = {r["g"]: r["median"] for r in group_profile(df, ["g"], "v", ["median"], median_method="builtin").collect()}
    assert a.keys() == b.keys() and all(np.isclose(a[k], b[k], rtol=1e-12) for k in a)


def test_describe_matches_pandas(spark):
    rnd = random.Random(9)
    data = [(rnd.randint(1, 50), None if rnd.random() < 0.2 else rnd.random() * 100) for _ in range(777)]
    df = spark.createDataFrame(data, "a long, b double")
    got = {r["column"]: r for r in describe(df).collect()}
    want = pd.DataFrame(data, columns=["a", "b"]).astype(float).describe()
    for c in ("a", "b"):
        for ours, theirs in (("count", "count"), ("mean", "mean"), ("std", "std"), ("min", "min"),
                             ("p25", "25%"), ("p50", "50%"), ("p75", "75%"), ("max", "max")):
            assert np.isclose(got[c][ours], want.loc[theirs, c], rtol=1e-9), (c, ours)


def test_frequency_keeps_null_key(spark):
    df = spark.createDataFrame([(1, "v"), (None, "w"), (None, "x"), (1, None)], "h long, id string")
    got = {r["h"]: r["count"] for r in frequency(df, "h", count_of="id").collect()}
    assert got == {1: 1, None: 2}


def test_size_chooses_the_plan_and_never_the_answer(spark, monkeypatch):
    import visitstat.operators.profile as P
    rnd = random.Random(8)
    data = [(rnd.choice("pq"), rnd.random(), rnd.randint(0, 5)) for _ in range(500)]
    data += [("n", 1.0, 1), ("n", 2.0, 1), ("n", float("nan"), 1), (None, float("nan"), None), (None, None, 2), (None, 4.0, 3)]
    df = spark.createDataFrame(data, "g string, v double, w long")

    def both():
        prof = {r["g"]: (r["median"], r["min"]) for r in group_profile(df, ["g"], "v", ["median", "min"]).collect()}
        desc = {r["column"]: tuple(r) for r in describe(df, ["v", "w"]).select(
            "column", "p25", "p50", "p75", "min", "max", "count").collect()}
        return prof, desc

    small = both()
    monkeypatch.setattr(P, "BUILTIN_MAX_VALUES", 100)
    large = both()
    assert small == large and small[0]["n"][0] == 1.5 and small[0][None][0] == 4.0
    for method in ("builtin", "distributed"):
        got = {r["g"]: r["median"] for r in group_profile(df, ["g"], "v", ["median"], median_method=method).collect()}
        assert got == {g: m for g, (m, _) in small[0].items()}


def test_counting_copies_no_rows(spark, monkeypatch):
    import visitstat.operators.profile as P
    names = []
    write = P.write_table
    monkeypatch.setattr(P, "write_table", lambda df, name="table", **kw: names.append(name) or write(df, name, **kw))
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0)], "g string, v double")
    assert group_profile(df, ["g"], "v").count() == 2
    assert names == ["groups"]


def test_describe_has_one_percentile_per_column(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0)], "a int, b double, c double")
    plan = describe(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("percentile(") == 3


def test_money_sums_do_not_overflow(spark):
    from visitstat.operators.profile import exact_sum_avg
    df = spark.createDataFrame([(5 * 10 ** 18,)] * 3, "micro bigint")
    total, mean = exact_sum_avg("micro", 1e6)
    assert tuple(df.agg(total, mean).first()) == (1.5e13, 5e12)


def test_approx_method_is_close(spark):
    rnd = random.Random(31)
    data = [(rnd.choice("xy"), rnd.gauss(100, 15)) for _ in range(4000)]
    df = spark.createDataFrame(data, "g string, v double")
    exact = {r["g"]: r["median"] for r in group_profile(df, ["g"], "v", ["median"]).collect()}
    approx = {r["g"]: r["median"] for r in group_profile(df, ["g"], "v", ["median"], median_method="approx").collect()}
    assert exact.keys() == approx.keys() and all(abs(exact[k] - approx[k]) < 1.0 for k in exact)
    d = {r["column"]: r for r in describe(df, ["v"], median_method="approx").collect()}
    assert abs(d["v"]["p50"] - np.median([v for _, v in data])) < 1.0
