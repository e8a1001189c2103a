import math

from visitstat.operators.trim import log_trim


def rows(spark, data):
    return spark.createDataFrame(data, "g string, v double")


def test_single_row_group_keeps_nothing(spark):
    assert log_trim(rows(spark, [("a", 5.0)]), "v", ["g"]).count() == 0


def test_equal_values_keep_nothing(spark):
    assert log_trim(rows(spark, [("a", 1.0)] * 3), "v", ["g"]).count() == 0


def test_non_positive_left_out_before_log(spark):
    df = rows(spark, [("a", 0.0), ("a", -1.0), ("a", 1.0), ("a", 2.0), ("a", 3.0), (None, 1.0)])
    out = log_trim(df, "v", ["g"]).collect()
    assert sorted(r["v"] for r in out) == [1.0, 2.0, 3.0]


def test_matches_brute_force_and_is_subset(spark):
    import random
    random.seed(7)
    data = [(random.choice("abc"), math.exp(random.gauss(3, 1))) for _ in range(600)]
    data += [("a", 1e9), ("b", 1e-6)]  # far outliers
    data += [(None, 5.0), (None, 6.0)]  # null key is one group
    out = log_trim(rows(spark, data), "v", ["g"], k=3.09)
    got = sorted((r["g"] or "", r["v"]) for r in out.collect())
    want = []
    for g in {d[0] for d in data}:
        xs = [math.log(v) for gg, v in data if gg == g and v > 0]
        m = sum(xs) / len(xs)
        sd = math.sqrt(sum((x - m) ** 2 for x in xs) / (len(xs) - 1))
        want += [(g or "", v) for gg, v in data if gg == g and abs(math.log(v) - m) < 3.09 * sd]
    assert got == sorted(want)
    assert ("a", 1e9) not in got and ("b", 1e-6) not in got


def test_without_keys(spark):
    df = rows(spark, [("a", float(v)) for v in (1, 2, 3, 4, 1e12)])
    assert log_trim(df, "v", [], k=1.0).count() < 5


def test_bound_covers_kept_rows(spark):
    import random
    from visitstat.operators.trim import log_trim_bounded
    rnd = random.Random(3)
    data = [(rnd.choice("abc"), math.exp(rnd.gauss(2, 1))) for _ in range(500)] + [("d", 1.0), ("e", -2.0)]
    df = rows(spark, data)
    kept, bound = log_trim_bounded(df, "v", ["g"])
    n = kept.count()
    assert n <= bound == 500  # groups d (one row, null stddev) and e (no positive value) keep nothing
    kept0, bound0 = log_trim_bounded(df, "v", [])
    assert kept0.count() <= bound0 == 501


def test_nan_is_a_missing_value(spark):
    data = [("a", float(v)) for v in range(1, 51)]
    clean = sorted(r["v"] for r in log_trim(rows(spark, data), "v", ["g"]).collect())
    assert sorted(r["v"] for r in log_trim(rows(spark, data + [("a", float("nan"))]), "v", ["g"]).collect()) == clean
