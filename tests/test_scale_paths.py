"""The large-input paths give the same results as the small-input ones.

At test scale ``median_method='auto'`` picks Spark's percentile and the
per-group tables are broadcast; these tests force the distributed quantile
operator and the shuffle-join fallback and compare.
"""

from pyspark.sql import functions as F

from visitstat.operators.attach import attach
from visitstat.operators.trim import log_trim
from visitstat.plans import reports as R
from visitstat.sources.testdata import sessions_table

SF = "/root/testdata/sf0.001"


def _rows(df, key):
    return {r[key]: r for r in df.collect()}


def test_daily_profile_distributed_equals_auto(spark):
    s = sessions_table(spark, SF)
    a = _rows(R.daily_profile(s), "date")
    b = _rows(R.daily_profile(s, median_method="distributed"), "date")
    assert a.keys() == b.keys() and len(a) > 100
    for d in a:
        assert a[d]["median"] == b[d]["median"] and a[d]["count"] == b[d]["count"]
        assert a[d]["min"] == b[d]["min"] and a[d]["max"] == b[d]["max"]


def test_segment_report_distributed_equals_auto(spark):
    s = sessions_table(spark, SF)
    a = _rows(R.segment_report(s, min_count=0).select("channelGrouping", "operatingSystem", "median_revenue",
              "median_hits", "median_pageviews", "median_timeonsite", "median_visits",
              F.concat_ws("|", "channelGrouping", "operatingSystem").alias("k")), "k")
    b = _rows(R.segment_report(s, min_count=0, median_method="distributed").select(
              "median_revenue", "median_hits", "median_pageviews", "median_timeonsite", "median_visits",
              F.concat_ws("|", "channelGrouping", "operatingSystem").alias("k")), "k")
    assert a.keys() == b.keys() and len(a) == 25
    for k in a:
        for c in ("median_revenue", "median_hits", "median_pageviews", "median_timeonsite", "median_visits"):
            assert a[k][c] == b[k][c], (k, c)


def test_attach_shuffle_fallback_equals_broadcast(spark):
    rows = spark.createDataFrame([(k, float(i)) for i, k in enumerate(["a", "b", None] * 50)], "k string, v double")
    small = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "k string, w int")
    def key(r):
        return tuple("" if v is None else str(v) for v in r)
    b = sorted((tuple(r) for r in attach(rows, small, ["k"]).collect()), key=key)
    s_df = attach(rows, small, ["k"], max_rows=0)  # over the bound: no broadcast hint
    s = sorted((tuple(r) for r in s_df.collect()), key=key)
    assert b == s and len(b) == 150  # the null key matched too


def test_log_trim_fallback_on_hot_key(spark):
    import math
    import random
    rnd = random.Random(4)
    data = [("hot", math.exp(rnd.gauss(0, 1))) for _ in range(3000)] + \
        [(f"k{i % 50}", math.exp(rnd.gauss(2, 0.5))) for i in range(1500)]
    df = spark.createDataFrame(data, "g string, v double")
    a = sorted(tuple(r) for r in log_trim(df, "v", ["g"]).select("g", "v").collect())
    b = sorted(tuple(r) for r in log_trim(df, "v", ["g"], max_rows=0).select("g", "v").collect())
    assert a == b and len(a) > 4000


def test_broadcast_check_counts_bytes(spark):
    from visitstat.operators.attach import fits_broadcast, row_bytes, sized
    df = spark.createDataFrame([("x" * 100, 1), (None, 2)], "k string, v long")
    assert df.agg(F.sum(row_bytes(df))).first()[0] == (100 + 8 + 8) + (0 + 8 + 8)
    _, ok, seen = sized(df)
    assert seen["rows"] == 2 and seen["bytes"] == 132
    assert ok and fits_broadcast(10, 10) and not fits_broadcast(10, 10 ** 12) and not fits_broadcast(10 ** 9, 1)
