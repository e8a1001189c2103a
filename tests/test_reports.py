import datetime as dt


from visitstat.plans import reports as R
from visitstat.sources.shards import SHARDED_SCHEMA


def sessions(spark, rows):
    """rows: (channel, os, revenue_micro or None, new 1/None, day)"""
    data = []
    for i, (ch, os_, rev, new, day) in enumerate(rows):
        data.append((f"v{i}", i, day, ch, (rev, 1, 2 + i % 3, 5, 100 + i, new), ("s",), ("b", os_, "d"),
                     ("US",), day))
    return spark.createDataFrame(data, SHARDED_SCHEMA)


def test_share_is_taken_before_threshold(spark):
    df = sessions(spark, [("a", "x", None, 1, "20170601"), ("a", "x", 2_000_000, None, "20170601"),
                          ("b", "x", None, None, "20170601")])
    out = R.segment_report(df, min_count=2).collect()
    assert len(out) == 1 and out[0]["channelGrouping"] == "a"
    assert abs(out[0]["count_parted_to_all"] - 2 / 3) < 1e-15
    assert out[0]["sum_revenue"] == 2.0 and out[0]["revenue_to_parted_all"] == 0.5
    # no revenue from a new visitor: sum over nulls is null, so the share is null (as in SQL)
    assert out[0]["percent_revenue_from_new"] is None and out[0]["sum_new_visits"] == 1


def test_new_visitor_share_null_without_revenue(spark):
    df = sessions(spark, [("a", "x", None, 1, "20170601"), ("a", "x", None, None, "20170602")])
    r = R.segment_report(df, min_count=1).first()
    assert r["percent_revenue_from_new"] is None and r["sum_revenue"] is None and r["median_revenue"] is None


def test_segment_order_is_by_revenue_desc(spark):
    rows = [("a", "x", 1_000_000, None, "20170601")] * 2 + [("b", "y", 5_000_000, None, "20170601")] * 2 + \
        [("c", "z", None, None, "20170601")] * 2
    out = [r["channelGrouping"] for r in R.segment_report(sessions(spark, rows), min_count=1).collect()]
    assert out == ["b", "a", "c"]


def test_weekly_uses_sunday_weeks(spark):
    df = sessions(spark, [("a", "x", 1_000_000, None, "20081225"), ("a", "x", 3_000_000, None, "20081221"),
                          ("a", "x", 2_000_000, None, "20081220")])
    got = [(r["date"], r["revenue_sum"]) for r in R.weekly_dynamics(df).collect()]
    assert got == [(dt.date(2008, 12, 14), 2.0), (dt.date(2008, 12, 21), 4.0)]


def test_daily_profile_order_and_trim(spark):
    # 3.09 sigma can only reject a point when n >= 12 ((n-1)/sqrt(n) > 3.09): use 26 ordinary rows
    rows = [("a", "x", m, None, d) for d, ms in (("20170602", [10, 11, 12, 13] * 6), ("20170601", [10, 12]))
            for m in ms] + [("a", "x", 10 ** 15, None, "20170603")] + [("a", "x", None, None, "20170601")]
    rows = [(c, o, (m * 1_000_000 if m < 10 ** 9 else m) if m else None, n, d) for c, o, m, n, d in rows]
    prof = R.daily_profile(sessions(spark, rows), trim_by=()).collect()
    assert [r["date"] for r in prof] == ["20170601", "20170602"]  # the far outlier day is trimmed away
    assert prof[1]["median"] == 11.5 and prof[1]["count"] == 24 and prof[0]["count"] == 2


def test_session_key_collisions_are_counted_twice(spark):
    # visitor "1" visit 23 and visitor "12" visit 3 share the key "123": count is a row count
    data = [("1", 23, "20170601", "a", (None, 1, 1, 1, 1, None), ("s",), ("b", "x", "d"), ("US",), "20170601"),
            ("12", 3, "20170601", "a", (None, 1, 1, 1, 1, None), ("s",), ("b", "x", "d"), ("US",), "20170601")]
    df = spark.createDataFrame(data, SHARDED_SCHEMA)
    r = R.segment_report(df, min_count=1).first()
    assert r["count_parted"] == 2 and r["count_parted_to_all"] == 1.0
