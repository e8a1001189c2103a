import datetime as dt

from pyspark.sql import functions as F

from visitstat.functions import parse_day, round_half_up, session_key, week_of_year_sunday, week_start_sunday


def test_week_start_is_sunday(spark):
    df = spark.createDataFrame([(dt.datetime(2008, 12, 25, 15, 30),)], "ts timestamp_ntz")
    got = df.select(week_start_sunday(F.to_date("ts")).alias("w")).first()["w"]
    assert got == dt.date(2008, 12, 21)


def test_week_number_matches_strftime_U(spark):
    days = [dt.date(1995, 1, 1) + dt.timedelta(days=i) for i in range(0, 11323, 3)]
    df = spark.createDataFrame([(d.strftime("%Y%m%d"),) for d in days], "s string")
    got = [r["w"] for r in df.select(week_of_year_sunday(parse_day("s")).alias("w")).collect()]
    assert got == [int(d.strftime("%U")) for d in days]
    first = spark.createDataFrame([("20170101",)], "s string").select(week_of_year_sunday(parse_day("s"))).first()[0]
    assert first == 1  # 2017-01-01 is a Sunday: week 1 (ISO would say 52)


def test_session_key_has_no_delimiter_and_nulls_propagate(spark):
    df = spark.createDataFrame([("12", 3), (None, 4)], "v string, i long")
    assert [r[0] for r in df.select(session_key("v", "i")).collect()] == ["123", None]


def test_round_half_up(spark):
    df = spark.createDataFrame([(2.5,), (-2.5,), (1.234567,), (None,)], "x double")
    got = [r[0] for r in df.select(round_half_up("x", 0)).collect()]
    assert got == [3.0, -3.0, 1.0, None]
    assert df.select(round_half_up("x", 3)).collect()[2][0] == 1.235
