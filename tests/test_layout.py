"""Data skipping inside the day shards: rows that scans read, from Spark's own metrics."""

import random

from pyspark.sql import functions as F

from tests.test_numbering import metric
from visitstat.plans import reports as R
from visitstat.session import scratch_path
from visitstat.sources.shards import SHARDED_SCHEMA, read_shards, write_shards

COUNTRIES = [f"country {i:02d}" for i in range(0, 40, 2)]


def written(spark, sort_by, partitions=1, options=None):
    rng = random.Random(6)
    rows = [(str(i), i, "20170601", "Direct", (i, 1, 2, 3, 4, None), ("s",), ("b", "o", "d"), (rng.choice(COUNTRIES),), "20170601")
            for i in range(20_000)]
    root = scratch_path(spark, "layout-test")
    write_shards(spark.createDataFrame(rows, SHARDED_SCHEMA), root, partitions=partitions, sort_by=sort_by,
                 options={"parquet.page.row.count.limit": "500", **(options or {})})
    return rows, root


def scanned(df):
    df.collect()
    return sum(metric(df._jdf.queryExecution().executedPlan(), "numOutputRows"))


def of(spark, root, country):
    return read_shards(spark, root).where(F.col("geoNetwork.country") == country).select("visitId", "geoNetwork.country")


def test_pages_of_other_countries_are_not_read(spark):
    rows, plain = written(spark, ())
    _, sorted_ = written(spark, ("geoNetwork.country",))
    want = sorted(r[1] for r in rows if r[7] == (COUNTRIES[3],))
    for root in (plain, sorted_):
        assert sorted(r["visitId"] for r in of(spark, root, COUNTRIES[3]).collect()) == want
    assert scanned(of(spark, plain, COUNTRIES[3])) == len(rows)
    assert scanned(of(spark, sorted_, COUNTRIES[3])) < len(want) + 1100         # at most a page more at both ends


def test_a_crowded_day_is_split_by_country(spark):
    rows, root = written(spark, ("geoNetwork.country",), partitions=8)
    files = read_shards(spark, root).groupBy(F.input_file_name().alias("f")).agg(F.countDistinct("geoNetwork.country").alias("n")).collect()
    assert len(files) >= 6 and max(r["n"] for r in files) < len(COUNTRIES) / 2


def test_a_country_between_others_is_ruled_out_by_the_bloom_filter(spark):
    _, root = written(spark, ("geoNetwork.country",), options={"parquet.page.row.count.limit": "20000"})
    assert scanned(of(spark, root, "country 07")) == 0        # inside the range of the statistics, in no row


def test_report_over_one_country_is_the_same(spark):
    _, plain = written(spark, ())
    _, sorted_ = written(spark, ("geoNetwork.country",), partitions=4)
    a, b = (R.weekly_dynamics(read_shards(spark, r), country=COUNTRIES[5]).collect() for r in (plain, sorted_))
    assert a == b and len(a) == 1
