import datetime as dt

import pytest
from pyspark.sql import functions as F

from tests.test_shards import sample_sessions
from visitstat.plans import reports as R
from visitstat.session import scratch_path
from visitstat.sources.quarantine import NO_DATE, NOT_A_DAY, OTHER_DAY, quarantine, split_counts
from visitstat.sources.shards import read_shards, write_shards

BAD = {"2017-06-02": NOT_A_DAY, "20170632": NOT_A_DAY, "2017063": NOT_A_DAY, "201706030": NOT_A_DAY, "junk": NOT_A_DAY, "": NOT_A_DAY,
       " 20170605": NOT_A_DAY, "20170229": NOT_A_DAY, "20160601": OTHER_DAY, None: NO_DATE}


def dirty(spark):
    days = [(dt.date(2017, 6, 1) + dt.timedelta(days=i)).strftime("%Y%m%d") for i in range(20)]
    root = scratch_path(spark, "shards-test")
    write_shards(sample_sessions(spark, days), root)
    spoil = F.col("date")
    for i, bad in enumerate(BAD):
        spoil = F.when(F.col("visitId") == i, F.lit(bad)).otherwise(spoil)
    return read_shards(spark, root, "20170601", "20170631").withColumn("date", spoil)


def test_every_kind_of_bad_day_is_set_aside(spark):
    split = quarantine(dirty(spark))
    assert (split.n_good, split.n_bad) == (20 - len(BAD), len(BAD))
    assert split.good.count() == split.n_good and split.good.columns == split.bad.columns[:-1]
    assert {r["date"]: r["reason"] for r in split.bad.select("date", "reason").collect()} == BAD
    counts = {r["reason"]: r["sessions"] for r in split_counts(split).collect()}
    assert counts == {"good": 10, NO_DATE: 1, NOT_A_DAY: 8, OTHER_DAY: 1}


def test_report_goes_on_over_the_good_part(spark):
    rows = dirty(spark)
    with pytest.raises(Exception, match="CANNOT_PARSE_TIMESTAMP|could not be parsed"):
        R.weekly_dynamics(rows).collect()
    good = quarantine(rows).good
    assert sum(r["revenue_sum"] for r in R.weekly_dynamics(good).collect()) == sum(range(len(BAD) + 1, 21))
    plan = good.select("totals.hits")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "20170601" in plan and "browser" not in plan     # still one pruned scan


def test_without_bad_rows_and_without_rows(spark):
    rows = sample_sessions(spark, ["20170601", "20170602"])
    for df, n in ((rows, 2), (rows.limit(0), 0)):
        split = quarantine(df)
        assert (split.n_good, split.n_bad, split.bad.count(), split.good.count()) == (n, 0, 0, n)
        assert [tuple(r) for r in split_counts(split).collect()] == [("good", n)]


def test_own_rule_own_path_and_clashing_name(spark):
    path = scratch_path(spark, "quarantine-test")
    rows = sample_sessions(spark, ["20170601", "20170602", "20170603"])
    split = quarantine(rows, path, F.when(F.col("totals.hits") == 3, "three hits"))
    assert (split.n_good, split.n_bad) == (0, 3) and spark.read.parquet(path).count() == 3
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        quarantine(rows, path)
    with pytest.raises(ValueError):
        quarantine(rows.withColumn("reason", F.lit(1)))


def test_runner_quarantines_on_request(spark):
    from visitstat.plans.run import run
    root, out, bad = (scratch_path(spark, n) for n in ("shards-test", "report-test", "bad-test"))
    rows = sample_sessions(spark, ["20170601", "20170602", "20170603"])
    write_shards(rows.withColumn("date", F.when(F.col("visitId") == 1, "junk").otherwise(F.col("date"))), root)
    got = run(spark, ["weekly_dynamics", "--source", root, "--out", out, "--quarantine", bad])
    assert [r["revenue_sum"] for r in got.collect()] == [4.0]
    assert [(r["visitId"], r["reason"]) for r in spark.read.parquet(bad).collect()] == [(1, NOT_A_DAY)]
