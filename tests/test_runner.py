"""Every report of the command-line runner runs over a day-sharded table and is written."""

import pytest
from pyspark.sql import functions as F

from visitstat.plans.run import _reports, parser, run
from visitstat.session import scratch_path
from visitstat.sources.shards import write_shards
from visitstat.sources.testdata import sessions_from_testdata

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def shards(spark):
    root = scratch_path(spark, "runner-shards")
    write_shards(sessions_from_testdata(spark, SF).where(F.col("table_suffix").between("19960101", "19981231")), root)
    return root


@pytest.mark.parametrize("report", sorted(_reports(parser().parse_args(["x", "--source", "s", "--out", "o"]))))
def test_report_runs(spark, shards, report):
    out = scratch_path(spark, "runner-out")
    df = run(spark, [report, "--source", shards, "--lo", "19970101", "--hi", "19971231", "--out", out,
                     "--min-count", "1", "--country-min-count", "1"])
    assert df.count() > 0


def test_what_was_built_outlives_dropped_tables(spark):
    """Dropping the intermediate tables makes the stand-in anew instead of giving out dead tables."""
    from visitstat.session import drop_scratch, scratch_count
    from visitstat.sources.testdata import sessions_table
    sf = "/root/testdata/sf0.001"
    n = sessions_table(spark, sf).count()
    before = scratch_count()
    assert sessions_table(spark, sf).count() == n and scratch_count() == before      # kept
    drop_scratch(spark)
    assert sessions_table(spark, sf).count() == n and scratch_count() > 0
