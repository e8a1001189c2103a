import datetime as dt

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from visitstat.session import scratch_path
from visitstat.sources.shards import SHARDED_SCHEMA, read_shards, write_shards, preview_rows


def sample_sessions(spark, days):
    rows = []
    for i, d in enumerate(days):
        rows.append((f"v{i}", i, d, "Direct", (1000000 * (i + 1), 1, 3, 2, 60, 1), ("search",),
                     ("Chrome", "Windows", "desktop"), ("United States" if i % 2 else "Canada",), d))
    return spark.createDataFrame(rows, SHARDED_SCHEMA)


def test_range_is_text_and_pruned(spark):
    days = [(dt.date(2017, 5, 28) + dt.timedelta(days=i)).strftime("%Y%m%d") for i in range(40)]
    root = scratch_path(spark, "shards-test")
    write_shards(sample_sessions(spark, days), root)
    got = read_shards(spark, root, "20170601", "20170631")  # June 31 is no day: all of June
    assert sorted(r[0] for r in got.select("table_suffix").distinct().collect()) == \
        [d for d in days if "20170601" <= d <= "20170631"]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "20170601" in plan


def test_struct_filter_and_pruning_reach_scan(spark):
    root = scratch_path(spark, "shards-test")
    write_shards(sample_sessions(spark, ["20170601", "20170602"]), root)
    df = read_shards(spark, root).where(F.col("geoNetwork.country") == "Canada").select("totals.hits")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "geoNetwork.country" in plan
    assert "ReadSchema: struct<totals:struct<hits:bigint>,geoNetwork:struct<country:string>>" in plan


def test_single_day_and_preview(spark):
    root = scratch_path(spark, "shards-test")
    days = ["20170801", "20170802"]
    write_shards(sample_sessions(spark, days), root)
    one = read_shards(spark, root, "20170801", "20170801")
    assert one.count() == 1
    prev = preview_rows(read_shards(spark, root), ["visitId"], ["visitId", "date"], start=1, n=1).collect()
    assert [tuple(r) for r in prev] == [(1, "20170802")]


def test_schema_listing_and_tables(spark):
    from visitstat.sources.shards import list_tables, schema_fields
    fields = dict((p, t) for p, t, _ in schema_fields(spark.createDataFrame([], SHARDED_SCHEMA)))
    assert fields["totals.totalTransactionRevenue"] == "bigint" and fields["geoNetwork.country"] == "string"
    spark.createDataFrame([], SHARDED_SCHEMA).createOrReplaceTempView("sessions_20170801")
    assert "sessions_20170801" in list_tables(spark)


def test_runner_writes_report(spark):
    from visitstat.plans.run import run
    from visitstat.sources.testdata import sessions_from_testdata
    root = scratch_path(spark, "shards-test")
    write_shards(sessions_from_testdata(spark, "/root/testdata/sf0.001").where(
        F.col("table_suffix").between("19970101", "19970331")), root)
    out = scratch_path(spark, "report-test")
    got = run(spark, ["weekly_dynamics", "--source", root, "--lo", "19970201", "--hi", "19970231", "--out", out])
    assert got.count() == 5  # weeks starting 1997-01-26 .. 1997-02-23
    assert {r["date"].month for r in got.collect()} <= {1, 2}


def test_digit_range_globs_are_exact():
    import fnmatch
    import random
    from visitstat.sources.shards import digit_range_globs
    universe = [f"{i:04d}" for i in range(10000)]
    rnd = random.Random(1)
    cases = [("0601", "0631"), ("0000", "9999"), ("1234", "1234"), ("0999", "1000"), ("0100", "0199")]
    cases += [tuple(sorted(rnd.sample(universe, 2))) for _ in range(60)]
    for lo, hi in cases:
        pats = digit_range_globs(lo, hi)
        got = {s for s in universe if any(fnmatch.fnmatchcase(s, p) for p in pats)}
        assert got == {s for s in universe if lo <= s <= hi}, (lo, hi, pats)


def test_glob_on_request_lists_only_the_range(spark):
    days = [(dt.date(2017, 5, 28) + dt.timedelta(days=i)).strftime("%Y%m%d") for i in range(40)]
    root = scratch_path(spark, "shards-test")
    write_shards(sample_sessions(spark, days), root)
    df = read_shards(spark, root, "20170601", "20170631", digit_glob=True)
    assert df.count() == 30
    files = df.inputFiles()
    assert files and all("table_suffix=201706" in f for f in files)
    for glob in (False, True):
        assert read_shards(spark, root, "20180101", "20180131", digit_glob=glob).count() == 0
        assert read_shards(spark, root, "20170602", "20170601", digit_glob=glob).count() == 0
    with pytest.raises(ValueError):
        read_shards(spark, root, "201706", "20170631", digit_glob=True)


def test_default_read_is_the_text_range(spark):
    root = scratch_path(spark, "shards-test")
    write_shards(sample_sessions(spark, ["20170601", "2017060A", "201706011", "20170701"]), root)
    got = sorted(r[0] for r in read_shards(spark, root, "20170601", "20170631").select("table_suffix").collect())
    assert got == ["20170601", "201706011", "2017060A"]   # text order, like BETWEEN


@pytest.mark.parametrize("bounds", [(), ("20170601", "20170631"), ("20170602", "20170601")])
@pytest.mark.parametrize("glob", [False, True])
def test_missing_root_is_an_error(spark, bounds, glob):
    if glob and not bounds:
        return
    with pytest.raises(AnalysisException):
        read_shards(spark, scratch_path(spark, "nowhere"), *bounds, digit_glob=glob).count()


def test_writing_a_day_leaves_the_others(spark):
    root = scratch_path(spark, "shards-test")
    write_shards(sample_sessions(spark, ["20170601", "20170602"]), root)
    write_shards(sample_sessions(spark, ["20170603"]), root)
    write_shards(sample_sessions(spark, ["20170602", "20170602"]), root)      # replaces that day
    counts = {r[0]: r[1] for r in read_shards(spark, root).groupBy("table_suffix").count().collect()}
    assert counts == {"20170601": 1, "20170602": 2, "20170603": 1}


def test_runner_errors_leave_the_output_untouched(spark):
    from visitstat.plans.run import run
    out = scratch_path(spark, "report-test")
    spark.range(5).write.parquet(out)
    missing = scratch_path(spark, "nowhere")
    for lo in ([], ["--lo", "20170601", "--hi", "20170631"]):
        with pytest.raises(AnalysisException):
            run(spark, ["weekly_dynamics", "--source", missing, "--out", out, *lo])
    for source, target in ((out, out), (out, f"{out}/sub"), (f"{out}/sub", out)):
        with pytest.raises(SystemExit):
            run(spark, ["weekly_dynamics", "--source", source, "--out", target])
    assert spark.read.parquet(out).count() == 5


def test_stand_in_follows_its_input(spark, tmp_path):
    from visitstat.sources.testdata import sessions_table
    for t in ("orders", "lineitem", "customer", "nation", "region"):
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    first = sessions_table(spark, str(tmp_path))
    assert sessions_table(spark, str(tmp_path)) is first
    few = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").limit(7).toPandas()
    spark.createDataFrame(few).write.mode("overwrite").parquet(f"{tmp_path}/orders.parquet")
    assert sessions_table(spark, str(tmp_path)).count() == 7


def test_mixed_shards_hold_all_days_and_the_range_selects(spark):
    from visitstat.plans.catalog import MIXED_HI, MIXED_LO, query
    from visitstat.sources.testdata import mixed_sharded_sessions, sessions_table
    sf_dir = "/root/testdata/sf0.001"
    every = read_shards(spark, mixed_sharded_sessions(spark, sf_dir))
    assert every.count() == sessions_table(spark, sf_dir).count()
    assert every.where(~F.col("table_suffix").between(MIXED_LO, MIXED_HI)).count() > 0
    got = sorted(r.table_suffix for r in query("shard_range_mixed")(spark, sf_dir).collect())
    assert got == sorted(r[0] for r in every.select("table_suffix").collect() if MIXED_LO <= r[0] <= MIXED_HI)
    assert any(x.endswith("A") for x in got) and any(x.isdigit() for x in got)
