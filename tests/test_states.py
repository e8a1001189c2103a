import random

import pytest

from tests.test_shards import sample_sessions
from visitstat.operators import states as S
from visitstat.plans import reports as R
from visitstat.session import scratch_path
from visitstat.sources.shards import SHARDED_SCHEMA, add_days, read_shards, read_table, register_shards, write_shards

DAYS = [f"2017{m:02d}{d:02d}" for m in (5, 6, 7) for d in (1, 2, 15, 28)]


def sessions(spark, days=DAYS, n=600, seed=1):
    rng = random.Random(seed)

    def some(x):
        return None if rng.random() < 0.2 else x
    rows = [(str(rng.randint(0, 50)), i, d, rng.choice(["Direct", "Search"]),
             (some(rng.randint(1, 10**12)), 1, some(rng.randint(0, 40)), some(rng.randint(0, 9)), some(rng.randint(0, 4000)), some(1)),
             ("s",), ("b", rng.choice(["Linux", "Windows", None]), "d"), (rng.choice(["A", "B", None]),), d)
            for i in range(n) for d in [rng.choice(days)]]
    return spark.createDataFrame(rows, SHARDED_SCHEMA)


def stored(spark, df, k=None):
    path = scratch_path(spark, "states-test")
    S.write_states(df, path, k)
    return path


def exact_segments(df, **kw):
    rows = R.segment_report(df, min_count=1, **kw).collect()
    return {(r["channelGrouping"], r["operatingSystem"]): r.asDict() for r in rows}


@pytest.mark.parametrize("lo,hi,country", [(None, None, None), ("20170601", "20170631", None), ("20170515", "20170701", "A"),
                                           ("20170602", "20170601", None), ("2017", "201706", "B")])
def test_range_reports_equal_those_over_sessions(spark, lo, hi, country):
    """Sums, averages and deviations to the last bit."""
    df = sessions(spark)
    st = S.read_states(spark, stored(spark, df), lo, hi, country)
    want = exact_segments(df, lo=lo, hi=hi, country=country)
    got = S.segment_report_of_states(st, min_count=1).collect()
    assert {(r["channelGrouping"], r["operatingSystem"]) for r in got} == set(want) and len(got) == len(want)
    for r in got:
        full = want[r["channelGrouping"], r["operatingSystem"]]
        assert {c: r[c] for c in full if c in r.asDict()} == {c: v for c, v in full.items() if not c.startswith("median_")}
    weekly = [tuple(r) for r in S.weekly_dynamics_of_states(st).collect()]
    assert weekly == [tuple(r) for r in R.weekly_dynamics(df, lo, hi, country).collect()]
    flat = R._flat(df, lo, hi, country, revenue_only=True)
    daily = R.group_profile(flat, ["date"], "total_revenue", ("count", "avg", "min", "max", "sko", "koef_var"),
                            exact=("revenue_micro", R.MICRO)).orderBy("date").collect()
    assert S.daily_profile_of_states(st).collect() == daily
    assert S.sessions_in(st) == R._flat(df, lo, hi, country).count()


def test_no_session_is_read_and_only_periods_of_the_range(spark):
    path = stored(spark, sessions(spark))
    st = S.read_states(spark, path, "20170601", "20170631")
    assert {f.split("period=")[1][:6] for f in st.inputFiles() if "period=" in f} >= {"201706"}
    plan = S.weekly_dynamics_of_states(st)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(period" in plan and plan.count("FileScan") == 1 and "totals" not in plan


@pytest.mark.parametrize("k", [None, 200])
def test_refresh_recomputes_only_its_days(spark, k):
    root = scratch_path(spark, "shards-test")
    write_shards(sessions(spark), root)
    path = stored(spark, read_shards(spark, root), k)
    before = {f: 0 for f in spark.read.parquet(path).inputFiles()}
    more = sessions(spark, ["20170602", "20170628", "20170809"], 50, seed=9)
    days = write_shards(more, root, states=path)
    assert days == ["20170602", "20170628", "20170809"]
    fresh = stored(spark, read_shards(spark, root))
    columns = [c for c in spark.read.parquet(fresh).columns if c != "period"]
    def rows(p): return sorted(map(str, S.read_states(spark, p).select(columns).collect()))
    assert rows(path) == rows(fresh)
    after = set(spark.read.parquet(path).inputFiles())
    assert {f for f in before if "period=201706" not in f} <= after            # other months' files are untouched
    assert not {f for f in before if "period=201706" in f} & after
    # a day that is gone loses its states
    spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(
        spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/table_suffix=20170809"), True)
    S.refresh_states(spark, root, path, ["20170809"])
    assert rows(path) == [r for r in rows(fresh) if "20170809" not in r]


def test_no_sessions_and_an_existing_folder(spark):
    path = stored(spark, sessions(spark).limit(0))
    st = S.read_states(spark, path, "20170601", "20170631")
    assert S.weekly_dynamics_of_states(st).collect() == [] and S.segment_report_of_states(st).collect() == []
    assert S.sessions_in(st) == 0
    with pytest.raises(Exception, match="ALREADY_EXISTS|already exists"):
        S.write_states(sessions(spark), path)
    with pytest.raises(ValueError):
        S.segment_report_of_states(st, median_method="exact")
    with pytest.raises(ValueError):
        S.session_states(sessions(spark), 7)


def test_sketched_medians_keep_their_rank_error(spark):
    """Against the exact values: the rank of a merged quantile lies within the stated error of the wanted one."""
    rng = random.Random(4)
    days = [f"201706{d:02d}" for d in range(1, 29)]
    rows = [(str(i), i, d, "Direct", (int(rng.lognormvariate(18, 1.5)), 1, rng.randint(0, 5), None, int(rng.expovariate(1 / 300)), None), ("s",),
             ("b", "Linux", "d"), ("A",), d) for i in range(40_000) for d in [rng.choice(days)]]
    df = spark.createDataFrame(rows, SHARDED_SCHEMA)
    for k, error in ((200, S.SKETCH_ERROR[200]), (800, S.SKETCH_ERROR[800])):
        st = S.read_states(spark, stored(spark, df, k), "20170603", "20170625")
        assert S.sketch_size(st) == k
        chosen = [r for r in rows if "20170603" <= r[2] <= "20170625"]
        for m, i, scale in (("revenue", 0, 1e6), ("timeOnSite", 4, 1), ("hits", 2, 1)):
            xs = sorted(r[4][i] for r in chosen)
            for q in (0.1, 0.5, 0.9):
                got = round(st.agg(S.merged_quantile(m, q).alias("x")).first()["x"] * scale)
                low, high = sum(x < got for x in xs) / len(xs), sum(x <= got for x in xs) / len(xs)
                assert low - error <= q <= high + error
    report = S.segment_report_of_states(st, min_count=1, median_method="sketch").first()
    exact = R.segment_report(df, "20170603", "20170625", min_count=1).first()
    assert report["median_pageviews"] is None and report["median_hits"] == exact["median_hits"]
    assert abs(report["median_revenue"] / exact["median_revenue"] - 1) < 0.05


def test_catalog_table_lists_only_the_range(spark):
    root, table = scratch_path(spark, "shards-test"), "days_test"
    write_shards(sample_sessions(spark, DAYS), root)
    register_shards(spark, root, table)
    try:
        days = read_table(spark, table, "20170601", "20170631")
        assert sorted(r[0] for r in days.select("table_suffix").collect()) == [d for d in DAYS if d[:6] == "201706"]
        assert days.schema == read_shards(spark, root).schema or [f.name for f in days.schema] == [f.name for f in SHARDED_SCHEMA]
        plan = days._jdf.queryExecution().executedPlan().toString()
        assert "CatalogFileIndex" in plan or "Location: InMemoryFileIndex(4 paths)" in plan
        assert read_table(spark, table).count() == len(DAYS)
        # a new day, and a day whose folder was never told to the catalog
        assert write_shards(sample_sessions(spark, ["20170630", "2017063A"]), root, table=table) == ["20170630", "2017063A"]
        assert read_table(spark, table, "20170629", "20170631").count() == 1
        assert read_table(spark, table, "20170629", "2017063Z").count() == 2
        write_shards(sample_sessions(spark, ["20170801"]), root)
        assert read_table(spark, table, "20170801", "20170801").count() == 0
        add_days(spark, table, root, ["20170801"])
        assert read_table(spark, table, "20170801", "20170801").count() == 1
        write_shards(sample_sessions(spark, ["20170801"] * 3), root, table=table)      # a known day, replaced
        assert read_table(spark, table, "20170801", "20170801").count() == 3
    finally:
        spark.sql(f"DROP TABLE {table}")
    assert read_shards(spark, root).count() > 0                   # dropping the table leaves the shards


@pytest.mark.parametrize("k", [None, 200])
def test_states_are_made_once_by_several_tasks(spark, k):
    """The sessions are partitioned by the keys, so no partial state is sent and no second partitioning
    makes the states again; a month's states do not end in one task."""
    df = sessions(spark, [f"201706{d:02d}" for d in range(1, 31)])
    plan = S.session_states(df, k, 4)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "rangepartitioning" in plan and "hashpartitioning" not in plan
    path = stored(spark, df, k)
    stored_rows, plain = S.read_states(spark, path), S.session_states(df)
    assert len({f for f in stored_rows.inputFiles() if "period=201706" in f}) > 1
    assert sorted(map(str, stored_rows.select(plain.columns).collect())) == sorted(map(str, plain.collect()))
