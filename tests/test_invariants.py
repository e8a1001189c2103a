"""Invariants of the reports on the sf0.001 stand-in table (SURVEY §5 (c), (d))."""

from pyspark.sql import functions as F

from visitstat.operators.sessions import session_extract
from visitstat.plans import reports as R
from visitstat.sources.testdata import sessions_table

SF = "/root/testdata/sf0.001"


def test_shares_sum_to_one_before_threshold(spark):
    s = sessions_table(spark, SF)
    rows = R.segment_report(s, min_count=0).collect()
    assert abs(sum(r["count_parted_to_all"] for r in rows) - 1.0) < 1e-12
    assert sum(r["count_parted"] for r in rows) == s.count()
    revenue = [r["sum_revenue"] or 0 for r in rows]
    assert revenue == sorted(revenue, reverse=True)  # ordered by revenue, largest first


def test_histogram_counts_sum_to_values_present(spark):
    s = sessions_table(spark, SF)
    ext = session_extract(s)
    out = R.distributions(s).collect()
    for c in R.DISTRIBUTION_COLUMNS:
        present = ext.where(F.col(c).isNotNull()).count()
        positive = ext.where(F.col(c) > 0).count()
        assert sum(r["count"] for r in out if r["column"] == c and r["scale"] == "raw") == present
        assert sum(r["count"] for r in out if r["column"] == c and r["scale"] == "log10") == positive


def test_trim_is_a_subset_and_profiles_cover_it(spark):
    s = sessions_table(spark, SF)
    trimmed = R.trimmed_revenue(s)
    revenue = R.trimmed_revenue(s, k=1e9)  # nothing is far enough to be cut
    assert trimmed.join(revenue, "unique_session_id", "left_anti").count() == 0
    daily = R.daily_profile(s).collect()
    assert sum(r["count"] for r in daily) == trimmed.count()
    dates = [r["date"] for r in daily]
    assert dates == sorted(dates)
