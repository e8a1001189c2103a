"""The registered queries: each reads the test tables of one scale directory,
builds the session rows from them and runs one report over the whole table.

``OUTPUT`` gives, per query, the output columns in order and the decimals
each double column is rounded to (``None`` = returned as computed). The same
spec drives the SQL oracles, so both sides round identically; the library
functions themselves return full precision.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visitstat.functions import round_half_up, session_key
from visitstat.operators.bins import histogram
from visitstat.operators.sessions import flatten_sessions, revenue_sessions, session_extract
from visitstat.operators.numbering import rows_by_rank, with_numbers
from visitstat.operators import states as S
from visitstat.plans import reports as R
from visitstat.sources.quarantine import quarantine, split_counts
from visitstat.sources.shards import read_shards, read_table, preview_rows
from visitstat.sources.testdata import mixed_sharded_sessions, sessions_table, sessions_table_sized, sharded_sessions, \
    sharded_table, stored_states, with_dirty_days

# Fixed parameters of the registered queries.
SHARD_LO, SHARD_HI = "19970601", "19970631"   # a one-month suffix range (June 31 is no day)
COUNTRY = "NATION_1"                           # the single-country form of the weekly report
SEGMENT_MIN_COUNT_STRICT = 600                 # a threshold that removes some segments at sf0.01
PREVIEW_START, PREVIEW_ROWS = 1, 10
YEAR_LO, YEAR_HI = "19970101", "19971231"      # the range of the reports over day shards (with COUNTRY)
RANGE_MIN_COUNT = 2                            # threshold of the segment report over that range
COUNTRY_MIN_COUNT_STRICT = 190                 # a threshold that removes some countries at sf0.01
MIXED_LO, MIXED_HI = "19970601", "19970631"    # a text range in which some suffixes are not digits
DEEP_START = 0.9                               # a preview that starts at this share of the table
DAY = "19970615"                               # a single-day scan

D6, D12 = 6, 12
OUTPUT: dict[str, list[tuple[str, int | None]]] = {
    "daily_profile_trimmed": [("date", None), ("count", None), ("avg", D6), ("median", D6), ("min", None),
                              ("max", None), ("sko", D6), ("koef_var", D6)],
    "log_trim_rows": [("unique_session_id", None), ("total_revenue", None), ("logtar", D6), ("date", None),
                      ("country", None), ("log_avg", D6), ("log_sko", D6)],
    "daily_dynamics": [("date", None), ("median", None), ("koef_var", None), ("count", None)],
    "segment_report": [("channelGrouping", None), ("operatingSystem", None), ("count_parted", None),
                       ("sum_new_visits", None), ("count_parted_to_all", D6), ("median_revenue", D6),
                       ("sum_revenue", None), ("percent_revenue_from_new", D6),
                       ("revenue_to_parted_all", D6), ("median_visits", D6), ("median_hits", D6),
                       ("median_pageviews", D6), ("sum_pageviews", None), ("median_timeonsite", D6),
                       ("koef_var_revenue", D6), ("koef_var_visits", D6), ("koef_var_hits", D6),
                       ("koef_var_pageviews", D6), ("koef_var_timeOnSite", D6)],
    "weekly_dynamics": [("date", None), ("revenue_sum", None), ("revenue_avg", D6), ("sum_timeOnSite", None)],
    "weekly_revenue": [("date", None), ("sum", None)],
    "weekly_dynamics_country": [("date", None), ("revenue_sum", None), ("revenue_avg", D6),
                                ("sum_timeOnSite", None)],
    "session_extract": [(c, None) for c in (
        "unique_session_id", "total_revenue", "visits", "hits", "pageviews", "timeOnSite", "newvisits",
        "source", "browser", "operatingSystem", "deviceCategory", "channelGrouping", "date",
        "revenue_true", "revenue_false")],
    "revenue_sessions": [("unique_session_id", None), ("total_revenue", None)],
    "week_of_year_counts": [("date", None), ("sessions", None)],
    "shard_range": [("unique_session_id", None), ("total_revenue", None), ("date", None),
                    ("table_suffix", None)],
    "country_profile_trimmed": [("country", None), ("count", None), ("avg", D6), ("median", D6), ("sko", D6)],
    "bin_plan": [("country", None), ("count", None), ("avg", D6), ("median", D6), ("sko", D6),
                 ("over_test_min", None), ("over_test_max", None), ("over_test", None), ("step", D6),
                 ("ceil", None), ("sum_another_teor", None)],
    "expand_bins": [("unique_session_id", None), ("country", None), ("total_revenue", None),
                    ("another_unnest", None)],
    "bin_index_series": [("country", None), ("num", None)],
    "hits_frequency": [("hits", None), ("count", None)],
    "country_frequency": [("country", None), ("count", None)],
    "revenue_frequency": [("total_revenue", None), ("count", None)],
    "describe_numeric": [("column", None), ("count", None), ("mean", D6), ("std", D6), ("min", None),
                         ("p25", D6), ("p50", D6), ("p75", D6), ("max", None)],
    "preview_rows": [("unique_session_id", None), ("visitId", None), ("date", None), ("total_revenue", None)],
}
for _n, _like in (("daily_profile_distributed", "daily_profile_trimmed"), ("daily_profile_range", "daily_profile_trimmed"),
                  ("segment_report_distributed", "segment_report"), ("segment_report_range", "segment_report"),
                  ("weekly_dynamics_range", "weekly_dynamics"), ("weekly_dynamics_timestamp", "weekly_dynamics"),
                  ("describe_distributed", "describe_numeric"), ("country_profile_strict", "country_profile_trimmed")):
    OUTPUT[_n] = list(OUTPUT[_like])
OUTPUT["binned_revenue"] = [("unique_session_id", None), ("country", None), ("total_revenue", None), ("bin", None)]
OUTPUT["revenue_bins"] = [("country", None), ("bin", None), ("count", None)]
OUTPUT["daily_states_range"] = [x for x in OUTPUT["daily_profile_trimmed"] if x[0] != "median"]
OUTPUT["weekly_states_range"] = list(OUTPUT["weekly_dynamics"])
OUTPUT["segment_states_range"] = [x for x in OUTPUT["segment_report"] if not x[0].startswith("median_")]
OUTPUT["shard_range_catalog"] = list(OUTPUT["shard_range"])
OUTPUT["shard_day"] = list(OUTPUT["shard_range"])
OUTPUT["preview_deep"] = list(OUTPUT["preview_rows"])
OUTPUT["session_numbers"] = [("unique_session_id", None), ("date", None), ("visitId", None), ("row_number", None)]
OUTPUT["quarantine_counts"] = [("reason", None), ("sessions", None)]
OUTPUT["quarantined_sessions"] = [("unique_session_id", None), ("date", None), ("table_suffix", None), ("reason", None)]
OUTPUT["weekly_dynamics_quarantine"] = list(OUTPUT["weekly_dynamics"])
OUTPUT["shard_range_mixed"] = list(OUTPUT["shard_range"])
OUTPUT["segment_report_base"] = [OUTPUT["segment_report"][0], OUTPUT["segment_report"][1]] + [
    next(x for x in OUTPUT["segment_report"] if x[0] == c) for c in R.SEGMENT_BASE_COLUMNS]
OUTPUT["segment_report_min600"] = list(OUTPUT["segment_report"])
HIST_SPEC = [("bin", None), ("bin_lo", D6), ("bin_hi", D6), ("count", None), ("density", D12)]
OUTPUT["distributions"] = [("column", None), ("scale", None)] + HIST_SPEC
OUTPUT["histogram_log10_pages_over"] = HIST_SPEC
for _c in R.DISTRIBUTION_COLUMNS:
    OUTPUT[f"histogram_{_c}"] = HIST_SPEC
    OUTPUT[f"histogram_log10_{_c}"] = HIST_SPEC


def shaped(df: DataFrame, spec: list[tuple[str, int | None]]) -> DataFrame:
    """Select the spec's columns in order, rounding the ones with a digit count."""
    return df.select(*[(round_half_up(c, d) if d is not None else F.col(c)).alias(c) for c, d in spec])


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions_table(spark, sf_dir)


def _segments(spark: SparkSession, sf_dir: str, **kw) -> DataFrame:
    """Segment report over the stored session table; its row count (observed
    when it was written) is a proven bound on the report's input."""
    table, rows = sessions_table_sized(spark, sf_dir)
    return R.segment_report(table, rows_bound=rows, **kw)


def _in_range(spark: SparkSession, sf_dir: str, lo: str, hi: str) -> DataFrame:
    """Days of the sharded stand-in; its folders are all named by days, so one glob may list them."""
    return read_shards(spark, sharded_sessions(spark, sf_dir), lo, hi, digit_glob=True)


def _days_of_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The year's days by way of the catalog: only their folders are listed."""
    return read_table(spark, sharded_table(spark, sf_dir), YEAR_LO, YEAR_HI)


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.read_states(spark, stored_states(spark, sf_dir), YEAR_LO, YEAR_HI, COUNTRY)


def _segments_in_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The states say how many sessions the range has, so one aggregate can do."""
    return R.segment_report(_days_of_table(spark, sf_dir), country=COUNTRY, min_count=RANGE_MIN_COUNT,
                            rows_bound=S.sessions_in(_states(spark, sf_dir)))


def _range_rows(days: DataFrame) -> DataFrame:
    return flatten_sessions(days).select("unique_session_id", "total_revenue", "date", "table_suffix")


def _mixed_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text range over shards of which some folders are not named by digits: it takes them alike."""
    return read_shards(spark, mixed_sharded_sessions(spark, sf_dir), MIXED_LO, MIXED_HI)


def _pages_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log10 histogram of a column with zeros: hundreds of pages per session."""
    ext = session_extract(_sessions(spark, sf_dir))
    return histogram(ext.select(F.floor(F.col("pageviews") / F.lit(100)).alias("pages_over")), "pages_over", log10=True)


def _preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = flatten_sessions(_sessions(spark, sf_dir))
    return preview_rows(flat, ["visitId"], ["unique_session_id", "visitId", "date", "total_revenue"],
                        PREVIEW_START, PREVIEW_ROWS)


def _preview_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten rows from nine tenths of the table on, without ordering or counting off the rows before."""
    flat = flatten_sessions(_sessions(spark, sf_dir)).select("unique_session_id", "visitId", "date", "total_revenue")
    return rows_by_rank(flat, ["visitId"], DEEP_START, PREVIEW_ROWS)


def _session_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sessions numbered by day and visit."""
    flat = flatten_sessions(_sessions(spark, sf_dir)).select("unique_session_id", "date", "visitId")
    return with_numbers(flat, ["date", "visitId"])


def _split(spark: SparkSession, sf_dir: str):
    """Day shards of which some rows have spoiled dates, split into good and bad rows."""
    return quarantine(with_dirty_days(read_shards(spark, sharded_sessions(spark, sf_dir))))


def _quarantined(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = _split(spark, sf_dir).bad
    return bad.select(session_key().alias("unique_session_id"), "date", "table_suffix", "reason")


def _week_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ext = session_extract(_sessions(spark, sf_dir))
    return ext.groupBy("date").agg(F.count(F.lit(1)).alias("sessions")).orderBy("date")


_BUILDERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "daily_profile_trimmed": lambda s, d: R.daily_profile(_sessions(s, d)),
    "log_trim_rows": lambda s, d: R.trimmed_revenue(_sessions(s, d)),
    "daily_dynamics": lambda s, d: R.daily_dynamics(R.daily_profile(_sessions(s, d))),
    "segment_report": lambda s, d: _segments(s, d),
    "segment_report_base": lambda s, d: _segments(s, d, columns=R.SEGMENT_BASE_COLUMNS),
    "segment_report_min600": lambda s, d: _segments(s, d, min_count=SEGMENT_MIN_COUNT_STRICT),
    "weekly_dynamics": lambda s, d: R.weekly_dynamics(_sessions(s, d)),
    "weekly_revenue": lambda s, d: R.weekly_revenue(_sessions(s, d)),
    "weekly_dynamics_country": lambda s, d: R.weekly_dynamics(_sessions(s, d), country=COUNTRY),
    "session_extract": lambda s, d: session_extract(_sessions(s, d)),
    "revenue_sessions": lambda s, d: revenue_sessions(_sessions(s, d)),
    "week_of_year_counts": _week_counts,
    "shard_range": lambda s, d: _range_rows(_in_range(s, d, SHARD_LO, SHARD_HI)),
    "shard_range_mixed": lambda s, d: _range_rows(_mixed_shards(s, d)),
    "daily_profile_distributed": lambda s, d: R.daily_profile(_sessions(s, d), median_method="distributed"),
    "segment_report_distributed": lambda s, d: R.segment_report(_sessions(s, d), median_method="distributed"),
    "describe_distributed": lambda s, d: R.distributions_describe(_sessions(s, d), median_method="distributed"),
    "daily_profile_range": lambda s, d: R.daily_profile(_days_of_table(s, d), country=COUNTRY),
    "segment_report_range": _segments_in_range,
    "weekly_dynamics_range": lambda s, d: R.weekly_dynamics(_days_of_table(s, d), country=COUNTRY),
    "shard_range_catalog": lambda s, d: _range_rows(read_table(s, sharded_table(s, d), SHARD_LO, SHARD_HI)),
    "daily_states_range": lambda s, d: S.daily_profile_of_states(_states(s, d)),
    "weekly_states_range": lambda s, d: S.weekly_dynamics_of_states(_states(s, d)),
    "segment_states_range": lambda s, d: S.segment_report_of_states(_states(s, d), min_count=RANGE_MIN_COUNT),
    "weekly_dynamics_timestamp": lambda s, d: R.weekly_dynamics(_sessions(s, d), as_timestamp=True),
    "country_profile_strict": lambda s, d: R.country_profile(_sessions(s, d), min_count=COUNTRY_MIN_COUNT_STRICT),
    "binned_revenue": lambda s, d: R.binned_revenue(_sessions(s, d)),
    "revenue_bins": lambda s, d: R.revenue_bins(_sessions(s, d)),
    "country_profile_trimmed": lambda s, d: R.country_profile(_sessions(s, d)),
    "bin_plan": lambda s, d: R.country_bin_plan(_sessions(s, d)),
    "expand_bins": lambda s, d: R.country_bin_rows(_sessions(s, d)),
    "bin_index_series": lambda s, d: R.country_bin_series(_sessions(s, d)),
    "hits_frequency": lambda s, d: R.hits_frequency(_sessions(s, d)),
    "country_frequency": lambda s, d: R.country_frequency(_sessions(s, d)),
    "revenue_frequency": lambda s, d: R.revenue_frequency(_sessions(s, d)),
    "describe_numeric": lambda s, d: R.distributions_describe(_sessions(s, d)),
    "preview_rows": _preview,
    "preview_deep": _preview_deep,
    "session_numbers": _session_numbers,
    "shard_day": lambda s, d: _range_rows(_in_range(s, d, DAY, DAY)),
    "quarantine_counts": lambda s, d: split_counts(_split(s, d)),
    "quarantined_sessions": _quarantined,
    "weekly_dynamics_quarantine": lambda s, d: R.weekly_dynamics(_split(s, d).good),
    "histogram_log10_pages_over": _pages_over,
    "distributions": lambda s, d: R.distributions(_sessions(s, d)),
}
for _c in R.DISTRIBUTION_COLUMNS:
    _BUILDERS[f"histogram_{_c}"] = (lambda c: lambda s, d: R.distribution_histogram(_sessions(s, d), c))(_c)
    _BUILDERS[f"histogram_log10_{_c}"] = (
        lambda c: lambda s, d: R.distribution_histogram(_sessions(s, d), c, log10=True))(_c)


def query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    build, spec = _BUILDERS[name], OUTPUT[name]
    return lambda spark, sf_dir: shaped(build(spark, sf_dir), spec)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query(name) for name in _BUILDERS}
