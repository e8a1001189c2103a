"""The whole-query reports, composed from the operators.

Each function takes the nested session rows (``read_shards`` or
``sessions_from_testdata``) and returns a DataFrame; nothing is collected
except single-row scalars (a grand total). Scan predicates (suffix range,
country, revenue present) are applied to the nested record first so they
reach the parquet scan as partition and pushed filters.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitstat.functions import (
    COUNTRY_MIN_COUNT, LOG_SIGMA_K, MICRO, SEGMENT_MIN_COUNT,
    parse_day, ratio, round_half_up, week_start_sunday,
)
from visitstat.operators.attach import BROADCAST_MAX_ROWS
from visitstat.session import write_table
from visitstat.operators.bins import bin_counts, bin_plan, expand_bins, histogram, histograms, place_in_bins
from visitstat.operators.profile import big_sum, describe, exact_sum_avg, exact_variation, frequency, group_profile, summarize
from visitstat.operators.sessions import flatten_sessions, session_extract, where_sessions
from visitstat.operators.trim import log_trim_bounded


def _flat(df: DataFrame, lo=None, hi=None, country=None, revenue_only=False) -> DataFrame:
    return flatten_sessions(where_sessions(df, lo, hi, country, revenue_only))


def _trimmed(df: DataFrame, lo=None, hi=None, country=None, trim_by: Sequence[str] = ("country",),
             k: float = LOG_SIGMA_K, max_rows: int = BROADCAST_MAX_ROWS) -> tuple[DataFrame, int]:
    flat = _flat(df, lo, hi, country, revenue_only=True)
    rows = flat.select("unique_session_id", "total_revenue", "revenue_micro", "date", "country")
    t, bound = log_trim_bounded(rows, "total_revenue", trim_by, k=k, max_rows=max_rows)
    return t.select("unique_session_id", "total_revenue", "logtar", "date", "country", "log_avg", "log_sko",
                    "revenue_micro"), bound


def trimmed_revenue(df: DataFrame, lo: str | None = None, hi: str | None = None,
                    country: str | None = None, trim_by: Sequence[str] = ("country",),
                    k: float = LOG_SIGMA_K, max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Revenue sessions after the log-sigma trim (per ``trim_by`` group):
    ``unique_session_id, total_revenue, logtar, date, country, log_avg, log_sko``
    (and ``revenue_micro``, the same revenue in integer micro-units)."""
    return _trimmed(df, lo, hi, country, trim_by, k, max_rows)[0]


def daily_profile(df: DataFrame, lo: str | None = None, hi: str | None = None,
                  country: str | None = None, trim_by: Sequence[str] = ("country",),
                  by: Sequence[str] = ("date",), k: float = LOG_SIGMA_K,
                  median_method: str = "auto") -> DataFrame:
    """Outlier-trimmed profile of revenue per day (trim per country, profile per date):
    ``date, count, avg, median, min, max, sko, koef_var`` ordered by date."""
    t, bound = _trimmed(df, lo, hi, country, trim_by, k)
    prof = group_profile(t, list(by), "total_revenue", median_method=median_method,
                         exact=("revenue_micro", MICRO), rows_bound=bound)
    return prof.orderBy(*by)


def daily_dynamics(profile: DataFrame) -> DataFrame:
    """The reporting series of a daily profile: date, median (2 places),
    variation (4 places), count; halves rounded away from zero."""
    return profile.select("date", round_half_up("median", 2).alias("median"),
                          round_half_up("koef_var", 4).alias("koef_var"), "count").orderBy("date")


SEGMENT_COLUMNS = (
    "count_parted", "sum_new_visits", "count_parted_to_all", "median_revenue", "sum_revenue",
    "percent_revenue_from_new", "revenue_to_parted_all", "median_visits", "median_hits",
    "median_pageviews", "sum_pageviews", "median_timeonsite", "koef_var_revenue", "koef_var_visits",
    "koef_var_hits", "koef_var_pageviews", "koef_var_timeOnSite",
)
SEGMENT_BASE_COLUMNS = (
    "count_parted", "count_parted_to_all", "median_revenue", "sum_revenue", "revenue_to_parted_all",
    "koef_var_revenue", "median_visits", "koef_var_visits", "median_hits", "koef_var_hits",
    "median_pageviews", "sum_pageviews", "koef_var_pageviews", "median_timeonsite", "koef_var_timeOnSite",
)


def segment_report(df: DataFrame, lo: str | None = None, hi: str | None = None,
                   country: str | None = None, by: Sequence[str] = ("channelGrouping", "operatingSystem"),
                   min_count: int = SEGMENT_MIN_COUNT, columns: Sequence[str] = SEGMENT_COLUMNS,
                   median_method: str = "auto", rows_bound: int | None = None) -> DataFrame:
    """Segment report: 17 metrics per segment, share of all sessions, kept when
    ``count_parted >= min_count``, ordered by revenue (largest first).

    The share is taken over *all* segments before the threshold. Plan: one
    grouped aggregate with partial aggregation for all sums/counts/moments,
    the exact medians of five columns, the per-segment table written once
    with the grand total (a single number) summed during that write.
    Revenue sums are exact (integer micro-units). ``rows_bound``: a known
    upper bound on the input sessions (see ``summarize``).
    """
    by = list(by)
    flat = _flat(df, lo, hi, country)

    want = set(columns)
    aggs = {
        "count_parted": F.count("unique_session_id"),
        "sum_new_visits": F.sum("newvisits"),
        "sum_revenue_micro": big_sum("revenue_micro"),
        "sum_new_micro": big_sum("revenue_from_new_micro"),
        "count_revenue": F.count("total_revenue"),
        "sum_pageviews": F.sum("pageviews"),
        "koef_var_revenue": exact_variation("revenue_micro", MICRO), "koef_var_visits": exact_variation("visits"),
        "koef_var_hits": exact_variation("hits"), "koef_var_pageviews": exact_variation("pageviews"),
        "koef_var_timeOnSite": exact_variation("timeOnSite"),
    }
    needed = want | {"count_parted", "sum_revenue_micro"} | (
        {"sum_new_micro"} if "percent_revenue_from_new" in want else set()) | (
        {"count_revenue"} if "revenue_to_parted_all" in want else set())
    aggs = {n: e for n, e in aggs.items() if n in needed}          # only the metrics asked for
    meds = {"median_revenue": "total_revenue", "median_visits": "visits", "median_hits": "hits",
            "median_pageviews": "pageviews", "median_timeonsite": "timeOnSite"}
    meds = {n: c for n, c in meds.items() if n in want}
    seg, seen = write_table(summarize(flat, by, aggs, meds, median_method=median_method, rows_bound=rows_bound),
                            "segments", observe={"total": F.sum("count_parted")})
    total = seen["total"] or 0
    derived = {
        "count_parted_to_all": ratio(F.col("count_parted"), F.lit(total)),
        "sum_revenue": F.col("sum_revenue_micro").cast("double") / F.lit(MICRO),
        "percent_revenue_from_new": ratio("sum_new_micro", "sum_revenue_micro"),
        "revenue_to_parted_all": ratio("count_revenue", "count_parted"),
    }
    out = seg.select(*by, "count_parted", *[F.col(c) for c in (*aggs, *meds) if c in want and c != "count_parted"],
                     *[e.alias(n) for n, e in derived.items() if n in want | {"sum_revenue"}])
    return (out.where(F.col("count_parted") >= F.lit(min_count))
               .select(*by, *columns)
               .orderBy(F.col("sum_revenue").desc_nulls_last(), *by))


def weekly_dynamics(df: DataFrame, lo: str | None = None, hi: str | None = None,
                    country: str | None = None, as_timestamp: bool = False) -> DataFrame:
    """Per week (weeks start on Sunday, UTC): ``date`` (the Sunday, as a date or, with
    ``as_timestamp``, as its midnight without a time zone), revenue sum and average
    (both from exact integer micro-unit sums), time-on-site sum; ordered by date."""
    flat = _flat(df, lo, hi, country)
    week = week_start_sunday(parse_day("date"))
    wk = flat.withColumn("week", week.cast("timestamp_ntz") if as_timestamp else week)
    total, mean = exact_sum_avg("revenue_micro", MICRO)
    out = wk.groupBy("week").agg(total.alias("revenue_sum"), mean.alias("revenue_avg"),
                                 F.sum("timeOnSite").alias("sum_timeOnSite"))
    return out.withColumnRenamed("week", "date").orderBy("date")


def weekly_revenue(df: DataFrame, lo: str | None = None, hi: str | None = None,
                   country: str | None = None) -> DataFrame:
    """The earlier weekly form: ``date, sum`` (revenue per Sunday-started week)."""
    return weekly_dynamics(df, lo, hi, country).select("date", F.col("revenue_sum").alias("sum")).orderBy("date")


def country_profile(df: DataFrame, lo: str | None = None, hi: str | None = None,
                    country: str | None = None, min_count: int = COUNTRY_MIN_COUNT,
                    k: float = LOG_SIGMA_K, median_method: str = "auto") -> DataFrame:
    """Trimmed revenue profile per country, groups with more than ``min_count``
    sessions: ``country, count, avg, median, sko`` ordered by count."""
    t, bound = _trimmed(df, lo, hi, country, ("country",), k)
    prof = group_profile(t, ["country"], "total_revenue", ("count", "avg", "median", "sko"),
                         median_method=median_method, exact=("revenue_micro", MICRO), rows_bound=bound)
    return prof.where(F.col("count") > F.lit(min_count)).orderBy("count", "country")


def country_bin_plan(df: DataFrame, lo: str | None = None, hi: str | None = None,
                     country: str | None = None, k: float = LOG_SIGMA_K,
                     median_method: str = "auto") -> DataFrame:
    """Bin plan of trimmed revenue per country (see ``bin_plan``)."""
    t, bound = _trimmed(df, lo, hi, country, ("country",), k)
    return bin_plan(t, ["country"], "total_revenue", median_method=median_method,
                    exact=("revenue_micro", MICRO), rows_bound=bound).orderBy("country")


def country_bin_series(df: DataFrame, lo: str | None = None, hi: str | None = None,
                       country: str | None = None, k: float = LOG_SIGMA_K) -> DataFrame:
    """The bin-index series of each country, 1..ceil (``GENERATE_ARRAY(1, ceil)``
    numbered as by ``ROW_NUMBER``): ``country, num``. The bin counts have one row
    per country; each row is expanded in place."""
    t, _ = _trimmed(df, lo, hi, country, ("country",), k)
    counts = bin_counts(t, ["country"], "total_revenue")
    return (counts.select("country", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("ceil"))).alias("num"))
                  .orderBy("country", "num"))


def country_bin_rows(df: DataFrame, lo: str | None = None, hi: str | None = None,
                     country: str | None = None, k: float = LOG_SIGMA_K) -> DataFrame:
    """Each trimmed revenue session once per bin index 1..ceil of its country:
    ``unique_session_id, country, total_revenue, another_unnest``. ``binned_revenue``
    gives each session its own bin instead."""
    t, _ = _trimmed(df, lo, hi, country, ("country",), k)
    rows = expand_bins(t, bin_counts(t, ["country"], "total_revenue"), ["country"])
    return rows.select("unique_session_id", "country", "total_revenue", "another_unnest")


def binned_revenue(df: DataFrame, lo: str | None = None, hi: str | None = None,
                   country: str | None = None, k: float = LOG_SIGMA_K) -> DataFrame:
    """Each trimmed revenue session with its own bin of its country's plan:
    ``unique_session_id, country, total_revenue, bin``."""
    t, _ = _trimmed(df, lo, hi, country, ("country",), k)
    rows = place_in_bins(t, bin_counts(t, ["country"], "total_revenue"), ["country"], "total_revenue")
    return rows.select("unique_session_id", "country", "total_revenue", "bin")


def revenue_bins(df: DataFrame, lo: str | None = None, hi: str | None = None,
                 country: str | None = None, k: float = LOG_SIGMA_K) -> DataFrame:
    """Sessions per country and bin of trimmed revenue: ``country, bin, count`` (bins with sessions)."""
    rows = binned_revenue(df, lo, hi, country, k)
    return rows.groupBy("country", "bin").agg(F.count(F.lit(1)).alias("count")).orderBy("country", "bin")


DISTRIBUTION_COLUMNS = ("timeOnSite", "pageviews", "hits", "total_revenue")
DESCRIBE_NUMERIC = ("total_revenue", "visits", "hits", "pageviews", "timeOnSite", "newvisits",
                    "date", "revenue_true", "revenue_false")


def distributions_describe(df: DataFrame, lo: str | None = None, hi: str | None = None,
                           country: str | None = None, median_method: str = "auto") -> DataFrame:
    """``describe`` of the numeric columns of the session extract."""
    ext = session_extract(where_sessions(df, lo, hi, country))
    return describe(ext, DESCRIBE_NUMERIC, median_method=median_method, scales={"total_revenue": MICRO}).orderBy("column")


def distribution_histogram(df: DataFrame, column: str, log10: bool = False, lo: str | None = None,
                           hi: str | None = None, country: str | None = None) -> DataFrame:
    """Histogram (raw or log10) of one extract column, Sturges bin count."""
    ext = session_extract(where_sessions(df, lo, hi, country))
    return histogram(ext, column, log10=log10)


def distributions(df: DataFrame, lo: str | None = None, hi: str | None = None,
                  country: str | None = None, columns: Sequence[str] = DISTRIBUTION_COLUMNS) -> DataFrame:
    """Raw and log10 histograms of the extract's distribution columns, all in
    one table (``column, scale, bin, bin_lo, bin_hi, count, density``) and
    from two passes over the data whatever the number of columns."""
    ext = session_extract(where_sessions(df, lo, hi, country))
    return histograms(ext, [(c, lg) for c in columns for lg in (False, True)])


def hits_frequency(df: DataFrame, lo=None, hi=None) -> DataFrame:
    """Sessions per hit count (null hit count is a group), ordered by hits."""
    return frequency(_with_visitor(df, lo, hi), "hits", count_of="fullVisitorId") \
        .orderBy(F.col("hits").asc_nulls_first())


def _with_visitor(df: DataFrame, lo=None, hi=None) -> DataFrame:
    d = where_sessions(df, lo, hi)
    return d.select("fullVisitorId", F.col("totals.hits").alias("hits"),
                    F.col("geoNetwork.country").alias("country"),
                    (F.col("totals.totalTransactionRevenue") / F.lit(MICRO)).alias("total_revenue"))


def country_frequency(df: DataFrame, lo=None, hi=None) -> DataFrame:
    """Sessions per country, ordered by count."""
    return frequency(_with_visitor(df, lo, hi), "country", count_of="fullVisitorId") \
        .orderBy("count", F.col("country").asc_nulls_first())


def revenue_frequency(df: DataFrame, lo=None, hi=None) -> DataFrame:
    """Sessions per revenue value (in units; no revenue is one null group), ordered by count."""
    return frequency(_with_visitor(df, lo, hi), "total_revenue", count_of="fullVisitorId") \
        .orderBy("count", F.col("total_revenue").asc_nulls_first())
