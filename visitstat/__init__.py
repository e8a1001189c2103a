"""Spark operators for web-session statistics.

Typical use::

    from visitstat import apply_conf, read_shards, segment_report
    apply_conf(spark)
    sessions = read_shards(spark, "s3://bucket/sessions", "20170601", "20170631")
    segment_report(sessions, country="United States").show()
"""

from visitstat.operators.bins import bin_counts, bin_plan, expand_bins, histogram, histograms, place_in_bins
from visitstat.operators.profile import describe, frequency, group_profile, summarize
from visitstat.operators.quantile import exact_quantiles, medians
from visitstat.operators.sessions import flatten_sessions, revenue_sessions, session_extract, where_sessions
from visitstat.operators.trim import log_trim
from visitstat.plans.reports import (
    binned_revenue, revenue_bins, country_bin_plan, country_bin_rows, country_bin_series, country_profile, daily_dynamics, daily_profile,
    distribution_histogram, distributions, distributions_describe, segment_report, trimmed_revenue,
    weekly_dynamics, weekly_revenue, hits_frequency, country_frequency, revenue_frequency,
)
from visitstat.session import apply_conf, build_session
from visitstat.sources.shards import list_tables, number_series, preview_rows, read_shards, schema_fields, \
    write_shards

__all__ = [
    "bin_counts", "bin_plan", "binned_revenue", "expand_bins", "place_in_bins", "revenue_bins", "histogram", "histograms", "describe", "frequency", "group_profile",
    "summarize", "exact_quantiles", "medians", "flatten_sessions", "revenue_sessions", "session_extract",
    "where_sessions", "log_trim", "country_bin_plan", "country_bin_rows", "country_bin_series",
    "country_profile", "daily_dynamics", "daily_profile", "distribution_histogram", "distributions",
    "distributions_describe", "segment_report", "trimmed_revenue", "weekly_dynamics", "weekly_revenue",
    "hits_frequency", "country_frequency", "revenue_frequency", "apply_conf", "build_session",
    "list_tables", "number_series", "preview_rows", "read_shards", "schema_fields", "write_shards",
]
