"""Flat per-session rows from nested session records (projection, flags, unit conversion)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitstat.functions import (
    flag_if, micro_to_units, parse_day, session_key, week_of_year_sunday,
)
from visitstat.sources.shards import SUFFIX, suffix_range

# Columns of the per-session extract, in order (the week number sits in `date`).
EXTRACT_COLUMNS = [
    "unique_session_id", "total_revenue", "visits", "hits", "pageviews", "timeOnSite",
    "newvisits", "source", "browser", "operatingSystem", "deviceCategory",
    "channelGrouping", "date", "revenue_true", "revenue_false",
]


def where_sessions(df: DataFrame, lo: str | None = None, hi: str | None = None,
                   country: str | None = None, revenue_only: bool = False) -> DataFrame:
    """The scan predicates of every query: suffix range, country, revenue present.

    Written against the nested record so they reach the parquet scan
    (partition filter on the suffix, pushed filters on struct fields).
    """
    out = suffix_range(df, lo, hi) if (lo or hi) else df
    if country is not None:
        out = out.where(F.col("geoNetwork.country") == F.lit(country))
    if revenue_only:
        out = out.where(F.col("totals.totalTransactionRevenue").isNotNull())
    return out


def flatten_sessions(df: DataFrame) -> DataFrame:
    """All fields the operators use, one flat row per session.

    Revenue is kept twice: in units (``total_revenue``, double) as reported,
    and in micro-units (``revenue_micro``, bigint) so money sums are exact.
    Catalyst drops whatever a query does not read, down to struct fields.
    """
    rev = F.col("totals.totalTransactionRevenue")
    newv = F.col("totals.newVisits")
    new_rev = F.when(rev.isNotNull() & (newv == 1), rev)
    return df.select(
        session_key().alias("unique_session_id"),
        F.col("visitId"),
        micro_to_units(rev).alias("total_revenue"),
        rev.alias("revenue_micro"),
        F.col("totals.visits").alias("visits"),
        F.col("totals.hits").alias("hits"),
        F.col("totals.pageviews").alias("pageviews"),
        F.col("totals.timeOnSite").alias("timeOnSite"),
        newv.alias("newvisits"),
        F.col("trafficSource.source").alias("source"),
        F.col("device.browser").alias("browser"),
        F.col("device.operatingSystem").alias("operatingSystem"),
        F.col("device.deviceCategory").alias("deviceCategory"),
        F.col("channelGrouping"),
        F.col("geoNetwork.country").alias("country"),
        F.col("date"),
        F.col(SUFFIX),
        flag_if(rev.isNotNull()).alias("revenue_true"),
        flag_if(rev.isNull()).alias("revenue_false"),
        micro_to_units(new_rev).alias("revenue_from_new"),
        new_rev.alias("revenue_from_new_micro"),
    )


def session_extract(df: DataFrame) -> DataFrame:
    """The 15-column per-session extract; ``date`` holds the Sunday-based week number."""
    flat = flatten_sessions(df).withColumn("date", week_of_year_sunday(parse_day("date")))
    return flat.select(*EXTRACT_COLUMNS)


def revenue_sessions(df: DataFrame) -> DataFrame:
    """Sessions with revenue: (unique_session_id, total_revenue)."""
    flat = flatten_sessions(where_sessions(df, revenue_only=True))
    return flat.select("unique_session_id", "total_revenue")
