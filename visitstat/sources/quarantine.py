"""Dirty days: rows whose ``date`` is no day are set aside with a reason, the others go on.

``parse_day`` raises on a value that is no ``yyyyMMdd`` day (ANSI mode), so one
bad row would end every weekly report. ``quarantine`` splits a session table before
that: the good part is a filter on the same scan (nothing is copied, partition
and pushed filters of later steps still reach it), the bad rows are written once
with their reason, and both parts are counted during that one write.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from visitstat.session import scratch_path
from visitstat.sources.shards import SUFFIX

REASON = "reason"
NO_DATE, NOT_A_DAY, OTHER_DAY = "no date", "not a day", "not the day of its shard"


def as_day(c: Column) -> Column:
    """The date of a ``yyyyMMdd`` text, null for anything else."""
    return F.when(c.rlike("^[0-9]{8}$"), F.try_to_date(c, "yyyyMMdd"))


def day_fault(df: DataFrame, date: str = "date", suffix: str = SUFFIX) -> Column:
    """Why a row's date cannot be used, null where it can: missing, not a day, or (in a
    table with a suffix that is itself a day) the day of another shard."""
    d = F.col(date)
    fault = F.when(d.isNull(), NO_DATE).when(as_day(d).isNull(), NOT_A_DAY)
    if suffix in df.columns:
        fault = fault.when(as_day(F.col(suffix)).isNotNull() & (F.col(suffix) != d), OTHER_DAY)
    return fault


@dataclass
class Split:
    """``good``: the rows that go on; ``bad``: the others with ``reason``, as written; their numbers."""

    good: DataFrame
    bad: DataFrame
    n_good: int
    n_bad: int


def quarantine(df: DataFrame, path: str | None = None, fault: Column | None = None) -> Split:
    """Split ``df`` by ``fault`` (default: ``day_fault``); the bad rows are written to ``path``, a fresh
    folder that must not exist (default: one below the shared checkpoint folder).

    All columns of a bad row are kept, so it can be mended and written back. An input without
    bad rows leaves an empty table."""
    if REASON in df.columns:
        raise ValueError(f"the table has a column {REASON!r} already")
    fault = day_fault(df) if fault is None else fault
    path = path or scratch_path(df.sparkSession, "quarantine")
    seen = Observation(f"quarantine_{uuid.uuid4().hex}")
    tagged = df.withColumn(REASON, fault)
    counted = tagged.observe(seen, F.count(F.lit(1)).alias("rows"), F.count(REASON).alias("bad"))
    counted.where(F.col(REASON).isNotNull()).write.mode("errorifexists").parquet(path)
    n = seen.get
    return Split(df.where(fault.isNull()), df.sparkSession.read.schema(tagged.schema).parquet(path), n["rows"] - n["bad"], n["bad"])


def split_counts(split: Split) -> DataFrame:
    """Rows per reason, and under ``good`` those that go on: ``reason, sessions``."""
    bad = split.bad.groupBy(REASON).agg(F.count(F.lit(1)).alias("sessions"))
    good = split.bad.sparkSession.createDataFrame([("good", split.n_good)], "reason string, sessions bigint")
    return bad.union(good).orderBy(REASON)
