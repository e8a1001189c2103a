"""Run one report over a day-sharded session table and write the result.

    spark-submit -m visitstat.plans.run segment_report --source s3://bucket/sessions \
        --lo 20170601 --hi 20170631 --country "United States" --out s3://bucket/reports/segments

``--source`` is a folder of ``table_suffix=yyyyMMdd`` shards (``write_shards``);
the result is written as parquet to ``--out``. On a cluster the session
must name a shared ``spark.checkpoint.dir`` (intermediate tables go there).
"""

from __future__ import annotations

import argparse
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from visitstat.functions import COUNTRY_MIN_COUNT, SEGMENT_MIN_COUNT
from visitstat.operators.sessions import revenue_sessions, session_extract, where_sessions
from visitstat.plans import reports as R
from visitstat.session import apply_conf, drop_scratch, scratch_count, write_table
from visitstat.sources.quarantine import quarantine
from visitstat.sources.shards import read_shards


def _reports(a: argparse.Namespace) -> dict[str, Callable[[DataFrame], DataFrame]]:
    c = a.country
    return {
        "daily_profile": lambda s: R.daily_profile(s, country=c),
        "daily_dynamics": lambda s: R.daily_dynamics(R.daily_profile(s, country=c)),
        "trimmed_revenue": lambda s: R.trimmed_revenue(s, country=c),
        "segment_report": lambda s: R.segment_report(s, country=c, min_count=a.min_count),
        "segment_report_base": lambda s: R.segment_report(s, country=c, min_count=a.min_count,
                                                          columns=R.SEGMENT_BASE_COLUMNS),
        "weekly_dynamics": lambda s: R.weekly_dynamics(s, country=c),
        "weekly_revenue": lambda s: R.weekly_revenue(s, country=c),
        "session_extract": lambda s: session_extract(where_sessions(s, country=c)),
        "revenue_sessions": lambda s: revenue_sessions(where_sessions(s, country=c)),
        "country_profile": lambda s: R.country_profile(s, country=c, min_count=a.country_min_count),
        "bin_plan": lambda s: R.country_bin_plan(s, country=c),
        "bin_rows": lambda s: R.country_bin_rows(s, country=c),
        "describe": lambda s: R.distributions_describe(s, country=c),
        "histogram": lambda s: R.distribution_histogram(s, a.column, log10=a.log10, country=c),
        "hits_frequency": R.hits_frequency,
        "country_frequency": R.country_frequency,
        "revenue_frequency": R.revenue_frequency,
    }


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("report")
    p.add_argument("--source", required=True, help="folder of table_suffix=yyyyMMdd shards")
    p.add_argument("--out", required=True, help="where the result is written (parquet)")
    p.add_argument("--lo", help="first suffix (text order, inclusive)")
    p.add_argument("--hi", help="last suffix (text order, inclusive; need not be a real day)")
    p.add_argument("--country", help="keep one geoNetwork.country")
    p.add_argument("--min-count", type=int, default=SEGMENT_MIN_COUNT)
    p.add_argument("--country-min-count", type=int, default=COUNTRY_MIN_COUNT)
    p.add_argument("--column", default="total_revenue", help="histogram column")
    p.add_argument("--log10", action="store_true", help="histogram of log10 of the column")
    p.add_argument("--quarantine", help="set rows aside whose date is no day of their shard: where they are written (parquet)")
    return p


def run(spark: SparkSession, argv: list[str] | None = None) -> DataFrame:
    a = parser().parse_args(argv)
    reports = _reports(a)
    if a.report not in reports:
        raise SystemExit(f"unknown report {a.report!r}; one of {sorted(reports)}")
    source, target = (p.rstrip("/") + "/" for p in (a.source, a.out))
    if source.startswith(target) or target.startswith(source):
        raise SystemExit("--out must lie outside --source, and --source outside --out")
    apply_conf(spark)
    tables = scratch_count()
    sessions = read_shards(spark, a.source, a.lo, a.hi)
    if a.quarantine:
        split = quarantine(sessions, a.quarantine)
        print(f"{split.n_good} sessions go on, {split.n_bad} are set aside in {a.quarantine}")
        sessions = split.good
    # The whole result is computed before --out is touched.
    result = write_table(reports[a.report](sessions), "report")
    result.write.mode("overwrite").parquet(a.out)
    drop_scratch(spark, tables)
    return spark.read.parquet(a.out)


def main() -> None:
    run(SparkSession.builder.appName("visitstat").getOrCreate())


if __name__ == "__main__":
    main()
