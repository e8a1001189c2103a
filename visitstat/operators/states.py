"""Mergeable states of the day shards: range reports that read no session.

A state row holds, per day, country, channel and operating system, what the reports
need and what can be added up: numbers of sessions, and per measure the count, sum and
sum of squares (38 digits), minimum and maximum, and on request a quantile sketch (KLL). A
report over any suffix range is a merge of the range's states; sums and deviations equal
those over the sessions to the last bit, because both come from the same integers.

The states are stored by period (the first ``PERIOD`` characters of the suffix), so a range reads
a few folders. ``refresh_states`` recomputes only the days it is given and leaves the others
as they are; ``write_shards(states=...)`` calls it for the days it wrote.

Medians cannot be merged exactly. ``median_method="sketch"`` takes them from the merged sketches
(needs ``sketch_k``): the value returned has a rank within ``SKETCH_ERROR[k]`` of the middle in 99
of 100 cases, whatever the number of rows. It is opt-in; without it the report has no medians.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from visitstat.functions import MICRO, SEGMENT_MIN_COUNT, parse_day, ratio, week_start_sunday
from visitstat.operators.profile import std_from_sums
from visitstat.operators.sessions import flatten_sessions
from visitstat.session import write_table
from visitstat.sources.shards import SUFFIX, read_shards, suffix_range

PERIOD = 6                   # yyyyMM
KEYS = ["date", "country", "channelGrouping", "operatingSystem"]
# measure -> (integer column, what it is divided by in reports)
MEASURES = {"revenue": ("revenue_micro", MICRO), "visits": ("visits", 1.0), "hits": ("hits", 1.0),
            "pageviews": ("pageviews", 1.0), "timeOnSite": ("timeOnSite", 1.0)}
# k of the sketch -> rank error of a quantile (one side, 99 of 100 cases), as the sketch's authors state it
SKETCH_ERROR = {200: 0.0133, 400: 0.0069, 800: 0.0036, 1600: 0.0019}


def session_states(sessions: DataFrame, sketch_k: int | None = None, partitions: int | None = None) -> DataFrame:
    """One state row per suffix and ``KEYS`` of nested session rows.

    With ``partitions`` the sessions are range-partitioned on the keys first, so each state is made once, from
    its rows, in the task that has all of them. Sessions in any order are spread over all tasks: nearly every
    row would be a partial state of its own, with sketches to be stored, sent and merged.
    """
    if sketch_k is not None and sketch_k not in SKETCH_ERROR:
        raise ValueError(f"sketch_k must be one of {sorted(SKETCH_ERROR)}")
    flat = flatten_sessions(sessions)
    if partitions is not None:
        flat = flat.repartitionByRange(partitions, SUFFIX, *KEYS)
    aggs = [F.count(F.lit(1)).alias("sessions"), F.count("unique_session_id").alias("keyed"), F.sum("newvisits").alias("new_visits"),
            F.sum(F.col("revenue_from_new_micro").cast("decimal(38,0)")).alias("new_revenue")]
    for m, (c, _) in MEASURES.items():
        x = F.col(c).cast("decimal(20,0)")
        aggs += [F.count(c).alias(f"n_{m}"), F.sum(F.col(c).cast("decimal(38,0)")).alias(f"sum_{m}"), F.sum(x * x).alias(f"squares_{m}"),
                 F.min(c).alias(f"min_{m}"), F.max(c).alias(f"max_{m}")]
        if sketch_k:
            aggs.append(F.kll_sketch_agg_bigint(c, F.lit(sketch_k)).alias(f"sketch_{m}"))
    return flat.groupBy(SUFFIX, *KEYS).agg(*aggs)


def _with_period(states: DataFrame) -> DataFrame:
    return states.withColumn("period", F.substring(SUFFIX, 1, PERIOD))


def _write_periods(states: DataFrame, path: str) -> None:
    """Write the folders of the states' periods in place of what they held; others stay."""
    (_with_period(states).write.partitionBy("period").mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").parquet(path))


def _store(states: DataFrame, path: str) -> None:
    _write_periods(_with_period(states).repartitionByRange("period", SUFFIX), path)


def write_states(sessions: DataFrame, path: str, sketch_k: int | None = None) -> None:
    """The states of nested session rows with their suffix, at ``path`` (a folder that must not exist)."""
    spark = sessions.sparkSession
    states = session_states(sessions, sketch_k, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # an empty table first: it fixes the schema and refuses a folder that exists
    spark.createDataFrame([], states.schema).write.mode("errorifexists").parquet(path)
    # a task has a run of suffixes already: a second range partitioning would make all states again to sample them
    _write_periods(states, path)


def refresh_states(spark: SparkSession, root: str, path: str, days: Iterable[str]) -> None:
    """Recompute the states of ``days`` (suffixes); a day without sessions loses its states. Only the shards of these
    days are read, and only the periods they lie in are written."""
    days = sorted(set(days))
    if not days:
        return
    old = _stored(spark, path)
    periods = sorted({d[:PERIOD] for d in days})
    k = sketch_size(old)
    new = session_states(read_shards(spark, root).where(F.col(SUFFIX).isin(days)), k)
    kept = old.where(F.col("period").isin(periods) & ~F.col(SUFFIX).isin(days))
    # written before the old files of the periods go
    both = write_table(kept.drop("period").unionByName(new.select(*[c for c in old.columns if c != "period"])), "states")
    left = {r[0] for r in _with_period(both).select("period").distinct().collect()}      # a few months
    _store(both, path)
    for period in periods:
        if period not in left:               # nothing is left of it: dynamic overwrite does not touch it
            folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/period={period}")
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def _stored(spark: SparkSession, path: str) -> DataFrame:
    """All states; the period is taken from the folder's name, as text."""
    df = spark.read.option("basePath", path).parquet(path)
    if "period" not in df.columns:           # no session yet
        return df.withColumn("period", F.lit(None).cast("string"))
    return df.withColumn("period", F.col("period").cast("string"))


def sketch_size(states: DataFrame) -> int | None:
    """The k that the table's sketches were made with, None if it has none."""
    if "sketch_visits" not in states.columns:
        return None
    text = states.select(F.kll_sketch_to_string_bigint("sketch_visits").alias("s")).where("s IS NOT NULL").first()
    return min(SKETCH_ERROR) if text is None else int(next(x for x in text["s"].splitlines() if x.strip().startswith("K")).split(":")[1])


def read_states(spark: SparkSession, path: str, lo: str | None = None, hi: str | None = None, country: str | None = None) -> DataFrame:
    """The states of the suffixes in [lo, hi] (as text); only the periods of the range are read."""
    df = suffix_range(_stored(spark, path), lo, hi)
    if lo is not None:
        df = df.where(F.col("period") >= lo[:PERIOD])
    if hi is not None:
        df = df.where(F.col("period") <= hi[:PERIOD])
    return df if country is None else df.where(F.col("country") == country)


def sessions_in(states: DataFrame) -> int:
    """The number of sessions behind states, a proven bound for plans over the same range."""
    return states.agg(F.sum("sessions")).first()[0] or 0


def merged(measure: str) -> dict[str, Column]:
    """Aggregates over state rows: ``count, sum, avg, min, max, sko, koef_var`` of a measure."""
    scale = MEASURES[measure][1]
    n, total = F.sum(f"n_{measure}"), F.sum(f"sum_{measure}").cast("double")
    mean = total / F.nullif(n, F.lit(0)) / F.lit(scale)
    std = std_from_sums(f"SUM(n_{measure})", f"SUM(sum_{measure})", f"SUM(squares_{measure})", scale)
    return {"count": n, "sum": total / F.lit(scale), "avg": mean, "min": F.min(f"min_{measure}") / F.lit(scale),
            "max": F.max(f"max_{measure}") / F.lit(scale), "sko": std, "koef_var": ratio(std, mean)}


def merged_quantile(measure: str, q: float) -> Column:
    """A quantile of a measure from the merged sketches of state rows (see ``SKETCH_ERROR``)."""
    middle = F.kll_sketch_get_quantile_bigint(F.kll_merge_agg_bigint(f"sketch_{measure}"), F.lit(q))
    return F.when(F.sum(f"n_{measure}") > 0, middle) / F.lit(MEASURES[measure][1])


def daily_profile_of_states(states: DataFrame) -> DataFrame:
    """Revenue per day over the sessions that have some: ``date, count, avg, min, max, sko, koef_var``
    (untrimmed: the trim's limits depend on the rows of the whole range)."""
    m = merged("revenue")
    columns = ("count", "avg", "min", "max", "sko", "koef_var")
    return states.groupBy("date").agg(*[m[c].alias(c) for c in columns]).where("count > 0").orderBy("date")


def weekly_dynamics_of_states(states: DataFrame) -> DataFrame:
    """``weekly_dynamics`` from states."""
    m = merged("revenue")
    out = states.groupBy(week_start_sunday(parse_day("date")).alias("date")).agg(
        m["sum"].alias("revenue_sum"), m["avg"].alias("revenue_avg"), F.sum("sum_timeOnSite").cast("bigint").alias("sum_timeOnSite"))
    return out.orderBy("date")


def segment_report_of_states(states: DataFrame, by: Sequence[str] = ("channelGrouping", "operatingSystem"),
                             min_count: int = SEGMENT_MIN_COUNT, median_method: str | None = None) -> DataFrame:
    """``segment_report`` from states, without medians unless ``median_method`` is ``'sketch'``."""
    if median_method not in (None, "sketch"):
        raise ValueError("states have medians by 'sketch' only")
    r = merged("revenue")
    money, new = F.sum("sum_revenue"), F.sum("new_revenue")
    aggs = {"count_parted": F.sum("keyed"), "sum_new_visits": F.sum("new_visits"), "sum_revenue": r["sum"],
            "percent_revenue_from_new": ratio(new, money), "revenue_to_parted_all": ratio(r["count"], F.sum("keyed")),
            "sum_pageviews": F.sum("sum_pageviews").cast("bigint")}
    aggs |= {f"koef_var_{m}": merged(m)["koef_var"] for m in MEASURES}
    if median_method:
        aggs |= {f"median_{m.lower()}": merged_quantile(m, 0.5) for m in MEASURES}
    seg, seen = write_table(states.groupBy(*by).agg(*[e.alias(n) for n, e in aggs.items()]), "segments",
                            observe={"total": F.sum("count_parted")})
    out = seg.withColumn("count_parted_to_all", ratio("count_parted", F.lit(seen["total"] or 0)))
    return out.where(F.col("count_parted") >= F.lit(min_count)).orderBy(F.col("sum_revenue").desc_nulls_last(), *by)
