"""Day-sharded session tables: read a suffix range, write shards, preview rows, number series."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SUFFIX = "table_suffix"

# Nested session record, one row per web session (field names are the input's).
TOTALS = T.StructType([
    T.StructField("totalTransactionRevenue", T.LongType()),
    T.StructField("visits", T.LongType()),
    T.StructField("hits", T.LongType()),
    T.StructField("pageviews", T.LongType()),
    T.StructField("timeOnSite", T.LongType()),
    T.StructField("newVisits", T.LongType()),
])
SESSION_SCHEMA = T.StructType([
    T.StructField("fullVisitorId", T.StringType()),
    T.StructField("visitId", T.LongType()),
    T.StructField("date", T.StringType()),
    T.StructField("channelGrouping", T.StringType()),
    T.StructField("totals", TOTALS),
    T.StructField("trafficSource", T.StructType([T.StructField("source", T.StringType())])),
    T.StructField("device", T.StructType([
        T.StructField("browser", T.StringType()),
        T.StructField("operatingSystem", T.StringType()),
        T.StructField("deviceCategory", T.StringType()),
    ])),
    T.StructField("geoNetwork", T.StructType([T.StructField("country", T.StringType())])),
])
SHARDED_SCHEMA = T.StructType(SESSION_SCHEMA.fields + [T.StructField(SUFFIX, T.StringType(), False)])


def suffix_range(df: DataFrame, lo: str | None = None, hi: str | None = None) -> DataFrame:
    """Keep rows whose suffix lies in [lo, hi], compared as text.

    Bounds need not be real days ('20170631' is fine). On a table partitioned
    by the suffix this becomes a partition filter, so other days are never listed.
    """
    s = F.col(SUFFIX)
    if lo is not None and hi is not None:
        return df.where(s.between(F.lit(lo), F.lit(hi)))
    if lo is not None:
        return df.where(s >= F.lit(lo))
    if hi is not None:
        return df.where(s <= F.lit(hi))
    return df


def digit_range_globs(lo: str, hi: str) -> list[str]:
    """Glob patterns matching exactly the digit strings s, len(s) == len(lo),
    with lo <= s <= hi (text order, which is numeric order at equal length).

    E.g. ('20170601', '20170631') -> ['2017060[1-9]', '201706[1-2][0-9]', '2017063[0-1]'].
    """
    if len(lo) != len(hi) or not (lo + hi).isdigit() or lo > hi:
        raise ValueError("bounds must be digit strings of equal length, lo <= hi")

    def cls(a: str, b: str) -> str:
        return a if a == b else f"[{a}-{b}]"

    def split(a: str, b: str) -> list[str]:
        if a == b:
            return [a]
        i = next(k for k in range(len(a)) if a[k] != b[k])
        p, r = a[:i], len(a) - i - 1
        x, y = a[i], b[i]
        if a[i + 1:] == "0" * r and b[i + 1:] == "9" * r:
            return [p + cls(x, y) + "[0-9]" * r]
        out = []
        if a[i + 1:] == "0" * r:
            first = x
        else:
            out += split(a, p + x + "9" * r)
            first = chr(ord(x) + 1)
        if b[i + 1:] == "9" * r:
            last = y
        else:
            last = chr(ord(y) - 1)
        if first <= last:
            out.append(p + cls(first, last) + "[0-9]" * r)
        if b[i + 1:] != "9" * r:
            out += split(p + y + "0" * r, b)
        return out

    return split(lo, hi)


def read_shards(spark: SparkSession, root: str, lo: str | None = None, hi: str | None = None,
                schema: T.StructType = SHARDED_SCHEMA, digit_glob: bool = False) -> DataFrame:
    """Scan the shards under ``root`` (``table_suffix=...`` folders) with a suffix in [lo, hi].

    The range is compared as text, both ends included, and applied as a
    partition filter: folders of any name are compared alike, and files
    outside the range are never opened. The explicit schema keeps the suffix a
    string whatever the session's partition-type inference says. A root that
    does not exist is an error, with and without bounds.

    ``digit_glob`` (only on request) lists the folders of the range through one
    glob instead of listing all of them. It is right only where every folder is
    named by digits of the bounds' length, which the caller asserts; bounds
    that are not digits of equal length are an error.
    """
    reader = spark.read.schema(schema).option("basePath", root)
    if digit_glob:
        if lo is None or hi is None or len(lo) != len(hi) or not (lo + hi).isdigit():
            raise ValueError("digit_glob needs two digit bounds of equal length")
        if lo <= hi:
            try:
                path = f"{root.rstrip('/')}/{SUFFIX}={{{','.join(digit_range_globs(lo, hi))}}}"
                return suffix_range(reader.parquet(path), lo, hi)
            except AnalysisException as e:
                if "PATH_NOT_FOUND" not in str(e):
                    raise                      # no folder in range: the root decides below
    return suffix_range(reader.parquet(root), lo, hi)


# Layout inside a day: the predicates of the reports skip what cannot match.
SORTED_BY = ("geoNetwork.country",)
BLOOM_VALUES = 1_000         # different values of a column that its Bloom filters are made for


def write_shards(df: DataFrame, root: str, mode: str = "days", partitions: int | None = None, table: str | None = None,
                 states: str | None = None, sort_by: Sequence[str] = SORTED_BY, options: Mapping[str, str] | None = None) -> list[str]:
    """Write session rows as one folder per day suffix; returns the suffixes that were written.

    ``mode="days"`` (default) writes the days present in ``df``, replacing each
    of them if it exists and leaving every other day as it is; any of Spark's
    save modes may be given instead ('errorifexists', 'append', 'overwrite' of the
    whole table).

    Range partitioning on (suffix, ``sort_by``, visit id) gives each task a contiguous run
    of days and splits a crowded day over several tasks, so a hot day never
    lands in a single writer and each day gets few files. Inside a day rows are sorted by ``sort_by``
    (fields of the record) and files carry Bloom filters of these: a filter on one
    of them reads only the files, row groups and pages whose statistics admit its value.
    ``options`` go to the Parquet writer.

    ``table`` names a catalog table over ``root`` (``register_shards``) that gets the new
    days, ``states`` a folder of states (``operators.states``) that is refreshed for the days written.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    seen = Observation(f"days_{uuid.uuid4().hex}")
    days = df.observe(seen, F.collect_set(SUFFIX).alias("days"))
    order = [F.col(SUFFIX), *[F.col(c) for c in sort_by], F.col("visitId")]
    ranged = days.repartitionByRange(n, *order).sortWithinPartitions(*order)
    blooms = {f"parquet.bloom.filter.{k}#{c}": v for c in sort_by for k, v in (("enabled", "true"), ("expected.ndv", str(BLOOM_VALUES)))}
    writer = ranged.write.partitionBy(SUFFIX).options(**blooms, **(options or {}))
    if mode == "days":
        writer = writer.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    else:
        writer = writer.mode(mode).option("partitionOverwriteMode", "static")
    writer.parquet(root)
    written = sorted(seen.get["days"])
    if table is not None:
        add_days(df.sparkSession, table, root, written)
    if states is not None:
        from visitstat.operators.states import refresh_states
        refresh_states(df.sparkSession, root, states, written)
    return written


def register_shards(spark: SparkSession, root: str, table: str, schema: T.StructType = SHARDED_SCHEMA) -> DataFrame:
    """A table of the session catalog over the shards below ``root``, every day folder a partition of it.

    Its partitions are found once, here; later a suffix range asks the catalog for them and lists only their
    files. ``write_shards(table=...)`` adds the days it writes."""
    data = T.StructType([f for f in schema.fields if f.name != SUFFIX])
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in data.fields)
    spark.sql(f"CREATE TABLE {table} ({columns}, `{SUFFIX}` string) USING parquet PARTITIONED BY (`{SUFFIX}`) LOCATION '{root}'")
    spark.sql(f"MSCK REPAIR TABLE {table}")
    return spark.table(table)


def add_days(spark: SparkSession, table: str, root: str, days: list[str]) -> None:
    """Tell the catalog table of ``root`` about day folders (known ones are left)."""
    for i in range(0, len(days), 500):
        parts = " ".join(f"PARTITION (`{SUFFIX}` = '{d}') LOCATION '{root.rstrip('/')}/{SUFFIX}={d}'" for d in days[i:i + 500])
        spark.sql(f"ALTER TABLE {table} ADD IF NOT EXISTS {parts}")
    spark.catalog.refreshTable(table)


def read_table(spark: SparkSession, table: str, lo: str | None = None, hi: str | None = None) -> DataFrame:
    """The shards with a suffix in [lo, hi] (as text) of a catalog table; no folder outside the range is listed."""
    return suffix_range(spark.table(table), lo, hi)


def preview_rows(df: DataFrame, key: list[str], fields: list[str] | None = None,
                 start: int = 0, n: int = 10) -> DataFrame:
    """Rows ``start``..``start+n-1`` in ``key`` order (a repeatable ``list_rows``).

    Planned as a per-partition top-(start+n) followed by one small merge.
    """
    out = df.select(*(fields or df.columns)) if fields else df
    return out.orderBy(*key).offset(start).limit(n)


def number_series(spark: SparkSession, a: int, b: int, step: int = 1, name: str = "num") -> DataFrame:
    """Integers a, a+step, ..., up to b inclusive, generated in parallel."""
    return spark.range(a, b + 1, step).withColumnRenamed("id", name)


def schema_fields(df: DataFrame) -> list[tuple[str, str, bool]]:
    """Flattened schema of a session table: (dotted field path, type, nullable).

    The listing of a table's schema (nested records included); it reads
    metadata only, so nothing is scanned.
    """
    out: list[tuple[str, str, bool]] = []

    def walk(prefix: str, st: T.StructType) -> None:
        for f in st.fields:
            path = f"{prefix}{f.name}"
            if isinstance(f.dataType, T.StructType):
                walk(path + ".", f.dataType)
            else:
                out.append((path, f.dataType.simpleString(), f.nullable))

    walk("", df.schema)
    return out


def list_tables(spark: SparkSession, database: str | None = None) -> list[str]:
    """Names of the tables and views of a database in the session catalog."""
    return [t.name for t in spark.catalog.listTables(database)]
