"""Group profiles, numeric summaries and frequency tables.

All statistics are partial aggregates (map-side combine, one shuffle of
per-task partial rows). Exact medians and quartiles (``PERCENTILE_CONT``);
null and NaN are missing values for every method:

* ``'distributed'``: the quantile operator of ``quantile.py``, which never
  gathers a group into one task (for inputs of any size);
* ``'builtin'``: Spark's exact ``percentile``; its buffers hold the distinct
  values of the groups of a task, so it is for inputs of bounded size;
* ``'auto'`` (default): ``'builtin'`` when all values together - rows times
  median columns - are at most ``BUILTIN_MAX_VALUES``, which bounds what any
  one task can hold, else ``'distributed'``. Both give identical values (same
  interpolation, same missing values), so the size chooses the plan and never
  the answer. The rows are counted by the aggregate that computes the other
  statistics; nothing is copied for it.
* ``'approx'``: ``percentile_approx`` (not exact; opt-in).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from visitstat.functions import ratio
from visitstat.operators.attach import BROADCAST_MAX_ROWS, null_safe_on
from visitstat.session import write_table
from visitstat.operators.quantile import exact_quantiles, quantiles_long

_ALL = "__all"
MEDIAN_METHODS = ("auto", "distributed", "builtin", "approx")
# Most values (rows times columns) whose exact quantiles 'auto' leaves to Spark's
# percentile: no task can hold more, whatever the groups.
BUILTIN_MAX_VALUES = 2_000_000


def _present(df: DataFrame, c: str) -> Column:
    """The column with NaN as null."""
    x = F.col(c)
    if isinstance(df.schema[c].dataType, (T.FloatType, T.DoubleType)):
        return F.nanvl(x, F.lit(None).cast(df.schema[c].dataType))
    return x


def _quantile_agg(x: Column, q: float, method: str) -> Column:
    if method == "builtin":
        return F.percentile(x, F.lit(q))
    return F.percentile_approx(x, F.lit(q), F.lit(10_000)).cast("double")


def _distributed_medians(rows: DataFrame, by: list[str], medians: dict[str, str], max_rows: int) -> DataFrame:
    cols = sorted(set(medians.values()))
    med = exact_quantiles(rows, by, cols, (0.5,), name=lambda c, q: f"__med_{c}", max_rows=max_rows)
    return med.select(*by, *[F.col(f"__med_{c}").alias(n) for n, c in medians.items()])


def _keyed(df: DataFrame, by: list[str]) -> tuple[DataFrame, list[tuple[str, str]]]:
    """``df`` with its key columns renamed apart, for a null-safe join on them."""
    names = [f"__k_{i}" for i in range(len(by))]
    return df.select(*[F.col(k).alias(n) for k, n in zip(by, names)],
                     *[c for c in df.columns if c not in by]), list(zip(by, names))


def summarize(df: DataFrame, by: Sequence[str], aggs: Mapping[str, Column],
              medians: Mapping[str, str] | None = None, median_method: str = "auto",
              max_rows: int = BROADCAST_MAX_ROWS,
              rows_bound: int | None = None) -> DataFrame:
    """``groupBy(by).agg(aggs)`` plus exact medians, one row per group.

    ``medians`` maps an output name to the input column whose median it is.
    Output columns: ``by``, then ``aggs`` in order, then ``medians`` in order.

    With ``median_method='auto'`` the aggregate also counts the rows, and that
    count chooses how the medians are computed (see the module text);
    ``rows_bound``, an upper bound on the input rows known to the caller, lets it
    take the one-aggregate plan at once when it is small enough.
    """
    if median_method not in MEDIAN_METHODS:
        raise ValueError(f"median_method must be one of {MEDIAN_METHODS}")
    by, medians = list(by), dict(medians or {})
    keyless = not by
    if keyless:  # one group: give it a constant key so the joins below have one
        df, by = df.withColumn(_ALL, F.lit(0)), [_ALL]
    agg_exprs = [e.alias(n) for n, e in aggs.items()]
    if median_method == "auto" and rows_bound is not None and rows_bound * len(medians) <= BUILTIN_MAX_VALUES:
        median_method = "builtin"  # no task can hold more than the whole input

    def meds(method: str) -> list[Column]:
        return [_quantile_agg(_present(df, c), 0.5, method).alias(n) for n, c in medians.items()]

    if not medians or median_method in ("builtin", "approx"):
        out = df.groupBy(*by).agg(*agg_exprs, *(meds(median_method) if medians else []))
    else:
        base, seen = write_table(df.groupBy(*by).agg(*agg_exprs, F.count(F.lit(1)).alias("__rows")), "groups",
                                 observe={"rows": F.sum("__rows")})
        if median_method == "auto" and (seen["rows"] or 0) * len(medians) <= BUILTIN_MAX_VALUES:
            med = df.groupBy(*by).agg(*meds("builtin"))
        else:
            med = _distributed_medians(df, by, medians, max_rows)
        # Both sides hold one row per group: a shuffle join on the group key,
        # turned into a broadcast by AQE when the measured side is small.
        med_k, pairs = _keyed(med, by)
        out = base.join(med_k, null_safe_on(base, med_k, pairs), "left").drop(*[p[1] for p in pairs])
    out = out.select(*by, *aggs.keys(), *medians.keys())
    return out.drop(_ALL) if keyless else out


PROFILE_METRICS = ("count", "avg", "median", "min", "max", "sko", "koef_var")


def exact_sum_avg(units: str, scale: float) -> tuple[Column, Column]:
    """Sum and average of ``units / scale`` from an integer column (money kept in
    integer micro-units): the sum is exact in 38 digits, so both results are
    independent of row order and do not overflow."""
    total = big_sum(units).cast("double")
    return total / F.lit(scale), total / F.count(units) / F.lit(scale)


def big_sum(units: str) -> Column:
    """Exact sum of an integer column in 38 digits (a bigint sum would overflow at scale)."""
    return F.sum(F.col(units).cast("decimal(38,0)"))


def std_from_sums(n: str, total: str, squares: str, scale: float = 1.0) -> Column:
    """Sample standard deviation from SQL texts of a count, a sum and a sum of squares of integers
    (38 digits), the same to the last bit in any row order: null below two values.

    With m = total div n and r = total - m * n the squared deviations from m add up to
    squares - m * m * n - 2 * m * r, an integer no larger than the squares; only r * r / n and the last
    division are floating point. Squares of 13-digit money in micro-units fit for 10^12 rows; beyond
    38 digits ANSI mode raises."""
    m = f"CAST({total} DIV NULLIF({n}, 0) AS DECIMAL(20, 0))"
    r = f"({total} - {m} * {n})"
    around = F.expr(f"{squares} - {m} * {m} * {n} - 2 * {m} * {r}").cast("double")
    rest, count = F.expr(r).cast("double"), F.expr(n)
    variance = (around - rest * rest / F.nullif(count, F.lit(0))) / F.nullif(count - F.lit(1), F.lit(0))
    return F.sqrt(variance) / F.lit(float(scale))


def exact_std(units: str, scale: float = 1.0) -> Column:
    """Sample standard deviation of ``units / scale`` from an integer column (see ``std_from_sums``)."""
    x = f"CAST(`{units}` AS DECIMAL(20, 0))"
    return std_from_sums(f"COUNT(`{units}`)", f"SUM(CAST(`{units}` AS DECIMAL(38, 0)))", f"SUM({x} * {x})", scale)


def exact_variation(units: str, scale: float = 1.0) -> Column:
    """``exact_std`` over the exact average (null when that is 0)."""
    return ratio(exact_std(units, scale), exact_sum_avg(units, scale)[1])


def group_profile(df: DataFrame, by: Sequence[str], value: str,
                  metrics: Sequence[str] = PROFILE_METRICS, median_method: str = "auto",
                  max_rows: int = BROADCAST_MAX_ROWS, exact: tuple[str, float] | None = None,
                  rows_bound: int | None = None) -> DataFrame:
    """Per-group profile of ``value``: count (non-null), avg, exact median, min,
    max, sample stddev (``sko``), coefficient of variation ``sko/avg``
    (null when avg is 0), ``sum``. Output in ``by`` + ``metrics`` order.

    ``exact=(integer column, scale)`` says ``value`` is that column divided by
    ``scale``; ``sum``, ``avg`` and the deviations are then taken from integer sums, exact
    and independent of row order."""
    v = F.col(value)
    total, mean = exact_sum_avg(*exact) if exact else (F.sum(v), F.avg(v))
    std = exact_std(*exact) if exact else F.stddev_samp(v)
    exprs = {
        "count": F.count(v), "avg": mean, "min": F.min(v), "max": F.max(v),
        "sko": std, "koef_var": ratio(std, mean), "sum": total,
    }
    unknown = set(metrics) - set(exprs) - {"median"}
    if unknown:
        raise ValueError(f"unknown metrics {sorted(unknown)}")
    aggs = {m: exprs[m] for m in metrics if m != "median"}
    meds = {"median": value} if "median" in metrics else {}
    out = summarize(df, by, aggs, meds, median_method=median_method, max_rows=max_rows, rows_bound=rows_bound)
    return out.select(*by, *metrics)


DESCRIBE_COLUMNS = ("column", "count", "mean", "std", "min", "p25", "p50", "p75", "max")


def describe(df: DataFrame, cols: Sequence[str] | None = None, median_method: str = "auto",
             max_rows: int = BROADCAST_MAX_ROWS, scales: Mapping[str, float] | None = None) -> DataFrame:
    """Numeric summary, one row per column: count, mean, std (sample), min,
    exact 25/50/75 % (linear interpolation), max. Nulls and NaN are missing
    values, per column (columns may have different counts).

    Mean and standard deviation of integer columns come from integer sums, exact in any row order; so do
    those of a column in ``scales``, which says that it holds integers divided by that number.

    One pass computes all simple statistics as a single wide aggregate (one
    row of numbers, returned to the driver); a second pass computes the
    quartiles of all columns, one ``percentile`` per column when all columns
    together have at most ``BUILTIN_MAX_VALUES`` values ('auto'), else with the
    distributed quantile operator.
    """
    numeric = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
    cols = list(cols) if cols is not None else [
        f.name for f in df.schema.fields if isinstance(f.dataType, numeric)]
    if not cols:
        raise ValueError("no numeric column to describe")
    kinds = {f.name: f.dataType for f in df.schema.fields}

    def clean(c: str) -> Column:
        x = F.col(c).cast("double")
        return F.nanvl(x, F.lit(None).cast("double")) if isinstance(kinds[c], (T.FloatType, T.DoubleType)) else x

    if median_method not in MEDIAN_METHODS:
        raise ValueError(f"median_method must be one of {MEDIAN_METHODS}")
    whole = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    scales = {c: 1.0 for c in cols if isinstance(kinds[c], whole)} | dict(scales or {})
    units = {c: f"__units_{c}" for c in cols if c in scales}
    both = df.select(*[clean(c).alias(c) for c in cols],
                     *[F.round(clean(c) * F.lit(scales[c])).cast("decimal(20,0)").alias(u) if scales[c] != 1.0 else F.col(c).alias(u)
                       for c, u in units.items()])
    xs = both.select(*cols)
    # Pass 1: all simple statistics in one aggregate, a row of 5 numbers per column.
    def mean(c: str) -> Column:
        return exact_sum_avg(units[c], scales[c])[1] if c in units else F.avg(c)

    def std(c: str) -> Column:
        return exact_std(units[c], scales[c]) if c in units else F.stddev_samp(c)

    wide = both.agg(*[e for c in cols for e in (
        F.count(c).alias(f"{c}__count"), mean(c).alias(f"{c}__mean"), std(c).alias(f"{c}__std"),
        F.min(c).alias(f"{c}__min"), F.max(c).alias(f"{c}__max"))]).first()
    simple = df.sparkSession.createDataFrame(
        [(c, wide[f"{c}__count"], wide[f"{c}__mean"], wide[f"{c}__std"], wide[f"{c}__min"], wide[f"{c}__max"])
         for c in cols],
        "column string, count bigint, mean double, std double, min double, max double")
    # All buffers meet in one task: the values of all columns bound it.
    if median_method == "auto":
        values = sum(wide[f"{c}__count"] for c in cols)
        median_method = "builtin" if values <= BUILTIN_MAX_VALUES else "distributed"

    # Pass 2: the quartiles of all columns.
    if median_method == "distributed":
        qs = quantiles_long(xs, [], cols, (0.25, 0.5, 0.75), max_rows=max_rows)
        quart = qs.groupBy("column").agg(
            *[F.max(F.when(F.col("q") == F.lit(q), F.col("value"))).alias(n)
              for q, n in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75"))])
    else:
        qs = F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))
        quart = xs.agg(*[(F.percentile(c, qs) if median_method == "builtin" else F.percentile_approx(c, qs, F.lit(10_000)))
                         .alias(c) for c in cols])
        quart = quart.select(F.inline(F.array(*[F.struct(
            F.lit(c).alias("column"), *[F.get(F.col(c), F.lit(i)).alias(n) for i, n in enumerate(("p25", "p50", "p75"))])
            for c in cols])))
    # Both sides have one row per described column: a bounded broadcast.
    out = simple.join(F.broadcast(quart), "column", "left")
    return out.select(*DESCRIBE_COLUMNS)


def frequency(df: DataFrame, key: str | Column, name: str | None = None, count_of: str | Column | None = None,
              count_name: str = "count") -> DataFrame:
    """Group by one key (a null key is a group) and count ``count_of`` (non-null rows)."""
    k = F.col(key) if isinstance(key, str) else key
    name = name or (key if isinstance(key, str) else None)
    if name is None:
        raise ValueError("name the key column")
    cnt = F.count(F.lit(1)) if count_of is None else F.count(
        F.col(count_of) if isinstance(count_of, str) else count_of)
    return df.groupBy(k.alias(name)).agg(cnt.alias(count_name))
