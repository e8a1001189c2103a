"""Equal-width histograms, per-group bin plans and the session x bin expansion."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from visitstat.functions import LN_BIN_A, LN_BIN_B, STURGES_A, STURGES_B
from visitstat.operators.attach import BROADCAST_MAX_ROWS, attach
from visitstat.operators.profile import exact_std, exact_sum_avg, summarize

HISTOGRAM_COLUMNS = ("bin", "bin_lo", "bin_hi", "count", "density")


def sturges(n: int) -> int:
    """Bin count ceil(1 + 3.32 * log10(n)), evaluated as Python/numpy would."""
    if n <= 0:
        raise ValueError("no values")
    return math.ceil(STURGES_A + STURGES_B * math.log10(n))


def histograms(df: DataFrame, specs: Sequence[tuple[str, bool]], bins: int | None = None) -> DataFrame:
    """Equal-width histograms, ``density=True`` style, of several columns at once.

    ``specs`` lists (column, log10) pairs. Rows: ``column``, ``scale``
    ('raw' or 'log10'), ``bin`` 0..k-1, edges ``bin_lo``/``bin_hi``,
    ``count`` and ``density = count / width / total`` (empty bins kept).

    * missing values (null, NaN) are left out per column; an infinite value is
      an error, as in numpy (no range can be cut into equal bins);
    * ``bins`` defaults to ceil(1 + 3.32 * log10(n)), n = values present in
      the column;
    * with log10 the histogram is of log10(x) over x > 0 only (no logarithm
      for 0 or less); the bin count still comes from n;
    * edges are min..max; if they are equal the range is widened by 0.5 on
      each side; the last bin is closed; bin placement and edges follow
      numpy's ``histogram``: index floor((x - lo) / (hi - lo) * k), edge
      i = i * ((hi - lo) / k) + lo, and the same one-step correction for
      values that sit on an edge.

    Plan, whatever the number of histograms: one global aggregate (counts,
    minima, maxima: one row of numbers to the driver), then one pass that
    unpivots the values to (histogram, value), bins them and counts per
    (histogram, bin) with partial aggregation; only bin counts are shuffled.
    """
    spark = df.sparkSession
    schema = T.StructType([
        T.StructField("column", T.StringType()), T.StructField("scale", T.StringType()),
        T.StructField("bin", T.LongType()), T.StructField("bin_lo", T.DoubleType()),
        T.StructField("bin_hi", T.DoubleType()), T.StructField("count", T.LongType()),
        T.StructField("density", T.DoubleType())])
    specs = [(c, bool(lg)) for c, lg in specs]
    cols = list(dict.fromkeys(c for c, _ in specs))

    def raw(c):
        x = F.col(c).cast("double")
        return F.when(x.isNotNull() & ~F.isnan(x), x)

    def value(c, lg):
        return F.when(raw(c) > F.lit(0), F.log10(raw(c))) if lg else raw(c)

    aggs = [F.count(raw(c)).alias(f"n_raw_{j}") for j, c in enumerate(cols)]
    for i, (c, lg) in enumerate(specs):
        v = value(c, lg)
        aggs += [F.count(v).alias(f"n_{i}"), F.min(v).alias(f"lo_{i}"), F.max(v).alias(f"hi_{i}")]
    st = df.agg(*aggs).first()

    params = {}  # histogram index -> (k, first, last, step, denom, n)
    for i, (c, lg) in enumerate(specs):
        n_raw, n = st[f"n_raw_{cols.index(c)}"], st[f"n_{i}"]
        if n_raw == 0 or n == 0:
            continue
        k = int(bins) if bins is not None else sturges(n_raw)
        first, last = float(st[f"lo_{i}"]), float(st[f"hi_{i}"])
        if math.isinf(first) or math.isinf(last):
            raise ValueError(f"column {c!r}: the range [{first}, {last}] is not finite")
        if first == last:
            first, last = first - 0.5, last + 0.5
        params[i] = (k, first, last, (last - first) / k, last - first, n)
    if not params:
        return spark.createDataFrame([], schema)

    # One row of parameters per histogram (a table bounded by len(specs)).
    par = spark.createDataFrame(
        [(i, p[0], p[1], p[2], p[3], p[4], float(p[5]), c, "log10" if lg else "raw")
         for i, p in params.items() for c, lg in [specs[i]]],
        "__h int, __k bigint, __first double, __last double, __step double, __denom double, __n double, "
        "column string, scale string")

    def edge(i):  # i: bigint column; the last edge is the maximum itself
        return F.when(i >= F.col("__k"), F.col("__last")).otherwise(
            i.cast("double") * F.col("__step") + F.col("__first"))

    x = F.col("__x")
    pairs = F.array(*[F.struct(F.lit(i).alias("__h"), value(c, lg).alias("__x"))
                      for i, (c, lg) in enumerate(specs) if i in params])
    vals = (df.select(F.inline(pairs)).where(x.isNotNull())
            .join(F.broadcast(par.select("__h", "__k", "__first", "__last", "__step", "__denom")), "__h"))
    # Bin index in steps (each step reads the previous column, nothing is repeated).
    i0 = F.floor((x - F.col("__first")) / F.col("__denom") * F.col("__k").cast("double"))
    vals = vals.withColumn("__i0", F.least(i0, F.col("__k") - F.lit(1)))
    vals = vals.withColumn("__i1", F.when(x < edge(F.col("__i0")), F.col("__i0") - F.lit(1))
                           .otherwise(F.col("__i0")))
    vals = vals.withColumn("bin", F.when((x >= edge(F.col("__i1") + F.lit(1)))
                                         & (F.col("__i1") != F.col("__k") - F.lit(1)),
                                         F.col("__i1") + F.lit(1)).otherwise(F.col("__i1")).cast("bigint"))
    counts = vals.groupBy("__h", "bin").agg(F.count(F.lit(1)).alias("count"))
    # Every bin of every histogram, made in place from the parameter rows.
    grid = par.withColumn("bin", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__k") - F.lit(1))))
    out = (grid.join(counts, ["__h", "bin"], "left")
               .select("__h", "column", "scale", "bin",
                       edge(F.col("bin")).alias("bin_lo"), edge(F.col("bin") + F.lit(1)).alias("bin_hi"),
                       F.coalesce(F.col("count"), F.lit(0).cast("bigint")).alias("count"), "__n"))
    width = F.col("bin_hi") - F.col("bin_lo")
    return (out.select("column", "scale", "bin", "bin_lo", "bin_hi", "count",
                       (F.col("count").cast("double") / width / F.col("__n")).alias("density"), "__h")
               .orderBy("__h", "bin").drop("__h"))


def histogram(df: DataFrame, column: str, bins: int | None = None, log10: bool = False) -> DataFrame:
    """Histogram of one column (see ``histograms``): ``bin, bin_lo, bin_hi, count, density``."""
    return histograms(df, [(column, log10)], bins).select(*HISTOGRAM_COLUMNS)


BIN_PLAN_COLUMNS = ("count", "avg", "median", "sko", "over_test_min", "over_test_max", "over_test",
                    "step", "ceil", "sum_another_teor")


def bin_plan(df: DataFrame, by: Sequence[str], value: str, median_method: str = "auto",
             max_rows: int = BROADCAST_MAX_ROWS, exact: tuple[str, float] | None = None,
             rows_bound: int | None = None) -> DataFrame:
    """Per-group bin plan of ``value``: profile plus ``step`` = range / (1 + 3.5 ln N),
    ``ceil`` = ceil(1 + 3.5 ln N) bins (1 when the range is 0, step 0 then),
    ``sum_another_teor`` = 1 + 2 + ... + ceil. N = non-null values in the group.
    ``exact`` as in ``group_profile`` (average and deviation from integer sums)."""
    v = F.col(value)
    mean = exact_sum_avg(*exact)[1] if exact else F.avg(v)
    prof = summarize(df, by, {
        "count": F.count(v), "avg": mean, "sko": exact_std(*exact) if exact else F.stddev_samp(v),
        "over_test_min": F.min(v), "over_test_max": F.max(v), "over_test": F.count(v),
    }, {"median": value}, median_method=median_method, max_rows=max_rows,
        rows_bound=rows_bound).where(F.col("over_test") > 0)
    out = _with_bins(prof, "over_test", "over_test_min", "over_test_max")
    k = F.col("ceil")
    out = out.withColumn("sum_another_teor", ((k * (k + F.lit(1))) / F.lit(2)).cast("bigint"))
    return out.select(*by, *BIN_PLAN_COLUMNS)


def _with_bins(groups: DataFrame, n: str, low: str, high: str) -> DataFrame:
    """``step`` and ``ceil`` of each group from its count and range."""
    rng = F.col(high) - F.col(low)
    bins_f = F.lit(LN_BIN_A) + F.lit(LN_BIN_B) * F.ln(F.col(n).cast("double"))
    return (groups.withColumn("step", F.when(rng > F.lit(0), rng / bins_f).otherwise(F.lit(0.0)))
                  .withColumn("ceil", F.when(rng > F.lit(0), F.ceil(bins_f)).otherwise(F.lit(1)).cast("bigint")))


def bin_counts(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Per group: ``n``, ``low``, ``high``, ``step`` and ``ceil`` of ``bin_plan``, from one
    aggregate (count, minimum, maximum) without the profile's medians."""
    v = F.col(value)
    groups = df.groupBy(*by).agg(F.count(v).alias("n"), F.min(v).alias("low"), F.max(v).alias("high"))
    return _with_bins(groups.where(F.col("n") > 0), "n", "low", "high")


def place_in_bins(rows: DataFrame, counts: DataFrame, by: Sequence[str], value: str, index_col: str = "bin",
                  max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """One row per input row with a value: its own bin, 1..ceil, under ``bin_counts``.

    Bins are ``step`` wide from the group's minimum; the last one is closed (and may
    be shorter, ceil being rounded up). A group of equal values has the one bin 1."""
    c = counts.select(*by, F.col("low").alias("__low"), F.col("step").alias("__step"), F.col("ceil").alias("__ceil"))
    joined = attach(rows.where(F.col(value).isNotNull()), c, list(by), max_rows=max_rows)
    place = F.floor((F.col(value) - F.col("__low")) / F.when(F.col("__step") > 0, F.col("__step"))) + F.lit(1)
    return joined.withColumn(index_col, F.least(F.coalesce(place, F.lit(1)), F.col("__ceil")).cast("bigint")) \
                 .drop("__low", "__step", "__ceil")


def expand_bins(rows: DataFrame, plan: DataFrame, by: Sequence[str], index_col: str = "another_unnest",
                max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """One row per input row and bin index 1..ceil of its group (``explode(sequence)``).

    The plan has one row per group; it is attached with a checked broadcast,
    then each row is expanded in place: no shuffle of the expanded rows.
    """
    p = plan.select(*by, F.col("ceil").alias("__k"))
    joined = attach(rows, p, list(by), how="inner", max_rows=max_rows)
    return joined.withColumn(index_col, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("__k")))).drop("__k")

