"""Exact interpolated quantiles per group (PERCENTILE_CONT), distributed.

Spark's exact ``percentile`` keeps every distinct value of a group in one
aggregation buffer, so a group holding a third of all rows would have to fit
one task. This operator never gathers a group:

1. values of all requested columns are unpivoted and pre-aggregated to
   (group, column, value, count) - a map-side combine that shrinks repeated
   values (counts, small integers) to one row per task;
2. the distinct values are range-partitioned on (group, column, value), which
   splits a crowded group over many partitions, and written out once with
   their partition id so that every later step sees the same layout;
3. per (partition, group, column) weights give each segment its starting
   rank within the group (a window over at most #partitions rows per group);
4. only the segments that contain a wanted rank are re-read, ordered inside
   the segment (bounded by one partition) and the values at the wanted ranks
   picked out; at most two per quantile and group reach the final step.

Interpolation follows ``PERCENTILE_CONT``: position p = (n-1)*q, value
x[floor p] * (1 - d) + x[ceil p] * d with d = p - floor p. Nulls and NaN are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from visitstat.operators.attach import BROADCAST_MAX_ROWS, attach, materialize

_M, _X, _C, _PID, _W, _N, _START, _RANKS, _R = (
    "__m", "__x", "__c", "__pid", "__w", "__n", "__start", "__ranks", "__r")


def quantiles_long(df: DataFrame, keys: Sequence[str], cols: Sequence[str],
                   qs: Sequence[float] = (0.5,), max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Rows (keys..., column, q, value): exact quantile ``q`` of ``column`` per key group."""
    keys, cols, qs = list(keys), list(cols), [float(q) for q in qs]
    for q in qs:
        if not 0.0 <= q <= 1.0:
            raise ValueError(f"quantile {q} outside [0, 1]")

    long = (df.select(*keys, *[F.col(c).cast("double").alias(c) for c in cols])
              .unpivot(keys, cols, _M, _X)
              .where(F.col(_X).isNotNull() & ~F.isnan(_X)))

    # 1-2: pre-aggregate equal values, then range-partition and pin the layout.
    counted = long.groupBy(*keys, _M, _X).agg(F.count(F.lit(1)).alias(_C))
    ranged = materialize(
        counted.repartitionByRange(*keys, _M, _X).withColumn(_PID, F.spark_partition_id()))

    # 3: segment weights -> first rank of each segment inside its group.
    grp = Window.partitionBy(*keys, _M)
    seg = (ranged.groupBy(_PID, *keys, _M).agg(F.sum(_C).alias(_W))
           .withColumn(_N, F.sum(_W).over(grp))
           .withColumn(_START, F.sum(_W).over(grp.orderBy(_PID).rowsBetween(Window.unboundedPreceding, 0))
                       - F.col(_W)))
    wanted = []
    for q in qs:
        pos = (F.col(_N) - F.lit(1)).cast("double") * F.lit(q)
        wanted += [F.floor(pos), F.ceil(pos)]
    lo, hi = F.col(_START), F.col(_START) + F.col(_W)
    targets = (seg.withColumn(_RANKS, F.array_distinct(
                    F.filter(F.array(*wanted), lambda r: (r >= lo) & (r < hi))))
               .where(F.size(_RANKS) > 0)
               .select(_PID, *keys, _M, _N, _START, _RANKS))

    # 4: read back only the wanted segments and pick the values at the ranks.
    cand = attach(ranged, targets, [_PID, *keys, _M], max_rows=max_rows)
    in_seg = Window.partitionBy(_PID, *keys, _M).orderBy(_X).rowsBetween(Window.unboundedPreceding, 0)
    end = F.col(_START) + F.sum(_C).over(in_seg)
    hits = (cand.withColumn("__end", end)
            .withColumn("__beg", F.col("__end") - F.col(_C))
            .select(*keys, _M, _N, _X, F.explode(F.filter(
                _RANKS, lambda r: (r >= F.col("__beg")) & (r < F.col("__end")))).alias(_R)))

    vals = hits.groupBy(*keys, _M).agg(
        F.first(_N).alias(_N),
        F.map_from_entries(F.collect_list(F.struct(_R, _X))).alias("__vals"))
    outs = []
    for q in qs:
        pos = (F.col(_N) - F.lit(1)).cast("double") * F.lit(q)
        lower, higher = F.floor(pos), F.ceil(pos)
        xl, xh = F.element_at("__vals", lower), F.element_at("__vals", higher)
        value = (F.when((lower == higher) | (xl == xh), xl)
                 .otherwise(xl * (F.lit(1.0) - (pos - lower.cast("double")))
                            + xh * (pos - lower.cast("double"))))
        outs.append(F.struct(F.lit(q).alias("q"), value.alias("value")))
    return (vals.select(*keys, F.col(_M).alias("column"), F.inline(F.array(*outs))))


def exact_quantiles(df: DataFrame, keys: Sequence[str], cols: Sequence[str],
                    qs: Sequence[float] = (0.5,),
                    name: Callable[[str, float], str] | None = None,
                    max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """One row per key group with a column per (column, q), named by ``name``."""
    name = name or (lambda c, q: f"{c}_p{int(round(q * 100))}")
    long = quantiles_long(df, keys, cols, qs, max_rows)
    aggs = [F.max(F.when((F.col("column") == F.lit(c)) & (F.col("q") == F.lit(float(q))), F.col("value")))
            .alias(name(c, q)) for c in cols for q in qs]
    return long.groupBy(*keys).agg(*aggs)


def medians(df: DataFrame, keys: Sequence[str], cols: Sequence[str],
            name: Callable[[str], str] = lambda c: f"median_{c}") -> DataFrame:
    """Exact medians of ``cols`` per key group."""
    return exact_quantiles(df, keys, cols, (0.5,), name=lambda c, q: name(c))
