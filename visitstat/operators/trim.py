"""Log-sigma outlier trim: keep rows whose ln(value) is near the group's mean ln."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitstat.functions import LOG_SIGMA_K
from visitstat.operators.attach import BROADCAST_MAX_ROWS, attach_observed


def log_trim(df: DataFrame, value: str, by: Sequence[str] = (), k: float = LOG_SIGMA_K,
             log_col: str = "logtar", avg_col: str = "log_avg", sko_col: str = "log_sko",
             max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Rows with ``|ln(value) - avg_g| < k * stddev_g``, statistics per group ``by``.

    * only rows with ``value > 0`` take part (null, NaN and non-positive values
      have no logarithm and are left out before the statistics);
    * the test is strict, so a group whose sample stddev is null (one row)
      or 0 (all values equal) keeps no row;
    * the per-group mean and stddev are plain partial aggregates; the small
      per-group table is written once, measured, and broadcast back onto the
      rows only under the size bounds (null-safe key match, so a null key is
      one group as in a window). No row-level window, no single-partition step.

    Adds ``log_col`` (the logarithm) and the group's ``avg_col``/``sko_col``.
    """
    return log_trim_bounded(df, value, by, k, log_col, avg_col, sko_col, max_rows)[0]


def log_trim_bounded(df: DataFrame, value: str, by: Sequence[str] = (), k: float = LOG_SIGMA_K,
                     log_col: str = "logtar", avg_col: str = "log_avg", sko_col: str = "log_sko",
                     max_rows: int = BROADCAST_MAX_ROWS) -> tuple[DataFrame, int]:
    """``log_trim`` and an upper bound on its row count: the rows of the groups
    that can keep any, summed while the per-group table is written."""
    by = list(by)
    v = F.col(value)
    # NaN counts as greater than any number in Spark; it is a missing value here
    pos = df.where(v.isNotNull() & (v > F.lit(0)) & ~F.isnan(v.cast("double"))).withColumn(log_col, F.ln(v))
    stats = pos.groupBy(*by).agg(F.avg(log_col).alias(avg_col), F.stddev_samp(log_col).alias(sko_col),
                                 F.count(F.lit(1)).alias("__n"))
    # Groups that can keep nothing are dropped here, which only shrinks the table.
    stats = stats.where(F.col(sko_col) > F.lit(0))
    if by:
        rows, seen = attach_observed(pos, stats, by, how="inner", max_rows=max_rows,
                                     observe={"bound": F.sum("__n")})
        rows, bound = rows.drop("__n"), seen.get("bound") or 0  # sum over no group is null
    else:
        row = stats.first()  # one row of three numbers
        if row is None:
            return (pos.withColumn(avg_col, F.lit(None).cast("double"))
                       .withColumn(sko_col, F.lit(None).cast("double")).where(F.lit(False))), 0
        rows = pos.withColumn(avg_col, F.lit(row[avg_col])).withColumn(sko_col, F.lit(row[sko_col]))
        bound = row["__n"]
    kept = rows.where(F.abs(F.col(log_col) - F.col(avg_col)) < F.lit(float(k)) * F.col(sko_col))
    return kept, int(bound)
