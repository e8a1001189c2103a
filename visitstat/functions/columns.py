"""Scalar column builders used by the session operators.

Everything here composes ``pyspark.sql.functions`` so Catalyst can fold,
push down and code-generate it; there is no Python UDF in the library.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# These must stay as they are for results to agree.
#   MICRO               revenue is stored in micro-units; divide by 1e6
#   LOG_SIGMA_K         keep rows with |ln(x) - mean| < 3.09 * stddev (strict)
#   SEGMENT_MIN_COUNT   segment report keeps segments with count >= 500
#   COUNTRY_MIN_COUNT   country profile keeps groups with count > 20
#   STURGES_A, STURGES_B   histogram bins: ceil(1 + 3.32 * log10(n))
#   LN_BIN_A, LN_BIN_B     bin plan: 1 + 3.5 * ln(n)
# ---------------------------------------------------------------------------
MICRO = 1e6
LOG_SIGMA_K = 3.09
SEGMENT_MIN_COUNT = 500
COUNTRY_MIN_COUNT = 20
STURGES_A, STURGES_B = 1.0, 3.32
LN_BIN_A, LN_BIN_B = 1.0, 3.5


def col_or_none(c):
    if c is None:
        return None
    return F.col(c) if isinstance(c, str) else c


def session_key(visitor: str | Column = "fullVisitorId", visit: str | Column = "visitId") -> Column:
    """Visitor id followed by the visit id, no delimiter (keys may collide; never dedupe on it)."""
    return F.concat(col_or_none(visitor), col_or_none(visit).cast("string"))


def micro_to_units(c: str | Column) -> Column:
    return col_or_none(c) / F.lit(MICRO)


def parse_day(c: str | Column) -> Column:
    """``yyyyMMdd`` text to a date."""
    return F.to_date(col_or_none(c), "yyyyMMdd")


def week_start_sunday(d: str | Column) -> Column:
    """The Sunday on or before ``d`` (weeks start on Sunday, not ISO Monday)."""
    d = col_or_none(d)
    return F.date_sub(d, F.dayofweek(d) - F.lit(1))


def week_of_year_sunday(d: str | Column) -> Column:
    """Week number 0-53 with Sunday-started weeks; days before the first Sunday are week 0."""
    d = col_or_none(d)
    return F.floor((F.dayofyear(d) + F.lit(7) - F.dayofweek(d)) / F.lit(7)).cast("int")


def ratio(a: str | Column, b: str | Column) -> Column:
    """a / b as double, null when b is 0 or null."""
    return F.try_divide(col_or_none(a).cast("double"), col_or_none(b).cast("double"))


def flag_if(cond: Column) -> Column:
    """1 when ``cond`` holds, otherwise null (a count-able flag)."""
    return F.when(cond, F.lit(1))


def round_half_up(c: str | Column, digits: int) -> Column:
    """Round to ``digits`` decimals, halves away from zero, on the double value.

    Written as sign(x) * floor(|x| * 10^d + 0.5) / 10^d so that any engine
    doing the same IEEE operations gives the same double (the SQL oracles
    use the identical formula).
    """
    x = col_or_none(c)
    scale = float(10 ** digits)
    return F.signum(x) * (F.floor(F.abs(x) * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale))
