"""Column expressions (all built-in Spark functions, JVM side, codegen friendly)."""

from visitstat.functions.columns import (
    MICRO, LOG_SIGMA_K, SEGMENT_MIN_COUNT, COUNTRY_MIN_COUNT,
    STURGES_A, STURGES_B, LN_BIN_A, LN_BIN_B,
    session_key, micro_to_units, parse_day, week_start_sunday, week_of_year_sunday,
    ratio, flag_if, col_or_none, round_half_up,
)

__all__ = [
    "MICRO", "LOG_SIGMA_K", "SEGMENT_MIN_COUNT", "COUNTRY_MIN_COUNT",
    "STURGES_A", "STURGES_B", "LN_BIN_A", "LN_BIN_B",
    "session_key", "micro_to_units", "parse_day", "week_start_sunday", "week_of_year_sunday",
    "ratio", "flag_if", "col_or_none", "round_half_up",
]
