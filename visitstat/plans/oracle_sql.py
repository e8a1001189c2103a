"""DuckDB SQL oracles for the registered queries.

Each oracle rebuilds the session rows from the test tables with the same
mapping as ``sources.testdata`` and states its report as grouped SQL: one row
per group from GROUP BY, statistics of a group joined to its rows. Rounding
follows ``catalog.OUTPUT``. Revenue sums and averages are taken from integer
micro-unit sums on both sides (128-bit here, 38 digits in Spark).
DuckDB notes: ``ln`` is the natural log (``log`` is base 10 there),
``dayofweek`` is 0 on Sunday, ``%U`` is the Sunday-based week number.
"""

from __future__ import annotations

from visitstat.plans.catalog import COUNTRY, COUNTRY_MIN_COUNT_STRICT, DAY, DEEP_START, MIXED_HI, MIXED_LO, OUTPUT, PREVIEW_ROWS, \
    PREVIEW_START, RANGE_MIN_COUNT, SEGMENT_MIN_COUNT_STRICT, SHARD_HI, SHARD_LO, YEAR_HI, YEAR_LO
from visitstat.plans.reports import DESCRIBE_NUMERIC, DISTRIBUTION_COLUMNS, SEGMENT_BASE_COLUMNS, SEGMENT_COLUMNS

SESSIONS = """
li AS (
  SELECT l_orderkey, count(*) AS n_lines, sum(l_quantity) AS qty,
         sum(CASE WHEN l_returnflag <> 'R' THEN l_linenumber END) AS kept_lines
  FROM lineitem GROUP BY l_orderkey
), fo AS (
  SELECT o_custkey AS f_custkey, min(o_orderkey) AS first_key FROM orders GROUP BY o_custkey
), s0 AS (
  SELECT
    CAST(o.o_custkey AS VARCHAR) AS fullVisitorId,
    o.o_orderkey AS visitId,
    strftime(o.o_orderdate, '%Y%m%d') AS date,
    o.o_orderpriority AS channelGrouping,
    CASE WHEN o.o_orderstatus = 'F' THEN CAST(round(o.o_totalprice * 1e6) AS BIGINT) END AS revenue_micro,
    CAST(1 AS BIGINT) AS visits,
    li.n_lines AS hits,
    CAST(round(li.qty) AS BIGINT) AS pageviews,
    CAST(li.kept_lines * 60 AS BIGINT) AS timeOnSite,
    CASE WHEN fo.first_key = o.o_orderkey THEN CAST(1 AS BIGINT) END AS newvisits,
    r.r_name AS source, o.o_orderstatus AS browser, c.c_mktsegment AS operatingSystem,
    r.r_name AS deviceCategory, n.n_name AS country
  FROM orders o
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
  JOIN fo ON o.o_custkey = fo.f_custkey
  LEFT JOIN li ON o.o_orderkey = li.l_orderkey
), s AS (
  SELECT *, fullVisitorId || CAST(visitId AS VARCHAR) AS unique_session_id,
         revenue_micro / 1e6 AS total_revenue,
         CASE WHEN revenue_micro IS NOT NULL AND newvisits = 1 THEN revenue_micro END AS revenue_from_new_micro,
         CAST(strptime(date, '%Y%m%d') AS DATE) AS day
  FROM s0
)"""

# Trimmed revenue rows: the limits of ln(revenue) per country, joined to its sessions.
TRIMMED = """
logs AS (
  SELECT unique_session_id, total_revenue, revenue_micro, date, country, ln(total_revenue) AS logtar
  FROM s WHERE revenue_micro > 0
), limits AS (
  SELECT country, avg(logtar) AS log_avg, stddev_samp(logtar) AS log_sko FROM logs GROUP BY country
), t AS (
  SELECT logs.*, limits.log_avg, limits.log_sko
  FROM logs JOIN limits ON logs.country IS NOT DISTINCT FROM limits.country
  WHERE logtar > log_avg - 3.09 * log_sko AND logtar < log_avg + 3.09 * log_sko
)"""

# Bin counts per country of the trimmed sessions.
COUNTS = """
ranges AS (
  SELECT country, count(*) AS n, min(total_revenue) AS low, max(total_revenue) AS high FROM t GROUP BY country
), bins AS (
  SELECT country, n, low, high, 1 + 3.5 * ln(n) AS width_count, high > low AS spread FROM ranges
), counts AS (
  SELECT country, n, low, high, if(spread, (high - low) / width_count, 0.0) AS step,
         CAST(if(spread, ceil(width_count), 1) AS BIGINT) AS ceil
  FROM bins
)"""


# Spoiled dates of some pending orders, and why they cannot be used.
DIRTY = """
spoiled AS (
  SELECT * REPLACE (CASE WHEN browser <> 'P' THEN date WHEN operatingSystem = 'MACHINERY' THEN NULL
                         WHEN operatingSystem = 'BUILDING' THEN strftime(day, '%Y-%m-%d')
                         WHEN operatingSystem = 'FURNITURE' THEN strftime(day, '%Y%m') || '32'
                         WHEN operatingSystem = 'HOUSEHOLD' THEN '19700101' ELSE date END AS date), date AS table_suffix
  FROM s
), judged AS (
  SELECT *, CASE WHEN date IS NULL THEN 'no date' WHEN try_strptime(date, '%Y%m%d') IS NULL OR len(date) <> 8 THEN 'not a day'
                 WHEN date <> table_suffix THEN 'not the day of its shard' END AS reason
  FROM spoiled
)"""


def R(x: str, d: int | None) -> str:
    if d is None:
        return x
    return f"(sign({x}) * floor(abs({x}) * 1e{d} + 0.5) / 1e{d})"


def wrap(name: str, body: str, ctes: tuple[str, ...] = (SESSIONS,)) -> str:
    """``WITH <ctes>, q AS (<body>) SELECT <spec columns, rounded> FROM q``."""
    cols = ", ".join(f'{R(f"q.{c}", d)} AS "{c}"' for c, d in OUTPUT[name])
    return "WITH " + ",\n".join(c.strip() for c in ctes) + f",\nq AS (\n{body}\n)\nSELECT {cols} FROM q"


def _moments(group: str, source: str, value: str = "total_revenue", micro: str = "revenue_micro") -> str:
    """One row per group: size, exact mean, median, extremes and spread of a money column."""
    return f"""
SELECT {group}, n AS count, total / n / 1e6 AS avg, middle AS median, low AS min, high AS max, spread AS sko,
       spread / nullif(total / n / 1e6, 0) AS koef_var
FROM (SELECT {group}, count({value}) AS n, sum({micro}) AS total, median({value}) AS middle, min({value}) AS low,
             max({value}) AS high, stddev_samp({value}) AS spread
      FROM {source} GROUP BY {group})"""


def _segment_body(min_count: int, where: str = "") -> str:
    """Totals per segment first; ratios are taken from the totals."""
    source = {"revenue": "total_revenue", "timeonsite": "timeOnSite"}
    names = {p: [c.removeprefix(p) for c in SEGMENT_COLUMNS if c.startswith(p)] for p in ("median_", "koef_var_")}
    middle = ", ".join(f"median({source.get(n, n)}) AS median_{n}" for n in names["median_"])
    spread = ", ".join(f"stddev_samp({c}) / nullif(avg({c}), 0) AS koef_var_{n}" for n, c in (
        (n, source.get(n, n)) for n in names["koef_var_"]))
    return f"""
WITH picked AS (SELECT * FROM s {where}),
everything AS (SELECT count(*) AS sessions FROM picked),
segments AS (
  SELECT operatingSystem, channelGrouping, count(*) AS sessions, count(revenue_micro) AS buyers,
         sum(revenue_micro) AS money, sum(revenue_from_new_micro) AS new_money,
         sum(pageviews) AS pages, sum(newvisits) AS newcomers, {middle}, {spread}
  FROM picked GROUP BY ALL
)
SELECT segments.*, segments.sessions AS count_parted, segments.sessions / everything.sessions AS count_parted_to_all,
       money / 1e6 AS sum_revenue, new_money / nullif(money, 0) AS percent_revenue_from_new,
       buyers / segments.sessions AS revenue_to_parted_all, CAST(pages AS BIGINT) AS sum_pageviews,
       CAST(newcomers AS BIGINT) AS sum_new_visits
FROM segments, everything WHERE segments.sessions >= {min_count}"""


_DAILY = _moments("date", "t")
_RANGE = f"WHERE date BETWEEN '{YEAR_LO}' AND '{YEAR_HI}' AND country = '{COUNTRY}'"

_WEEKLY = """
SELECT day - CAST(dayofweek(day) AS INTEGER) AS date,
  sum(revenue_micro) / 1e6 AS revenue_sum,
  sum(revenue_micro) / count(revenue_micro) / 1e6 AS revenue_avg,
  CAST(sum(timeOnSite) AS BIGINT) AS sum_timeOnSite
FROM s {where} GROUP BY 1"""

_EXTRACT = """
SELECT unique_session_id, total_revenue, visits, hits, pageviews, timeOnSite, newvisits, source, browser,
  operatingSystem, deviceCategory, channelGrouping, CAST(strftime(day, '%U') AS INTEGER) AS date,
  CASE WHEN revenue_micro IS NOT NULL THEN 1 END AS revenue_true,
  CASE WHEN revenue_micro IS NULL THEN 1 END AS revenue_false
FROM s"""

_PLAN = f"""
SELECT m.country, m.count, m.avg, m.median, m.sko, low AS over_test_min, high AS over_test_max, n AS over_test, step, ceil,
       CAST(ceil * (ceil + 1) / 2 AS BIGINT) AS sum_another_teor
FROM ({_moments("country", "t")}) AS m JOIN counts ON m.country IS NOT DISTINCT FROM counts.country"""

_BINNED = """
SELECT unique_session_id, t.country, total_revenue,
       CAST(least(if(step > 0, floor((total_revenue - low) / step) + 1, 1), ceil) AS BIGINT) AS bin
FROM t JOIN counts ON t.country IS NOT DISTINCT FROM counts.country"""


def _describe_body() -> str:
    parts = []
    for c in DESCRIBE_NUMERIC:
        parts.append(f"""
  SELECT '{c}' AS "column", count(x) AS count, avg(x) AS mean, stddev_samp(x) AS std, min(x) AS min,
    quantile_cont(x, 0.25) AS p25, quantile_cont(x, 0.5) AS p50, quantile_cont(x, 0.75) AS p75,
    max(x) AS max
  FROM (SELECT CAST("{c}" AS DOUBLE) AS x FROM e) v""")
    return "\nUNION ALL".join(parts)


def _histogram_body(column: str, log10: bool) -> str:
    xexpr = "log10(x)" if log10 else "x"
    keep = "WHERE x > 0" if log10 else ""

    def edge(i: str) -> str:
        return f"(CASE WHEN {i} >= p.k THEN p.hi ELSE CAST({i} AS DOUBLE) * p.step + p.lo END)"

    return f"""
  WITH v AS (SELECT CAST("{column}" AS DOUBLE) AS x FROM e WHERE "{column}" IS NOT NULL),
  kv AS (SELECT {xexpr} AS x FROM v {keep}),
  p0 AS (SELECT CAST(ceil(1 + 3.32 * log10((SELECT count(*) FROM v))) AS BIGINT) AS k,
                min(x) AS lo0, max(x) AS hi0, count(*) AS n FROM kv),
  p1 AS (SELECT k, n, CASE WHEN lo0 = hi0 THEN lo0 - 0.5 ELSE lo0 END AS lo,
                CASE WHEN lo0 = hi0 THEN hi0 + 0.5 ELSE hi0 END AS hi FROM p0),
  p AS (SELECT *, (hi - lo) / k AS step, hi - lo AS denom FROM p1),
  b0 AS (SELECT kv.x, LEAST(CAST(floor((kv.x - p.lo) / p.denom * CAST(p.k AS DOUBLE)) AS BIGINT), p.k - 1)
                AS i0 FROM kv, p),
  b1 AS (SELECT b0.x, CASE WHEN b0.x < {edge("b0.i0")} THEN b0.i0 - 1 ELSE b0.i0 END AS i1 FROM b0, p),
  b2 AS (SELECT CASE WHEN b1.x >= {edge("(b1.i1 + 1)")} AND b1.i1 <> p.k - 1 THEN b1.i1 + 1 ELSE b1.i1 END
                AS bin FROM b1, p),
  cnt AS (SELECT bin, count(*) AS c FROM b2 GROUP BY bin),
  grid AS (SELECT generate_series AS bin FROM p, generate_series(0, p.k - 1)),
  h AS (SELECT grid.bin, {edge("grid.bin")} AS bin_lo, {edge("(grid.bin + 1)")} AS bin_hi,
               coalesce(cnt.c, 0) AS count, p.n AS n
        FROM grid CROSS JOIN p LEFT JOIN cnt ON grid.bin = cnt.bin)
  SELECT bin, bin_lo, bin_hi, count, CAST(count AS DOUBLE) / (bin_hi - bin_lo) / n AS density FROM h"""


def oracle_sql() -> dict[str, str]:
    ext = (SESSIONS, f"e AS ({_EXTRACT})")
    trimmed = (SESSIONS, TRIMMED)
    binned = (*trimmed, COUNTS)
    # the trim's limits are those of the chosen sessions
    in_range = (SESSIONS, TRIMMED.replace("FROM s WHERE", f"FROM s {_RANGE} AND"))
    out = {
        "daily_profile_trimmed": wrap("daily_profile_trimmed", _DAILY, trimmed),
        "log_trim_rows": wrap("log_trim_rows", "SELECT * FROM t", trimmed),
        "daily_dynamics": wrap("daily_dynamics", f"""
SELECT date, {R("median", 2)} AS median, {R("koef_var", 4)} AS koef_var, count FROM ({_DAILY}) d""", trimmed),
        "segment_report": wrap("segment_report", _segment_body(500)),
        "segment_report_base": wrap("segment_report_base", _segment_body(500)),
        "segment_report_min600": wrap("segment_report_min600", _segment_body(SEGMENT_MIN_COUNT_STRICT)),
        "weekly_dynamics": wrap("weekly_dynamics", _WEEKLY.format(where="")),
        "weekly_revenue": wrap("weekly_revenue", f"SELECT date, revenue_sum AS sum FROM ({_WEEKLY.format(where='')}) w"),
        "weekly_dynamics_country": wrap("weekly_dynamics_country",
                                        _WEEKLY.format(where=f"WHERE country = '{COUNTRY}'")),
        "session_extract": wrap("session_extract", _EXTRACT),
        "revenue_sessions": wrap("revenue_sessions",
                                 "SELECT unique_session_id, total_revenue FROM s WHERE revenue_micro IS NOT NULL"),
        "week_of_year_counts": wrap("week_of_year_counts",
                                    "SELECT date, count(*) AS sessions FROM e GROUP BY date", ext),
        "shard_range": wrap("shard_range", f"""
SELECT unique_session_id, total_revenue, date, date AS table_suffix FROM s
WHERE date BETWEEN '{SHARD_LO}' AND '{SHARD_HI}'"""),
        "country_profile_trimmed": wrap("country_profile_trimmed",
                                        f"SELECT * FROM ({_moments('country', 't')}) WHERE count > 20", trimmed),
        "country_profile_strict": wrap("country_profile_strict", f"""
SELECT * FROM ({_moments('country', 't')}) WHERE count > {COUNTRY_MIN_COUNT_STRICT}""", trimmed),
        "bin_plan": wrap("bin_plan", _PLAN, binned),
        "expand_bins": wrap("expand_bins", """
SELECT t.unique_session_id, t.country, t.total_revenue, unnest(range(1, ceil + 1)) AS another_unnest
FROM t JOIN counts ON t.country IS NOT DISTINCT FROM counts.country""", binned),
        "bin_index_series": wrap("bin_index_series", "SELECT country, unnest(range(1, ceil + 1)) AS num FROM counts", binned),
        "binned_revenue": wrap("binned_revenue", _BINNED, binned),
        "revenue_bins": wrap("revenue_bins", f"SELECT country, bin, count(*) AS count FROM ({_BINNED}) GROUP BY country, bin",
                             binned),
        "daily_profile_distributed": wrap("daily_profile_distributed", _DAILY, trimmed),
        "segment_report_distributed": wrap("segment_report_distributed", _segment_body(500)),
        "describe_distributed": wrap("describe_distributed", _describe_body(), ext),
        "daily_profile_range": wrap("daily_profile_range", _DAILY, in_range),
        "segment_report_range": wrap("segment_report_range", _segment_body(RANGE_MIN_COUNT, _RANGE)),
        "weekly_dynamics_range": wrap("weekly_dynamics_range", _WEEKLY.format(where=_RANGE)),
        "weekly_dynamics_timestamp": wrap("weekly_dynamics_timestamp", f"""
SELECT CAST(date AS TIMESTAMP) AS date, revenue_sum, revenue_avg, sum_timeOnSite FROM ({_WEEKLY.format(where='')})"""),
        "shard_range_mixed": wrap("shard_range_mixed", f"""
SELECT unique_session_id, total_revenue, date, suffix AS table_suffix
FROM (SELECT *, if(browser = 'O', substr(date, 1, 7) || 'A', date) AS suffix FROM s WHERE date LIKE '{MIXED_LO[:6]}%')
WHERE suffix BETWEEN '{MIXED_LO}' AND '{MIXED_HI}'"""),
        "histogram_log10_pages_over": wrap("histogram_log10_pages_over", _histogram_body("pages_over", True), (
            SESSIONS, "e AS (SELECT floor(pageviews / 100) AS pages_over FROM s)")),
        "hits_frequency": wrap("hits_frequency", "SELECT hits, count(fullVisitorId) AS count FROM s GROUP BY hits"),
        "country_frequency": wrap("country_frequency",
                                  "SELECT country, count(fullVisitorId) AS count FROM s GROUP BY country"),
        "revenue_frequency": wrap("revenue_frequency", """
SELECT revenue_micro / 1e6 AS total_revenue, count(fullVisitorId) AS count FROM s GROUP BY revenue_micro"""),
        "describe_numeric": wrap("describe_numeric", _describe_body(), ext),
        "shard_range_catalog": wrap("shard_range_catalog", f"""
SELECT unique_session_id, total_revenue, date, date AS table_suffix FROM s
WHERE date BETWEEN '{SHARD_LO}' AND '{SHARD_HI}'"""),
        "daily_states_range": wrap("daily_states_range", _moments("date", f"(SELECT * FROM s {_RANGE} AND revenue_micro IS NOT NULL)")),
        "weekly_states_range": wrap("weekly_states_range", _WEEKLY.format(where=_RANGE)),
        "segment_states_range": wrap("segment_states_range", _segment_body(RANGE_MIN_COUNT, _RANGE)),
        "shard_day": wrap("shard_day", f"SELECT unique_session_id, total_revenue, date, date AS table_suffix FROM s WHERE date = '{DAY}'"),
        "preview_deep": wrap("preview_deep", f"""
SELECT unique_session_id, visitId, date, total_revenue
FROM (SELECT *, row_number() OVER (ORDER BY visitId) - 1 AS place, count(*) OVER () AS n FROM s)
WHERE place >= floor({DEEP_START} * n) AND place < floor({DEEP_START} * n) + {PREVIEW_ROWS}"""),
        "session_numbers": wrap("session_numbers", """
SELECT unique_session_id, date, visitId, row_number() OVER (ORDER BY date, visitId) AS row_number FROM s"""),
        "quarantine_counts": wrap("quarantine_counts", """
SELECT coalesce(reason, 'good') AS reason, count(*) AS sessions FROM judged GROUP BY 1""", (SESSIONS, DIRTY)),
        "quarantined_sessions": wrap("quarantined_sessions", "SELECT * FROM judged WHERE reason IS NOT NULL", (SESSIONS, DIRTY)),
        "weekly_dynamics_quarantine": wrap("weekly_dynamics_quarantine", _WEEKLY.format(where="").replace(
            "FROM s", "FROM judged").replace("GROUP BY", "WHERE reason IS NULL GROUP BY"), (SESSIONS, DIRTY)),
        "preview_rows": wrap("preview_rows", f"""
SELECT unique_session_id, visitId, date, total_revenue FROM s ORDER BY visitId
LIMIT {PREVIEW_ROWS} OFFSET {PREVIEW_START}"""),
    }
    union = "\nUNION ALL\n".join(
        f"""SELECT '{c}' AS "column", '{'log10' if lg else 'raw'}' AS scale, h.* FROM ({_histogram_body(c, lg)}) h"""
        for c in DISTRIBUTION_COLUMNS for lg in (False, True))
    out["distributions"] = wrap("distributions", union, ext)
    for c in DISTRIBUTION_COLUMNS:
        out[f"histogram_{c}"] = wrap(f"histogram_{c}", _histogram_body(c, False), ext)
        out[f"histogram_log10_{c}"] = wrap(f"histogram_log10_{c}", _histogram_body(c, True), ext)
    assert not set(SEGMENT_BASE_COLUMNS) - {c for c, _ in OUTPUT["segment_report"]}
    return out
