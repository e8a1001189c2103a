"""Joining small per-group tables back onto rows, with a checked broadcast."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from visitstat.session import write_table

# A per-group table is broadcast only when its row count and data size,
# measured while it is written out, are at most these; beyond them the join is
# a shuffle join (AQE splits a skewed key on the large side).
BROADCAST_MAX_ROWS = 200_000
BROADCAST_MAX_BYTES = 64 * 1024 * 1024


def row_bytes(df: DataFrame) -> Column:
    """Data size of one row: string and binary lengths plus 8 bytes per other value
    (nested values count 64). Summed during a write it bounds what a broadcast ships."""
    parts = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            parts.append(F.coalesce(F.octet_length(c), F.lit(0)) + F.lit(8))
        elif isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)):
            parts.append(F.lit(64))
        else:
            parts.append(F.lit(8))
    return reduce(lambda a, b: a + b, parts, F.lit(0)).cast("bigint")


def fits_broadcast(rows: int, size: int | None, max_rows: int = BROADCAST_MAX_ROWS,
                   max_bytes: int = BROADCAST_MAX_BYTES) -> bool:
    return rows <= max_rows and (size or 0) <= max_bytes


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` to the session's checkpoint folder and read it back (cuts lineage)."""
    return write_table(df, name)


def sized(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS,
          observe: dict | None = None) -> tuple[DataFrame, bool, dict]:
    """Write a derived table once and report whether it may be broadcast: its
    row count and data size are observed during that write (no extra pass),
    with any further ``observe`` aggregates; returns (table, fits, observed)."""
    m, seen = write_table(df, "small", count_rows=True,
                          observe={"bytes": F.sum(row_bytes(df)), **(observe or {})})
    return m, fits_broadcast(seen["rows"], seen["bytes"], max_rows), seen


def null_safe_on(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]]):
    """Join condition with null-safe equality (null keys form one group, like GROUP BY)."""
    if not pairs:
        raise ValueError("at least one key is needed")
    return reduce(lambda a, b: a & b, [left[l].eqNullSafe(right[r]) for l, r in pairs])


def attach(rows: DataFrame, small: DataFrame, keys: list[str], how: str = "inner",
           max_rows: int = BROADCAST_MAX_ROWS, checked: bool = True) -> DataFrame:
    """Join a per-group table ``small`` onto ``rows`` by ``keys`` (null-safe).

    With ``checked`` the small side is written out and measured first; it is
    broadcast only under ``max_rows`` and ``BROADCAST_MAX_BYTES``. Otherwise
    (or unchecked) Spark chooses, using its own runtime sizes under AQE.
    """
    return attach_observed(rows, small, keys, how, max_rows, checked)[0]


def attach_observed(rows: DataFrame, small: DataFrame, keys: list[str], how: str = "inner",
                    max_rows: int = BROADCAST_MAX_ROWS, checked: bool = True,
                    observe: dict | None = None) -> tuple[DataFrame, dict]:
    """``attach``, also returning aggregates of ``small`` observed while it is written."""
    tmp = {k: f"__key_{i}" for i, k in enumerate(keys)}
    s = small.select(*[F.col(k).alias(tmp[k]) for k in keys],
                     *[c for c in small.columns if c not in tmp])
    seen: dict = {}
    if checked:
        s, fits, seen = sized(s, max_rows, observe)
        if fits:
            s = F.broadcast(s)
    out = rows.join(s, null_safe_on(rows, s, [(k, tmp[k]) for k in keys]), how)
    return out.drop(*tmp.values()), seen
