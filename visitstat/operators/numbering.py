"""Global row numbers and rows by rank, without one task that sees all rows.

Rows are range-partitioned on the keys and sorted inside their partition; an id made of the
partition and the place in it is written with them, so it rises with the rank. The rows per
partition, summed up in order, give every partition's first rank (a window over one
row per partition). The input's own position is the last key, so ties have an order and a
key that many rows share is split over partitions like any other.

* ``with_numbers`` adds the partition's first rank to the place: gapless numbers from 1.
* ``rows_by_rank`` turns the first and last wanted rank into two ids. Files hold
  consecutive ids, so the filter on the id is answered from their statistics: only those
  with wanted rows are read, however deep the start.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from visitstat.operators.attach import attach
from visitstat.session import write_table

ID, PART, POSITION = "__rank_id", "__part", "__position"
PLACE_BITS = 33              # of monotonically_increasing_id


def ranked(df: DataFrame, keys: Sequence[str | Column]) -> tuple[DataFrame, DataFrame]:
    """(table, starts): the rows with their id, written; and per partition its rows ``n`` and the number
    ``start`` of rows before it. Order: ``keys`` ascending (nulls first), then the input's position."""
    order = [F.col(k) if isinstance(k, str) else k for k in keys] + [F.col(POSITION)]
    placed = (df.withColumn(POSITION, F.monotonically_increasing_id())
              .repartitionByRange(*order).sortWithinPartitions(*order)
              .withColumn(ID, F.monotonically_increasing_id()).drop(POSITION))
    table = write_table(placed, "ranked")
    part = F.shiftright(ID, PLACE_BITS).alias(PART)
    before = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)       # one row per partition
    starts = table.groupBy(part).agg(F.count(F.lit(1)).alias("n")).withColumn(
        "start", F.coalesce(F.sum("n").over(before), F.lit(0).cast("bigint")))
    return table, starts


def with_numbers(df: DataFrame, keys: Sequence[str | Column], name: str = "row_number") -> DataFrame:
    """``df`` with the global number of each row, 1 to N without gaps, in ``keys`` order."""
    if name in df.columns:
        raise ValueError(f"the table has a column {name!r} already")
    table, starts = ranked(df, keys)
    rows = table.withColumn(PART, F.shiftright(ID, PLACE_BITS))
    numbered = attach(rows, starts.select(PART, "start"), [PART])
    place = F.col(ID).bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    return numbered.withColumn(name, F.col("start") + place + F.lit(1)).select(*df.columns, name)


def rows_by_rank(df: DataFrame, keys: Sequence[str | Column], start: int | float = 0, n: int = 10) -> DataFrame:
    """The rows of ranks ``start`` .. ``start + n - 1`` (from 0) in ``keys`` order; a float below 1 is a share of
    the table. Past the end there are none."""
    if n < 0 or start < 0:
        raise ValueError("start and n must not be negative")
    table, starts = ranked(df, keys)
    starts = write_table(starts, "starts")
    rows = starts.agg(F.sum("n")).first()[0] or 0
    first = int(start * rows) if isinstance(start, float) else start
    last = min(first + n, rows) - 1
    if first > last:
        return table.where(F.lit(False)).drop(ID)

    def id_of(rank: int) -> Column:
        inside = F.lit(rank).between(F.col("start"), F.col("start") + F.col("n") - F.lit(1))
        return F.max(F.when(inside, F.shiftleft(PART, PLACE_BITS) + F.lit(rank) - F.col("start")))

    low, high = starts.agg(id_of(first).alias("low"), id_of(last).alias("high")).first()
    return table.where(F.col(ID).between(F.lit(low), F.lit(high))).orderBy(ID).drop(ID)
