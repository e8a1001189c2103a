"""Connected components of an edge table by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitstat.session import write_table


def components(edges: DataFrame) -> DataFrame:
    """(v, root) for every vertex of ``edges`` (columns a, b, both bigint).

    Each round takes the smallest label among the neighbours (a grouped
    minimum, combined before the shuffle) and then the label of that label.
    Every round's labels are written, so both joins read plain tables and a
    vertex with very many edges is split by the skew-join rule; nothing but
    one sum per round reaches the driver. An empty table gives an empty one.
    """
    both = write_table(edges.select(F.col("a").alias("v"), F.col("b").alias("w"))
                       .union(edges.select(F.col("b").alias("v"), F.col("a").alias("w"))).distinct(), "links")
    total = {"s": F.sum(F.col("root").cast("decimal(38,0)"))}
    labels, seen = write_table(both.groupBy("v").agg(F.least(F.col("v"), F.min("w")).alias("root")), "labels",
                               observe=total)
    while seen["s"] is not None:
        before = seen["s"]
        near = (both.join(labels.select(F.col("v").alias("w"), "root"), "w").select("v", "root")
                .union(labels).groupBy("v").agg(F.min("root").alias("root")))
        near = write_table(near, "labels")
        jump = near.join(near.select(F.col("v").alias("root"), F.col("root").alias("next")), "root")
        labels, seen = write_table(jump.select("v", F.col("next").alias("root")), "labels", observe=total)
        if seen["s"] == before:
            break
    return labels
