import random

import pytest
from pyspark.sql import functions as F

from visitstat.operators.numbering import ranked, rows_by_rank, with_numbers


def table(spark, n=5000, parts=13, seed=1):
    rng = random.Random(seed)
    rows = [(rng.choice(["hot"] * 5 + [None] + list("abcdefg")), rng.randint(0, 50), i) for i in range(n)]
    return rows, spark.createDataFrame(rows, "k string, v int, i int").repartition(parts)


@pytest.fixture
def many_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def key(r):
    return (r[0] is not None, r[0] or "", r[1])


def test_numbers_are_gapless_and_in_order(spark, many_partitions):
    rows, df = table(spark)
    got = sorted(with_numbers(df, ["k", "v"]).collect(), key=lambda r: r["row_number"])
    assert [r["row_number"] for r in got] == list(range(1, len(rows) + 1))
    assert sorted(r["i"] for r in got) == list(range(len(rows)))
    assert [key(r) for r in got] == sorted(map(key, rows))


def test_a_key_of_all_rows_is_split(spark, many_partitions):
    """Equal keys, even equal rows, go to many partitions: the input's position is the last key."""
    df = spark.range(0, 4000, 1, 8).select(F.lit(1).alias("k"))
    _, starts = ranked(df, ["k"])
    sizes = [r["n"] for r in starts.collect()]
    assert len(sizes) > 20 and max(sizes) < 1000
    assert sorted(r["n"] for r in with_numbers(df, ["k"], "n").collect()) == list(range(1, 4001))


@pytest.mark.parametrize("start,n", [(0, 10), (4500, 10), (4995, 10), (5000, 10), (9999, 3), (0, 0), (1234, 700), (0.9, 7), (0.0, 2)])
def test_rows_by_rank(spark, many_partitions, start, n):
    rows, df = table(spark)
    order = sorted(rows, key=lambda r: (*key(r), r[2]))
    first = int(start * len(rows)) if isinstance(start, float) else start
    got = [tuple(r) for r in rows_by_rank(df, ["k", "v", "i"], start, n).collect()]
    assert got == order[first:first + n]


def test_deep_rows_read_few_files_and_nothing_is_counted_off(spark, many_partitions):
    _, df = table(spark)
    out = rows_by_rank(df, ["k", "v", "i"], 4500, 10)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Limit" not in plan and "TakeOrdered" not in plan and "Offset" not in plan
    assert "GreaterThanOrEqual(__rank_id" in plan and "LessThanOrEqual(__rank_id" in plan
    out.collect()
    scan = out._jdf.queryExecution().executedPlan()
    rows_read = [int(m) for m in metric(scan, "numOutputRows")]
    assert max(rows_read) < 1000                       # of 5000: the other files' statistics leave them out


def metric(plan, name):
    """The metric of all scans of an executed plan."""
    while plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        plan = plan.executedPlan()
    todo, out = [plan], []
    while todo:
        p = todo.pop()
        if "Scan" in p.nodeName():
            out.append(p.metrics().apply(name).value())
        for i in range(p.children().size()):
            todo.append(p.children().apply(i))
        if p.getClass().getSimpleName().endswith("QueryStageExec"):
            todo.append(p.plan())
    return out


def test_empty_and_errors(spark):
    empty = spark.createDataFrame([], "k string, v int")
    assert with_numbers(empty, ["k"]).collect() == [] and rows_by_rank(empty, ["k"], 0, 5).collect() == []
    with pytest.raises(ValueError):
        with_numbers(empty, ["k"], "v")
    with pytest.raises(ValueError):
        rows_by_rank(empty, ["k"], -1)
