import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from visitstat.operators.profile import describe, exact_std, exact_variation, group_profile


def std(xs):
    if len(xs) < 2:
        return None
    mean = Fraction(sum(xs), len(xs))
    return math.sqrt(sum((x - mean) ** 2 for x in xs) / (len(xs) - 1))


def values(seed):
    rng = random.Random(seed)
    out = [("near", 10**12 + rng.randint(0, 9)) for _ in range(3000)]                  # squares cancel in floating point
    out += [("wide", rng.randint(-10**13, 10**13)) for _ in range(3000)]
    out += [("equal", 7)] * 50 + [("one", 5), ("none", None), ("none", None), (None, 3), (None, 8), (None, None)]
    rng.shuffle(out)
    return out


def test_deviations_are_those_of_exact_arithmetic(spark):
    data = values(1)
    df = spark.createDataFrame(data, "g string, u bigint")
    got = {r["g"]: r["s"] for r in df.groupBy("g").agg(exact_std("u", 1e6).alias("s")).collect()}
    for g in got:
        want = std([u for k, u in data if k == g and u is not None])
        assert (got[g] is None) == (want is None)
        if want is not None:
            assert math.isclose(got[g], want / 1e6, rel_tol=1e-14, abs_tol=0)


@pytest.mark.parametrize("parts", [1, 3, 17])
def test_equal_bits_in_any_row_order(spark, parts):
    data = values(2)
    df = spark.createDataFrame(data, "g string, u bigint").withColumn("x", F.col("u") / 1e6)
    first = None
    for seed in range(3):
        mixed = df.repartition(parts, F.rand(seed)).orderBy(F.rand(seed + 10))
        prof = {r["g"]: tuple(r)[1:] for r in group_profile(mixed, ["g"], "x", ["count", "avg", "sko", "koef_var"], exact=("u", 1e6)).collect()}
        desc = sorted(tuple(r) for r in describe(mixed.select("u", "x"), scales={"x": 1e6}).collect())
        first = first or (prof, desc)
        assert (prof, desc) == first


def test_variation_of_mean_zero_and_of_no_rows(spark):
    df = spark.createDataFrame([(-1,), (1,)], "u bigint")
    assert df.agg(exact_variation("u").alias("v")).first()["v"] is None
    assert df.limit(0).agg(exact_std("u").alias("s")).first()["s"] is None


def test_squares_beyond_38_digits_raise(spark):
    df = spark.createDataFrame([(9 * 10**18,)] * 5, "u bigint")
    with pytest.raises(Exception, match="OVERFLOW|NUMERIC_VALUE_OUT_OF_RANGE"):
        df.agg(exact_std("u").alias("s")).collect()
