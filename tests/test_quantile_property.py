"""Property test: the distributed quantile operator equals numpy's linear quantiles."""

import numpy as np
import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from visitstat.operators.profile import group_profile
from visitstat.operators.quantile import exact_quantiles

QS = (0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0)

rows = st.lists(
    st.tuples(st.sampled_from(["a", "b", "c", None]),
              st.one_of(st.none(), st.integers(-5, 5).map(float),
                        st.just(float("nan")), st.floats(-1e6, 1e6, allow_nan=False, allow_infinity=False))),
    min_size=1, max_size=300)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows)
def test_matches_numpy(spark, data):
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    try:
        df = spark.createDataFrame(data, "g string, v double")
        got = exact_quantiles(df, ["g"], ["v"], QS, name=lambda c, q: f"q{q}").collect()
        paths = [{r["g"]: r["median"] for r in group_profile(df, ["g"], "v", ["median"], median_method=m).collect()}
                 for m in ("builtin", "distributed", "auto")]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    pdf = pd.DataFrame(data, columns=["g", "v"]).dropna(subset=["v"])
    want = {g: grp["v"].to_numpy() for g, grp in pdf.groupby("g", dropna=False)}
    got = {r["g"]: r for r in got}
    assert {k if k == k else None for k in want} == set(got)  # NaN group key from pandas is None
    assert paths[0] == paths[1] == paths[2]      # one median, whatever the plan
    for g, vals in want.items():
        r = got[None if g != g else g]
        for q in QS:
            assert np.isclose(r[f"q{q}"], np.quantile(vals, q), rtol=1e-12, atol=1e-9), (g, q)
