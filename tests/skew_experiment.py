"""Skew experiment: reports on a session table where one country holds a third of all rows.

Usage: python tests/skew_experiment.py [sf_dir] [copies]
The table is derived from the stand-in sessions of ``sf_dir``: ``copies``
copies of every session (new visit ids), every third session moved to the
country 'HOT'. The country profile and segment report run with each median
method; results must be equal, and the largest shuffle read per task is
printed (from an event log in a scratch folder).
"""

from __future__ import annotations

import glob
import itertools
import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main() -> None:
    from pyspark.sql import functions as F
    from visitstat.plans import reports as R
    from visitstat.session import build_session, write_table
    from visitstat.sources.testdata import sessions_table

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    copies = int(sys.argv[2]) if len(sys.argv) > 2 else 10
    evdir = tempfile.mkdtemp(prefix="visitstat-events-")
    spark = build_session(shuffle_partitions=32, extra={
        "spark.eventLog.enabled": "true", "spark.eventLog.dir": evdir, "spark.eventLog.compress": "false"})
    base = sessions_table(spark, sf_dir)
    rep = (base.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
               .withColumn("visitId", F.col("visitId") * copies + F.col("copy"))
               .withColumn("geoNetwork", F.when(F.col("visitId") % 3 == 0, F.struct(F.lit("HOT").alias("country")))
                           .otherwise(F.col("geoNetwork")))
               .drop("copy"))
    big = write_table(rep, "skewed")
    n = big.count()
    print(f"rows {n}, share of HOT {big.where(F.col('geoNetwork.country') == 'HOT').count() / n:.3f}")
    res = {}
    for m in ("builtin", "auto", "distributed", "auto", "builtin"):
        t = time.time()
        res[m] = (R.country_profile(big, median_method=m).collect(), R.segment_report(big, median_method=m).collect())
        print(f"{m:12s} {time.time() - t:6.1f} s", flush=True)
    keys = ("median", "median_revenue", "median_timeonsite", "median_hits", "median_pageviews")
    for m in ("auto", "distributed"):
        same = all(tuple(r[k] for k in keys if k in r) == tuple(s[k] for k in keys if k in s)
                   for part in (0, 1) for r, s in zip(res[m][part], res["builtin"][part]))
        print(f"{m} equals builtin: {same}")
    spark.stop()
    worst = 0
    for line in itertools.chain.from_iterable(open(x) for x in sorted(glob.glob(evdir + "/*/*"))):
        e = json.loads(line)
        if e["Event"] == "SparkListenerTaskEnd" and e.get("Task Metrics"):
            worst = max(worst, e["Task Metrics"]["Shuffle Read Metrics"]["Total Records Read"])
    print(f"largest shuffle read of one task: {worst} records (of {n} rows)")


if __name__ == "__main__":
    main()
