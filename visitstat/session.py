"""SparkSession settings the library relies on, and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every session running these operators should carry.
#  - UTC: day suffixes and week starts are calendar values, never local time.
#  - ANSI on: a bad division or cast fails loudly instead of turning into null.
#  - partition column type inference off: `table_suffix=20170631` stays a
#    string, so range predicates compare as text, like the day-table suffix.
#  - AQE: runtime coalescing, broadcast conversion and skew-join splitting.
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.sources.partitionColumnTypeInference.enabled": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str = "local[*]", shuffle_partitions: int = 8,
                  app_name: str = "visitstat", extra: dict | None = None) -> SparkSession:
    """A session for tests, the bench and local runs (no UI, UTC, ANSI)."""
    b = (SparkSession.builder.master(master).appName(app_name)
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.driver.memory", "8g"))
    for k, v in {**SESSION_CONF, **(extra or {})}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def apply_conf(spark: SparkSession) -> None:
    """Put the library settings on an existing session."""
    for k, v in SESSION_CONF.items():
        spark.conf.set(k, v)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder used to cut lineage (``DataFrame.checkpoint``).

    Taken from the session (``spark.checkpoint.dir`` or an earlier
    ``setCheckpointDir``). Only a local-mode session without one gets a fresh
    scratch folder; on a cluster the folder must be configured, because a
    machine-local folder would not survive the loss of an executor.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # a remote (Spark Connect) session has no SparkContext: use its setting
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if not configured:
            raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS/S3/DBFS)")
        return f"{configured.rstrip('/')}/{application_id(spark)}"
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS/S3/DBFS)")
        configured = tempfile.mkdtemp(prefix="visitstat-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def application_id(spark: SparkSession) -> str:
    """The application's id, from the session configuration."""
    return spark.conf.get("spark.app.id")


_SCRATCH: list[str] = []


def scratch_path(spark: SparkSession, name: str = "table") -> str:
    """A fresh folder below the shared checkpoint folder, for a written intermediate table."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/visitstat/{name}-{uuid.uuid4().hex}"
    _SCRATCH.append(path)
    return path


def drop_scratch(spark: SparkSession, since: int = 0) -> None:
    """Delete the intermediate tables named after the first ``since`` of them (see
    ``scratch_count``). What still reads them becomes unusable, so call it when the
    results are written."""
    for path in _SCRATCH[since:]:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    del _SCRATCH[since:]


def scratch_count() -> int:
    """How many intermediate tables this process has named so far."""
    return len(_SCRATCH)


def scratch_since(n: int) -> list[str]:
    """The intermediate tables named after the first ``n``."""
    return _SCRATCH[n:]


def not_dropped(paths: list[str]) -> bool:
    """Whether none of these intermediate tables was deleted by ``drop_scratch``."""
    return set(paths) <= set(_SCRATCH)


def write_table(df, name: str = "table", count_rows: bool = False, observe: dict | None = None):
    """Write ``df`` as parquet into the shared checkpoint folder and read it back.

    This is how the library cuts lineage: one pass writes the table, later
    steps read the files. A lost executor then costs a re-read of the files,
    not a recomputation of the plan that produced them. The table is read
    back with the schema it was written with (no footer scan).

    Aggregates over the written rows can be observed during the write itself
    (no second pass): with ``count_rows`` the result is ``(table, rows)``;
    with ``observe`` (name -> aggregate column) it is ``(table, {name: value})``.
    """
    from pyspark.sql import Observation
    from pyspark.sql import functions as F

    spark = df.sparkSession
    path = scratch_path(spark, name)
    metrics = dict(observe or {})
    if count_rows:
        metrics["__rows"] = F.count(F.lit(1))
    obs = None
    if metrics:
        obs = Observation(f"obs_{uuid.uuid4().hex}")
        df = df.observe(obs, *[c.alias(n) for n, c in metrics.items()])
    df.write.mode("errorifexists").option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    if not metrics:
        return table
    got = obs.get
    if count_rows and not observe:
        return table, int(got["__rows"])
    values = {n: got[n] for n in (observe or {})}
    if count_rows:
        values["rows"] = int(got["__rows"])
    return table, values
