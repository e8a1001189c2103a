"""op6_simhash: SimHash fingerprints and near-duplicate components of all documents."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visitstat.llm.simhash import near_groups


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_groups(docs, F.col("doc_id")).select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"))


ORACLE_SQL = None   # DuckDB has no XXH64; tests/llm compares with brute force
