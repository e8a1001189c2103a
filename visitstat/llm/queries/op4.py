"""op4_lm_scoring: Katz backoff scores of all documents."""

from pyspark.sql import DataFrame, SparkSession

from visitstat.llm.common import held_out
from visitstat.llm.katz import score


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, held_out("doc_id", 10, 0)).withColumnRenamed("id", "doc_id")


ORACLE_SQL = None   # discounts and backoff weights are beyond SQL; tests/llm compares with plain dictionaries
