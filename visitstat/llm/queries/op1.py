"""op1_language_id: the language of every document, learned from those not held out."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visitstat.llm.common import held_out
from visitstat.llm.ppm import predict, train


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = held_out("doc_id", 4, 2)
    return predict(docs, train(docs, ~held), {"doc_id": F.col("doc_id"), "held_out": held})


ORACLE_SQL = None   # SQL has no context trees; tests/llm compares with a plain recursion
