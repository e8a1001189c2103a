"""op7_mixing: all documents mixed to the weights of their sources."""

from pyspark.sql import DataFrame, SparkSession

from visitstat.llm.mixing import mix


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "rate", "copies")


ORACLE_SQL = None   # the dual has no closed form in SQL; tests/llm compares with plain loops
