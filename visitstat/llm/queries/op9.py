"""op9_extraction: the main text of all pages."""

from pyspark.sql import DataFrame, SparkSession

from visitstat.llm.extraction import extract, train


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return extract(pages, train(spark, pages))


ORACLE_SQL = None   # SQL has no trees; tests/llm uses pages with known text
