"""op8_packing: all documents concatenated and cut into windows of 2048 ids."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from visitstat.llm.packing import pack

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), TOKENIZER).drop("ids")


ORACLE_SQL = None   # SQL has no tokenizer; tests/llm compares with the concatenated stream
