"""op3_token_files: all documents as token-id files, digests read back from the files."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from visitstat.llm.token_files import read_token_digests, write_token_files
from visitstat.session import scratch_path

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token_files")
    write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, TOKENIZER)
    return read_token_digests(spark, path)


ORACLE_SQL = None   # SQL has no tokenizer; tests/llm compares with a plain loop
