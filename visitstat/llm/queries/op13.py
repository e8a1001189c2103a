"""op13_alignment: two public tokenizers aligned over all documents."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from visitstat.llm.alignment import align

TOKENIZER_A = public_tokenizers.path("byte_bpe_50k.json")
TOKENIZER_B = public_tokenizers.path("piece_bpe_32k.model")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(spark.read.parquet(f"{sf_dir}/documents.parquet"), TOKENIZER_A, TOKENIZER_B)


ORACLE_SQL = None   # SQL has no tokenizers; tests/llm compares with plain loops
