"""The corpus pipeline: language ID, host-level quality rules, SimHash
near-duplicates, mixing to target weights, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's documents.

Defined results, for every stage: an empty table gives an empty result; all columns but those a
stage says it sets are handed on as they are, whatever their names; repeated rows are rows of their own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from visitstat.llm.common import ship_package
from visitstat.llm.host_rules import keep_passing
from visitstat.llm.mixing import mixed
from visitstat.llm.packing import pack
from visitstat.llm.ppm import keep_identified
from visitstat.llm.queries.op8 import TOKENIZER
from visitstat.llm.simhash import keep_one
from visitstat.session import write_table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; ``lang`` becomes that language.

    A null text and one without a letter go. A table without any non-null ``lang`` has nothing to
    learn from, so all its documents go. Null ids and sources stay as they are. Ties between languages
    go to the first by name."""
    return keep_identified(docs)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules on hosts that pass.

    A null or empty text has no words and fails. A null source is a host of its own."""
    return keep_passing(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near-duplicates: that with the smallest id, of equal ids the first row.

    A null id comes after all others. Null and empty texts share the fingerprint zero and are one group."""
    return keep_one(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that the sources meet their target weights.

    A null source is a source, last in order. A document without words has size 0 and keeps its one copy. Equal documents
    have equal rates; which of them are rounded up depends on their id and text alone."""
    return mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences, with their token ids.

    A null or empty text is its end id alone; a null id stays null."""
    return pack(docs, TOKENIZER)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("mixing", mixing),
    ("packing", packing),
]

# The language model, the mixing rates and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; every stage's result is written and reread."""
    ship_package(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = write_table(docs, f"stage_{name}")
    return docs
