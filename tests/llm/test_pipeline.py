import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.data import frame
from tests.oracle_check import compare, duck
from visitstat.llm import catalog
from visitstat.session import write_table

SF = "/root/testdata/sf0.001"


def test_stages_call_in_order_and_keep_the_columns(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality_rules", "near_duplicates", "mixing", "packing"]
    docs = frame(spark)
    columns, counts = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = write_table(stage(spark, docs, ""), name)
        assert docs.columns == columns
        counts.append(docs.count())
    assert counts[0] >= counts[1] >= counts[2] > 0
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, "")
    tokens = pieces.agg(F.sum("length"), F.max("sequence_id")).first()
    assert tokens[1] == (tokens[0] - 1) // 2048


def test_stages_accept_an_empty_table(spark):
    docs = frame(spark, [])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.collect() == []


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_oracle(spark, name):
    assert compare(spark, duck(SF), name, catalog.queries()[name], catalog.oracle_sql()[name], SF)
