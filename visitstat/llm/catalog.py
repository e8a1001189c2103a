"""The registered queries of this package (``op<N>_<name>`` and ``pipeline``)
and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from visitstat.llm.common import ship_package

# The modules that hold a registered query: each has query(spark, sf_dir) and
# ORACLE_SQL (None where SQL cannot express the query).
MODULES = {
    "op1_language_id": "op1",
    "op2_search": "op2",
    "op3_token_files": "op3",
    "op4_lm_scoring": "op4",
    "op5_chat": "op5",
    "op6_simhash": "op6",
    "op7_mixing": "op7",
    "op8_packing": "op8",
    "op9_extraction": "op9",
    "op10_host_rules": "op10",
    "op11_nearest": "op11",
    "op12_prefix_trie": "op12",
    "op13_alignment": "op13",
}


def _read(name: str):
    return import_module(f"visitstat.llm.queries.{name}")


def _shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return query(spark, sf_dir)
    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """One entry per operator, each over its whole table."""
    return {name: _shipped(_read(module).query) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: _read(module).ORACLE_SQL for name, module in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
