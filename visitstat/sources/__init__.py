"""Inputs: day-sharded session tables and the session rows built from the test tables."""

from visitstat.sources.shards import (
    SUFFIX, SESSION_SCHEMA, SHARDED_SCHEMA,
    suffix_range, read_shards, write_shards, preview_rows, number_series, schema_fields, list_tables,
)
from visitstat.sources.testdata import sessions_from_testdata, sessions_table, table

__all__ = [
    "SUFFIX", "SESSION_SCHEMA", "SHARDED_SCHEMA",
    "suffix_range", "read_shards", "write_shards", "preview_rows", "number_series",
    "schema_fields", "list_tables",
    "sessions_from_testdata", "sessions_table", "table",
]
