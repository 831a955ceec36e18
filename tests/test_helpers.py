"""Helper queries against their SQL on the small tables."""

from __future__ import annotations

import duckdb
import pytest

from quireflow.plans import helpers, registry

from test_composed import SF, rows


@pytest.mark.parametrize("name", list(helpers.QUERIES))
def test_engines_agree(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "conversations", "part", "events", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    got = rows(registry.queries()[name](spark, SF).toPandas())
    assert got and got == rows(con.execute(registry.oracle_sql()[name]).df())
