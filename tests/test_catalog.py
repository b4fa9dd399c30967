"""Registered queries against their DuckDB twins on the smallest tables.

``WEBLODE_ALL_QUERIES=1`` runs every one; by default one per group.
"""

import os
from pathlib import Path

import duckdb
import pytest

from checks.catalog import ORACLES, QUERIES
from checks.compare import rows_of

SF = os.environ.get("WEBLODE_SF_DIR", "/root/testdata/sf0.001")
SOME = ["page_links", "detail_templates", "robots_gate", "calls_ranked", "coverage_delta", "greedy_dedupe", "verify_tools", "next_version"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from '{path}'")
    return con


@pytest.mark.skipif(not Path(SF).exists(), reason="test tables not present")
@pytest.mark.parametrize("name", sorted(ORACLES) if os.environ.get("WEBLODE_ALL_QUERIES") else SOME)
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, SF)
    want = duck.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(want.columns, want.fetchall())
