"""Shared fixtures: one local Spark session and DuckDB views over the
smallest driver tables."""

from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SMALL_SF = os.environ.get("LABELFLOW_TEST_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from labelflow.session import build_session

    s = build_session(master="local[*]", app_name="labelflow-tests", shuffle_partitions=8)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    if not os.path.isdir(SMALL_SF):
        pytest.skip(f"test tables not found at {SMALL_SF}")
    return SMALL_SF


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    from labelflow.sources.tables import TABLES

    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    yield con
    con.close()
