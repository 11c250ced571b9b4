"""Every registered query against its SQL on the smallest data; those without SQL have a test of their own."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

from veritide.plans.queries import ORACLE_SQL, QUERIES

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def rows_of(frame, columns):
    def plain(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "NULL"
        if isinstance(v, bool) or type(v).__name__ == "bool":
            return str(bool(v))
        return repr(float(v)) if isinstance(v, (int, float)) or hasattr(v, "dtype") else str(v)

    return sorted(tuple(plain(v) for v in r) for r in frame[columns].itertuples(index=False, name=None))


# Queries that SQL can't say, and the test that holds each against brute force.
BY_HAND: dict[str, str] = {}


def test_all_queries_are_held_against_something():
    import importlib

    assert set(QUERIES) - set(ORACLE_SQL) == set(BY_HAND)
    for test in BY_HAND.values():
        module, name = test.split(".")
        assert callable(getattr(importlib.import_module(module), name))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, duck, name):
    found = QUERIES[name](spark, str(DATA)).toPandas()
    assert len(found)
    wanted = duck.execute(ORACLE_SQL[name]).df()
    columns = sorted(wanted.columns)
    assert sorted(found.columns) == columns
    assert rows_of(found, columns) == rows_of(wanted, columns)


def test_range_belongs_to_the_join(spark):
    found = QUERIES["user_usage_stats"](spark, "/root/testdata/sf0.01")
    assert found.count() == 1500
    assert found.filter("request_count = 0").count() == 701
