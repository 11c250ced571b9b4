"""The driver's entry points, and that the library stands without its optional subpackage."""

from __future__ import annotations

import re
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_flagship(spark):
    rows = entry.entry(spark)
    assert rows.columns[:2] == ["id", "username"] and rows.count() > 0


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_else_imports_the_subpackage():
    optional = ROOT / "veritide" / "llm"
    for path in (ROOT / "veritide").rglob("*.py"):
        if optional not in path.parents:
            assert not re.search(r"veritide[./]llm", path.read_text(encoding="utf-8")), path


def test_no_plan_crosses_tables(spark):
    """Cross joins only put rows of one line each together."""
    for name in ("user_usage_stats", "perm_resolve", "sliding_60s_usage", "first_wins_dedup"):
        plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
