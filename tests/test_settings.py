"""Settings, arguments, templates, exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from veritide.operators import records, templates
from veritide.sources import config


def test_settings(tmp_path):
    (tmp_path / "c.json").write_text('{"limits": {"max_files": 5, "unknown": 1}, "filtering": {"ignore": ["x/"], "doc_files": true}}')
    found = config.load(str(tmp_path / "c.json"), {"AUDIT_CONTEXT_LINES": "9"})
    assert (found.limits.max_files, found.limits.context_lines, found.limits.max_depth) == (5, 9, 3)
    assert found.filtering.ignore == ("x/",) and found.filtering.doc_files and found.filtering.css_files
    assert config.load(environment={}) == config.Settings()


def test_arguments():
    assert config.argument_problems({}) == []
    assert len(config.argument_problems({"min_confidence": 0.9, "max_confidence": 0.1, "max_files": -1, "filter_level": "x", "format": "csv", "include_paths": ["a"], "exclude_paths": ["a"]})) == 5


def test_templates(spark):
    rows = spark.createDataFrame([("a", "x", 1, "say {code} to {who}", ["code", "who"]), ("a", "x", 2, "say {code}", ["code", "who"]), ("b", "x", 1, "{oh}", None)], templates.TEMPLATE)
    assert {(r.name, r.version) for r in templates.latest(rows).collect()} == {("a", 2), ("b", 1)}
    assert {(r.name, r.version) for r in templates.invalid(rows).collect()} == {("a", 2), ("b", 1)}
    more = spark.createDataFrame([("a", "y", 3, "new", [])], templates.TEMPLATE)
    assert {(r.name, r.type) for r in templates.added(rows, more).collect()} == {("a", "y"), ("b", "x")}
    assert {r.name for r in templates.removed(rows, ["a"]).collect()} == {"b"}
    found = spark.createDataFrame([("CWE-89",), ("CWE-1",)], "cwe string")
    assert {(r.standard, r.category) for r in templates.by_standard(found).collect()} == {("OWASP", "A03_Injection"), ("CWE-25", "Input_Validation")}


def test_exports(spark):
    checked = spark.createDataFrame([(1, True, "ok"), (2, False, "quota")], "id long, allowed boolean, reason string")
    rows = {r.user_id: (r.export_status, r.blocked_reason) for r in records.export_attempts(checked, "json", F.lit(2), "2024-01-01").collect()}
    assert rows == {1: ("success", None), 2: ("blocked", "quota")}
    report = records.system_report(spark.range(1).select(F.lit(3).alias("n")), checked.select("id")).first().report
    assert report == '{"statistics":{"n":3},"users":[{"id":1},{"id":2}]}'
