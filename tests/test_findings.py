"""Confidence, false positives, front-end pages, answers, related files and reports."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from veritide.functions import confidence, detection, false_positives, frontend
from veritide.operators import analysis, findings, records
from veritide.sources import tables


def scored(spark, kind, snippet, **more):
    row = {"type": kind, "code_snippet": snippet, "tech_stack": True, "security_config": True} | more
    return confidence.scored(spark.createDataFrame([row], ", ".join(f"{k} {'boolean' if isinstance(v, bool) else 'array<string>' if isinstance(v, list) else 'string'}" for k, v in row.items()))).first()


def test_golden_scores(spark):
    assert scored(spark, "SQL注入漏洞", "x = query(a)").confidence == 0.948
    assert scored(spark, "硬编码密钥和敏感信息", "a = 1\nb = 2\nc = 3").confidence == 0.9749999999999999
    row = scored(spark, "时序攻击漏洞", "for a in b:\n    if a != c:\n        return")
    assert (row.confidence, row.risk_level, row.confidence_factors.code_complexity) == (0.99, "high", 1.0)


def test_factors(spark):
    safe = scored(spark, "SQL注入", "@Query(select ?1)", frameworks=["spring_data_jpa", "django"], layer="dao")
    assert safe.confidence_factors.framework_protection == pytest.approx(0.05 * 0.1)
    assert safe.confidence_factors.pattern_reliability == pytest.approx(0.2)
    assert safe.confidence_factors.historical_accuracy == pytest.approx(1 - 0.425)
    assert scored(spark, "SQL注入", "${a}").confidence_factors.pattern_reliability == pytest.approx(1.5)
    assert scored(spark, "权限验证绕过", "x", layer="dao").confidence_factors.architecture_appropriateness == 0.2
    assert scored(spark, "SQL注入", "x", layer="entity").confidence_factors.architecture_appropriateness == 0.3
    assert "short snippet (1 lines)" in scored(spark, "x", "y").confidence_reasoning


def dropped(spark, mode="intended", **finding):
    row = {"type": "", "code_snippet": "", "description": "", "confidence": 0.8, "severity": "low", "line": 1, "file": "a", "code": "", "language": "java"} | finding
    schema = "type string, code_snippet string, description string, confidence double, severity string, line int, file string, code string, language string"
    return false_positives.with_drop_reasons(spark.createDataFrame([tuple(row.values())], schema), mode).first().drop_reason


def test_false_positives(spark):
    secret, sql, bypass = false_positives.SECRET, false_positives.SQL, false_positives.BYPASS
    assert dropped(spark, confidence=0.3) == "low_confidence"
    assert dropped(spark, type=secret, code_snippet="package com.a.b;", confidence=0.9) == "java_package_declaration"
    assert dropped(spark, type=sql, code_snippet="repo.findOne(id)", confidence=0.7) == "jpa_safe_methods"
    assert dropped(spark, type=sql, code_snippet="x #{id}") == "framework"
    assert dropped(spark, severity="high", confidence=0.5) == "high_without_confidence"
    assert dropped(spark, "compat", severity="high", confidence=0.5) is None
    assert dropped(spark, type=bypass, code="a\nif (auth) {\nb", line=2) == "harmless_context"
    assert dropped(spark, description="这里可能存在风险") == "doubtful_description"
    assert dropped(spark, type=secret, code_snippet='password = "x"', description="未明确说明", language="go") is None
    assert dropped(spark, type=sql, description="如果x参数未经过严格过滤") is None
    assert false_positives.rule_counts(spark).agg(F.sum("n")).first()[0] == 27


PAGES = {
    "static": ("<html><head><title>x</title><style>div{color:red}</style></head><div>text</div></html>", "static"),
    "form": ('<form action="/login" method="POST"><input name="username"><input type="password" name="password"></form><script>document.querySelector("x")</script>', "input_extraction"),
    "xss": ("<script>e.innerHTML = location.hash;\neval('a' + x);\nsetTimeout(\"f()\")</script><form><input><select><textarea>", "hotspot"),
    "sensitive": ("<script>var api_key = 'abcdefghijklmnop';\nlocalStorage.a = document.cookie</script><form><input><select><textarea>", "hotspot"),
}


@pytest.mark.parametrize("name", sorted(PAGES))
def test_frontend(spark, name):
    content, kind = PAGES[name]
    row = frontend.strategy(spark.createDataFrame([(name, content)], "path string, content string")).first()
    assert (row.analysis_type, row.should_skip) == (kind, kind == "static")
    if name == "form":
        assert [(p.type, p.name, p.action, p.method) for p in row.input_points] == [("form", "username", "/login", "POST"), ("form", "password", "/login", "POST")]
    if name == "sensitive":
        spots = frontend.hot_spots(spark.createDataFrame([(name, content)], "path string, content string"), "path").collect()
        assert ("SENSITIVE_INFO", "high", 1) in {(s.type, s.severity, s.line_number) for s in spots}


def test_line_numbers(spark):
    row = spark.createDataFrame([("ab\ncd\nef",)], "c string").select(*(detection.line_of(F.col("c"), F.lit(k)).alias(f"a{k}") for k in (0, 2, 3, 6)), *(detection.line_of_inclusive(F.col("c"), F.lit(k)).alias(f"b{k}") for k in (0, 2, 3, 6))).first()
    assert (row.a0, row.a2, row.a3, row.a6) == (1, 1, 2, 3)
    assert (row.b0, row.b2, row.b3) == (1, 1, 2)


def test_answers(spark):
    fenced = 'x\n```json\n{"findings": [{"type": "XSS", "line": 3}, {"severity": "high"}]}\n```'
    rows = spark.createDataFrame([("a", "py", fenced), ("b", "py", "发现漏洞:\n- SQL注入 here\n- fine"), ("c", "py", ""), ("d", "py", "```json\n{}\n```"), ("e", "py", None)], "file string, language string, response string")
    found = [(r.file, r.type, r.severity, r.line) for r in findings.parsed(rows).orderBy("file", "seq").collect()]
    assert found == [("a", "XSS", "medium", 3), ("a", "security_issue", "high", 0), ("b", "security_issue", "medium", 0), ("b", "security_issue", "medium", 0)]


def test_related_files(spark):
    rows = spark.createDataFrame([("src/a.php", "include 'b.php';", 10), ("src/b.php", "call a", 10), ("config.php", "", 1), ("c.txt", "a.php", 5)], "path string, content string, size long")
    edges = {(r.path, r.related) for r in findings.reference_edges(rows, findings.REFERENCES, "callee").collect()}
    assert edges == {("src/a.php", "src/b.php")}
    callers = {(r.path, r.caller) for r in findings.caller_edges(rows).collect()}
    assert ("src/b.php", "src/a.php") in callers and ("src/a.php", "c.txt") not in callers
    some = spark.createDataFrame([("src/a.php", "路径遍历")], "path string, type string")
    assert {(r.related, r.relation) for r in findings.related_files(some, rows).collect()} >= {("config.php", "config"), ("src/b.php", "callee")}


def test_parent_controllers(spark):
    paths = ["web/api/Upload/form.php", "web/api/Upload/FormController.php", "web/api/other/OtherController.php", "web/aController.php", "MainController.java", "web/plain.php"]
    files = spark.createDataFrame([(p, "", 1) for p in paths], "path string, content string, size long")
    some = spark.createDataFrame([(paths[0], "XSS"), ("web/plain.php", "XSS"), ("rootfile.php", "XSS")], "path string, type string")
    got = {(r.path, r.related, r.place) for r in findings.related_files(some, files).collect() if r.relation == "parent"}
    assert got == {(paths[0], paths[1], 1), (paths[0], paths[3], 2), ("rootfile.php", "MainController.java", 1)}


def test_adjustment(spark):
    rows = spark.createDataFrame([("a", "x", 0.5), ("b", "x", 0.995), ("c", "x", 0.5)], "path string, type string, confidence double")
    related = spark.createDataFrame([("a", "x", "x", ""), ("a", "x", "y", "有验证"), ("b", "x", "x", ""), ("c", "x", "y", "z")], "path string, type string, found_type string, found_description string")
    got = {r.path: (round(r.adjusted_confidence, 6), r.recommendation) for r in findings.adjusted(rows, related).collect()}
    assert (got["a"][0], got["b"][0], got["c"][0]) == (0.6, 0.995, 0.5)


def test_answers_of_providers(spark):
    def fails(text):
        raise OSError("down")

    rows = spark.createDataFrame([("a", "py", "code")], "path string, language string, prompt string")
    row = analysis.analyse(rows, ("first", fails), ("second", lambda text: f"seen {text}")).first()
    assert (row.response, row.provider, row.error) == ("seen code", "second", None)
    assert analysis.analyse(rows, ("first", fails)).first().error == "OSError: down"
    shown = spark.range(1).select(analysis.prompt("{a} {b}", a=F.lit("x")).alias("p"), analysis.template_variables(F.lit("{a} {b} {a}")).alias("v")).first()
    assert (shown.p, shown.v) == ("x {b}", ["a", "b"])


def test_report_and_cache(spark, tmp_path):
    rows = spark.createDataFrame([("f", "high", "T", 3), ("f", None, "U", 1)], "file string, severity string, type string, line int")
    tables.markdown_report(rows, str(tmp_path / "r"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "r")).collect()]
    assert sorted(lines) == sorted(["- high: 1", "- unknown: 1", "1. [unknown] U (line 1)", "2. [high] T (line 3)"])
    tables.json_report(rows, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    cache = spark.createDataFrame([("k", "r", "2024-01-01 00:00:00"), ("old", "r", "2023-12-30 00:00:00")], "key string, response string, at string").select("key", "response", F.col("at").cast("timestamp_ntz").alias("cached_at"))
    asked = spark.createDataFrame([("k",), ("old",), ("new",)], "key string")
    hits, misses = tables.from_cache(asked, cache, "2024-01-02 00:00:00")
    assert [r.key for r in hits.collect()] == ["k"] and {r.key for r in misses.collect()} == {"old", "new"}


def test_records(spark):
    codes = records.new_codes(spark, 50, spark.createDataFrame([("X",)], "code string"), seed=1)
    got = [r.code for r in codes.collect()]
    assert len(set(got)) == 50 and all(len(c) == 16 for c in got)
    rows = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, "b", "z")], "seq int, k string, v string")
    assert {(r.k, r.v) for r in records.first_wins(rows, ["k"], ["seq"]).collect()} == {("a", "x"), ("b", "z")}
    assert records.one_of(rows, F.col("k") == "b").first().v == "z"
    with pytest.raises(Exception, match="more than one row"):
        records.one_of(rows, F.col("k") == "a").collect()
    waits = spark.createDataFrame([(1, "q", i, i) for i in range(6)], "priority int, queue string, id long, created_at long")
    assert [r.wait_seconds for r in records.queue_positions(waits).orderBy("position").collect()] == [0, 0, 300, 300, 600, 600]
    guess = spark.range(1).select(records.token_estimate(F.lit(5000.0), F.lit(20_000)).alias("a"), records.token_estimate(F.lit(100.0), F.lit(10)).alias("b")).first()
    assert (guess.a, guess.b) == (10000, 1000)


def test_hints_and_priorities(spark):
    rows = spark.createDataFrame([("python", "os.system(x); cursor.execute(query)"), ("java", "statement"), ("javascript", "e.innerHTML = eval(x)"), ("go", "eval")], "language string, code string")
    got = {r.language: r.h for r in rows.select("language", detection.hints(F.col("code"), F.col("language")).alias("h")).collect()}
    assert got == {"python": ["检查命令注入漏洞", "检查SQL注入漏洞", "检查代码注入漏洞"], "java": [], "javascript": ["检查代码注入漏洞", "检查XSS漏洞"], "go": []}
    files = spark.createDataFrame([("api/user_test.py", "python"), ("x/readme.md", "x"), ("a.json", "json")], "path string, language string")
    name = F.element_at(F.split("path", "/"), -1)
    got = [(r.p, r.s) for r in files.select("path", detection.priority(F.col("path"), F.col("language")).alias("p"), detection.skip_reason(name, F.lit(10)).alias("s")).collect()]
    assert got == [(13, "test"), (0, "documentation"), (0, "config")]


def test_relevant_code(spark):
    lines = [f"x{i} = 1" for i in range(60)]
    lines[10], lines[40] = "cursor.execute(a)", "def f():"
    row = spark.createDataFrame([("\n".join(lines),)], "c string").select(detection.relevant_code(F.col("c"), "python", 100).alias("a"), detection.optimised(F.col("c"), "python").alias("b"), detection.optimised(F.col("c"), "python", quick=True).alias("q")).first()
    assert row.a.split("\n") == ["# ... (省略第0-7行)", *(f"{i + 1:4d}: {lines[i]}" for i in range(8, 13)), "# ... (省略第13-39行)", f"  41: {lines[40]}"]
    assert row.b == "\n".join(lines) and row.q.startswith("\n".join(lines[:20]) + "\n\n# ... ")


def test_reports_in_order(spark, tmp_path):
    """Equal lines and types are ordered by severity and the key that is given; HTML is escaped."""
    rows = spark.createDataFrame([("f<1>", "low", "T", 3, 2), ("f<1>", "low", "T", 3, 1), ("f<1>", "high", "T", 3, 3)], "file string, severity string, type string, line int, id int")
    lines = tables.report_lines(rows.withColumn("type", F.concat("type", F.col("id").cast("string"))), "id")
    assert [r.text for r in lines.filter("section = 1").orderBy("number").collect()] == ["1. [low] T1 (line 3)", "2. [low] T2 (line 3)", "3. [high] T3 (line 3)"]
    same = tables.report_lines(rows.withColumn("text_id", F.col("id")), "id").filter("section = 1")
    assert [r.text for r in same.orderBy("number").collect()] == ["1. [high] T (line 3)", "2. [low] T (line 3)", "3. [low] T (line 3)"]
    tables.html_report(rows, str(tmp_path / "h"), "id")
    html = "\n".join(r.value for r in spark.read.text(str(tmp_path / "h")).collect())
    assert "<h2>f&lt;1&gt;</h2>" in html and html.count("<p>") == 5


def test_seeded_provider_order(spark):
    some = spark.createDataFrame([(c,) for c in "abcdef"], "name string")
    orders = {tuple(r.name for r in analysis.random_order(some, seed).collect()) for seed in range(6)}
    assert len(orders) > 1 and all(sorted(o) == list("abcdef") for o in orders)
    assert [r.name for r in analysis.random_order(some, 1).collect()] == [r.name for r in analysis.random_order(some, 1).collect()]
