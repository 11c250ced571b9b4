"""Scans, filters, languages, manifests and project facts on small fixtures."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from veritide.functions import languages
from veritide.functions.patterns import glob, matches_globs
from veritide.operators import projects
from veritide.schemas import quarantine
from veritide.sources import files, manifests


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def paths(spark, *names, content=""):
    return files.described(table(spark, [("p", n, content, len(content)) for n in names], "project_id string, path string, content string, size long"))


def test_ignored_folders_and_files(spark):
    rows = paths(spark, "test.py", "__pycache__/test.pyc", ".git/config")
    assert [r.path for r in files.scanned(rows).collect()] == ["test.py"]


def test_source_files(spark):
    rows = paths(spark, "test.py", "test.js", "test.java", "Makefile", "Dockerfile", "test.txt", "test.log", "test.pyc")
    found = {r.path for r in rows.filter(files.is_source(F.col("name"))).collect()}
    assert found == {"test.py", "test.js", "test.java", "Makefile", "Dockerfile"}


def test_decisions_in_order(spark):
    cases = {
        "app.env": "force_included", "node_modules/a.py": "ignore_pattern", "a.css": "css_file", "a.js": "js_file", "my_test.py": "test_file", "logs/x.py": "log_file", "src/a.py": "included",
    }
    found = {r.path: r.reason for r in files.decided(paths(spark, *cases)).collect()}
    assert found == cases
    library = files.decided(paths(spark, "lib.py", content="# Generated by tool\n")).first()
    assert (library.reason, library.included) == ("library_file", False)
    big = files.decided(paths(spark, "big.py").withColumn("size", F.lit(512_001))).first()
    assert big.reason == "too_large"
    stats = files.filter_stats(files.decided(paths(spark, *cases))).first()
    assert (stats.total_files, stats.included_files, stats.efficiency) == (7, 2, 71.4)


def test_globs():
    import re

    for pattern, text, fits in (("*.py", "a/b.py", True), ("a?c", "abc", True), ("[!x]y", "xy", False), ("[ab]y", "by", True), ("a.b", "axb", False), ("docs/**", "docs/a/b", True)):
        assert bool(re.match(glob(pattern), text)) is fits


def test_folder_patterns(spark):
    rows = paths(spark, "es", "es/a", "best/a")
    assert {r.path for r in rows.filter(matches_globs(F.col("path"), ["es/"])).collect()} == {"es", "es/a"}


@pytest.mark.parametrize(
    "name, content, language",
    [
        ("a.py", "", "python"), ("a.js", "", "javascript"), ("a.java", "", "java"), ("a.unknown", "", None), ("setup.py", "", "python"), ("package.json", "", "javascript"), ("pom.xml", "", "java"),
        ("x", "#!/usr/bin/env python3\n", "python"), ("x", "#!/usr/bin/env node\n", "javascript"), ("x", "nothing", None),
        ("x", "import os\ndef main():\n    pass\nif __name__ == '__main__':\n    main()\n", "python"), ("x", "function f() {}\nconst a = require('b')\nmodule.exports = f\n", "javascript"),
    ],
)
def test_languages(spark, name, content, language):
    row = table(spark, [(name, content)], "name string, content string").select(languages.detect(F.col("name"), F.col("content")).alias("language")).first()
    assert row.language == language


def test_language_confidence(spark):
    row = table(spark, [("a.py", "import os\nimport sys\n")], "name string, content string").select(languages.confidences(F.col("name"), F.col("content")).alias("c")).first()
    assert row.c["python"] == pytest.approx(0.7)


def test_scan_reads_text_without_bad_bytes(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_bytes(b"x = 1\xff\n")
    row = files.scan(spark, str(tmp_path), "p").first()
    assert (row.path, row.name, row.language, row.content, row.size) == ("src/a.py", "a.py", "python", "x = 1\n", 7)
    assert len(row.hash) == 64


def manifest(spark, name, text):
    return files.described(table(spark, [("p", name, text, len(text))], "project_id string, path string, content string, size long"))


def test_requirements(spark):
    text = "# comment\nrequests==2.28.0\nflask>=1.0.0\ndjango\n# more\npytest>=6.0.0  # why\n-r other.txt\n"
    found = [(r.name, r.version, r.source) for r in manifests.dependencies(manifest(spark, "requirements.txt", text)).orderBy("seq").collect()]
    assert found == [("requests", "2.28.0", "pip"), ("flask", "1.0.0", "pip"), ("django", None, "pip"), ("pytest", "6.0.0", "pip")]


def test_other_manifests(spark):
    package = '{"dependencies": {"express": "^4.18.0", "lodash": "^4.17.21"}, "devDependencies": {"jest": "^28.0.0"}}'
    found = {(r.name, r.version, r.source) for r in manifests.dependencies(manifest(spark, "package.json", package)).collect()}
    assert found == {("express", "^4.18.0", "npm"), ("lodash", "^4.17.21", "npm"), ("jest", "^28.0.0", "npm")}
    go = "module x\n\nrequire (\n\tgithub.com/a/b v1.2.3\n\t// note\n\tc v0.1.0\n)\nrequire d v2.0.0\n"
    assert {(r.name, r.version) for r in manifests.go_mod(manifest(spark, "go.mod", go)).collect()} == {("github.com/a/b", "v1.2.3"), ("c", "v0.1.0"), ("d", "v2.0.0")}
    cargo = '[package]\nname = "x"\n[dependencies]\nserde = "1.0"\ntokio = { version = "1" }\n[dev-dependencies]\nfoo = "2"\n'
    assert {(r.name, r.version) for r in manifests.dependencies(manifest(spark, "Cargo.toml", cargo)).collect()} == {("serde", "1.0"), ("tokio", '{ version = "1" }')}
    toml = '[tool.poetry.dependencies]\npython = "^3.9"\nrich = "^13"\n[tool.black]\nline = "1"\n'
    assert {(r.name, r.version) for r in manifests.dependencies(manifest(spark, "pyproject.toml", toml)).collect()} == {("rich", "^13")}


def test_project_facts(spark):
    rows = paths(spark, "models/user.py", "views/user_view.py", "controllers/user_controller.py")
    assert projects.architecture(rows).first().architecture == "MVC"
    web = paths(spark, "app.py", "templates/index.html")
    deps = table(spark, [("p", "flask")], "project_id string, name string")
    types = projects.project_type(web, deps)
    assert types.first().project_type == "web_application"
    entries = [r.path for r in projects.entry_points(paths(spark, "main.py", "app.py", "utils.py"), types).orderBy("n").collect()]
    assert sorted(entries) == ["app.py", "main.py"]
    counts = {r.language: r.n for r in projects.language_counts(paths(spark, "a.py", "b.js", "c.py")).collect()}
    assert counts == {"python": 2, "javascript": 1}


def test_validators(spark):
    rows = table(spark, [("a", 1), ("", 1), ("b", -1), (None, 1)], "path string, size long")
    good, bad = quarantine(rows, "file")
    assert good.count() == 1 and bad.count() == 3
    confidences = table(spark, [(0.5, 1), (1.5, 1), (-0.1, 1), (0.5, 0), (None, None)], "confidence double, line int")
    assert quarantine(confidences, "finding")[0].count() == 2


def test_scan_reads_only_what_passes(spark, tmp_path):
    for path, text in (("src/a.py", "x = 1"), ("src/b.log", "no"), ("node_modules/c.js", "no"), ("big.py", "y" * 600_000), ("app.env", "K=1"), ("notes.md", "text")):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    everything = files.scan(spark, str(tmp_path), "p")
    assert everything.count() == 6 and {r.path for r in everything.filter("size > 1000").collect()} == {"big.py"}
    some = files.scan(spark, str(tmp_path), "p", files.Filtering())
    assert {(r.path, r.content) for r in some.collect()} == {("src/a.py", "x = 1")} and some.columns == everything.columns
    assert files.scan(spark, str(tmp_path), "p", files.Filtering(include_extensions=("nothing",))).count() == 0


def test_uploads(spark, tmp_path):
    import zipfile

    from veritide.sources import uploads

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("src/main.py", "print(1)")
        z.writestr("../out.py", "no")
    (tmp_path / "b.py").write_text("x")
    (tmp_path / "c.zip").write_bytes(b"no archive")
    members = uploads.ingest(spark, str(tmp_path))
    got = {(r.upload.rpartition("/")[2], r.path, bytes(r.data) if r.data is not None else None) for r in members.collect()}
    assert got == {("a.zip", "src/main.py", b"print(1)"), ("a.zip", "../out.py", None), ("b.py", "b.py", b"x"), ("c.zip", None, None)}
    totals = {r.upload.rpartition("/")[2]: (r.total_files, r.errors, r.valid) for r in uploads.upload_totals(members).collect()}
    assert totals == {"a.zip": (1, 1, True), "b.py": (1, 0, True), "c.zip": (0, 1, False)}


def test_damaged_and_large_archives(spark):
    import io
    import zipfile

    from veritide.sources import uploads

    made = io.BytesIO()
    with zipfile.ZipFile(made, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in (("a.py", "x = 1\n" * 500), ("b.py", "y = 2\n" * 500), ("big.txt", "z" * 100_000)):
            z.writestr(name, text)
    data = bytearray(made.getvalue())
    at = data.index(b"b.py") + 4
    data[at : at + 8] = b"\xff" * 8  # the second member's stream
    rows = spark.createDataFrame([("p/ok.zip", bytes(made.getvalue())), ("p/bad.zip", bytes(data)), ("p/cut.zip", bytes(data[: len(data) // 2])), ("p/none.zip", b""), ("p/null.zip", None)], "path string, content binary")
    got = {(r.upload, r.path): r for r in uploads.unpacked(rows, most=50_000).collect()}
    assert got["p/ok.zip", "b.py"].size == 3000 and got["p/ok.zip", "big.txt"].error == "too large"
    assert got["p/bad.zip", "a.py"].size == 3000 and got["p/bad.zip", "b.py"].error and got["p/bad.zip", "b.py"].data is None
    assert all(got[p, None].error for p in ("p/cut.zip", "p/none.zip", "p/null.zip"))
