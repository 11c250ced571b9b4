"""Substring index, reachability and literal prefilter against plain versions; functions that no query reads tables for."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from veritide.functions import detection, false_positives, frontend, languages, patterns, prefilter
from veritide.operators import findings, graphs, substrings, usage


@pytest.mark.parametrize("part", [10_000, 3])
def test_contained_against_brute_force(spark, monkeypatch, part):
    monkeypatch.setattr(substrings, "PART", part)
    draw = random.Random(1)
    word = lambda: "".join(draw.choice("abé日😀") for _ in range(draw.randint(1, 6)))
    texts = [(f"t{i}", " ".join(word() for _ in range(draw.randint(0, 12)))) for i in range(80)] + [("none", None), (None, "abab"), ("empty", "")]
    strings = [(word(),) for _ in range(150)] + [("",), (None,), ("ab",), ("ab",), ("zzz",), ("a b",)]
    found = substrings.contained(spark.createDataFrame(texts, "id string, text string"), spark.createDataFrame(strings, "string string"))
    wanted = {(i, s) for i, t in texts for (s,) in strings if i and t and s and s in t}
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == wanted
    plan = found._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert substrings.contained(spark.createDataFrame(texts, "id string, text string"), spark.createDataFrame([], "string string")).count() == 0
    assert substrings.contained(spark.createDataFrame([], "id string, text string"), spark.createDataFrame(strings, "string string")).count() == 0


@pytest.mark.parametrize(("part", "blocked"), [(500_000, 10_000), (40, 1)])
def test_first_texts_of_a_string(spark, monkeypatch, part, blocked):
    monkeypatch.setattr(substrings, "PART", part)
    monkeypatch.setattr(substrings, "BLOCKED", blocked)
    draw = random.Random(2)
    word = lambda most: "".join(draw.choice("abé日😀") for _ in range(draw.randint(1, most)))
    texts = [(f"t{i:03}", " ".join(word(20) for _ in range(draw.randint(0, 9))) + " the") for i in range(200)] + [("none", None), (None, "the"), ("empty", "")]
    draw.shuffle(texts)
    strings = [(w,) for w in {word(11) for _ in range(100)} | {"the", "zzz", "", "a b"} | {(t or "")[3:k] for _, t in texts[:20] for k in (7, 12, 30)}]
    frame = spark.createDataFrame(texts, "id string, text string").repartition(3)
    wanted = {(i, s) for (s,) in strings if s for i in sorted(i for i, t in texts if i and t and s in t)[:3]}
    got = [tuple(r) for r in substrings.first_containing(frame, spark.createDataFrame(strings, "string string"), 3).collect()]
    assert len(got) == len(set(got)) and set(got) == wanted
    # A task gives a common string's first texts only, and not a row for each text.
    assert substrings.searched(substrings.plain(frame), ["the"], 3).count() == 9


def test_callers_of_some_files(spark):
    files = spark.createDataFrame([(f"z/c{i}.py", "target1 target2", 10) for i in range(3)], "path string, content string, size long")
    called = spark.createDataFrame([("b/target1.txt",)], "path string")
    assert {tuple(r) for r in findings.caller_edges(files, mode="all", called=called).select("path", "caller").collect()} == {("b/target1.txt", f"z/c{i}.py") for i in range(3)}


def test_all_files_are_callers(spark):
    rows = [(f"z/c{i:03}.py", f"import target{i % 3} index.js", 10) for i in range(130)] + [(f"b/target{i}.py", "", 1) for i in range(3)] + [("b/index.js", "index.js", 1), ("b/other.txt", "target0", 1)]
    files = spark.createDataFrame(rows, "path string, content string, size long")
    got = {}
    for r in findings.caller_edges(files, mode="all", read=None).collect():
        got.setdefault((r.path, r.pattern), []).append((r.n, r.caller))
    for path, name in [(f"b/target{i}.py", f"target{i}") for i in range(3)] + [("b/index.js", "index.js")]:
        callers = sorted(p for p, text, _ in rows if name in text and p != path and p.endswith((".py", ".js")))[:5]
        assert [c for _, c in sorted(got[path, name])] == callers
    assert all(p != c for (p, _), xs in got.items() for _, c in xs)


def test_reachable_at_any_depth_and_through_a_hub(spark):
    chain = [(i, i + 1) for i in range(30)] + [(30, 0), (3, 3), (None, 1), (2, None), (5, 6), (5, 6)]
    edges = spark.createDataFrame(chain, "a long, b long")
    starts = spark.createDataFrame([(0,), (7,), (99,), (None,)], "node long")
    got = {(r.start, r.node): r.depth for r in graphs.reachable(edges, starts).collect()}
    assert got == {(0, i): i for i in range(31)} | {(7, (7 + i) % 31): i for i in range(31)} | {(99, 99): 0}
    assert {r.depth for r in graphs.reachable(edges, starts, 2).collect()} == {0, 1, 2}
    n = 100_000
    hub = spark.range(n).select((F.col("id") + 1).alias("a"), F.lit(0).cast("long").alias("b")).union(spark.range(n).select(F.lit(0).cast("long"), F.col("id") + 1))
    counts = graphs.reachable(hub, spark.createDataFrame([(1,), (0,)], "node long")).groupBy("start", "depth").count().collect()
    assert {(r.start, r.depth): r["count"] for r in counts} == {(1, 0): 1, (1, 1): 1, (1, 2): n - 1, (0, 0): 1, (0, 1): n}


def test_pieces_are_in_every_match():
    assert prefilter.pieces(r"pickle\.loads?\s*\(") == [("(",), ("pickle.load",)]
    assert prefilter.pieces(r"(?:ab|cd)e+x?['\"]") == [("'", '"'), ("ab", "cd"), ("e",)] and prefilter.pieces(r"x*|y") == [] and prefilter.pieces(r"\d+[a-z]") == []
    draw = random.Random(4)
    patterns = [p for _, some in detection.FAMILIES.values() for p in some] + [p for _, p in frontend.RULES]
    parts = sorted({x for p in patterns for some in prefilter.pieces(p) for x in some}) + list("=:('\")[]{}+ x1;")
    seen = 0
    for _ in range(30_000):
        line = "".join(draw.choice(parts) for _ in range(draw.randint(1, 9)))
        line = line.upper() if draw.random() < 0.2 else line
        for p in patterns:
            if re.search(p, line, re.I | re.A):
                seen += 1
                assert all(any(x in line.lower() for x in some) for some in prefilter.pieces(p)), (p, line)
    assert seen > 5_000


def test_language_patterns_run_only_where_their_pieces_are(spark):
    draw = random.Random(6)
    parts = [x for ps in languages.CONTENT.values() for p in ps for some in prefilter.pieces(p) for x in some] + list("=:('\")[]{}<>$@ x1;\n") + [" x = ", " a (", " b\n", "claſs a", "İmport b", "pacKage c", "ımport d"]
    texts = ["".join(draw.choice(parts) + draw.choice([" ", "", " w"]) for _ in range(draw.randint(1, 25))) for _ in range(600)]
    rows = spark.createDataFrame([(i, t.upper() if i % 7 == 0 else t) for i, t in enumerate([*texts, "", None])], "id int, content string")
    head = F.substring("content", 1, languages.READ)
    plain = {lang: sum((F.regexp_count(head, F.lit(patterns.regex(p, ignore_case=True, multiline=True))) for p in ps), F.lit(0)) for lang, ps in languages.CONTENT.items()}
    both = rows.select(*(c.alias(f"a_{lang}") for lang, c in plain.items()), *(languages.content_hits(F.col("content"), lang).alias(f"b_{lang}") for lang in plain)).collect()
    assert all(r[f"a_{lang}"] == r[f"b_{lang}"] for r in both for lang in plain) and sum(r[f"a_{lang}"] or 0 for r in both for lang in plain) > 500
    plan = rows.select(languages.by_content(F.col("content")))._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains(" in plan or "contains(" in plan.lower()


def test_lines_are_lowered_before_they_are_filtered(spark):
    files = spark.createDataFrame([("a", "x\nPICKLE.loads(x)")], "path string, content string")
    pages = files.withColumn("content", F.lit("a\n<A href=JAVASCRIPT:x onclick=eval(x)>"))
    for rows in (detection.findings(files), frontend.hot_spots(pages, "path")):
        filters = [line for line in rows._jdf.queryExecution().optimizedPlan().toString().split("\n") if line.lstrip(" :+-").startswith("Filter")]
        assert filters and not any("lower(" in line for line in filters)
    assert [r.line for r in detection.findings(files).collect()] == [2]


def test_rule_counts_and_invented_curve(spark):
    counts = {(r.scope, r.language): r.n for r in false_positives.rule_counts(spark).collect()}
    assert counts["project", "any"] == len(false_positives.PROJECT_RULES) and sum(n for (scope, _), n in counts.items() if scope == "universal") >= len(false_positives.UNIVERSAL_RULES)
    curve = usage.synthetic_history(usage.day_spine(spark, "2024-01-01", "2024-01-30"), 120.0, 50).orderBy("date").collect()
    assert len(curve) == 30 and curve[-1].used == int(120 * 50 * 0.8) and curve[-3].used == int(120.0 * 50 * 0.6 * 0.9 * (0.8 + 0.08 * 2))
