"""Answers that are cut, split over several blocks or broken in places keep every complete finding."""

from __future__ import annotations

import json
import random

from veritide.operators import findings

ANSWER = "file string, language string, response string"


def of(spark, *texts):
    rows = findings.parsed(spark.createDataFrame([(str(i), "python", t) for i, t in enumerate(texts)], ANSWER)).collect()
    return [[(r.type, r.line, r.description) for r in sorted(rows, key=lambda r: r.seq) if r.file == str(i)] for i in range(len(texts))]


def test_cut_answers_keep_complete_findings(spark):
    draw, items = random.Random(2), []
    for i in range(6):
        items.append({"type": f"t{i}", "line": i, "description": draw.choice(['a {brace', 'quote \" and \\ slash', "list [1, 2]", "``` fence", "漏洞 } ]"]) + str(i), "extra": {"deep": {"er": [1, {"x": "}"}]}}})
    whole = "Text before {not json}\n```json\n" + json.dumps({"findings": items}, ensure_ascii=False) + "\n```\nafter {it} [all]"
    ends, at = [], whole.index("[{") + 1
    for x in items:
        at = whole.index(text := json.dumps(x, ensure_ascii=False), at) + len(text)
        ends.append(at)
    cuts = sorted({len(whole), *ends, *(e - 1 for e in ends), *(draw.randrange(whole.index("[{") + 1, len(whole)) for _ in range(120))})
    for cut, got in zip(cuts, of(spark, *(whole[:c] for c in cuts))):
        n = sum(e <= cut for e in ends)
        assert got == [(x["type"], x["line"], x["description"]) for x in items[:n]], cut


def test_several_blocks_broken_objects_and_other_types(spark):
    got = of(
        spark,
        'x\n```json\n{"findings": [{"type": "a", "line": 1}]}\n```\nand\n```json\n{"findings": [{"type": "b", "line": "7"}, {"type": \'c\'}, {"type": "d", "line": "none", "description": null}]}\n```',
        '```json\n{"findings": []}\n``` 漏洞 XSS', '```json\n{"other": 1}\n```\n发现XSS漏洞', "nothing", None, '{"findings": [{"type": "no fence"}]}',
        '```json\n{"summary": "two", "findings" : [ {"type": "a"} , {"type": "b"} ] , "more": [{"type": "c"}]}',
    )
    assert got[0] == [("a", 1, ""), ("b", 7, ""), ("d", 0, "")]
    assert got[1] == [] and got[2] == [("security_issue", 0, "发现XSS漏洞")] and got[3] == got[4] == got[5] == []
    assert [x[0] for x in got[6]] == ["a", "b"]


def test_long_answers(spark):
    items = ", ".join(json.dumps({"type": "t", "line": i, "description": "word " * 50}) for i in range(5000))
    got = of(spark, '```json\n{"findings": [' + items + "]}\n```", '```json\n{"findings": [{"type": "' + "x" * 1_000_000)
    assert [x[1] for x in got[0]] == list(range(5000)) and got[1] == []
