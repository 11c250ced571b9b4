"""Pages in turn, by number and by cursor, equal the full sort."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from veritide.operators.pages import Pages


@pytest.mark.parametrize("descending", [False, True])
def test_pages_equal_the_full_sort(spark, descending):
    draw = random.Random(5)
    values = [(i, draw.choice([None, 7.0, draw.randrange(40) / 2, float(i)]), draw.choice("ab")) for i in range(230)]
    rows = spark.createDataFrame(values, "id long, v double, s string").repartition(3).cache()
    wanted = [r[0] for r in sorted(values, key=lambda r: (r[1] is None, 0 if r[1] is None else -r[1] if descending else r[1], r[2], r[0]))]
    pages = Pages(rows, "v", "s", "id", size=23, descending=descending, stretches=12)
    assert pages.total() == 230
    by_number = [[r.id for r in pages.number(k).collect()] for k in range(1, 12)]
    assert sum(by_number, []) == wanted and by_number[-1] == [] and pages.number(0).collect() == []
    by_cursor, cursor = [], None
    for _ in range(11):
        page = pages.after(cursor).collect()
        by_cursor += [r.id for r in page]
        cursor = page[-1].asDict() if page else cursor
    assert by_cursor == wanted


def test_a_page_reads_a_range(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(0, 50_000).select("id", (F.col("id") * 2).alias("v")).repartitionByRange(8, "v").sortWithinPartitions("v").write.parquet(path)
    rows = spark.read.parquet(path)
    pages = Pages(rows, "v", "id", size=10, stretches=100)
    page = pages.number(3001)
    assert [r.id for r in page.collect()] == list(range(30_000, 30_010))
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(v," in plan and "LessThanOrEqual(v," in plan
    read = page._jdf.queryExecution().optimizedPlan().toString()
    assert "v" in read and pages.after({"v": 60_000, "id": 30_000}).first().id == 30_001
    ends, counts = pages.stretches()
    assert max(counts) <= 3 * 50_000 / 100 and len(ends) <= 100


def test_empty_tables_and_only_nulls(spark):
    none = Pages(spark.createDataFrame([], "id long, v double"), "v", "id")
    assert none.total() == 0 and none.number(1).collect() == [] and none.after().collect() == []
    nulls = Pages(spark.createDataFrame([(i, None) for i in range(5)], "id long, v double"), "v", "id", size=2)
    assert [[r.id for r in nulls.number(k).collect()] for k in (1, 2, 3)] == [[0, 1], [2, 3], [4]]
    assert [r.id for r in nulls.after({"v": None, "id": 3}).collect()] == [4]
    with pytest.raises(ValueError):
        Pages(nulls.rows, "v", size=2)
