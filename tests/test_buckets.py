"""Changing tables: batches that come again, deletes merged on read, rewriting of single buckets."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from veritide.sources.buckets import Buckets, cascade
from veritide.sources.cache import ResponseCache

ENTRY = "key string, response string, cached_at timestamp_ntz"


def entries(spark, *rows):
    return spark.createDataFrame([(k, r, t) for k, r, t in rows], "key string, response string, t string").select("key", "response", F.col("t").cast("timestamp_ntz").alias("cached_at"))


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def now(cache):
    return sorted((r.key or "", r.response) for r in cache.read().collect())


def test_batches_that_come_again_change_nothing(spark, tmp_path):
    cache = ResponseCache(spark, str(tmp_path), buckets=8)
    assert cache.read().collect() == [] and cache.touched() == [] and cache.rewrite() == []
    first = entries(spark, ("a", "1", "2024-01-01 00:00:00"), ("b", "1", "2024-01-01 00:00:00"), (None, "1", "2024-01-01 00:00:00"))
    second = entries(spark, ("a", "2", "2024-01-01 06:00:00"), ("b", "older", "2023-12-31 00:00:00"), ("c", "2", "2024-01-02 00:00:00"))
    assert cache.put(first, 0) and cache.put(second, 1)
    wanted = [("", "1"), ("a", "2"), ("b", "1"), ("c", "2")]
    assert now(cache) == wanted
    before = files(tmp_path)
    assert not cache.put(second, 1) and files(tmp_path) == before and now(cache) == wanted
    assert sorted(r.key for r in cache.fresh("2024-01-02 03:00:00").collect()) == ["a", "c"]
    assert cache.touched() == cache.rewrite() and cache.touched() == []
    assert now(cache) == wanted and not cache.put(first, 0) and now(cache) == wanted


def test_expiry_writes_only_the_buckets_that_have_expired_entries(spark, tmp_path):
    cache = ResponseCache(spark, str(tmp_path), buckets=16)
    cache.put(entries(spark, *((f"k{i}", "x", "2024-01-01 00:00:00" if i == 7 else "2024-01-05 00:00:00") for i in range(60))), 0)
    cache.rewrite()
    before = files(tmp_path / "base")
    hit = cache.expire("2024-01-05 12:00:00")
    assert len(hit) == 1 and len(now(cache)) == 59
    new = set(files(tmp_path / "base")) - set(before)
    assert new and all(f"bucket={hit[0]}/" in f for f in new)
    assert {f: t for f, t in files(tmp_path / "base").items() if f in before} == before
    assert cache.expire("2024-01-05 12:00:00") == []
    cache.put(entries(spark, ("k7", "back", "2024-01-05 01:00:00")), 1)
    assert len(now(cache)) == 60 and cache.touched() == hit


def test_a_slower_rewriting_fails(spark, tmp_path):
    cache = ResponseCache(spark, str(tmp_path), buckets=2)
    cache.put(entries(spark, ("a", "1", "2024-01-01 00:00:00")), 0)
    cache.rewrite()
    with pytest.raises(RuntimeError):
        cache._enter(1, {})


def test_a_stream_writes_the_cache(spark, tmp_path):
    source = tmp_path / "in"
    for k in range(3):
        entries(spark, *((f"k{i}", f"r{k}", f"2024-01-0{1 + k} 00:00:00") for i in range(k, 5))).coalesce(1).write.mode("append").parquet(str(source))
    cache = ResponseCache(spark, str(tmp_path / "cache"), buckets=4)
    for _ in range(2):  # the second run starts from a new checkpoint, so all batches come again
        stream = spark.readStream.schema(ENTRY).option("maxFilesPerTrigger", 1).parquet(str(source))
        run = cache.sink(stream).option("checkpointLocation", str(tmp_path / f"check{_}")).trigger(availableNow=True).start()
        run.awaitTermination(120)
    assert now(cache) == [("k0", "r0"), ("k1", "r1"), *((f"k{i}", "r2") for i in range(2, 5))]


def test_cascading_deletes_touch_only_what_they_hit(spark, tmp_path):
    def table(name, ddl, key, rows):
        t = Buckets(spark, str(tmp_path / name), StructType.fromDDL(ddl), key, buckets=16)
        t.put(spark.createDataFrame(rows, ddl), 0)
        t.rewrite()
        return t

    users = table("users", "id long, name string", "id", [(i, f"u{i}") for i in range(40)])
    tasks = table("tasks", "task long, user_id long", "user_id", [(100 + i, i % 40) for i in range(120)])
    notes = table("notes", "note long, task long", "task", [(1000 + i, 100 + i % 120) for i in range(240)])
    before = {t.path: files(f"{t.path}/base") for t in (users, tasks, notes)}
    cascade(spark.createDataFrame([(3,), (17,), (99,)], "id long"), [(users, "id"), (tasks, "task"), (notes, "note")], 1)
    left = {i for i in range(40)} - {3, 17}
    kept = {100 + i for i in range(120) if i % 40 in left}

    def check():
        assert {r.id for r in users.read().collect()} == left and {r.task for r in tasks.read().collect()} == kept
        assert sorted(r.note for r in notes.read().collect()) == [1000 + i for i in range(240) if 100 + i % 120 in kept]

    check()
    assert {t.path: files(f"{t.path}/base") for t in (users, tasks, notes)} == before
    hit = {t.path: t.rewrite() for t in (users, tasks, notes)}
    assert len(hit[users.path]) <= 3 and len(hit[tasks.path]) <= 3
    for t in (users, tasks, notes):
        assert {int(f.split("bucket=")[1].split("/")[0]) for f in set(files(f"{t.path}/base")) - set(before[t.path])} <= set(hit[t.path])
    check()
    users.put(spark.createDataFrame([(3, "again")], "id long, name string"), 2)  # comes after the delete
    assert {r.id for r in users.read().collect()} == left | {3}


def test_folders_that_are_replaced_are_not_read(spark, tmp_path):
    cache = ResponseCache(spark, str(tmp_path), buckets=4)
    cache.put(entries(spark, *((f"k{i}", "x", "2024-01-01 00:00:00") for i in range(20))), 0)
    cache.rewrite()
    plan = cache.read()._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "batch" in plan.split("PartitionFilters")[1]
    assert len(cache.read().inputFiles()) <= len(files(tmp_path))
