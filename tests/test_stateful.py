"""State machines, their batch fold and their stream."""

from __future__ import annotations

import datetime as dt

import pytest

from veritide.streaming import machines, operators


def run(machine, *events):
    state, out = None, []
    for now, event in events:
        state, result = machine.step(machine.start(now) if state is None else state, now, {"tokens": 0, "success": True} | event)
        out.append(result)
    return out


def test_token_bucket():
    got = run(machines.token_bucket(10, 1), (0.0, {"tokens": 8}), (0.0, {"tokens": 5}), (3.0, {"tokens": 5}))
    assert [g[:2] for g in got] == [(True, 0.0), (False, 3.0), (True, 0.0)]


def test_admission_keeps_the_spent_request():
    got = run(machines.admission(2, 60), (0.0, {"tokens": 100}), (0.0, {"tokens": 100}), (0.0, {"tokens": 1}))
    assert [g[0] for g in got] == [False, False, False]


def test_circuit_breaker():
    fail = lambda t: (t, {"success": False})
    ok = lambda t: (t, {"success": True})
    b = machines.circuit_breaker()
    assert run(b, *map(fail, (0.0, 1.0, 2.0, 3.0, 4.0)))[-1] == ("open", True)
    assert run(b, fail(0.0), fail(1.0), ok(2.0), fail(3.0), fail(4.0), fail(5.0))[-1] == ("closed", True)
    opened = list(map(fail, (0.0, 1.0, 2.0, 3.0, 4.0)))
    assert run(b, *opened, ok(64.0))[-1] == ("open", False)
    assert run(b, *opened, ok(64.1))[-1] == ("half_open", True)
    assert run(b, *opened, ok(65.0), ok(66.0), ok(67.0))[-1] == ("closed", True)
    assert run(b, *opened, ok(65.0), fail(66.0))[-1] == ("open", True)


@pytest.mark.parametrize("errors, wanted", [(16, 7), (10, 10), (2, 13)])
def test_concurrency(errors, wanted):
    events = [(0.0, {"success": i >= errors}) for i in range(99)] + [(31.0, {"success": True})]
    assert run(machines.adaptive_concurrency(10, 3, 20), *events)[-1] == (wanted,)


def some_events(spark):
    start = dt.datetime(2024, 1, 1)
    rows = [(f"k{i % 3}", i, start + dt.timedelta(seconds=7 * i), float(i % 5), i % 4 != 0) for i in range(60)]
    return spark.createDataFrame(rows, operators.EVENT)


def dealt(spark, rows, path, files):
    """The rows in so many files, at random, read one file a batch."""
    import random

    draw = random.Random(11)
    all_rows = rows.collect()
    parts = [[] for _ in range(files)]
    for k, r in enumerate(sorted(all_rows, key=lambda r: (r.ts is None, r.ts or 0))):
        parts[min(files - 1, max(0, k * files // len(all_rows) + draw.choice([-1, 0, 0, 1])))].append(r)
    for k, part in enumerate(parts):
        spark.createDataFrame(part, rows.schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


def all_of(spark, query, name, tmp_path, mode="append"):
    q = query.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"check-{name}")).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set(key, before)
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def with_an_end(spark, rows):
    """And an event of its own key so late that the watermark passes all others."""
    end = spark.createDataFrame([("end", 999, dt.datetime(2024, 1, 3), 0.0, True), ("end", 1000, dt.datetime(2024, 1, 3, 0, 0, 1), 0.0, True)], operators.EVENT)
    return rows.unionByName(end)


@pytest.mark.parametrize("files", [1, 5])
def test_stream_equals_batch(spark, tmp_path, rocks, files):
    """Whatever files events come in, in order or not; an event without a time changes nothing."""
    rows = some_events(spark).unionByName(spark.createDataFrame([("k0", 500, None, 1.0, False)], operators.EVENT))
    for name, machine, idle in (("bucket", machines.token_bucket(10, 0.5), None), ("breaker", machines.circuit_breaker(2, 30.0), 60.0)):
        stream = dealt(spark, with_an_end(spark, rows), str(tmp_path / f"in-{name}"), files)
        got = all_of(spark, operators.streamed(stream, machine, "30 minutes", idle, ticks=True), f"{name}{files}", tmp_path).filter("key <> 'end' and id is not null")
        wanted = operators.folded(rows, machine, idle, ticks=True).filter("id is not null")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, wanted.collect())) and got.count() == 60


def test_a_breaker_half_opens_without_an_event_and_idle_keys_leave(spark, tmp_path, rocks):
    start = dt.datetime(2024, 1, 1)
    rows = spark.createDataFrame([("a", i, start + dt.timedelta(seconds=i), 0.0, False) for i in range(3)] + [("b", 10, start, 0.0, True)], operators.EVENT)
    path = str(tmp_path / "in")
    stream = dealt(spark, with_an_end(spark, rows), path, 1)
    query = operators.streamed(stream, machines.circuit_breaker(2, 30.0), "1 second", idle=3600.0, ticks=True).writeStream.format("memory").queryName("half").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    got = {(r.key, r.id, r.ts, r.breaker) for r in spark.table("half").collect()}
    # The third failure comes while the breaker is open and isn't executed, so thirty seconds count from the second.
    assert ("a", None, start + dt.timedelta(seconds=31), "half_open") in got and ("a", 2, start + dt.timedelta(seconds=2), "open") in got
    last = [p["stateOperators"][0]["numRowsTotal"] for p in (x if isinstance(x, dict) else __import__("json").loads(x.json) for x in query.recentProgress) if p["stateOperators"]]
    query.stop()
    assert last[-1] < max(last)
    assert {r.key for r in operators.undated(rows.withColumn("ts", __import__("pyspark.sql.functions", fromlist=["lit"]).lit(None).cast("timestamp"))).collect()} == {"a", "b"}


def test_idle_keys_start_anew_in_a_table(spark):
    start = dt.datetime(2024, 1, 1)
    rows = spark.createDataFrame([("a", i, start + dt.timedelta(seconds=s), 8.0, True) for i, s in enumerate((0, 1, 100, 101))], operators.EVENT)
    got = sorted((r.id, r.admitted) for r in operators.folded(rows, machines.token_bucket(10, 0.0001), idle=60.0).collect())
    assert got == [(0, True), (1, False), (2, True), (3, False)]


def test_outer_joined_streams_give_what_nothing_follows_once(spark, tmp_path, rocks):
    rows = some_events(spark)
    left, right = rows.filter("id % 7 = 0"), rows.filter("id % 5 = 0 and id > 12")
    streams = [dealt(spark, with_an_end(spark, x), str(tmp_path / n), 4) for n, x in (("l", left), ("r", right))]
    got = all_of(spark, operators.joined_streams(*streams, "40 seconds", "left_outer", "10 minutes"), "outer", tmp_path).filter("key <> 'end'")
    wanted = operators.joined_streams(left, right, "40 seconds", "left_outer")
    as_rows = lambda f: sorted(map(repr, map(tuple, f.collect())))
    assert as_rows(got) == as_rows(wanted) and wanted.filter("second_id is null").count() > 0


def test_late_rows_are_kept_and_copies_dropped(spark, tmp_path, rocks):
    start = dt.datetime(2024, 1, 1)
    rows = lambda *xs: spark.createDataFrame([("k", i, None if s is None else start + dt.timedelta(seconds=s), 0.0, True) for i, s in xs], operators.EVENT)
    parts = [rows((1, 0), (2, 1000)), rows((3, 500), (4, 100), (5, None), (6, 1500)), rows((7, 950), (8, 850))]
    path = str(tmp_path / "in")
    for p in parts:
        p.coalesce(1).write.mode("append").parquet(path)
    side = operators.LateRows(str(tmp_path / "good"), str(tmp_path / "late"), "10 minutes")
    for run in range(2):  # all batches come again
        stream = spark.readStream.schema(operators.EVENT).option("maxFilesPerTrigger", 1).parquet(path)
        side.sink(stream).option("checkpointLocation", str(tmp_path / f"c{run}")).trigger(availableNow=True).start().awaitTermination(120)
        assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "late")).collect()) == [4, 5, 8]
        assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "good")).collect()) == [1, 2, 3, 6, 7]
    again = parts[0].unionByName(parts[0])
    again.coalesce(1).write.parquet(str(tmp_path / "again"))
    firsts = operators.first_of_each(spark.readStream.schema(operators.EVENT).parquet(str(tmp_path / "again")), "key", "id")
    assert sorted(r.id for r in all_of(spark, firsts, "firsts", tmp_path).collect()) == [1, 2]


def test_windows_on_a_stream(spark, tmp_path):
    rows = some_events(spark)
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = operators.windowed_usage(stream).writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    assert sorted(map(tuple, spark.table("windows").collect())) == sorted(map(tuple, operators.windowed_usage(rows).collect()))


def test_joined_streams_on_tables(spark):
    rows = some_events(spark)
    pairs = operators.joined_streams(rows.filter("id < 3"), rows, "1 minute")
    assert {(r.first_id, r.second_id) for r in pairs.collect() if r.first_id == 0} == {(0, 0), (0, 3), (0, 6)}


def test_long_histories_in_batches(spark, monkeypatch):
    monkeypatch.setattr(operators, "ROWS_AT_ONCE", 7)
    rows = some_events(spark).unionByName(some_events(spark).selectExpr("cast(null as string) key", "id + 100 id", "ts", "tokens", "success"))
    machine = machines.token_bucket(10, 0.5)
    got = {(r.key, r.id): (r.admitted, r.left) for r in operators.folded(rows, machine).collect()}
    wanted = {}
    for key in ("k0", "k1", "k2", None):
        state = None
        for e in sorted((r for r in rows.collect() if r.key == key), key=lambda r: (r.ts, r.id)):
            now = e.ts.timestamp()
            state, result = machine.step(machine.start(now) if state is None else state, now, e.asDict())
            wanted[key, e.id] = (result[0], result[2])
    assert got == wanted
