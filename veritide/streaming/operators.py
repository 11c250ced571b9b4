"""Stateful operators over finished tables and over streams; windows with watermarks; joins of streams.

Events without a time take no part in what follows time; ``undated`` lists them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from veritide.streaming.machines import Machine

EVENT = "key string, id long, ts timestamp, tokens double, success boolean"


def events(rows: DataFrame) -> DataFrame:
    """The columns machines read; missing ones are null."""
    have = set(rows.columns)
    kinds = [x.split() for x in EVENT.split(", ")]
    return rows.select(*((F.col(n) if n in have else F.lit(None)).cast(t).alias(n) for n, t in kinds))


def undated(rows: DataFrame) -> DataFrame:
    return events(rows).filter("ts is null")


class Chain:
    """The state of one key as its events come in order.

    A pause of more than ``idle`` seconds forgets the state. With ``ticks``, changes that are
    due between events are results too, without an id and at the time they are due.
    """

    def __init__(self, machine: Machine, idle: float | None = None, ticks: bool = False, state: tuple | None = None, last: float = 0.0):
        self.machine, self.idle, self.ticks, self.state, self.last = machine, idle, ticks, state, last

    def until(self, now: float, inclusive: bool = False) -> Iterator[tuple]:
        """Results (id, seconds, ...) of what is due before a time; then a state that was idle too long is forgotten."""
        if self.state is not None and self.machine.tick is not None:
            due = self.machine.due(self.state)
            gone = float("inf") if self.idle is None else self.last + self.idle
            if due is not None and due <= gone and (due < now or inclusive and due == now):
                self.state, result = self.machine.tick(self.state)
                if self.ticks:
                    yield (None, due, *result)
        if self.state is not None and self.idle is not None and now - self.last > self.idle:
            self.state = None

    def step(self, now: float, event: dict) -> Iterator[tuple]:
        yield from self.until(now)
        self.state, result = self.machine.step(self.machine.start(now) if self.state is None else self.state, now, event)
        self.last = now
        yield (event["id"], now, *result)

    def wakes(self) -> list[float]:
        """When something is due without an event."""
        if self.state is None:
            return []
        return [t for t in (self.machine.due(self.state), None if self.idle is None else self.last + self.idle) if t is not None]


ROWS_AT_ONCE = 10_000
ARROW = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "timestamp": pa.timestamp("us", "UTC")}


def in_batches(rows: Iterable[tuple], schema: str) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of a bounded number of rows."""
    names, kinds = zip(*(x.split() for x in schema.split(", ")))
    some: list[tuple] = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, ARROW[t]) for c, t in zip(list(zip(*some)) or [()] * len(names), kinds)], list(names))

    for row in rows:
        some.append(row)
        if len(some) == ROWS_AT_ONCE:
            yield batch()
            some = []
    yield batch()


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def micros(seconds: float) -> int:
    return round(seconds * 1_000_000)


def folded(rows: DataFrame, machine: Machine, idle: float | None = None, ticks: bool = False) -> DataFrame:
    """A finished table: each key's events in order of time and id.

    One key's chain is sequential by nature; a task reads sorted events one by one and
    holds one state, whatever the length of a key's history.
    """
    schema = f"key string, id long, ts timestamp, {machine.result}"
    names = [x.split()[0] for x in EVENT.split(", ")]

    def results(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        chain, key = Chain(machine, idle, ticks), None
        for row in rows_of(batches):
            e = dict(zip(names, row))
            if key != (e["key"],):
                key, chain = (e["key"],), Chain(machine, idle, ticks)
            for number, seconds, *result in chain.step(e["ts"].timestamp(), e):
                yield (e["key"], number, micros(seconds), *result)

    ordered = events(rows).filter("ts is not null").repartition("key").sortWithinPartitions("key", "ts", "id")
    return ordered.mapInArrow(lambda batches: in_batches(results(batches), schema), schema)


class Keyed(StatefulProcessor):
    """Events wait in a list until the watermark has passed them, and are then taken in order; timers wake a key.

    So results don't depend on how events are dealt to batches, as long as they come within
    the watermark's delay. Timers are for events that wait, for changes that are due, and for
    keys that have been idle too long, whose state goes.
    """

    def __init__(self, machine: Machine, idle: float | None, ticks: bool):
        self.machine, self.idle, self.ticks = machine, idle, ticks

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", f"{self.machine.state}, seen double")
        self.waiting = handle.getListState("waiting", "id long, us long, tokens double, success boolean")

    def close(self) -> None:
        pass

    def wake(self, seconds: float) -> None:
        self.handle.registerTimer(int(-(-micros(seconds) // 1000)))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for some in rows:
            us = some["ts"].astype("datetime64[us]").astype("int64").tolist()
            plain = lambda c, t: [None if pd.isna(x) else t(x) for x in some[c]]
            self.waiting.appendList(list(zip(plain("id", int), us, plain("tokens", float), plain("success", bool))))
            self.wake(min(us) / 1_000_000)
        yield self.frame(key, [])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        held = list(self.waiting.get()) if self.waiting.exists() else []
        ready = sorted((e for e in held if e[1] <= mark), key=lambda e: (e[1], e[0] is not None, e[0] or 0))
        *state, last = self.state.get() if self.state.exists() else (None,)
        chain = Chain(self.machine, self.idle, self.ticks, tuple(state) if state else None, last or 0.0)
        out = []
        for number, us, tokens, success in ready:
            out += chain.step(us / 1_000_000, {"key": key[0], "id": number, "tokens": tokens, "success": success})
        out += chain.until(mark / 1_000_000, inclusive=True)
        if ready:
            later = [e for e in held if e[1] > mark]
            if later:
                self.waiting.put(later)
                self.wake(min(e[1] for e in later) / 1_000_000)
            else:
                self.waiting.clear()
        if chain.state is None:
            self.state.clear()
        else:
            self.state.update((*chain.state, chain.last))
            for t in chain.wakes():
                if micros(t) > mark:
                    self.wake(t + 0.001)
        yield self.frame(key, out)

    def frame(self, key: tuple, out: list[tuple]) -> pd.DataFrame:
        names = ["key", "id", "ts", *(x.split()[0] for x in self.machine.result.split(", "))]
        made = pd.DataFrame([(key[0], number, micros(seconds), *result) for number, seconds, *result in out], columns=names)
        return made.assign(id=made["id"].astype("Int64"), ts=pd.to_datetime(made["ts"].astype("int64"), unit="us"))


def streamed(rows: DataFrame, machine: Machine, late: str = "10 minutes", idle: float | None = None, ticks: bool = False) -> DataFrame:
    """A stream: equals ``folded`` on the events that come within the watermark's delay, in whatever batches."""
    schema = f"key string, id long, ts timestamp, {machine.result}"
    dated = events(rows).filter("ts is not null").withWatermark("ts", late)
    return dated.groupBy("key").transformWithStateInPandas(Keyed(machine, idle, ticks), schema, "append", "eventTime")


def windowed_usage(rows: DataFrame, late: str = "10 minutes", width: str = "1 minute", slide: str | None = None) -> DataFrame:
    """Count and tokens by key and time window; events later than the watermark are left out of a stream."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    sums = rows.withWatermark("ts", late).groupBy("key", window.alias("w")).agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"))
    return sums.select("key", F.col("w.start").alias("start"), "n", "tokens")


def sessions(rows: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Count by key and session: a pause of the gap ends one."""
    grouped = rows.withWatermark("ts", late).groupBy("key", F.session_window("ts", gap).alias("w"))
    return grouped.agg(F.count("*").alias("n")).select("key", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def joined_streams(left: DataFrame, right: DataFrame, within: str = "10 minutes", how: str = "inner", late: str | None = None) -> DataFrame:
    """Pairs of one key whose second event follows the first within a time.

    ``how="left_outer"``: first events that nothing follows are kept too, each once, as soon as
    the watermarks (``late`` behind the newest event, the time within by default) say that
    nothing can follow any more; state goes by then as well.
    """
    a = left.select(F.col("key"), F.col("ts").alias("first_ts"), F.col("id").alias("first_id")).withWatermark("first_ts", late or within)
    b = right.select(F.col("key").alias("other"), F.col("ts").alias("second_ts"), F.col("id").alias("second_id")).withWatermark("second_ts", late or within)
    near = F.expr(f"key = other and second_ts >= first_ts and second_ts <= first_ts + interval {within}")
    return a.join(b, near, how).drop("other")


def first_of_each(rows: DataFrame, *key: str, late: str = "10 minutes") -> DataFrame:
    """Rows of a stream without those that come again with the same key within the watermark's delay."""
    return rows.filter("ts is not null").withWatermark("ts", late).dropDuplicatesWithinWatermark(list(key))


class LateRows:
    """Parts a stream by its watermark as batches come: rows in time go on, late and undated ones go to a side table.

    Spark drops late rows in silence; this keeps them. The newest time seen is kept beside
    the side table for each batch, so a batch that comes again is parted as before.
    """

    def __init__(self, on_time: str, late: str, delay: str = "10 minutes"):
        self.on_time, self.late, self.delay = on_time, late, delay

    def put(self, rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        marks = spark.createDataFrame([], "batch long, newest timestamp")
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        folder = hadoop.Path(f"{self.late}-marks")
        if folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
            marks = spark.read.schema("newest timestamp, batch long").parquet(f"{self.late}-marks")
        before = marks.filter(F.col("batch") < batch).agg(F.max("newest").alias("newest")).first()["newest"]
        mark = F.lit(before).cast("timestamp") - F.expr(f"interval {self.delay}")
        out = F.col("ts").isNull() | F.coalesce(F.col("ts") <= mark, F.lit(False))
        rows.filter(~out).write.mode("overwrite").parquet(f"{self.on_time}/batch={batch}")
        rows.filter(out).write.mode("overwrite").parquet(f"{self.late}/batch={batch}")
        rows.agg(F.max("ts").alias("newest")).write.mode("overwrite").parquet(f"{self.late}-marks/batch={batch}")

    def sink(self, rows: DataFrame):
        return rows.writeStream.foreachBatch(lambda some, batch: self.put(some, batch))
