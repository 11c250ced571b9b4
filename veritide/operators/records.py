"""Record keeping: filters, pages, permissions, invitations, retention, updates, queues."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def page(rows: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """Page ``number`` (from 1) in an order that must end with a key."""
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def page_info(rows: DataFrame, size: int) -> DataFrame:
    """One row: the total and the number of pages."""
    return rows.agg(F.count("*").alias("total"), F.ceil(F.count("*") / size).cast("long").alias("pages"))


def search(rows: DataFrame, text: str | None, *columns: str) -> DataFrame:
    """Rows of which any column contains the text in any case; all of them without a text."""
    return rows if not text else rows.filter(reduce(Column.__or__, [F.col(c).ilike(f"%{text}%") for c in columns]))


def log_filter(rows: DataFrame, user_id: int | None = None, action: str | None = None, contains: dict[str, str] | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """All given conditions together; a zero or missing value means none."""
    found = []
    if user_id:
        found.append(F.col("user_id") == user_id)
    if action:
        found.append(F.col("action") == action)
    found += [F.col(c).ilike(f"%{t}%") for c, t in (contains or {}).items() if t]
    if start:
        found.append(F.col("created_at") >= F.lit(start).cast("timestamp_ntz"))
    if end:
        found.append(F.col("created_at") <= F.lit(end).cast("timestamp_ntz"))
    return rows.filter(reduce(Column.__and__, found)) if found else rows


def one_of(rows: DataFrame, condition: Column) -> DataFrame:
    """The row that fulfils a condition; an error when it is read and there are two."""
    found = rows.filter(condition).limit(2)
    n = F.count(F.lit(1)).over(Window.partitionBy(F.lit(1)))
    return found.withColumn("_n", n).filter(F.when(F.col("_n") > 1, F.raise_error(F.lit("more than one row")).cast("boolean")).otherwise(F.lit(True))).drop("_n")


def records_page(tasks: DataFrame, users: DataFrame, number: int, size: int, status: str | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Tasks with their users' names, newest first."""
    rows = tasks if status is None else tasks.filter(F.col("status") == status)
    rows = log_filter(rows, start=start, end=end)
    names = users.select(F.col("id").alias("user_id"), "username")
    return page(rows.join(names, "user_id"), [F.desc("created_at"), F.desc("id")], number, size)


def export_permission(users: DataFrame, own: DataFrame, by_level: DataFrame, done_today: DataFrame, wanted: str) -> DataFrame:
    """Per user: is an export in the wanted format allowed, by which rule, and how many are left today.

    A user's own active rule goes before the active rule of the level; without either it is denied.
    """
    fields = lambda: F.struct("allowed_formats", "max_exports_per_day", "max_file_size_mb")
    first = own.filter("is_active").select(F.col("user_id").alias("id"), fields().alias("own"))
    second = by_level.filter("is_active").select("user_level", fields().alias("level_rule"))
    counts = done_today.groupBy(F.col("user_id").alias("id")).agg(F.count("*").alias("used"))
    rows = users.join(first, "id", "left").join(second, "user_level", "left").join(counts, "id", "left")
    rule = F.coalesce("own", "level_rule")
    rows = rows.withColumns({"rule": rule, "used": F.coalesce("used", F.lit(0).cast("long")), "via": F.when(F.col("own").isNotNull(), "user").when(F.col("level_rule").isNotNull(), "level").otherwise("none")})
    fits = F.array_contains(F.from_json("rule.allowed_formats", "array<string>"), wanted)
    left = F.greatest(F.lit(0).cast("long"), F.col("rule.max_exports_per_day") - F.col("used"))
    reason = F.when(F.col("rule").isNull(), "no rule").when(~F.coalesce(fits, F.lit(False)), "format").when(left <= 0, "quota").otherwise("ok")
    return rows.select("id", "via", "used", F.coalesce(left, F.lit(0).cast("long")).alias("remaining"), reason.alias("reason"), (reason == "ok").alias("allowed"))


def invitation_status(as_of: str) -> Column:
    """inactive, expired, inactive when used up, else active."""
    now = F.lit(as_of).cast("timestamp_ntz")
    return F.when(~F.col("is_active"), "inactive").when(F.col("expires_at").isNotNull() & (F.col("expires_at") <= now), "expired").when(F.col("used_count") >= F.col("max_uses"), "inactive").otherwise("active")


def invitations_page(codes: DataFrame, as_of: str, number: int, size: int, status: str | None = None) -> DataFrame:
    """Codes with their status, newest first; of one status if it is given."""
    rows = codes.withColumn("status", invitation_status(as_of))
    rows = rows if status is None else rows.filter(F.col("status") == status)
    return page(rows, [F.desc("created_at"), F.desc("id")], number, size)


def cancelled(tasks: DataFrame, task_id: Column, user_id: Column, as_of: str) -> DataFrame:
    """The table with a user's own task cancelled, if it is pending or running; others stay as they are."""
    can = (F.col("id") == task_id) & (F.col("user_id") == user_id) & F.col("status").isin("pending", "running")
    return updated(tasks, can, {"status": F.lit("cancelled"), "completed_at": F.lit(as_of).cast("timestamp_ntz")})


def existing(rows: DataFrame, others: DataFrame, key: str, other: str) -> DataFrame:
    """Rows whose key is among the others."""
    return rows.join(others.select(F.col(other).alias("_other")), F.col(key) == F.col("_other"), "left_semi")


def progress(events: DataFrame) -> DataFrame:
    """Where each task stands after its last event (task_id, ts, id, analyzed, total, status).

    A running task is at five percent at least and below a hundred; one that is done is at a hundred.
    """
    last = events.groupBy("task_id").agg(F.max(F.struct("ts", "id", "analyzed", "total", "status")).alias("e")).select("task_id", "e.*")
    share = 100.0 * F.col("analyzed") / F.greatest(F.col("total"), F.lit(1))
    percent = F.when(F.col("status") == "completed", 100.0).when(F.col("status") == "pending", 0.0).otherwise(F.least(F.lit(99.0), F.greatest(F.lit(5.0), share)))
    return last.select("task_id", "status", "analyzed", "total", F.round(percent, 2).alias("progress_percent"))


def limiter_stats(requests: DataFrame, last: int = 100) -> DataFrame:
    """Per key: successes, errors, their rate, and the mean tokens of the last successes (key, ts, id, tokens, success)."""
    counts = requests.groupBy("key").agg(F.count(F.when(F.col("success"), 1)).alias("success_count"), F.count(F.when(~F.col("success"), 1)).alias("error_count"))
    newest = Window.partitionBy("key").orderBy(F.desc("ts"), F.desc("id"))
    recent = requests.filter("success").withColumn("n", F.row_number().over(newest)).filter(F.col("n") <= last).groupBy("key").agg(F.avg("tokens").alias("avg_actual_tokens"))
    rate = F.col("error_count") / F.greatest(F.lit(1), F.col("success_count") + F.col("error_count"))
    return counts.join(recent, "key", "left").select("key", "success_count", "error_count", rate.alias("error_rate"), F.coalesce("avg_actual_tokens", F.lit(0.0)).alias("avg_actual_tokens"))


def invitation_stats(codes: DataFrame, as_of: str) -> DataFrame:
    rows = codes.withColumn("status", invitation_status(as_of))
    n = lambda s: F.count(F.when(F.col("status") == s, 1)).alias(s)
    left = F.greatest(F.lit(0), F.col("max_uses") - F.col("used_count"))
    return rows.agg(F.count("*").alias("total"), n("active"), n("inactive"), n("expired"), F.sum("used_count").alias("used"), F.sum(F.when(F.col("status") == "active", left)).alias("left"))


def use_invitation(codes: DataFrame, code: str, as_of: str) -> DataFrame:
    """The table with a valid code's uses raised by one; other codes stay as they are."""
    valid = (F.col("code") == code) & (invitation_status(as_of) == "active")
    return codes.withColumn("used_count", F.when(valid, F.col("used_count") + 1).otherwise(F.col("used_count")))


def new_codes(spark, n: int, existing: DataFrame, seed: int, length: int = 16) -> DataFrame:
    """n codes of capital letters and digits, none of them in ``existing``; more are drawn than needed."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    pick = F.concat(*(F.substring(F.lit(letters), (F.pmod(F.xxhash64(F.lit(seed), "id", F.lit(k)), F.lit(len(letters))) + 1).cast("int"), F.lit(1)) for k in range(length)))
    drawn = spark.range(n + 64 + n // 8).select(pick.alias("code"), "id")
    first = drawn.groupBy("code").agg(F.min("id").alias("id"))
    return first.join(existing.select("code"), "code", "left_anti").orderBy("id").limit(n).select("code")


def retained(rows: DataFrame, cutoff: str) -> DataFrame:
    """What stays when all rows before the cutoff are deleted."""
    return rows.filter(F.col("created_at") >= F.lit(cutoff).cast("timestamp_ntz"))


def soft_deleted(rows: DataFrame, condition: Column) -> DataFrame:
    return rows.withColumn("is_active", F.when(condition, F.lit(False)).otherwise(F.col("is_active")))


def updated(rows: DataFrame, condition: Column, changes: dict[str, Column]) -> DataFrame:
    """Columns changed where a condition holds."""
    return rows.withColumns({c: F.when(condition, v).otherwise(F.col(c)) for c, v in changes.items()})


def cascade(gone: DataFrame, key: str, children: dict[str, tuple[DataFrame, str]]) -> dict[str, DataFrame]:
    """Child tables without the rows that refer to deleted parents."""
    ids = gone.select(F.col(key).alias("_id")).distinct()
    return {name: rows.join(ids, rows[ref] == ids["_id"], "left_anti") for name, (rows, ref) in children.items()}


def seed_missing(defaults: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Default rows whose key isn't there yet."""
    return defaults.join(existing.select(key), key, "left_anti")


def first_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key; by one aggregation, so a hot key is combined before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    ordered = F.min(F.struct(*(F.col(c).alias(f"_{i}") for i, c in enumerate(order)), *rest))
    return rows.groupBy(*keys).agg(ordered.alias("_first")).select(*keys, *(F.col(f"_first.{c}").alias(c) for c in rest))


def sliding_usage(requests: DataFrame, seconds: int = 60) -> DataFrame:
    """Each request with count and tokens of its key's last seconds; exactly that long ago still counts."""
    w = Window.partitionBy("key").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-seconds * 1_000_000, 0)
    return requests.withColumns({"n": F.count("*").over(w), "tokens_in_window": F.sum("tokens").over(w)})


def rolling_mean(rows: DataFrame, keys: list[str], order: list[str], value: str, last: int = 100) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-(last - 1), 0)
    return rows.withColumn("rolling_mean", F.avg(value).over(w))


def token_estimate(mean: Column, length: Column) -> Column:
    """A request's tokens: the recent mean by length in 10 000 characters, half to double; 1000 at least."""
    return F.greatest(F.lit(1000), (mean * F.greatest(F.lit(0.5), F.least(F.lit(2.0), length / 10000))).cast("int"))


def queue_positions(waiting: DataFrame, slots: int = 2, seconds: int = 300) -> DataFrame:
    """Place in the queue by priority, then age, and how long it takes until its turn."""
    position = F.row_number().over(Window.partitionBy("queue").orderBy(F.desc("priority"), "created_at", "id"))
    rounds = F.floor((F.col("position") - slots - 1) / slots) + 1
    return waiting.withColumn("position", position).withColumn("wait_seconds", F.greatest(F.lit(0), rounds) * seconds)


def dequeue(waiting: DataFrame, free: int) -> DataFrame:
    return waiting.orderBy(F.desc("priority"), "created_at", "id").limit(free)


def duration(start: Column, end: Column) -> Column:
    """H:MM:SS between two times."""
    s = F.unix_seconds(end.cast("timestamp")) - F.unix_seconds(start.cast("timestamp"))
    return F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)


def rotation(rows: DataFrame, ordinal: str, last_used: int, n: int) -> DataFrame:
    """Round robin: the one after the last used comes first."""
    return rows.withColumn("turn", F.pmod(F.col(ordinal) - last_used - 1, F.lit(n)))


def backoff_delay(attempt: Column, kind: Column) -> Column:
    """Seconds before a retry, by kind of failure, 60 at most. The growth factors."""
    base = F.when(kind == "rate_limit", 3.0).when(kind == "502", 4.0).when(kind == "503", 5.0)
    grown = F.when(base.isNotNull(), F.pow(base, attempt)).when(kind == "timeout", 1.5 * F.pow(F.lit(2.0), attempt)).otherwise(F.pow(F.lit(2.0), attempt))
    return F.least(F.lit(60.0), grown)


def cost_estimate(prompt: Column, completion: Column) -> Column:
    return prompt / 1000 * 0.001 + completion / 1000 * 0.002


def export_attempts(checked: DataFrame, wanted: str, size_mb: Column, as_of: str) -> DataFrame:
    """Log rows of export attempts from checked permissions: success, or blocked with the reason."""
    return checked.select(
        F.col("id").alias("user_id"), F.lit(wanted).alias("export_format"), size_mb.cast("double").alias("file_size_mb"), F.when(F.col("allowed"), "success").otherwise("blocked").alias("export_status"),
        F.when(~F.col("allowed"), F.col("reason")).alias("blocked_reason"), F.lit(as_of).cast("timestamp_ntz").alias("created_at"),
    )


def system_report(stats: DataFrame, users: DataFrame, most: int = 1000) -> DataFrame:
    """One JSON document: a row of statistics and the first users by id; the number of users is the feature's limit."""
    some = users.orderBy("id").limit(most).agg(F.sort_array(F.collect_list(F.struct(*users.columns))).alias("users"))
    return stats.crossJoin(some).select(F.to_json(F.struct(F.struct(*stats.columns).alias("statistics"), "users")).alias("report"))  # one row each


def snapshot_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Distinct rows with the change: added, removed and kept between two snapshots, and any that is in either."""
    found = {"added": after.select(before.columns).subtract(before), "removed": before.subtract(after.select(before.columns)), "kept": before.intersect(after.select(before.columns)), "any": before.union(after.select(before.columns)).distinct()}
    return reduce(DataFrame.unionAll, (rows.select(F.lit(change).alias("change"), *before.columns) for change, rows in found.items()))


def with_user(logs: DataFrame, users: DataFrame) -> DataFrame:
    """Log rows with the name of their user; those of unknown users are left out."""
    return logs.join(users.select(F.col("id").alias("user_id"), "username"), "user_id")
