"""Usage statistics: per user, per day, for the whole system."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNKNOWN = "未知"  # fixed value: shown where there is no provider


def exact_sum(column: str | Column) -> Column:
    """A sum of money or amounts that doesn't depend on the order of rows."""
    return F.coalesce(F.sum(F.col(column).cast("decimal(20,4)") if isinstance(column, str) else column.cast("decimal(20,4)")), F.lit(0).cast("decimal(20,4)")).cast("double")


def within(column: str, start: str, end: str) -> Column:
    """Both ends belong to the window."""
    return F.col(column).between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz"))


def top_per_key(rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """The most frequent value of each key, ties to the smallest; one aggregation, no sort of groups."""
    counts = rows.groupBy(key, value).agg(F.count("*").alias("_n"))
    return counts.groupBy(key).agg(F.min(F.struct((-F.col("_n")).alias("n"), F.col(value).alias("v")))["v"].alias(name))


def user_usage(users: DataFrame, usage: DataFrame, start: str, end: str) -> DataFrame:
    """Per user: sum, count, cost, last use and most used provider in a window.

    The window belongs to the join, so users without usage stay with zeros. Usage is
    aggregated before the join: one row for each user is shuffled at most per task.
    """
    recent = usage.filter(within("created_at", start, end))
    sums = recent.groupBy("user_id").agg(exact_sum("tokens_consumed").alias("total_tokens"), F.count("id").alias("request_count"), exact_sum("cost").alias("total_cost"), F.max("created_at").alias("last_used"))
    favourite = top_per_key(recent, "user_id", "provider", "most_used_provider")
    joined = users.join(sums, users["id"] == sums["user_id"], "left").drop("user_id").join(favourite, users["id"] == favourite["user_id"], "left")
    return joined.select(
        "id", "username", F.coalesce("total_tokens", F.lit(0.0)).alias("total_tokens"), F.coalesce("request_count", F.lit(0)).alias("request_count"),
        F.coalesce("total_cost", F.lit(0.0)).alias("total_cost"), "last_used", F.coalesce("most_used_provider", F.lit(UNKNOWN)).alias("most_used_provider"),
    )


def system_usage(usage: DataFrame, start: str, end: str) -> DataFrame:
    """One row: sum, cost, count, average and most used provider of a window; zeros if it is empty."""
    recent = usage.filter(within("created_at", start, end))
    by_provider = recent.groupBy("provider").agg(exact_sum("tokens_consumed").alias("t"), exact_sum("cost").alias("c"), F.count("*").alias("n"))
    first = F.min(F.struct((-F.col("n")).alias("n"), F.col("provider").alias("p")))["p"]
    total = F.coalesce(F.sum("n"), F.lit(0))
    return by_provider.agg(
        exact_sum("t").alias("total_tokens"), exact_sum("c").alias("total_cost"), total.alias("total_requests"),
        F.when(total > 0, exact_sum("t") / total).otherwise(0.0).alias("average_tokens"), F.coalesce(first, F.lit(UNKNOWN)).alias("most_used_provider"),
    )


def daily_breakdown(usage: DataFrame, start: str, end: str) -> DataFrame:
    """Sum, count and cost of each day in a window."""
    recent = usage.filter(within("created_at", start, end))
    return recent.groupBy(F.to_date("created_at").alias("date")).agg(exact_sum("tokens_consumed").alias("tokens"), F.count("*").alias("requests"), exact_sum("cost").alias("cost"))


def daily_user_stats(usage: DataFrame) -> DataFrame:
    """Sum, count and average of each user's days."""
    sums = usage.groupBy("user_id", F.to_date("created_at").alias("usage_date")).agg(exact_sum("tokens_consumed").alias("daily_tokens"), F.count("*").alias("request_count"))
    return sums.withColumn("avg_tokens", F.col("daily_tokens") / F.col("request_count"))


def user_statistics(users: DataFrame, tasks: DataFrame, results: DataFrame) -> DataFrame:
    """Per user: tasks, completed tasks and the sum of their results' issues; a task has one result."""
    of_task = tasks.join(results, tasks["id"] == results["task_id"], "left").select("user_id", tasks["id"].alias("task"), "status", "issues")
    sums = of_task.groupBy("user_id").agg(F.count_distinct("task").alias("total_tasks"), F.count_distinct(F.when(F.col("status") == "completed", F.col("task"))).alias("completed_tasks"), F.sum("issues").alias("total_issues"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return users.join(sums, users["id"] == sums["user_id"], "left").select("id", "username", zero("total_tasks"), zero("completed_tasks"), zero("total_issues"))


def usage_rate(used: Column, limit: Column) -> Column:
    """Percent of a limit, one decimal; 0 without a limit."""
    return F.when(limit > 0, F.round(used / F.greatest(limit, F.lit(1)) * 100, 1)).otherwise(0.0)


def limit_totals(users: DataFrame) -> DataFrame:
    """Used and allowed in all, with averages; a missing or zero value counts as its default."""
    instead = lambda c, d: F.coalesce(F.when(c != 0, c), F.lit(d))
    active = F.when(F.col("is_active"), F.col("used"))
    return users.agg(
        F.coalesce(exact_sum("used"), F.lit(0.0)).alias("total_used"), instead(exact_sum("allowed"), 0.0).alias("total_limit"),
        instead(F.count("*"), 1).cast("long").alias("n_users"), F.coalesce(F.avg(active.cast("decimal(20,4)")).cast("double"), F.lit(0.0)).alias("avg_active_used"),
    )


def day_spine(spark, first: str, last: str) -> DataFrame:
    """A row for each day, both ends included."""
    return spark.sql(f"select explode(sequence(date'{first}', date'{last}', interval 1 day)) as date")


def zero_filled(spine: DataFrame, counts: DataFrame, on: str, value: str) -> DataFrame:
    return spine.join(counts, on, "left").select(on, F.coalesce(value, F.lit(0).cast("long")).alias(value))


def used_and_remaining(days: DataFrame) -> DataFrame:
    """Two rows for each day: what was used and what was left."""
    return days.unpivot(["date"], ["used", "remaining"], "type", "value")


def synthetic_history(spine: DataFrame, average: float, users: int) -> DataFrame:
    """An invented usage curve: fewer on weekends, less the older, a ripple by day number (no random part)."""
    weekend = F.when(F.weekday("date") >= 5, 0.6).otherwise(1.0)
    decay = F.greatest(F.lit(0.7), 1 - 0.05 * F.col("i"))
    ripple = 0.8 + 0.08 * (F.col("i") % 5)
    return spine.withColumn("i", F.row_number().over(Window.orderBy(F.desc("date"))) - 1).select("date", (average * users * weekend * decay * ripple).cast("long").alias("used"))


# Names of weekdays from Monday on.
WEEKDAYS = ["周一", "周二", "周三", "周四", "周五", "周六", "周日"]


def weekday_name(date: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, WEEKDAYS)), F.weekday(date) + 1)


def month_day(date: Column) -> Column:
    return F.date_format(date, "MM-dd")
