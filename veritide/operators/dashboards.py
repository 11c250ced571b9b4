"""Dashboard figures: one pass of conditional aggregates each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Labels and colours of task states.
STATUS_LABELS = {"completed": ("已完成", "#52c41a"), "running": ("进行中", "#1890ff"), "pending": ("等待中", "#faad14"), "failed": ("失败", "#ff4d4f"), "cancelled": ("已取消", "#d9d9d9")}
# Display names.
PROVIDER_NAMES = {"qwen": "通义千问", "kimi": "Kimi", "openai": "OpenAI", "claude": "Claude"}


def lookup(key: Column, values: dict[str, str], default: Column) -> Column:
    """A constant map's value, or the default."""
    pairs = [F.lit(x) for kv in values.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[key], default) if values else default


def count_if(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def status_counts(tasks: DataFrame) -> DataFrame:
    """Tasks per state with its label; unknown states keep their own names."""
    labels = {k: v[0] for k, v in STATUS_LABELS.items()}
    return tasks.groupBy("status").agg(F.count("*").alias("n")).withColumn("label", lookup(F.col("status"), labels, F.col("status")))


def provider_label(column: Column) -> Column:
    return lookup(column, PROVIDER_NAMES, F.initcap(column))


def risk_group(severity: Column) -> Column:
    """高危 for high and critical, 低危 for low and info, else 中危."""
    return F.when(severity.isin("high", "critical"), "高危").when(severity.isin("low", "info"), "低危").otherwise("中危")


def issue_distribution(results: DataFrame) -> DataFrame:
    """Findings in JSON arrays counted by type and risk group; items that aren't objects don't count."""
    items = F.from_json("findings", "array<string>")
    one = results.select(F.explode(items).alias("item")).filter(F.ltrim("item").startswith("{"))
    found = one.select(F.from_json("item", "type string, severity string").alias("f"))
    kind = F.coalesce(F.col("f.type"), F.lit("unknown"))
    return found.groupBy(kind.alias("type"), risk_group(F.lower(F.coalesce(F.col("f.severity"), F.lit("medium")))).alias("risk")).agg(F.count("*").alias("n"))


def severity_counts(findings: DataFrame) -> DataFrame:
    """Exact names only: critical and info are in none of the three."""
    return findings.agg(*(count_if(F.col("severity") == s).alias(f"{s}_issues") for s in ("high", "medium", "low")))


def mean_confidence(findings: DataFrame) -> DataFrame:
    """Average of the confidences that aren't zero or null, 0.0 if there are none."""
    return findings.agg(F.coalesce(F.avg(F.when(F.col("confidence") != 0, F.col("confidence"))), F.lit(0.0)).alias("confidence"))


def severity_histogram(findings: DataFrame) -> DataFrame:
    return findings.groupBy(F.coalesce("severity", F.lit("unknown")).alias("severity")).agg(F.count("*").alias("n"))


def by_file(findings: DataFrame) -> DataFrame:
    """Findings of each file in order of line, with their mean confidence."""
    item = F.struct("line", "type", "severity", "description")
    return findings.groupBy("file").agg(F.sort_array(F.collect_list(item)).alias("findings"), F.avg("confidence").alias("confidence"), F.count("*").alias("n"))


def log_stats(logs: DataFrame, today: str) -> DataFrame:
    """All logs; of today's: all, logins, task starts and ends, errors."""
    on_day = F.to_date("created_at") == F.lit(today).cast("date")
    action = F.col("action")
    return logs.agg(
        F.count("*").alias("total_logs"), count_if(on_day).alias("today_logs"), count_if(on_day & (action == "login")).alias("login_count"),
        count_if(on_day & action.isin("start_audit", "complete_audit")).alias("audit_count"), count_if(on_day & action.ilike("%error%")).alias("error_count"),
    )


def export_stats(logs: DataFrame) -> DataFrame:
    size = F.when(F.col("file_size_mb") > 0, F.col("file_size_mb"))
    return logs.agg(count_if(F.col("export_status") == "success").alias("exports"), count_if(F.col("export_status") == "blocked").alias("blocked"), F.round(F.avg(size), 2).alias("avg_size_mb"))


def timing_stats(times: DataFrame) -> DataFrame:
    """Sum, mean, count and cache hits of times per file; a hit took less than a second."""
    hits = count_if(F.col("seconds") < 1)
    return times.agg(F.sum("seconds").alias("total"), F.avg("seconds").alias("mean"), F.count("seconds").alias("n"), hits.alias("hits"), (100 * hits / F.nullif(F.count("seconds"), F.lit(0))).alias("hit_rate"))


def estimated_tokens(n_files: Column, n_findings: Column) -> Column:
    return n_files * 100 + n_findings * 20


def system(users: DataFrame, tasks: DataFrame, tokens: DataFrame, logs: DataFrame, task_day: str, log_day: str) -> DataFrame:
    """One row of the system's figures: users, tasks, tokens (total_tokens, summed beforehand) and logs of a day."""
    on = lambda day: F.to_date("created_at") == F.lit(day).cast("date")
    a = users.agg(F.count("*").alias("total_users"), count_if(F.col("is_active")).alias("active_users"))
    b = tasks.agg(F.count("*").alias("total_tasks"), count_if(F.col("status") == "completed").alias("completed_tasks"), count_if(on(task_day)).alias("today_tasks"))
    return a.crossJoin(b).crossJoin(tokens).crossJoin(logs.agg(count_if(on(log_day)).alias("today_logs")))  # one row each


def provider_stats(providers: DataFrame, requests: DataFrame) -> DataFrame:
    """Providers with their number of requests, none left out."""
    counts = requests.groupBy(F.col("provider").alias("name")).agg(F.count("*").alias("request_count"))
    return providers.join(counts, "name", "left").withColumn("request_count", F.coalesce("request_count", F.lit(0).cast("long")))


def benchmark_summary(timings: DataFrame) -> DataFrame:
    """One row for each run (run, kind system or api, step, seconds): totals, the model's share, and its speed.

    Fixed value: a large request is taken as 4,000 tokens.
    """
    total = lambda kind: F.coalesce(F.sum(F.when((F.col("kind") == kind) & (F.col("seconds") > 0), F.col("seconds"))), F.lit(0.0))
    large = F.max(F.when((F.col("kind") == "api") & (F.col("step") == "large_request") & (F.col("seconds") > 0), F.col("seconds")))
    rows = timings.groupBy("run").agg(total("system").alias("system_seconds"), total("api").alias("api_seconds"), large.alias("large"))
    share = F.when(F.col("api_seconds") > 0, F.round(100 * F.col("api_seconds") / (F.col("system_seconds") + F.col("api_seconds")), 1))
    return rows.select("run", "system_seconds", "api_seconds", share.alias("api_percent"), F.round(4000 / F.col("large"), 1).alias("tokens_per_second"), (F.col("large") * 4).alias("four_files_in_turn"))
