"""Usage, dashboards, records and permissions over the driver's tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritide.operators import dashboards, records, usage
from veritide.operators.pages import Pages
from veritide.plans.registry import Tables, query
from veritide.scratch import new_path
from veritide.sources.buckets import Buckets, cascade

START, END = "1997-01-01 00:00:00", "1997-06-30 23:59:59"
DAY = "2024-01-15"
BETWEEN = f"BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}'"
SUM = "coalesce(sum(cast({0} AS DECIMAL(20,4))), 0)::DOUBLE"
TOKENS, COST = SUM.format("o_totalprice"), SUM.format("o_totalprice * 0.5")
date_text = lambda c: F.date_format(c, "yyyy-MM-dd")
time_text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")


@query(f"""
WITH r AS (SELECT * FROM orders WHERE o_orderdate {BETWEEN}),
s AS (SELECT o_custkey, {TOKENS} AS t, count(*) AS n, {COST} AS c, max(o_orderdate) AS l FROM r GROUP BY 1),
p AS (SELECT o_custkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY count(*) DESC, o_orderpriority) AS k FROM r GROUP BY 1, 2)
SELECT c_custkey AS id, c_name AS username, coalesce(t, 0) AS total_tokens, coalesce(n, 0) AS request_count, coalesce(c, 0) AS total_cost,
  strftime(l, '%Y-%m-%d %H:%M:%S') AS last_used, coalesce(p.o_orderpriority, '未知') AS most_used_provider
FROM customer LEFT JOIN s ON s.o_custkey = c_custkey LEFT JOIN p ON p.o_custkey = c_custkey AND k = 1""")
def user_usage_stats(t: Tables) -> DataFrame:
    return usage.user_usage(t.users(), t.usage(), START, END).withColumn("last_used", time_text("last_used"))


@query(f"""
WITH r AS (SELECT * FROM orders WHERE o_orderdate {BETWEEN})
SELECT {TOKENS} AS total_tokens, {COST} AS total_cost, count(*) AS total_requests, CASE WHEN count(*) > 0 THEN {TOKENS} / count(*) ELSE 0 END AS average_tokens,
 coalesce((SELECT o_orderpriority FROM r GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1), '未知') AS most_used_provider FROM r""")
def system_usage_stats(t: Tables) -> DataFrame:
    return usage.system_usage(t.usage(), START, END)


@query(f"SELECT strftime(o_orderdate, '%Y-%m-%d') AS date, {TOKENS} AS tokens, count(*) AS requests, {COST} AS cost FROM orders WHERE o_orderdate {BETWEEN} GROUP BY 1")
def daily_breakdown(t: Tables) -> DataFrame:
    return usage.daily_breakdown(t.usage(), START, END).withColumn("date", date_text("date"))


@query(f"SELECT o_custkey AS user_id, strftime(o_orderdate, '%Y-%m-%d') AS usage_date, {TOKENS} AS daily_tokens, count(*) AS request_count, {TOKENS} / count(*) AS avg_tokens FROM orders GROUP BY 1, 2")
def daily_user_stats_view(t: Tables) -> DataFrame:
    return usage.daily_user_stats(t.usage()).withColumn("usage_date", date_text("usage_date"))


@query("""
WITH r AS (SELECT l_orderkey, count(*) AS issues FROM lineitem GROUP BY 1)
SELECT c_custkey AS id, c_name AS username, count(DISTINCT o_orderkey) AS total_tasks, count(DISTINCT CASE WHEN o_orderstatus = 'F' THEN o_orderkey END) AS completed_tasks, coalesce(sum(issues), 0)::BIGINT AS total_issues
FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN r ON l_orderkey = o_orderkey GROUP BY 1, 2""")
def user_statistics_view(t: Tables) -> DataFrame:
    results = t.lineitem.groupBy(F.col("l_orderkey").alias("task_id")).agg(F.count("*").alias("issues"))
    return usage.user_statistics(t.users(), t.tasks(), results)


@query(f"""
SELECT (SELECT count(*) FROM customer) AS total_users, (SELECT count(*) FROM customer WHERE c_acctbal > 0) AS active_users, (SELECT count(*) FROM orders) AS total_tasks,
 (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS completed_tasks, (SELECT count(*) FROM orders WHERE o_orderdate::DATE = DATE '1997-03-03') AS today_tasks,
 (SELECT {TOKENS} FROM orders) AS total_tokens, (SELECT count(*) FROM events WHERE ts::DATE = DATE '{DAY}') AS today_logs""")
def system_dashboard(t: Tables) -> DataFrame:
    tokens = t.usage().agg(usage.exact_sum("tokens_consumed").alias("total_tokens"))
    return dashboards.system(t.users(), t.tasks(), tokens, t.logs(), "1997-03-03", DAY)


@query("""
SELECT CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'pending' ELSE 'P' END AS status, count(*) AS n,
 CASE o_orderstatus WHEN 'F' THEN '已完成' WHEN 'O' THEN '等待中' ELSE 'P' END AS label FROM orders GROUP BY 1, 3""")
def task_status_counts(t: Tables) -> DataFrame:
    return dashboards.status_counts(t.tasks())


@query("""
WITH d AS (SELECT unnest(generate_series(DATE '2024-01-01', DATE '2024-02-15', INTERVAL 1 DAY))::DATE AS date), c AS (SELECT ts::DATE AS date, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY 1)
SELECT strftime(d.date, '%Y-%m-%d') AS date, coalesce(n, 0) AS n FROM d LEFT JOIN c USING (date)""")
def trend_zero_fill(t: Tables) -> DataFrame:
    counts = t.logs().filter("action = 'purchase'").groupBy(F.to_date("created_at").alias("date")).agg(F.count("*").alias("n"))
    return usage.zero_filled(usage.day_spine(t.spark, "2024-01-01", "2024-02-15"), counts, "date", "n").withColumn("date", date_text("date"))


@query("SELECT lang AS language, count(*) AS n, sum(n_chars)::BIGINT AS size FROM documents WHERE lang IS NOT NULL AND lang <> '' GROUP BY 1")
def language_counts(t: Tables) -> DataFrame:
    from veritide.operators.projects import language_counts as counts

    return counts(t.documents.select(F.col("lang").alias("language"), F.col("n_chars").alias("size")))


@query("""
WITH f AS (SELECT event_type AS type, CASE (props->>'$.k')::INT % 5 WHEN 0 THEN 'high' WHEN 1 THEN 'low' WHEN 2 THEN 'critical' WHEN 3 THEN 'info' ELSE 'medium' END AS severity FROM events)
SELECT type, CASE WHEN severity IN ('high', 'critical') THEN '高危' WHEN severity IN ('low', 'info') THEN '低危' ELSE '中危' END AS risk, count(*) AS n FROM f GROUP BY 1, 2""")
def issue_distribution(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int") % 5
    severity = F.element_at(F.array(*map(F.lit, ["high", "low", "critical", "info", "medium"])), k + 1)
    item = F.to_json(F.struct(F.col("event_type").alias("type"), severity.alias("severity")))
    return dashboards.issue_distribution(t.events.select(F.concat(F.lit("["), item, F.lit(', "no object"]')).alias("findings")))


@query("""
WITH f AS (SELECT CASE WHEN n_chars > 4000 THEN 'high' WHEN n_chars > 1000 THEN 'medium' WHEN n_chars > 200 THEN 'low' ELSE 'info' END AS s FROM documents)
SELECT count(*) FILTER (s = 'high') AS high_issues, count(*) FILTER (s = 'medium') AS medium_issues, count(*) FILTER (s = 'low') AS low_issues FROM f""")
def severity_counts(t: Tables) -> DataFrame:
    return dashboards.severity_counts(t.findings())


@query("SELECT round(coalesce(avg(nullif((doc_id % 11) / 10, 0)), 0), 9) AS confidence FROM documents")
def mean_confidence_nonzero(t: Tables) -> DataFrame:
    return dashboards.mean_confidence(t.findings()).withColumn("confidence", F.round("confidence", 9))


@query("""
SELECT CASE WHEN n_chars > 4000 THEN 'high' WHEN n_chars > 1000 THEN 'medium' WHEN n_chars > 200 THEN 'low' ELSE 'info' END AS severity, count(*) AS n FROM documents GROUP BY 1""")
def severity_histogram(t: Tables) -> DataFrame:
    return dashboards.severity_histogram(t.findings())


@query("SELECT 'src/' || source || '.java' AS file, count(*) AS n, round(avg((doc_id % 11) / 10), 9) AS confidence, min(doc_id % 50 + 1)::INT AS first_line FROM documents GROUP BY 1")
def findings_by_file(t: Tables) -> DataFrame:
    return dashboards.by_file(t.findings()).select("file", "n", F.round("confidence", 9).alias("confidence"), F.col("findings")[0]["line"].alias("first_line"))


@query(f"""
SELECT count(*) AS total_logs, count(*) FILTER (ts::DATE = DATE '{DAY}') AS today_logs, count(*) FILTER (ts::DATE = DATE '{DAY}' AND event_type = 'login') AS login_count,
 count(*) FILTER (ts::DATE = DATE '{DAY}' AND event_type IN ('start_audit', 'complete_audit')) AS audit_count, count(*) FILTER (ts::DATE = DATE '{DAY}' AND event_type ILIKE '%error%') AS error_count FROM events""")
def log_stats(t: Tables) -> DataFrame:
    return dashboards.log_stats(t.logs(), DAY)


@query("""
SELECT event_id AS id, user_id, event_type AS action FROM events WHERE user_id = 7 AND event_type = 'click' AND props ILIKE '%K%' AND ts >= TIMESTAMP '2024-01-03' AND ts <= TIMESTAMP '2024-01-25'""")
def log_filter(t: Tables) -> DataFrame:
    return records.log_filter(t.logs(), user_id=7, action="click", contains={"details": "K"}, start="2024-01-03 00:00:00", end="2024-01-25 00:00:00").select("id", "user_id", "action")


@query("""
SELECT o_orderkey AS id, c_name AS username, strftime(o_orderdate, '%Y-%m-%d') AS created FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20 OFFSET 40""")
def audit_records_page(t: Tables) -> DataFrame:
    rows = records.records_page(t.tasks(), t.users(), 3, 20, status="completed")
    return rows.select("id", "username", date_text("created_at").alias("created"))


@query("SELECT c_custkey AS id, c_name AS username FROM customer WHERE c_name ILIKE '%01%' OR c_mktsegment ILIKE '%01%' ORDER BY c_custkey DESC LIMIT 50 OFFSET 50")
def users_page_search(t: Tables) -> DataFrame:
    return records.page(records.search(t.users(), "01", "username", "user_level"), [F.desc("id")], 2, 50).select("id", "username")


@query("SELECT count(*) AS total, ceil(count(*) / 20)::BIGINT AS pages FROM orders WHERE o_orderstatus = 'F'")
def page_totals(t: Tables) -> DataFrame:
    return records.page_info(t.tasks().filter("status = 'completed'"), 20)


@query("""
WITH own AS (SELECT c_custkey AS id, ['json', 'markdown'] AS f, 5 AS m FROM customer WHERE c_custkey % 7 = 0 AND c_custkey % 2 = 0),
lv AS (SELECT * FROM (VALUES ('BUILDING', ['json'], 2), ('AUTOMOBILE', ['json', 'pdf', 'markdown'], 3), ('MACHINERY', ['pdf'], 10)) v(l, f, m)),
u AS (SELECT o_custkey AS id, count(*) AS used FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' GROUP BY 1),
r AS (SELECT c_custkey AS id, CASE WHEN own.id IS NOT NULL THEN 'user' WHEN lv.l IS NOT NULL THEN 'level' ELSE 'none' END AS via, coalesce(used, 0) AS used, coalesce(own.f, lv.f) AS f, coalesce(own.m, lv.m) AS m
 FROM customer LEFT JOIN own ON own.id = c_custkey LEFT JOIN lv ON lv.l = c_mktsegment LEFT JOIN u ON u.id = c_custkey)
SELECT id, via, used, coalesce(greatest(0, m - used), 0)::BIGINT AS remaining, CASE WHEN m IS NULL THEN 'no rule' WHEN NOT list_contains(f, 'markdown') THEN 'format' WHEN m - used <= 0 THEN 'quota' ELSE 'ok' END AS reason,
 coalesce(list_contains(f, 'markdown') AND m - used > 0, false) AS allowed FROM r""")
def perm_resolve(t: Tables) -> DataFrame:
    rules = [("BUILDING", '["json"]', 2, 1.0, True), ("AUTOMOBILE", '["json", "pdf", "markdown"]', 3, 1.0, True), ("MACHINERY", '["pdf"]', 10, 1.0, True), ("FURNITURE", '["markdown"]', 9, 1.0, False)]
    by_level = t.spark.createDataFrame(rules, "user_level string, allowed_formats string, max_exports_per_day bigint, max_file_size_mb double, is_active boolean")
    own = t.users().filter("id % 7 = 0").select(F.col("id").alias("user_id"), F.lit('["json", "markdown"]').alias("allowed_formats"), F.lit(5).cast("long").alias("max_exports_per_day"), F.lit(1.0).alias("max_file_size_mb"), (F.col("id") % 2 == 0).alias("is_active"))
    return records.export_permission(t.users(), own, by_level, t.usage().filter("created_at >= timestamp_ntz'1998-01-01'"), "markdown")


@query("SELECT p_partkey AS id FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45)")
def config_seed_anti(t: Tables) -> DataFrame:
    existing = t.lineitem.filter("l_quantity > 45").select(F.col("l_partkey").alias("id"))
    return records.seed_missing(t.part.select(F.col("p_partkey").alias("id")), existing, "id")


@query("SELECT p_partkey AS id, p_name AS name FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45)")
def existence_semi(t: Tables) -> DataFrame:
    parts = t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    return records.existing(parts, t.lineitem.filter("l_quantity > 45"), "id", "l_partkey")


# Every third page of ten from the newest log on, found by bounds.
@query("""
WITH o AS (SELECT event_id AS id, (row_number() OVER (ORDER BY value DESC, event_id) - 1) // 200 + 1 AS page FROM events)
SELECT page::INT AS page, id FROM o WHERE page IN (1, 4, 7, 10)""")
def log_pages_by_bounds(t: Tables) -> DataFrame:
    pages = Pages(t.logs(), "value", "id", size=200, descending=True)
    return reduce(DataFrame.unionAll, (pages.number(k).select(F.lit(k).alias("page"), "id") for k in (1, 4, 7, 10)))


@query("SELECT event_id AS id FROM events WHERE ts >= TIMESTAMP '2024-01-20'")
def retention_delete(t: Tables) -> DataFrame:
    return records.retained(t.logs(), "2024-01-20 00:00:00").select("id")


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 10 = 3 THEN false ELSE c_acctbal > 0 END AS is_active FROM customer")
def soft_delete(t: Tables) -> DataFrame:
    return records.soft_deleted(t.users(), F.col("id") % 10 == 3).select("id", "is_active")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def cascade_delete(t: Tables) -> DataFrame:
    gone = t.tasks().filter("status = 'completed'")
    return records.cascade(gone, "id", {"lines": (t.lineitem, "l_orderkey")})["lines"].select("l_orderkey", "l_linenumber")


# Customers in debt go, with their orders and those orders' lines: keys are written, and reading leaves the rows out.
@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_acctbal < 0)")
def cascade_tombstones(t: Tables) -> DataFrame:
    def table(rows: DataFrame, name: str, key: str) -> Buckets:
        own = Buckets(t.spark, new_path(t.spark, name), rows.schema, key)
        own.put(rows, 0)
        return own

    customers = table(t.customer.select("c_custkey", "c_acctbal"), "tomb-customer", "c_custkey")
    orders = table(t.orders.select("o_orderkey", "o_custkey"), "tomb-orders", "o_custkey")
    lines = table(t.lineitem.select("l_orderkey", "l_linenumber"), "tomb-lineitem", "l_orderkey")
    cascade(customers.read().filter("c_acctbal < 0").select("c_custkey"), [(customers, "c_custkey"), (orders, "o_orderkey"), (lines, "l_orderkey")], 1)
    lines.rewrite()
    return lines.read()


@query("SELECT user_id, event_type AS provider FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS k FROM events GROUP BY 1, 2) WHERE k = 1")
def topk_provider_per_user(t: Tables) -> DataFrame:
    return usage.top_per_key(t.logs(), "user_id", "action", "provider")


@query("""
SELECT event_id AS id, count(*) OVER w AS n, sum((props->>'$.k')::INT) OVER w::BIGINT AS tokens_in_window FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 60 SECONDS PRECEDING AND CURRENT ROW)""")
def sliding_60s_usage(t: Tables) -> DataFrame:
    rows = t.events.select(F.col("event_id").alias("id"), F.col("user_id").alias("key"), "ts", F.get_json_object("props", "$.k").cast("long").alias("tokens"))
    return records.sliding_usage(rows).select("id", "n", "tokens_in_window")


@query("SELECT event_id AS id, round(avg((props->>'$.k')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW), 9) AS rolling_mean FROM events")
def rolling_mean_100(t: Tables) -> DataFrame:
    rows = t.events.select(F.col("event_id").alias("id"), "user_id", "ts", F.get_json_object("props", "$.k").cast("int").alias("tokens"))
    return records.rolling_mean(rows, ["user_id"], ["ts", "id"], "tokens").select("id", F.round("rolling_mean", 9).alias("rolling_mean"))


@query("""
WITH q AS (SELECT o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey % 100 ORDER BY 9 - substr(o_orderpriority, 1, 1)::INT DESC, o_orderdate, o_orderkey) AS position FROM orders WHERE o_orderstatus = 'O')
SELECT id, position::INT AS position, (greatest(0, floor((position - 3) / 2) + 1) * 300)::BIGINT AS wait_seconds FROM q""")
def queue_position_wait(t: Tables) -> DataFrame:
    rows = t.tasks().filter("status = 'pending'").select("id", (F.col("user_id") % 100).alias("queue"), (9 - F.substring("priority_name", 1, 1).cast("int")).alias("priority"), "created_at")
    return records.queue_positions(rows).select("id", "position", F.col("wait_seconds").cast("long").alias("wait_seconds"))


@query("""
WITH d AS (SELECT unnest(generate_series(DATE '2024-01-01', DATE '2024-01-31', INTERVAL 1 DAY))::DATE AS date), c AS (SELECT ts::DATE AS date, count(*) AS n FROM events GROUP BY 1),
j AS (SELECT strftime(d.date, '%Y-%m-%d') AS date, coalesce(n, 0)::BIGINT AS used FROM d LEFT JOIN c USING (date))
SELECT date, 'used' AS type, used AS value FROM j UNION ALL SELECT date, 'remaining', 1000 - used FROM j""")
def date_spine_unpivot(t: Tables) -> DataFrame:
    counts = t.logs().groupBy(F.to_date("created_at").alias("date")).agg(F.count("*").alias("used"))
    days = usage.zero_filled(usage.day_spine(t.spark, "2024-01-01", "2024-01-31"), counts, "date", "used").withColumn("date", date_text("date"))
    return usage.used_and_remaining(days.withColumn("remaining", 1000 - F.col("used")))


@query("SELECT min(doc_id) AS doc_id, md5(text) AS digest FROM documents GROUP BY text")
def first_wins_dedup(t: Tables) -> DataFrame:
    rows = t.documents.select(F.sha2("text", 256).alias("hash"), "doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))
    return records.first_wins(rows, ["hash"], ["doc_id"]).select("doc_id", "digest")


@query("SELECT count(*) AS n_users, coalesce(sum(cast(c_acctbal AS DECIMAL(20,4))), 0)::DOUBLE AS total_used, count(*)::DOUBLE * 1000 AS total_limit, round(coalesce(avg(CASE WHEN c_acctbal > 0 THEN c_acctbal END), 0), 4) AS avg_active_used FROM customer")
def limit_totals(t: Tables) -> DataFrame:
    rows = usage.limit_totals(t.users().select(F.col("balance").alias("used"), F.lit(1000.0).alias("allowed"), "is_active"))
    return rows.withColumn("avg_active_used", F.round("avg_active_used", 4))


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 5 > 0 THEN round(c_custkey % 97 / greatest(c_custkey % 5, 1) * 100, 1) ELSE 0 END AS rate FROM customer")
def usage_rates(t: Tables) -> DataFrame:
    return t.users().select("id", usage.usage_rate((F.col("id") % 97).cast("double"), (F.col("id") % 5).cast("double")).alias("rate"))


@query("""
WITH c AS (SELECT o_orderkey, o_orderstatus <> 'P' AS a, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderdate END AS e, o_orderkey % 4 AS u, 3 AS m FROM orders),
s AS (SELECT *, CASE WHEN NOT a THEN 'inactive' WHEN e IS NOT NULL AND e <= TIMESTAMP '1996-06-01' THEN 'expired' WHEN u >= m THEN 'inactive' ELSE 'active' END AS status FROM c)
SELECT count(*) AS total, count(*) FILTER (status = 'active') AS active, count(*) FILTER (status = 'inactive') AS inactive, count(*) FILTER (status = 'expired') AS expired, sum(u)::BIGINT AS used,
 sum(CASE WHEN status = 'active' THEN greatest(0, m - u) END)::BIGINT AS left FROM s""".replace(" AS left", ' AS "left"'))
def invitation_stats(t: Tables) -> DataFrame:
    codes = t.orders.select((F.col("o_orderstatus") != "P").alias("is_active"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderdate")).alias("expires_at"), (F.col("o_orderkey") % 4).alias("used_count"), F.lit(3).cast("long").alias("max_uses"))
    return records.invitation_stats(codes, "1996-06-01 00:00:00")


@query("""
SELECT count(*) FILTER (event_type = 'purchase') AS exports, count(*) FILTER (event_type = 'error') AS blocked, round(avg(CASE WHEN (props->>'$.k')::INT > 0 THEN (props->>'$.k')::INT END), 2) AS avg_size_mb FROM events""")
def export_stats(t: Tables) -> DataFrame:
    status = F.when(F.col("event_type") == "purchase", "success").when(F.col("event_type") == "error", "blocked").otherwise("failed")
    return dashboards.export_stats(t.events.select(status.alias("export_status"), F.get_json_object("props", "$.k").cast("int").alias("file_size_mb")))


@query("SELECT count(*) AS n, count(*) FILTER (k < 1) AS hits, sum(k)::BIGINT AS total, round(100.0 * count(*) FILTER (k < 1) / count(*), 6) AS hit_rate FROM (SELECT (props->>'$.k')::INT AS k FROM events)")
def timing_stats(t: Tables) -> DataFrame:
    rows = dashboards.timing_stats(t.events.select(F.get_json_object("props", "$.k").cast("int").alias("seconds")))
    return rows.select("n", "hits", "total", F.round("hit_rate", 6).alias("hit_rate"))


@query("""
WITH k AS (SELECT event_id, event_type, user_id % 6 AS a FROM events), b AS (SELECT *, CASE event_type WHEN 'click' THEN pow(3, a) WHEN 'view' THEN pow(4, a) WHEN 'purchase' THEN pow(5, a) WHEN 'signup' THEN 1.5 * pow(2, a) ELSE pow(2, a) END AS d FROM k)
SELECT event_id AS id, least(60, d)::DOUBLE AS delay FROM b""")
def backoff_delay(t: Tables) -> DataFrame:
    kind = F.when(F.col("event_type") == "click", "rate_limit").when(F.col("event_type") == "view", "502").when(F.col("event_type") == "purchase", "503").when(F.col("event_type") == "signup", "timeout").otherwise("other")
    return t.events.select(F.col("event_id").alias("id"), records.backoff_delay(F.col("user_id") % 6, kind).alias("delay"))


@query("SELECT event_id AS id, round((props->>'$.k')::INT / 1000 * 0.001 + user_id / 1000 * 0.002, 9) AS cost FROM events")
def cost_estimate(t: Tables) -> DataFrame:
    return t.events.select(F.col("event_id").alias("id"), F.round(records.cost_estimate(F.get_json_object("props", "$.k").cast("int"), F.col("user_id")), 9).alias("cost"))


@query("SELECT o_orderkey AS id, strftime(o_orderdate, '%m-%d') AS month_day, ['周一', '周二', '周三', '周四', '周五', '周六', '周日'][isodow(o_orderdate)] AS weekday FROM orders")
def weekday_labels(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_orderkey").alias("id"), usage.month_day(F.col("o_orderdate")).alias("month_day"), usage.weekday_name(F.col("o_orderdate")).alias("weekday"))


@query("""
WITH f AS (SELECT user_id, min(ts) AS a, max(ts) AS b FROM events GROUP BY 1), s AS (SELECT user_id, (epoch_us(b) // 1000000 - epoch_us(a) // 1000000)::BIGINT AS s FROM f)
SELECT user_id, printf('%d:%02d:%02d', s // 3600, s // 60 % 60, s % 60) AS duration FROM s""")
def task_duration(t: Tables) -> DataFrame:
    spans = t.logs().groupBy("user_id").agg(F.min("created_at").alias("a"), F.max("created_at").alias("b"))
    return spans.select("user_id", records.duration(F.col("a"), F.col("b")).alias("duration"))


@query("SELECT n_nationkey AS id, (n_nationkey - 3) % 25 + CASE WHEN n_nationkey < 3 THEN 25 ELSE 0 END AS turn FROM nation")
def round_robin(t: Tables) -> DataFrame:
    return records.rotation(t.nation.select(F.col("n_nationkey").alias("id")), "id", 2, 25)
