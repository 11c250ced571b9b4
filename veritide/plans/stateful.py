"""Stateful operators and time windows over the driver's events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritide.operators import graphs
from veritide.plans.registry import Tables, query
from veritide.streaming import machines, operators


def requests(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("double")
    return t.events.select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), k.alias("tokens"), (F.col("event_type") != "error").alias("success"))


def shown(rows: DataFrame) -> DataFrame:
    """Without the time, which engines print in different ways."""
    return rows.drop("ts")


# Events in order per user; the machines' states go from row to row.
EVENTS = """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch(ts) AS now, coalesce((props->>'$.k')::DOUBLE, 0) AS need, event_type <> 'error' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events)"""
NEXT = "JOIN e ON e.user_id = s.user_id AND e.k = s.k + 1"


@query(f"""{EVENTS},
s AS (SELECT user_id, event_id, k, now, need, 100::DOUBLE AS have, CASE WHEN 100 >= need THEN 100 - need ELSE 100 END::DOUBLE AS left_over FROM e WHERE k = 1
 UNION ALL SELECT user_id, event_id, k, now, need, have, CASE WHEN have >= need THEN have - need ELSE have END FROM
  (SELECT e.user_id, e.event_id, e.k, e.now, e.need, least(100::DOUBLE, s.left_over + greatest(0::DOUBLE, e.now - s.now) * 0.01::DOUBLE) AS have FROM s {NEXT}))
SELECT user_id::VARCHAR AS key, event_id AS id, have >= need AS admitted, round(CASE WHEN have >= need THEN 0 ELSE (need - have) / 0.01::DOUBLE END, 6)::DOUBLE AS wait_seconds, round(left_over, 6) AS "left" FROM s""")
def token_bucket(t: Tables) -> DataFrame:
    rows = shown(operators.folded(requests(t), machines.token_bucket(100, 0.01)))
    return rows.withColumns({c: F.round(c, 6) for c in ("wait_seconds", "left")})


@query(f"""{EVENTS},
a AS (SELECT *, 2 / 60::DOUBLE AS rr, 2::DOUBLE AS tr FROM e),
s AS (SELECT user_id, event_id, k, now AS ra, 1::DOUBLE AS r, 2::DOUBLE AS rhave, now AS ta, 120::DOUBLE AS thave, need, CASE WHEN 120 >= need THEN 120 - need ELSE 120 END::DOUBLE AS t FROM e WHERE k = 1
 UNION ALL SELECT user_id, event_id, k, now, CASE WHEN rhave >= 1 THEN rhave - 1 ELSE rhave END, rhave, CASE WHEN rhave >= 1 THEN now ELSE ta END, thave, need,
  CASE WHEN rhave < 1 THEN t WHEN thave >= need THEN thave - need ELSE thave END FROM
  (SELECT e.user_id, e.event_id, e.k, e.now, e.need, s.t, s.ta, least(2::DOUBLE, s.r + greatest(0::DOUBLE, e.now - s.ra) * (2 / 60::DOUBLE)) AS rhave, least(120::DOUBLE, s.t + greatest(0::DOUBLE, e.now - s.ta) * 2::DOUBLE) AS thave FROM s {NEXT}))
SELECT user_id::VARCHAR AS key, event_id AS id, rhave >= 1 AND thave >= need AS admitted, round(CASE WHEN rhave < 1 THEN (1 - rhave) / (2 / 60::DOUBLE) WHEN thave >= need THEN 0 ELSE (need - thave) / 2::DOUBLE END, 6)::DOUBLE AS wait_seconds FROM s""")
def rate_admission(t: Tables) -> DataFrame:
    return shown(operators.folded(requests(t), machines.admission(2, 120))).withColumn("wait_seconds", F.round("wait_seconds", 6))


@query(f"""{EVENTS},
s AS (SELECT user_id, event_id, k, 'closed' AS name, CASE WHEN ok THEN 0 ELSE 1 END AS failed, 0 AS good, CASE WHEN ok THEN 0 ELSE now END::DOUBLE AS seen, true AS executed FROM e WHERE k = 1
 UNION ALL SELECT user_id, event_id, k,
  CASE WHEN waits THEN 'open' WHEN ok THEN CASE WHEN before = 'half_open' AND good < 2 THEN 'half_open' ELSE 'closed' END WHEN before = 'half_open' OR failed + 1 >= 2 THEN 'open' ELSE before END,
  CASE WHEN waits THEN failed WHEN ok THEN CASE WHEN before = 'half_open' AND good < 2 THEN failed ELSE 0 END ELSE failed + 1 END,
  CASE WHEN waits THEN good WHEN ok AND before = 'half_open' THEN good + 1 ELSE good END, CASE WHEN waits OR ok THEN seen ELSE now END, NOT waits FROM
  (SELECT e.user_id, e.event_id, e.k, e.now, e.ok, s.failed, s.seen, s.name = 'open' AND e.now - s.seen <= 3600 AS waits, CASE WHEN s.name = 'open' AND e.now - s.seen > 3600 THEN 'half_open' ELSE s.name END AS before,
    CASE WHEN s.name = 'open' AND e.now - s.seen > 3600 THEN 0 ELSE s.good END AS good FROM s {NEXT}))
SELECT user_id::VARCHAR AS key, event_id AS id, name AS breaker, executed FROM s""")
def circuit_breaker(t: Tables) -> DataFrame:
    return shown(operators.folded(requests(t), machines.circuit_breaker(failures=2, recovery=3600.0)))


@query(f"""{EVENTS},
s AS (SELECT user_id, event_id, k, 15 AS current, 1 AS total, (NOT ok)::INT AS errors, now AS since FROM e WHERE k = 1
 UNION ALL SELECT user_id, event_id, k, CASE WHEN NOT due THEN current WHEN errors / total > 0.15 THEN greatest(5, floor(current * 0.7::DOUBLE)::INT) WHEN errors / total < 0.03 THEN least(25, floor(current * 1.3::DOUBLE)::INT) ELSE current END,
  CASE WHEN due THEN 0 ELSE total END, CASE WHEN due THEN 0 ELSE errors END, CASE WHEN due THEN now ELSE since END FROM
  (SELECT e.user_id, e.event_id, e.k, e.now, s.current, s.since, s.total + 1 AS total, s.errors + (NOT e.ok)::INT AS errors, e.now - s.since >= 30 AND s.total + 1 >= 10 AS due FROM s {NEXT}))
SELECT user_id::VARCHAR AS key, event_id AS id, current AS concurrency FROM s""")
def adaptive_concurrency(t: Tables) -> DataFrame:
    return shown(operators.folded(requests(t), machines.adaptive_concurrency()))


@query("""
WITH RECURSIVE e AS (SELECT user_id, event_id, event_type = 'error' AS bad, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
f AS (SELECT user_id, event_id, k, greatest(0.1::DOUBLE, least(0.9::DOUBLE, 0.5::DOUBLE * 0.9::DOUBLE + CASE WHEN bad THEN 0.1::DOUBLE ELSE 0 END)) AS rate FROM e WHERE k = 1
 UNION ALL SELECT e.user_id, e.event_id, e.k, greatest(0.1::DOUBLE, least(0.9::DOUBLE, f.rate * 0.9::DOUBLE + CASE WHEN e.bad THEN 0.1::DOUBLE ELSE 0 END)) FROM f JOIN e ON e.user_id = f.user_id AND e.k = f.k + 1)
SELECT user_id::VARCHAR AS key, event_id AS id, round(rate, 9) AS rate FROM f""")
def moving_false_rate(t: Tables) -> DataFrame:
    return shown(operators.folded(requests(t), machines.false_rate())).withColumn("rate", F.round("rate", 9))


@query("SELECT user_id::VARCHAR AS key, strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n, sum((props->>'$.k')::INT)::DOUBLE AS tokens FROM events GROUP BY 1, 2")
def tumbling_usage(t: Tables) -> DataFrame:
    return operators.windowed_usage(requests(t), width="1 hour").withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


@query("""
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id::VARCHAR AS key, count(*) AS n, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start FROM s GROUP BY user_id, s""")
def session_usage(t: Tables) -> DataFrame:
    return operators.sessions(requests(t), gap="6 hours").select("key", "n", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"))


@query("""
WITH RECURSIVE e AS (SELECT n_nationkey AS a, (n_nationkey * 3 + 1) % 25 AS b FROM nation UNION SELECT n_nationkey, (n_nationkey + 5) % 25 FROM nation),
r AS (SELECT n_nationkey AS start, n_nationkey AS node, 0 AS depth, [n_nationkey] AS seen FROM nation UNION ALL SELECT start, b, depth + 1, list_append(seen, b) FROM r JOIN e ON e.a = r.node WHERE depth < 3 AND NOT list_contains(seen, b))
SELECT start, node, min(depth)::INT AS depth FROM r GROUP BY 1, 2""")
def reachable_files(t: Tables) -> DataFrame:
    n = F.col("n_nationkey")
    edges = t.nation.select(n.alias("a"), ((n * 3 + 1) % 25).alias("b")).union(t.nation.select(n, ((n + 5) % 25))).distinct()
    return graphs.reachable(edges, t.nation.select(n.alias("node")), 3)


# Each document leads to two or three later ones, and a few lead back; any number of hops.
@query("""
WITH RECURSIVE d AS (SELECT doc_id AS i, count(*) OVER () AS n FROM documents),
e AS (SELECT i AS a, 2 * i + 1 AS b FROM d WHERE 2 * i + 1 < n UNION SELECT i, 2 * i + 2 FROM d WHERE 2 * i + 2 < n UNION SELECT i, 3 * i + 1 FROM d WHERE 3 * i + 1 < n UNION SELECT i, i - 1 FROM d WHERE i % 64 = 63),
r AS (SELECT i AS start, i AS node, 0 AS depth FROM d UNION SELECT start, b, depth + 1 FROM r JOIN e ON e.a = r.node WHERE depth < 40)
SELECT start, node, min(depth)::INT AS depth FROM r GROUP BY 1, 2""")
def reachable_any_depth(t: Tables) -> DataFrame:
    docs = t.documents.select(F.col("doc_id").alias("a"))
    n = t.documents.select(F.count("*").alias("n"))
    a = F.col("a")
    ahead = docs.crossJoin(F.broadcast(n)).select("a", F.explode(F.array(2 * a + 1, 2 * a + 2, 3 * a + 1)).alias("b"), "n").filter("b < n").select("a", "b")
    back = docs.filter(a % 64 == 63).select("a", a - 1)
    return graphs.reachable(ahead.union(back), docs.select(a.alias("node")))
