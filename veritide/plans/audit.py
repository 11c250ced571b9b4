"""Manifests, references between files, project facts, the model step and records over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritide.functions import detection, false_positives, languages
from veritide.operators import analysis, dashboards, projects, records, templates
from veritide.operators import findings as found
from veritide.plans.registry import Tables, query
from veritide.sources import files as sources
from veritide.sources import manifests, tables


# Manifests: five for each supplier

MANIFEST_TEXTS = {
    "requirements.txt": "requests>=2.{n}\npkg-{k}==1.0 # pinned\n-r other.txt\n# comment\n\nflask\n",
    "pyproject.toml": "[tool.poetry.dependencies]\npython = \"^3.9\"\nflask = \"^2.0\"\nnumpy = '1.{n}'\n[tool.other]\nx = \"1\"\n",
    "package.json": '{"dependencies": {"react": "^18.{n}"}, "devDependencies": {"jest": "~29"}}',
    "go.mod": "module m\n\nrequire (\n\tgithub.com/a/b v1.{n}.0\n\t// github.com/c/d v2\n)\nrequire golang.org/x/y v0.{n}\n",
    "Cargo.toml": '[package]\nname = "c"\n[dependencies]\nserde = "1.{n}"\n# rand = "0"\n',
}


@query("""
WITH s AS (SELECT s_suppkey AS k, s_nationkey AS n FROM supplier)
SELECT 'p' || k AS project_id, d.manifest, d.name, d.version, d.source FROM s, LATERAL (VALUES
 ('requirements.txt', 'requests', '2.' || n, 'pip'), ('requirements.txt', 'pkg-' || k, '1.0', 'pip'), ('requirements.txt', 'flask', NULL, 'pip'), ('pyproject.toml', 'numpy', '1.' || n, 'pip'), ('package.json', 'react', '^18.' || n, 'npm'), ('package.json', 'jest', '~29', 'npm'),
 ('go.mod', 'github.com/a/b', 'v1.' || n || '.0', 'go'), ('go.mod', 'golang.org/x/y', 'v0.' || n, 'go'), ('Cargo.toml', 'serde', '1.' || n, 'cargo')) AS d(manifest, name, version, source)""")
def manifest_dependencies(t: Tables) -> DataFrame:
    texts = F.array(*(F.struct(F.lit(name).alias("path"), analysis.prompt(text, k=F.col("s_suppkey"), n=F.col("s_nationkey")).alias("content")) for name, text in MANIFEST_TEXTS.items()))
    files = t.supplier.select(F.concat(F.lit("p"), "s_suppkey").alias("project_id"), F.explode(texts).alias("f")).select("project_id", "f.*")
    return manifests.dependencies(sources.described(files)).select("project_id", "manifest", "name", "version", "source")


# References between files

# Fifty files to a folder, each of which refers to the next two.
FOLDER = "src/d' || doc_id // 50 || '/"
CODE = FOLDER + "' || CASE WHEN doc_id % 3 = 0 THEN 'Upload' ELSE 'Page' END || doc_id || '.php"
CODE_FILES = f"WITH f AS (SELECT doc_id, doc_id // 50 AS folder, '{CODE}' AS path FROM documents)"


def code_files(t: Tables) -> DataFrame:
    """A file for each document, and a controller in each folder."""
    name = lambda i: F.concat(F.when(i % 3 == 0, "Upload").otherwise("Page"), i.cast("string"), F.lit(".php"))
    folder = F.concat(F.lit("d"), F.floor(F.col("doc_id") / 50).cast("string"), F.lit("/"))
    content = F.concat(F.lit("include '"), name(F.col("doc_id") + 1), F.lit("';\n$x = template \"../"), folder, name(F.col("doc_id") + 2), F.lit("\";\n"))
    own = t.documents.select(F.concat(F.lit("src/"), folder, name(F.col("doc_id"))).alias("path"), content.alias("content"))
    controllers = t.documents.select(F.concat(F.lit("src/"), folder, F.lit("MainController.java")).alias("path"), F.lit("class C {}").alias("content")).distinct()
    return own.unionByName(controllers).withColumn("size", F.char_length("content").cast("long"))


@query(f"""{CODE_FILES}
SELECT a.path, b.path AS related, 'callee' AS relation FROM f a JOIN f b ON b.doc_id = a.doc_id + 1 AND b.folder = a.folder
UNION ALL SELECT a.path, b.path, 'template' FROM f a JOIN f b ON b.doc_id = a.doc_id + 2 AND b.folder = a.folder""")
def reference_edges(t: Tables) -> DataFrame:
    files = code_files(t)
    return found.reference_edges(files, found.REFERENCES, "callee").unionByName(found.reference_edges(files, found.TEMPLATES, "template")).select("path", "related", "relation")


@query(f"SELECT '{CODE}' AS path, '{FOLDER}MainController.java' AS related, 0 AS at FROM documents WHERE doc_id % 3 = 0")
def parent_controllers(t: Tables) -> DataFrame:
    files = code_files(t)
    return found.parent_edges(files.select("path"), files).select("path", "related", "at")


NAMED = "CASE WHEN {0} % 3 = 0 THEN 'Upload' ELSE 'Page' END || {0} || '.php'"
TEXT = f"""'include ' || chr(39) || {NAMED.format("(doc_id + 1)")} || chr(39) || ';' || chr(10) || '$x = template "../d' || folder || '/' || {NAMED.format("(doc_id + 2)")} || '";'"""


@query(f"""{CODE_FILES},
c AS (SELECT path AS caller, text FROM (SELECT path, {TEXT} AS text FROM f UNION SELECT 'src/d' || folder || '/MainController.java', 'class C' FROM f) ORDER BY path LIMIT 100),
p AS (SELECT doc_id, path, {NAMED.format("doc_id")} AS name, unnest([0, 1]) AS rank FROM f),
h AS (SELECT doc_id, caller, rank, row_number() OVER (PARTITION BY doc_id, rank ORDER BY caller) AS n FROM p JOIN c ON contains(text, CASE rank WHEN 0 THEN replace(name, '.php', '') ELSE name END) AND caller <> path),
e AS (SELECT doc_id, caller AS related, 'caller' AS relation, 0 AS rank, row_number() OVER (PARTITION BY doc_id ORDER BY rank * 10 + n, caller) AS n FROM h WHERE n <= 5
 UNION ALL SELECT a.doc_id, b.path, 'callee', 1, 1 FROM f a JOIN f b ON b.doc_id = a.doc_id + 1 AND b.folder = a.folder
 UNION ALL SELECT a.doc_id, b.path, 'template', 3, 1 FROM f a JOIN f b ON b.doc_id = a.doc_id + 2 AND b.folder = a.folder WHERE a.doc_id % 2 = 0
 UNION ALL SELECT doc_id, 'src/d' || folder || '/MainController.java', 'parent', 4, 1 FROM f WHERE doc_id % 3 = 0),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY rank, n) AS place FROM e WHERE n <= 3)
SELECT path, related, relation, place::INT AS place FROM o JOIN f USING (doc_id) WHERE place <= 5""")
def related_files(t: Tables) -> DataFrame:
    files = code_files(t)
    number = F.nullif(F.regexp_extract("path", r"(\d+)\.php$", 1), F.lit("")).cast("long")
    kind = F.when(F.col("i") % 2 == 0, "XSS攻击").otherwise("其他")
    keys = files.withColumn("i", number).filter("i is not null").select("path", kind.alias("type"))
    return found.related_files(keys, files).select("path", "related", "relation", "place")


# Projects

PATHS = ["package.json", "src/main/App.java", "models/user.py", "views/list.py", "controllers/home.py", "Dockerfile", "api/routes/x.go", "setup.py", "test/a.py", "index.html", "docker-compose.yml", "data/f.csv"]
FILES_SQL = f"WITH f AS (SELECT DISTINCT 'n' || (c_custkey % 97) AS project_id, {PATHS}[1 + (c_custkey * 7 + c_custkey // 97) % 12] AS path FROM customer)"


def project_files(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    path = F.element_at(F.array(*map(F.lit, PATHS)), (1 + (k * 7 + F.floor(k / 97)) % 12).cast("int"))
    return t.customer.select(F.concat(F.lit("n"), k % 97).alias("project_id"), path.alias("path")).distinct()


def project_dependencies(t: Tables) -> DataFrame:
    return t.customer.filter("c_custkey % 5 = 0").select(F.concat(F.lit("n"), F.col("c_custkey") % 97).alias("project_id"), F.when(F.col("c_custkey") % 2 == 0, "Flask").otherwise("gin").alias("name")).distinct()


DEPENDENCIES_SQL = "d AS (SELECT DISTINCT 'n' || (c_custkey % 97) AS project_id, CASE WHEN c_custkey % 2 = 0 THEN 'flask' ELSE 'gin' END AS name FROM customer WHERE c_custkey % 5 = 0)"
TYPE_ROWS = ", ".join(f"('{kind}', '{p.lower()}', {i})" for i, (kind, some) in enumerate(projects.TYPES.items()) for p in some)
TYPES_SQL = f"""{FILES_SQL}, {DEPENDENCIES_SQL},
n AS (SELECT DISTINCT project_id, unnest([lower(path), regexp_extract(lower(path), '[^/]*$')]) AS name FROM f), p(kind, pattern, i) AS (VALUES {TYPE_ROWS}),
h AS (SELECT project_id, kind, i, sum(contains(name, pattern)::INT + 2 * (name = pattern)::INT)::INT AS n FROM n, p GROUP BY ALL),
x AS (SELECT project_id, max((name IN ('setup.py', 'pyproject.toml'))::INT) * 2 AS lib, max(contains(name, 'docker')::INT) * 2 AS micro FROM n GROUP BY 1),
w AS (SELECT project_id, max((name = 'flask')::INT) * 3 AS web, max((name = 'gin')::INT) * 3 AS api FROM d GROUP BY 1),
s AS (SELECT h.project_id, kind, i, n + CASE kind WHEN 'library' THEN lib WHEN 'microservice' THEN micro WHEN 'web_application' THEN coalesce(web, 0) WHEN 'api_service' THEN coalesce(api, 0) ELSE 0 END AS n FROM h JOIN x USING (project_id) LEFT JOIN w USING (project_id)),
t AS (SELECT project_id, CASE WHEN max(n) > 0 THEN arg_max(kind, n * 100 - i) ELSE 'unknown' END AS project_type FROM s GROUP BY 1)"""


@query(TYPES_SQL + " SELECT project_id, project_type FROM t")
def project_type(t: Tables) -> DataFrame:
    return projects.project_type(project_files(t), project_dependencies(t))


ARCHITECTURE_CASES = " ".join(f"WHEN len(list_intersect(have, {needed})) >= {len(needed) * 0.6} THEN '{name}'" for name, needed in projects.ARCHITECTURES.items())


@query(f"""{FILES_SQL}, g AS (SELECT project_id, list(DISTINCT folder) AS have FROM (SELECT project_id, unnest(string_split(lower(path), '/')[:-2]) AS folder FROM f) GROUP BY 1)
SELECT project_id, CASE {ARCHITECTURE_CASES} WHEN list_contains(have, 'src') AND list_contains(have, 'test') THEN 'Standard Source Layout' END AS architecture FROM g""")
def project_architecture(t: Tables) -> DataFrame:
    return projects.architecture(project_files(t))


@query(f"""{TYPES_SQL}, e AS (SELECT project_id, path, CASE WHEN lower(regexp_extract(path, '[^/]*$')) IN ('index.html', 'main.py', 'app.py', 'server.py', 'index.py', 'run.py', 'main.js', 'app.js', 'server.js', 'index.js', 'main.java', 'main.go', 'main.rs', 'main.cpp', 'main.c', 'index.php') THEN 0 WHEN project_type = 'web_application' AND regexp_matches(lower(path), 'wsgi[.]py|asgi[.]py|manage[.]py|app[.]py') THEN 1 END AS r FROM f JOIN t USING (project_id))
SELECT project_id, path, row_number() OVER (PARTITION BY project_id ORDER BY r, path)::INT AS n FROM e WHERE r IS NOT NULL""")
def project_entry_points(t: Tables) -> DataFrame:
    files = project_files(t)
    return projects.entry_points(files, projects.project_type(files, project_dependencies(t))).select("project_id", "path", "n")


# The model step


def even_only(prompt: str) -> str:
    if len(prompt) % 2:
        raise TimeoutError("odd")
    return f"even {len(prompt)}"


def not_short(prompt: str) -> str:
    if len(prompt) < 200:
        raise ValueError("short")
    return f"odd {len(prompt)}"


@query("""
WITH p AS (SELECT doc_id, length('Review ' || coalesce(lang, '') || ': ' || text) AS n FROM documents)
SELECT doc_id::VARCHAR AS file, CASE WHEN n % 2 = 0 THEN 'even ' || n WHEN n >= 200 THEN 'odd ' || n END AS response, CASE WHEN n % 2 = 0 THEN 'first' ELSE 'second' END AS provider, CASE WHEN n % 2 = 1 AND n < 200 THEN 'ValueError: short' END AS error FROM p""")
def model_failover(t: Tables) -> DataFrame:
    asked = analysis.prompt("Review {lang}: {text}", lang=F.col("lang"), text=F.col("text"))
    rows = t.documents.select(F.col("doc_id").cast("string").alias("path"), F.col("lang").alias("language"), asked.alias("prompt"))
    return analysis.analyse(rows, ("first", even_only), ("second", not_short)).select("file", "response", "provider", "error")


@query("SELECT p_partkey AS ord, p_name || p_partkey AS name FROM part ORDER BY CASE WHEN p_partkey = 7 THEN 0 ELSE 1 END, p_retailprice, p_partkey LIMIT 5")
def provider_order(t: Tables) -> DataFrame:
    """The five that are asked first: a report of the top ones."""
    some = t.part.select(F.concat("p_name", F.col("p_partkey").cast("string")).alias("name"), F.col("p_retailprice").alias("cost"), F.col("p_partkey").alias("ord"))
    preferred = some.filter("ord = 7").first()
    return analysis.provider_order(some, preferred["name"] if preferred else None).limit(5).select("ord", "name")


@query("SELECT o_orderpriority AS name, count(*) AS request_count, length(o_orderpriority)::BIGINT AS priority FROM orders GROUP BY 1 UNION ALL SELECT 'unused', 0, 6")
def provider_stats(t: Tables) -> DataFrame:
    names = t.orders.select(F.col("o_orderpriority").alias("name")).distinct().unionByName(t.spark.createDataFrame([("unused",)], "name string"))
    return dashboards.provider_stats(names.withColumn("priority", F.char_length("name").cast("long")), t.usage())


@query("""
WITH k AS (SELECT user_id AS run, CASE WHEN event_type IN ('click', 'view') THEN 'system' ELSE 'api' END AS kind, CASE WHEN event_type = 'purchase' THEN 'large_request' ELSE event_type END AS step, ((props->>'$.k')::INT)::DOUBLE AS s FROM events),
g AS (SELECT run, coalesce(sum(CASE WHEN kind = 'system' AND s > 0 THEN s END), 0)::DOUBLE AS sy, coalesce(sum(CASE WHEN kind = 'api' AND s > 0 THEN s END), 0)::DOUBLE AS ap, max(CASE WHEN step = 'large_request' AND s > 0 THEN s END) AS l FROM k GROUP BY 1)
SELECT run, sy AS system_seconds, ap AS api_seconds, CASE WHEN ap > 0 THEN round(100 * ap / (sy + ap), 1) END AS api_percent, round(4000 / l, 1) AS tokens_per_second, l * 4 AS four_files_in_turn FROM g""")
def benchmark_summary(t: Tables) -> DataFrame:
    step = F.when(F.col("event_type") == "purchase", "large_request").otherwise(F.col("event_type"))
    kind = F.when(F.col("event_type").isin("click", "view"), "system").otherwise("api")
    return dashboards.benchmark_summary(t.events.select(F.col("user_id").alias("run"), kind.alias("kind"), step.alias("step"), F.get_json_object("props", "$.k").cast("int").cast("double").alias("seconds")))


@query("""
WITH e AS (SELECT user_id::VARCHAR AS key, ts, event_id, ((props->>'$.k')::INT)::DOUBLE AS k, event_type <> 'error' AS ok FROM events),
c AS (SELECT key, count(*) FILTER (ok) AS s, count(*) FILTER (NOT ok) AS f FROM e GROUP BY 1), r AS (SELECT key, k, row_number() OVER (PARTITION BY key ORDER BY ts DESC, event_id DESC) AS n FROM e WHERE ok), a AS (SELECT key, avg(k) AS a FROM r WHERE n <= 100 GROUP BY 1)
SELECT key, s AS success_count, f AS error_count, f / greatest(1, s + f) AS error_rate, coalesce(round(a, 9), 0)::DOUBLE AS avg_actual_tokens FROM c LEFT JOIN a USING (key)""")
def limiter_stats(t: Tables) -> DataFrame:
    from veritide.plans.stateful import requests

    return records.limiter_stats(requests(t)).withColumn("avg_actual_tokens", F.round("avg_actual_tokens", 9))


@query("""
WITH l AS (SELECT l_orderkey AS task_id, l_linenumber AS id, l_linenumber AS analyzed, 7 AS total, CASE WHEN l_linenumber >= 6 THEN 'completed' WHEN l_linenumber = 1 THEN 'pending' ELSE 'running' END AS status, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC) AS n FROM lineitem)
SELECT task_id, status, analyzed, total, CASE status WHEN 'completed' THEN 100 WHEN 'pending' THEN 0 ELSE round(least(99, greatest(5, 100.0::DOUBLE * analyzed / 7)), 2) END::DOUBLE AS progress_percent FROM l WHERE n = 1""")
def task_progress(t: Tables) -> DataFrame:
    n = F.col("l_linenumber")
    status = F.when(n >= 6, "completed").when(n == 1, "pending").otherwise("running")
    return records.progress(t.lineitem.select(F.col("l_orderkey").alias("task_id"), n.alias("ts"), n.alias("id"), n.alias("analyzed"), F.lit(7).alias("total"), status.alias("status")))


# Records


@query("SELECT c_custkey AS id, c_name AS username FROM customer WHERE c_name = 'Customer#000000007'")
def login_lookup(t: Tables) -> DataFrame:
    return records.one_of(t.users(), F.col("username") == "Customer#000000007").select("id", "username")


INVITES = "SELECT o_orderkey AS id, o_orderdate AS created_at, o_custkey % 3 <> 0 AS is_active, CASE WHEN o_orderkey % 4 = 0 THEN o_orderdate + INTERVAL 30 DAY END AS expires_at, (o_orderkey % 5)::INT AS used_count, 3 AS max_uses FROM orders"
STATUS = "CASE WHEN NOT is_active THEN 'inactive' WHEN expires_at <= TIMESTAMP '1997-01-01' THEN 'expired' WHEN used_count >= max_uses THEN 'inactive' ELSE 'active' END"


def invites(t: Tables) -> DataFrame:
    key = F.col("o_orderkey")
    expires = F.when(key % 4 == 0, F.col("o_orderdate").cast("timestamp_ntz") + F.expr("interval 30 days"))
    return t.orders.select(key.alias("id"), F.col("o_orderdate").cast("timestamp_ntz").alias("created_at"), (F.col("o_custkey") % 3 != 0).alias("is_active"), expires.alias("expires_at"), (key % 5).cast("int").alias("used_count"), F.lit(3).alias("max_uses"))


@query(f"WITH i AS ({INVITES}) SELECT id, {STATUS} AS status FROM i WHERE {STATUS} = 'expired' ORDER BY created_at DESC, id DESC LIMIT 20 OFFSET 20")
def invitation_page(t: Tables) -> DataFrame:
    return records.invitations_page(invites(t), "1997-01-01", 2, 20, "expired").select("id", "status")


@query(f"WITH i AS ({INVITES}) SELECT id, CASE WHEN id % 7 = 0 AND {STATUS} = 'active' THEN used_count + 1 ELSE used_count END AS used_count FROM i")
def invitation_use(t: Tables) -> DataFrame:
    codes = invites(t).withColumn("code", F.when(F.col("id") % 7 == 0, "welcome").otherwise(F.col("id").cast("string")))
    return records.use_invitation(codes, "welcome", "1997-01-01").select("id", "used_count")


@query("SELECT o_orderkey AS id, CASE WHEN o_custkey % 10 = 1 AND o_orderstatus = 'O' THEN 'cancelled' WHEN o_orderstatus = 'F' THEN 'completed' WHEN o_orderstatus = 'O' THEN 'pending' ELSE 'P' END AS status FROM orders")
def cancel_guard(t: Tables) -> DataFrame:
    """Each tenth user cancels all own tasks: only pending and running ones change."""
    own = F.when(F.col("user_id") % 10 == 1, F.col("user_id"))
    tasks = t.tasks().withColumn("completed_at", F.lit(None).cast("timestamp_ntz"))
    return records.cancelled(tasks, F.col("id"), own, "2024-01-01").select("id", "status")


@query("SELECT c_custkey AS id, CASE WHEN c_acctbal < 0 THEN 0 ELSE c_acctbal END AS balance, CASE WHEN c_acctbal < 0 THEN 'blocked' ELSE c_mktsegment END AS user_level FROM customer")
def keyed_update(t: Tables) -> DataFrame:
    return records.updated(t.users(), F.col("balance") < 0, {"user_level": F.lit("blocked"), "balance": F.lit(0.0)}).select("id", "balance", "user_level")


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderpriority DESC, o_orderdate, o_orderkey LIMIT 10")
def top_of_queue(t: Tables) -> DataFrame:
    waiting = t.tasks().filter("status = 'pending'").withColumn("priority", F.col("priority_name"))
    return records.dequeue(waiting, 10).select("id")


@query("SELECT count(*) AS total, count(*) FILTER (o_orderdate < TIMESTAMP '1997-01-01') AS expired, count(*) FILTER (o_orderdate >= TIMESTAMP '1997-01-01') AS valid, round(sum(length(o_orderpriority)) / 1048576, 2) AS size_mb FROM orders")
def cache_totals(t: Tables) -> DataFrame:
    cache = t.orders.select(F.col("o_orderdate").cast("timestamp_ntz").alias("cached_at"), F.col("o_orderpriority").alias("response"))
    return tables.cache_stats(cache, "1997-01-02 00:00:00")


@query("SELECT n_name AS provider, CASE n_nationkey % 5 WHEN 0 THEN '通义千问' WHEN 1 THEN 'Kimi' WHEN 2 THEN 'OpenAI' WHEN 3 THEN 'Claude' ELSE upper(n_name[1]) || lower(n_name[2:]) END AS label, (n_nationkey * 100 + 7 * 20)::BIGINT AS tokens FROM nation WHERE NOT contains(n_name, ' ')")
def provider_labels(t: Tables) -> DataFrame:
    k = F.col("n_nationkey")
    known = F.element_at(F.array(*map(F.lit, dashboards.PROVIDER_NAMES)), F.least(F.lit(4), k % 5 + 1).cast("int"))
    name = F.when(k % 5 < 4, known).otherwise(F.col("n_name"))
    return t.nation.filter(~F.col("n_name").contains(" ")).select(F.col("n_name").alias("provider"), dashboards.provider_label(name).alias("label"), dashboards.estimated_tokens(k, F.lit(7)).cast("long").alias("tokens"))


# Code

SNIPPETS = [
    "price = x + request.args", "role = request.form['r']", "role = request.form; total = input()", "nothing here", "admin = current_user.id", "#!/usr/bin/env python3", "#!/usr/bin/node", "subprocess.run(q)", "execute(sql)",
    'password = "hunter2"', "q = ${id} WHERE 1", "@PreAuthorize x.findOne(1)", "new File(request.getParameter(n))", "def f(x):", "class A:",
]


def snippet(number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, SNIPPETS)), (number % len(SNIPPETS) + 1).cast("int"))


def sql_list(some: list[str]) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in some) + "]"


WITH_SNIPPET = f"WITH s AS (SELECT *, {sql_list(SNIPPETS)}[1 + doc_id % {len(SNIPPETS)}] AS line FROM documents)"
# The line stands in front of a document's whole text.
WITH_CODE = f"WITH s AS (SELECT doc_id, {sql_list(SNIPPETS)}[1 + doc_id % {len(SNIPPETS)}] || chr(10) || text AS code FROM documents)"


def coded(t: Tables) -> DataFrame:
    return t.documents.withColumn("line", snippet(F.col("doc_id"))).withColumn("code", F.concat("line", F.lit("\n"), "text"))


def sql_any(patterns: list[str], of: str, flags: str = "") -> str:
    return "(" + " OR ".join(f"regexp_matches({of}, '{p.replace(chr(39), chr(39) * 2)}'{flags})" for p in patterns) + ")"


I_FLAG = ", 'i'"


@query(f"{WITH_CODE} " + " UNION ALL ".join(f"SELECT doc_id, '{kind}' AS type FROM s WHERE {sql_any(detection.BUSINESS[kind], 'code', I_FLAG)}" for kind in detection.LOOKED_FOR))
def business_logic(t: Tables) -> DataFrame:
    return detection.business_logic(coded(t).select("doc_id", "code"), "doc_id", "code")


def sql_kinds(rules: dict[str, list[str]]) -> str:
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {sql_any(some, 'line')} THEN '{kind}' END" for kind, some in rules.items()) + ")"


@query(f"{WITH_SNIPPET} SELECT doc_id, {sql_kinds(false_positives.DEFINITE)} AS definite, {sql_kinds(false_positives.SAFE)} AS safe FROM s")
def conservative_rules(t: Tables) -> DataFrame:
    kinds = lambda rules: F.array_join(false_positives.kinds_in(F.col("line"), rules), ",")
    return coded(t).select("doc_id", kinds(false_positives.DEFINITE).alias("definite"), kinds(false_positives.SAFE).alias("safe"))


@query(f"""{WITH_SNIPPET} SELECT doc_id, CASE WHEN starts_with(line, '#!') AND contains(line, 'python') THEN 'python' WHEN starts_with(line, '#!') THEN 'javascript' END AS by_line,
 CASE doc_id % 4 WHEN 0 THEN 'python' WHEN 1 THEN 'rust' WHEN 2 THEN 'java' END AS by_name, CASE doc_id % 4 WHEN 0 THEN 'python' WHEN 1 THEN 'rust' WHEN 2 THEN 'java' ELSE 'javascript' END AS detected, doc_id % 4 = 3 AS front FROM s""")
def language_steps(t: Tables) -> DataFrame:
    k = F.col("doc_id") % 4
    name = F.when(k == 0, "manage.py").when(k == 1, "Cargo.toml").when(k == 2, "pom.xml").otherwise("a.jsx")
    rows = coded(t).withColumn("name", name)
    found_language = languages.detect(F.col("name"), F.concat("line", F.lit("\nx")))
    front = languages.is_frontend(F.col("name"), languages.by_extension(F.col("name")))
    return rows.select("doc_id", languages.by_first_line(F.col("line")).alias("by_line"), languages.by_name(F.col("name")).alias("by_name"), found_language.alias("detected"), front.alias("front"))


@query(f"""{WITH_SNIPPET}, c AS (SELECT doc_id, (doc_id % 4 = 0)::INT * 0.8::DOUBLE + (contains(line, '#!') AND contains(line, 'python'))::INT * 0.8::DOUBLE + least(0.7::DOUBLE, 0.1::DOUBLE * (contains(line, 'def f(')::INT)) AS n FROM s)
SELECT doc_id, round(n / greatest(1::DOUBLE, n), 6) AS python FROM c""")
def language_confidence(t: Tables) -> DataFrame:
    name = F.when(F.col("doc_id") % 4 == 0, "manage.py").otherwise("x")
    scores = languages.confidences(name, F.col("line"))
    return coded(t).select("doc_id", F.round(F.coalesce(scores["python"], F.lit(0.0)), 6).alias("python"))


def sql_words(words: list[str]) -> str:
    return "(" + " AND ".join(f"contains(lower(code), '{w}')" for w in words) + ")"


def sql_hints(language: str) -> str:
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {sql_words(first)} OR {sql_words(second)} THEN '{hint}' END" for first, second, hint in detection.HINTS[language]) + ")"


@query(f"{WITH_CODE} SELECT doc_id, CASE doc_id % 3 " + " ".join(f"WHEN {i} THEN {sql_hints(x)}" for i, x in enumerate(detection.HINTS)) + " END AS hints FROM s")
def analysis_hints(t: Tables) -> DataFrame:
    language = F.get(F.array(*map(F.lit, detection.HINTS)), (F.col("doc_id") % 3).cast("int"))
    return coded(t).select("doc_id", F.array_join(detection.hints(F.col("code"), language), ",").alias("hints"))


@query(rf"""{WITH_CODE}, l AS (SELECT doc_id, trim(unnest(string_split(code, chr(10)))) AS text, unnest(range(len(string_split(code, chr(10)))))::INT + 1 AS line FROM s),
k AS (SELECT *, CASE WHEN regexp_matches(text, '^(async\s+)?def |^function |^func |^fn |^(public|private|protected)\b.*\(') THEN 'function' WHEN regexp_matches(text, '^class |^struct |^interface |\bclass \w+') THEN 'class'
 WHEN regexp_matches(text, '^import |^from \w|^#include|^using |^require') THEN 'import' END AS kind FROM l) SELECT doc_id, line, kind, text FROM k WHERE kind IS NOT NULL""")
def code_definitions(t: Tables) -> DataFrame:
    return detection.definitions(coded(t).select("doc_id", F.col("code").alias("content")), "doc_id")


@query("SELECT page_id, length(substr(html, 1, instr(html, '<article>'))) - length(replace(substr(html, 1, instr(html, '<article>')), chr(10), '')) + 1 AS line FROM pages")
def line_numbers(t: Tables) -> DataFrame:
    return t.pages.select("page_id", detection.line_of(F.col("html"), F.instr("html", "<article>")).cast("long").alias("line"))


@query("SELECT doc_id, lower(text) AS text FROM documents WHERE n_chars BETWEEN 100 AND 2000 AND lower(lang) IN ('en', 'de')")
def files_of_language_and_size(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", F.col("lang").alias("language"), F.col("n_chars").alias("size"), F.lower("text").alias("text"))
    return sources.of_size(sources.of_language(rows, "EN", "de"), 100, 2000).select("doc_id", "text")


@query("""
SELECT doc_id, (doc_id % 11) / 10 < 0.3 OR (kind = 'SQL注入' AND (contains(text, '?') OR contains(text, ':'))) OR (kind = '权限验证绕过' AND contains(lower(source), 'dao')) AS simply_false
FROM (SELECT *, CASE lang WHEN 'en' THEN 'SQL注入' WHEN 'fr' THEN '权限验证绕过' WHEN 'de' THEN 'XSS攻击' ELSE '其他' END AS kind FROM documents)""")
def simple_false_positives(t: Tables) -> DataFrame:
    rows = t.findings()
    return rows.select("doc_id", false_positives.simply_false(F.col("type"), F.col("code"), F.col("file"), F.col("confidence")).alias("simply_false"))


# Templates and standards

KINDS = list(analysis.WEAKNESSES) + ["error_handling", "other"]


def cases(values: dict[str, str], of: str = "kind") -> str:
    return f"CASE {of} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + " END"


@query(f"WITH k AS (SELECT doc_id, {sql_list(KINDS)}[1 + doc_id % {len(KINDS)}] AS kind FROM documents) SELECT doc_id, {cases(analysis.WEAKNESSES)} AS cwe, {cases(analysis.SEVERITIES)} AS usual_severity, {cases(analysis.CATEGORIES)} AS category FROM k")
def weakness_lookups(t: Tables) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("doc_id") % len(KINDS) + 1).cast("int"))
    return analysis.classified(t.documents.select("doc_id", kind.alias("type"))).select("doc_id", "cwe", "usual_severity", "category")


STANDARD_ROWS = ", ".join(f"('{s}', '{k}', '{c}')" for s, some in templates.STANDARDS.items() for k, cwes in some.items() for c in cwes)


@query(f"WITH s(standard, category, cwe) AS (VALUES {STANDARD_ROWS}), k AS (SELECT doc_id, {cases(analysis.WEAKNESSES)} AS cwe FROM (SELECT doc_id, {sql_list(KINDS)}[1 + doc_id % {len(KINDS)}] AS kind FROM documents)) SELECT doc_id, cwe, standard, category FROM k JOIN s USING (cwe)")
def findings_by_standard(t: Tables) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("doc_id") % len(KINDS) + 1).cast("int"))
    rows = analysis.classified(t.documents.select("doc_id", kind.alias("type"))).select("doc_id", "cwe")
    return templates.by_standard(rows).select("doc_id", "cwe", "standard", "category")


@query("""
WITH v AS (SELECT p_size::VARCHAR AS name, p_partkey::INT AS version, 'Check {code} of ' || p_brand || CASE WHEN p_partkey % 2 = 0 THEN ' in {lang}' ELSE '' END AS text, p_partkey % 2 = 0 AS two FROM part),
l AS (SELECT name, arg_max(text, version) AS text, arg_max(two, version) AS two, max(version) AS version FROM v GROUP BY 1)
SELECT name, version, text, CASE WHEN two THEN 'code,lang' ELSE 'code' END AS used, NOT two AS invalid FROM l""")
def template_registry(t: Tables) -> DataFrame:
    text = F.concat(F.lit("Check {code} of "), "p_brand", F.when(F.col("p_partkey") % 2 == 0, " in {lang}").otherwise(""))
    rows = t.part.select(F.col("p_size").cast("string").alias("name"), F.lit("audit").alias("type"), F.col("p_partkey").cast("int").alias("version"), text.alias("text"), F.array(F.lit("code"), F.lit("lang")).alias("variables"))
    last = templates.latest(rows)
    wrong = templates.invalid(last).select("name", F.lit(True).alias("invalid"))
    return templates.with_variables(last).join(wrong, "name", "left").select("name", "version", "text", F.array_join("used", ",").alias("used"), F.coalesce("invalid", F.lit(False)).alias("invalid"))


# Two snapshots of the parts' manifests: what came, went and stayed

@query("""
WITH a AS (SELECT p_brand AS name, p_size AS version FROM part WHERE p_partkey % 3 <> 0), b AS (SELECT p_brand AS name, p_size AS version FROM part WHERE p_partkey % 3 <> 1)
SELECT 'added' AS change, * FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT 'removed', * FROM (SELECT * FROM a EXCEPT SELECT * FROM b)
UNION ALL SELECT 'kept', * FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'any', * FROM (SELECT * FROM a UNION SELECT * FROM b)""")
def snapshot_changes(t: Tables) -> DataFrame:
    of = lambda left_out: t.part.filter(F.col("p_partkey") % 3 != left_out).select(F.col("p_brand").alias("name"), F.col("p_size").alias("version"))
    return records.snapshot_changes(of(0), of(1))


@query("""
SELECT e.event_id AS id, c_name AS username, CASE WHEN e.value > 100 THEN 'blocked' ELSE 'success' END AS export_status
FROM events e JOIN customer ON c_custkey = e.user_id WHERE e.event_type = 'purchase'""")
def export_log_users(t: Tables) -> DataFrame:
    logs = t.events.filter("event_type = 'purchase'").select(F.col("event_id").alias("id"), "user_id", F.when(F.col("value") > 100, "blocked").otherwise("success").alias("export_status"))
    return records.with_user(logs, t.users()).select("id", "username", "export_status")


@query("""
SELECT doc_id, (c > 0.4 AND c < 0.98) OR kind IN ('权限验证绕过', 'XSS攻击') AS needs_related FROM (SELECT doc_id, (doc_id % 11) / 10 AS c, CASE lang WHEN 'en' THEN 'SQL注入' WHEN 'fr' THEN '权限验证绕过' WHEN 'de' THEN 'XSS攻击' ELSE '其他' END AS kind FROM documents)""")
def cross_file_guards(t: Tables) -> DataFrame:
    return t.findings().select("doc_id", found.needs_related(F.col("type"), F.col("confidence")).alias("needs_related"))
