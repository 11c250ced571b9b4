"""Files, pages, findings and their scores over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritide.functions import confidence, detection, false_positives, frontend, languages
from veritide.operators import findings as found
from veritide.plans.registry import Tables, query
from veritide.scratch import new_path
from veritide.sources import files as sources
from veritide.sources import tables
from veritide.sources.cache import ResponseCache

PATH = "regexp_extract(url, '^[a-z]+://[^/]+/([^?#]*)', 1)"
FINDINGS = """
SELECT doc_id, 'src/' || source || '.java' AS file, CASE lang WHEN 'en' THEN 'SQL注入' WHEN 'fr' THEN '权限验证绕过' WHEN 'de' THEN 'XSS攻击' ELSE '其他' END AS type,
 array_to_string(string_split(text, chr(10))[1:3], chr(10)) AS snippet, CASE doc_id % 3 WHEN 0 THEN 'dao' WHEN 1 THEN 'entity' ELSE 'unknown' END AS layer, string_split(text, chr(10))[1] AS description, (doc_id % 11) / 10 AS confidence FROM documents"""
COUNT = "((length(snippet) - length(replace(snippet, '{0}', ''))) // {1})"
SCORE = f"""
WITH f AS ({FINDINGS}), b AS (SELECT *, ({' + '.join(COUNT.format(w, len(w)) + ' * 0.1::DOUBLE' for w in confidence.BRANCHING)}) AS branching, len(string_split(snippet, chr(10))) AS n FROM f),
s AS (SELECT doc_id, greatest(0.1::DOUBLE, least(1::DOUBLE, 1::DOUBLE * 0.25::DOUBLE + (CASE WHEN layer = 'dao' AND contains(type, '权限') THEN 0.2::DOUBLE WHEN layer = 'entity' AND contains(type, 'SQL注入') THEN 0.3::DOUBLE ELSE 1::DOUBLE END) * 0.20::DOUBLE
 + (CASE WHEN n < 3 THEN 0.8::DOUBLE ELSE 1::DOUBLE END) * (CASE WHEN branching < 0.2::DOUBLE THEN 0.9::DOUBLE ELSE 1::DOUBLE END) * 0.15::DOUBLE + 1::DOUBLE * 0.20::DOUBLE + 0.9::DOUBLE * 0.9::DOUBLE * 0.95::DOUBLE * 0.10::DOUBLE
 + (CASE type WHEN 'SQL注入' THEN 1 - 0.85::DOUBLE * 0.5::DOUBLE WHEN '权限验证绕过' THEN 1 - 0.75::DOUBLE * 0.5::DOUBLE WHEN 'XSS攻击' THEN 1 - 0.6::DOUBLE * 0.5::DOUBLE ELSE 1::DOUBLE END) * 0.10::DOUBLE)) AS c FROM b)"""
LEVEL = "CASE WHEN c >= 0.8 THEN 'high' WHEN c >= 0.6 THEN 'medium' WHEN c >= 0.4 THEN 'low' ELSE 'very_low' END"


@query("SELECT doc_id, sha256(text) AS hash, n_chars AS size FROM documents")
def content_hash(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", sources.content_hash(F.col("text")).alias("hash"), F.col("n_chars").alias("size"))


@query("SELECT doc_id, md5(text || '|owasp|' || coalesce(lang, '')) AS key FROM documents")
def cache_key_md5(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", tables.cache_key(F.col("text"), F.lit("owasp"), F.col("lang")).alias("key"))


@query("SELECT md5(text) AS key, count(*) AS n FROM documents WHERE md5(text) NOT IN (SELECT md5(text) FROM documents WHERE doc_id % 4 = 0) GROUP BY 1")
def cache_lookup_miss(t: Tables) -> DataFrame:
    keyed = t.documents.select("doc_id", F.md5(F.col("text").cast("binary")).alias("key"))
    cache = keyed.filter("doc_id % 4 = 0").select("key", F.lit("answer").alias("response"), F.lit("2024-01-01 12:00:00").cast("timestamp_ntz").alias("cached_at"))
    _, misses = tables.from_cache(keyed.select("key"), cache, "2024-01-02 00:00:00")
    return misses.groupBy("key").agg(F.count("*").alias("n"))


# Three batches, the second one twice; then what has expired goes.
@query("""
WITH e AS (SELECT md5(text) AS key, lang || ' ' || doc_id AS response, TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 HOUR * (doc_id % 48) AS cached_at, doc_id % 3 AS batch FROM documents),
n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY cached_at DESC, batch DESC, response DESC) AS r FROM e)
SELECT key, response, strftime(cached_at, '%Y-%m-%d %H:%M:%S') AS cached_at FROM n WHERE r = 1 AND cached_at + INTERVAL 24 HOURS >= TIMESTAMP '2024-01-02 12:00:00'""")
def cache_after_batches(t: Tables) -> DataFrame:
    at = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_interval(hours=(F.col("doc_id") % 48).cast("int"))
    entries = t.documents.select((F.col("doc_id") % 3).alias("batch"), F.md5(F.col("text").cast("binary")).alias("key"), F.concat("lang", F.lit(" "), F.col("doc_id").cast("string")).alias("response"), at.alias("cached_at"))
    cache = ResponseCache(t.spark, new_path(t.spark, "cache"))
    for batch in (0, 1, 1, 2):
        cache.put(entries.filter(F.col("batch") == batch), batch)
    cache.expire("2024-01-02 12:00:00")
    return cache.read().withColumn("cached_at", F.date_format("cached_at", "yyyy-MM-dd HH:mm:ss"))


@query(f"SELECT page_id, lower(regexp_extract(regexp_extract({PATH}, '[^/]*$'), '^.+([.][^.]+)$', 1)) AS ext FROM pages WHERE lower(regexp_extract(regexp_extract({PATH}, '[^/]*$'), '^.+([.][^.]+)$', 1)) <> '.html'")
def file_ext_filter(t: Tables) -> DataFrame:
    rows = sources.described(t.pages_with_path())
    return rows.filter(sources.extension_ok(F.col("name"), (), ("html",))).select("page_id", "ext")


@query(f"SELECT page_id FROM pages WHERE contains(trim({PATH}, '/'), 'en') AND NOT contains(trim({PATH}, '/'), '7')")
def path_filter(t: Tables) -> DataFrame:
    return t.pages_with_path().filter(sources.path_ok(F.col("path"), ("en",), ("7",))).select("page_id")


@query(f"SELECT page_id FROM pages WHERE NOT (regexp_full_match({PATH}, '.*[.]html') OR list_contains(string_split({PATH}, '/'), 'de'))")
def glob_ignore(t: Tables) -> DataFrame:
    from veritide.functions.patterns import ignored_by_globs

    return t.pages_with_path().filter(~ignored_by_globs(F.col("path"), ["*.html", "de"])).select("page_id")


DECISION = f"""
WITH p AS (SELECT page_id, {PATH} AS path, regexp_extract({PATH}, '[^/]*$') AS name, length(html) AS size, lower(array_to_string(string_split(html, chr(10))[1:10], chr(10))) AS head FROM pages),
d AS (SELECT page_id, CASE WHEN ends_with(path, '.env') THEN 'force_included' WHEN starts_with(path, 'es/') OR path = 'es' THEN 'ignore_pattern' WHEN size > 20000 THEN 'too_large' WHEN ends_with(path, '.html') THEN 'doc_file' WHEN contains(head, 'react') OR contains(head, 'vue') THEN 'library_file' ELSE 'included' END AS reason FROM p)"""


@query(DECISION + " SELECT page_id, reason, reason IN ('force_included', 'included') AS included FROM d")
def include_decision(t: Tables) -> DataFrame:
    return decisions(t).select("page_id", "reason", "included")


def decisions(t: Tables) -> DataFrame:
    by = sources.Filtering(force_include=("*.env",), ignore=("es/",), max_size=20_000, css_files=False, js_files=False, test_files=False, log_files=False, doc_files=True, doc=("*.html",), library_keywords=("React", "Vue"))
    rows = t.pages_with_path().withColumns({"size": F.char_length("html"), "content": F.col("html")})
    return sources.decided(rows, by)


@query(DECISION + """
 SELECT count(*) AS total_files, count(*) FILTER (reason IN ('force_included', 'included')) AS included_files, count(*) FILTER (reason NOT IN ('force_included', 'included')) AS filtered_files,
 count(*) FILTER (reason = 'ignore_pattern') AS filtered_by_pattern, count(*) FILTER (reason = 'too_large') AS filtered_by_size, count(*) FILTER (reason = 'gitignore') AS filtered_by_gitignore,
 count(*) FILTER (reason = 'library_file') AS filtered_by_library, count(*) FILTER (reason = 'force_included') AS force_included, round(100.0 * count(*) FILTER (reason NOT IN ('force_included', 'included')) / count(*), 1) AS efficiency FROM d""")
def filter_stats(t: Tables) -> DataFrame:
    return sources.filter_stats(decisions(t))


def sql_signs(signs: list[str]) -> str:
    quoted = [s.replace("'", "''") for s in signs]
    return " + ".join(f"contains(lower(html), '{s}')::INT" for s in quoted)


def sql_hits() -> str:
    patterns = [p.replace("'", "''") for some in frontend.HOT_SPOTS.values() for p in some]
    return " + ".join(f"len(regexp_extract_all(x, '{p}', 0, 'i'))" for p in patterns)


@query(f"""
WITH s AS (SELECT page_id, html, {sql_signs(frontend.STATIC)} AS st, {sql_signs(frontend.DYNAMIC)} AS dy FROM pages),
k AS (SELECT *, dy = 0 OR (st > 0 AND st / (st + dy) > 0.8 AND dy < 3) OR (length(html) > 5000 AND dy < 5) AS static,
 list_sum(list_transform(string_split(html, chr(10)), lambda x: {sql_hits()}))::INT AS hot, regexp_matches(html, '<form|[$][.](post|get)|fetch[(]|axios|XMLHttpRequest|location[.]|getParameter|URLSearchParams') AS inp,
 regexp_matches(html, 'onclick=|onchange=|onsubmit=|addEventListener|document[.]getElementById|document[.]querySelector') AS light FROM s),
a AS (SELECT *, CASE WHEN static THEN 'static' WHEN hot > 0 THEN 'hotspot' WHEN inp THEN 'input_extraction' WHEN light THEN 'light' ELSE 'no_risk' END AS analysis_type FROM k)
SELECT page_id, hot AS n_hotspots, analysis_type, analysis_type IN ('static', 'no_risk') AS should_skip,
 round(CASE WHEN analysis_type IN ('static', 'no_risk') THEN greatest(1, length(html) / 1000) WHEN analysis_type = 'input_extraction' THEN greatest(1, length(html) / 1000) * 0.7 WHEN analysis_type = 'light' THEN greatest(1, length(html) / 1000) * 0.5 ELSE 0 END, 6)::DOUBLE AS estimated_time_saved FROM a""")
def frontend_strategy(t: Tables) -> DataFrame:
    rows = frontend.strategy(t.pages.select("page_id", F.col("html").alias("content")))
    return rows.select("page_id", "n_hotspots", "analysis_type", "should_skip", F.round("estimated_time_saved", 6).alias("estimated_time_saved"))


# A line of code for each pattern of hot spots, one of which goes before each document's text.
HOT_LINES = [
    "a.innerHTML = 'x' + y;", "a.outerHTML = 'x' + y;", "document.write(a + b)", "eval('f' + x)", "setTimeout('f' + x)", "setInterval('f' + x)", "password = 'abcdef1'", "api_key: '0123456789ab'",
    "token = 'abcdefghijklmnopqrstuv'", "secret = 'abcdefgh9'", "jdbc:mysql://h?password=xyz", "eval (x)", "new Function (x)", "setTimeout('f()', 3)", "setInterval('f()', 3)", "location.hash", "location.search", "document.referrer", "window.name", "document.URL",
]


def sql_texts(some: list[str]) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in some) + "]"


def with_line(rows: DataFrame, number: Column, lines: list[str], text: Column) -> DataFrame:
    """``content``: the line of this number, then the text."""
    line = F.element_at(F.array(*map(F.lit, lines)), (number % len(lines) + 1).cast("int"))
    return rows.withColumn("content", F.concat(line, F.lit("\n"), text))


def sql_patterns(rows: list[tuple[str, str, str]]) -> str:
    return ", ".join("('{}', '{}', '{}')".format(*(x.replace("'", "''") for x in r)) for r in rows)


def sql_lines(key: str, lines: list[str]) -> str:
    content = f"{sql_texts(lines)}[1 + {key} % {len(lines)}] || chr(10) || text"
    return f"SELECT {key}, unnest(string_split({content}, chr(10))) AS line, unnest(range(len(string_split({content}, chr(10))))) + 1 AS line_number FROM documents"


HOT_ROWS = [(kind, frontend.SEVERITY[kind], p) for kind, some in frontend.HOT_SPOTS.items() for p in some]


# DuckDB takes constant patterns only, so each has a branch of its own over the lines.
@query(f"WITH l AS ({sql_lines('doc_id', HOT_LINES)}), m AS (" + " UNION ALL ".join(f"SELECT doc_id, line_number, {i} AS i, len(regexp_extract_all(line, '{p.replace(chr(39), chr(39) * 2)}', 0, 'i')) AS n FROM l" for i, (*_, p) in enumerate(HOT_ROWS)) + f""")
SELECT doc_id, line_number::INT AS line_number, r.type, r.severity, r.pattern, sum(n)::BIGINT AS n FROM m JOIN (SELECT *, row_number() OVER () - 1 AS i FROM (VALUES {sql_patterns(HOT_ROWS)}) AS r(type, severity, pattern)) r USING (i) WHERE n > 0 GROUP BY ALL""")
def hotspots(t: Tables) -> DataFrame:
    rows = frontend.hot_spots(with_line(t.documents, F.col("doc_id"), HOT_LINES, F.col("text")), "doc_id")
    return rows.groupBy("doc_id", "line_number", "type", "severity", "pattern").agg(F.count("*").alias("n"))


@query(f"""
SELECT page_id, CASE WHEN ends_with(lower({PATH}), '.html') THEN 'html' END AS language, CASE WHEN regexp_matches(lower({PATH}), 'controller|rest|api|endpoint') THEN 'controller' WHEN regexp_matches(lower({PATH}), 'service|business|logic') THEN 'service'
 WHEN regexp_matches(lower({PATH}), 'dao|repository|mapper|model') THEN 'dao' WHEN regexp_matches(lower({PATH}), 'entity|domain|pojo') THEN 'entity' WHEN contains(lower({PATH}), 'config') THEN 'config' ELSE 'unknown' END AS layer FROM pages""")
def language_and_layer(t: Tables) -> DataFrame:
    rows = sources.described(t.pages_with_path())
    return rows.select("page_id", "language", languages.layer(F.col("path")).alias("layer"))


def sql_content_hits() -> str:
    one = lambda p: f"len(regexp_extract_all(t, '{p.replace(chr(39), chr(39) * 2)}', 0, 'im'))"
    return ", ".join(f"{{'n': {' + '.join(map(one, ps))}, 'o': {-i}, 'lang': '{lang}'}}" for i, (lang, ps) in enumerate(languages.CONTENT.items()))


CODE_LINES = [
    "import os\ndef main (x)", "function f(a) { var b = 1; let c = 2 }", "package main\nfunc main() ", "interface A\ntype B = string", "public class A\nprivate int b", "fn main() { let x = 1 }\nuse std", "#include <a.h>\nint main (", "using System\nnamespace A",
    "<?php\n$a = 1\necho 2", "def f\nputs 1\nend", "fun f(x)\nval y = 1", "import UIKit\nlet x = 1\nfunc g(", "object A\nval b = 1\nvar c = 2", "",
]


@query(rf"""
WITH p AS (SELECT doc_id, substr({sql_texts(CODE_LINES).replace("{", "{{").replace("}", "}}").replace(chr(10), "' || chr(10) || '")}[1 + doc_id % {len(CODE_LINES)}] || chr(10) || text, 1, 10240) AS t FROM documents),
h AS (SELECT doc_id, list_max([{sql_content_hits()}]) AS best FROM p) SELECT doc_id, CASE WHEN best.n >= 2 THEN best.lang END AS language FROM h""".replace("{{", "{").replace("}}", "}"))
def language_by_content(t: Tables) -> DataFrame:
    """Over the whole documents, code of each language in front of them; the first 10,240 characters count, as a feature."""
    rows = with_line(t.documents, F.col("doc_id"), CODE_LINES, F.col("text"))
    return rows.select("doc_id", languages.by_content(F.col("content")).alias("language"))


@query("SELECT sum(greatest(1, n_chars // 50))::BIGINT AS total_lines FROM documents WHERE lang IS NOT NULL AND n_chars > 0")
def estimated_lines(t: Tables) -> DataFrame:
    return sources.estimated_lines(t.documents.select(F.col("lang").alias("language"), F.col("n_chars").alias("size")))


@query("""
SELECT source AS project_id, count(*) AS n_files, sum(n_chars)::BIGINT AS size, sum(CASE WHEN n_chars > 0 THEN greatest(1, n_chars // 50) END)::BIGINT AS total_lines, string_agg(DISTINCT CASE lang WHEN 'en' THEN 'python' WHEN 'fr' THEN 'go' WHEN 'de' THEN 'java' END, ',' ORDER BY CASE lang WHEN 'en' THEN 'python' WHEN 'fr' THEN 'go' WHEN 'de' THEN 'java' END) AS languages
FROM documents GROUP BY 1""")
def project_summary(t: Tables) -> DataFrame:
    from veritide.operators.projects import summary

    lang = F.when(F.col("lang") == "en", "python").when(F.col("lang") == "fr", "go").when(F.col("lang") == "de", "java").otherwise("es")
    rows = summary(t.documents.select(F.col("source").alias("project_id"), F.col("n_chars").alias("size"), lang.alias("language")))
    return rows.withColumn("languages", F.array_join("languages", ","))


@query(SCORE + f" SELECT doc_id, round(c, 9) AS confidence, {LEVEL} AS risk_level FROM s")
def confidence_score(t: Tables) -> DataFrame:
    rows = confidence.scored(t.findings().drop("confidence"))
    return rows.select("doc_id", F.round("confidence", 9).alias("confidence"), "risk_level")


@query(SCORE + f" SELECT {LEVEL} AS risk_level, count(*) AS n FROM s GROUP BY 1")
def risk_buckets(t: Tables) -> DataFrame:
    return confidence.scored(t.findings().drop("confidence")).groupBy("risk_level").agg(F.count("*").alias("n"))


@query("""
WITH s AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '.findOne( id )' WHEN 1 THEN 'x = 1' ELSE '@GetMapping' END AS snippet, CASE WHEN doc_id % 2 = 0 THEN 'SQL注入漏洞' ELSE '权限验证绕过' END AS type, (doc_id % 11) / 10 AS confidence, 'low' AS severity FROM documents)
SELECT doc_id, CASE WHEN type = 'SQL注入漏洞' AND snippet = '.findOne( id )' AND confidence <= 0.7 THEN 'jpa_safe_methods' WHEN type = '权限验证绕过' AND snippet = '@GetMapping' AND confidence <= 0.6 THEN 'spring_mvc_annotations' WHEN confidence < 0.4 THEN 'low_confidence'
 WHEN type = 'SQL注入漏洞' AND snippet = '.findOne( id )' AND confidence <= 0.8 THEN 'jpa_findone_safe' WHEN type = 'SQL注入漏洞' AND snippet = '.findOne( id )' THEN 'framework' END AS drop_reason FROM s""")
def false_positive_reasons(t: Tables) -> DataFrame:
    snippet = F.when(F.col("doc_id") % 3 == 0, ".findOne( id )").when(F.col("doc_id") % 3 == 1, "x = 1").otherwise("@GetMapping")
    kind = F.when(F.col("doc_id") % 2 == 0, "SQL注入漏洞").otherwise("权限验证绕过")
    rows = t.findings().select("doc_id", snippet.alias("code_snippet"), kind.alias("type"), F.lit("x").alias("description"), F.lit("a\nb\nc").alias("code"), F.lit("src/A.java").alias("file"), "confidence", F.lit("low").alias("severity"), F.lit(2).alias("line"), F.lit("java").alias("language"))
    return false_positives.with_drop_reasons(rows).select("doc_id", "drop_reason")


@query(f"""
WITH f AS ({FINDINGS}), r AS (SELECT file, type, sum(CASE WHEN type = 'SQL注入' THEN 0.2::DOUBLE ELSE -0.1::DOUBLE END) AS change FROM (SELECT DISTINCT file, type FROM f) GROUP BY 1, 2),
j AS (SELECT doc_id, f.confidence, CASE WHEN f.confidence > 0.99::DOUBLE THEN f.confidence ELSE greatest(0.1::DOUBLE, least(1::DOUBLE, f.confidence + r.change)) END AS a FROM f JOIN r USING (file, type))
SELECT doc_id, round(a, 6) AS adjusted_confidence, CASE WHEN a > confidence + 0.1::DOUBLE THEN 'up' WHEN a < confidence - 0.1::DOUBLE THEN 'down' ELSE 'same' END AS verdict FROM j""")
def cross_file_adjust(t: Tables) -> DataFrame:
    rows = t.findings().withColumn("path", F.col("file"))
    other = F.when(F.col("type") == "SQL注入", F.col("type")).otherwise("另一类")
    related = rows.select("path", "type").distinct().select("path", "type", other.alias("found_type"), F.lit("已有安全验证").alias("found_description"))
    out = found.adjusted(rows, related)
    verdict = F.when(F.col("recommendation").contains("增加"), "up").when(F.col("recommendation").contains("降低"), "down").otherwise("same")
    return out.select("doc_id", F.round("adjusted_confidence", 6).alias("adjusted_confidence"), verdict.alias("verdict"))


@query("""
WITH c AS (SELECT 'a/f' || lpad(doc_id::VARCHAR, 7, '0') || '.py' AS caller, substr(text, 1, 10240) AS head FROM documents WHERE n_chars <= 512000 ORDER BY 1 LIMIT 100),
p AS (SELECT 'b/' || word || '.txt' AS path, unnest([word, word || '.txt']) AS pattern FROM (SELECT DISTINCT split_part(trim(text), ' ', 1) AS word FROM benchmark) WHERE regexp_full_match(word, '[A-Za-z]+')),
h AS (SELECT path, caller, pattern, row_number() OVER (PARTITION BY path, pattern ORDER BY caller) AS n FROM p JOIN c ON contains(head, pattern)) SELECT path, caller, pattern FROM h WHERE n <= 5""")
def caller_edges(t: Tables) -> DataFrame:
    docs = t.documents.select(F.concat(F.lit("a/f"), F.lpad(F.col("doc_id").cast("string"), 7, "0"), F.lit(".py")).alias("path"), F.col("text").alias("content"), F.col("n_chars").alias("size"))
    word = F.element_at(F.split(F.trim("text"), " "), 1)
    names = t.benchmark.select(word.alias("word")).distinct().filter(F.col("word").rlike("^[A-Za-z]+$")).select(F.concat(F.lit("b/"), "word", F.lit(".txt")).alias("path"), F.lit("").alias("content"), F.lit(1).cast("long").alias("size"))
    return found.caller_edges(docs.unionByName(names)).filter(F.col("path").startswith("b/")).select("path", "caller", "pattern")


# Every document is searched whole for every document's first word, as stem and as file name.
@query("""
WITH c AS (SELECT 'a/f' || lpad(doc_id::VARCHAR, 7, '0') || '.py' AS caller, text FROM documents WHERE n_chars <= 512000),
p AS (SELECT 'b/' || word || '.txt' AS path, unnest([word, word || '.txt']) AS pattern FROM (SELECT DISTINCT split_part(trim(text), ' ', 1) AS word FROM documents) WHERE regexp_full_match(word, '[A-Za-z]+')),
h AS (SELECT path, caller, pattern, row_number() OVER (PARTITION BY path, pattern ORDER BY caller) AS n FROM p JOIN c ON contains(text, pattern)) SELECT path, caller, pattern FROM h WHERE n <= 5""")
def caller_edges_all(t: Tables) -> DataFrame:
    docs = t.documents.select(F.concat(F.lit("a/f"), F.lpad(F.col("doc_id").cast("string"), 7, "0"), F.lit(".py")).alias("path"), F.col("text").alias("content"), F.col("n_chars").alias("size"))
    word = F.element_at(F.split(F.trim("text"), " "), 1)
    names = t.documents.select(word.alias("word")).distinct().filter(F.col("word").rlike("^[A-Za-z]+$")).select(F.concat(F.lit("b/"), "word", F.lit(".txt")).alias("path"), F.lit("").alias("content"), F.lit(1).cast("long").alias("size"))
    return found.caller_edges(docs.unionByName(names), mode="all", read=None, called=names).select("path", "caller", "pattern")


@query("SELECT doc_id, (length(text) // 4)::BIGINT AS tokens, length(CASE WHEN length(text) > 2000 THEN substr(text, 1, 2000) || chr(10) || '... (truncated)' ELSE text END)::INT AS shown FROM documents")
def token_estimate(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", detection.token_estimate(F.col("text")).alias("tokens"), F.char_length(detection.truncated(F.col("text"))).alias("shown"))


@query("""
SELECT event_id, event_type AS type, CASE WHEN (props->>'$.k')::INT % 2 = 0 THEN 'high' ELSE 'medium' END AS severity, (props->>'$.k')::INT AS line FROM events WHERE user_id % 2 = 0
UNION ALL SELECT event_id, 'security_issue', 'medium', 0 FROM events WHERE user_id % 2 = 1 AND user_id % 3 = 0""")
def response_parse(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    item = F.to_json(F.struct(F.col("event_type").alias("type"), F.when(k % 2 == 0, "high").alias("severity"), k.alias("line")))
    fenced = F.concat(F.lit("Here:\n```json\n{\"findings\": ["), item, F.lit("]}\n```\n"))
    plain = F.when(F.col("user_id") % 3 == 0, F.lit("text\n发现XSS漏洞 here\nend")).otherwise(F.lit("nothing to report"))
    rows = t.events.select(F.col("event_id").cast("string").alias("file"), F.lit("python").alias("language"), F.when(F.col("user_id") % 2 == 0, fenced).otherwise(plain).alias("response"))
    return found.parsed(rows).select(F.col("file").cast("long").alias("event_id"), "type", "severity", "line")


@query(f"""
WITH f AS ({FINDINGS}), s AS (SELECT f.doc_id, file, type, (f.doc_id % 50 + 1)::INT AS line, CASE WHEN n_chars > 4000 THEN 'high' WHEN n_chars > 1000 THEN 'medium' WHEN n_chars > 200 THEN 'low' ELSE 'info' END AS severity FROM f JOIN documents d USING (doc_id))
SELECT 0 AS section, '' AS file, 0 AS number, '- ' || severity || ': ' || count(*) AS text FROM s GROUP BY severity
UNION ALL SELECT 1, file, n::INT, n || '. [' || severity || '] ' || type || ' (line ' || line || ')' FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY line, type, severity, doc_id) AS n FROM s)""")
def markdown_report_rows(t: Tables) -> DataFrame:
    return tables.report_lines(t.findings(), "doc_id")


# A line of code for most patterns of the families.
FAMILY_LINES = [
    "if step == 3:", "state = 'open'", "workflow[x] = 1", "process_step (a)", "validate_step(a)", "skip_step(a)", "session['u'] = x.user", "state = request.args", "status = read_input", "role = form.get(x)", "permission = the_user",
    "render_template_string(a)", "Template('{a}')", "format(a, user.b)", "'a'.format(request.args)", "x % (user.a)", "f'a {b.user} c'", "pickle.loads(a)", "yaml.load(a)", "json.loads(user)", "marshal.load(a)", "eval(user)", "exec(user)", "__import__(user)",
    "threading.Thread", "multiprocessing.Pool", "async def f", "await g()", "lock = a", "with my_lock", "time.sleep(1)", "check it then use it", "hashlib.md5(a)", "hashlib.sha1 (a)", "random.random()", "time.time()", "DES(a)", "RC4(a)", "ECB mode", "key = 'k'", "iv = 'v'", "salt = 's'",
    "session_id = the_user", "cookie[a] = user", "session.permanent = True", "remember_me = True", "session_timeout = None", "secure = False", "httponly = False", "nothing at all",
]
FAMILY_ROWS = [(family, severity, p) for family, (severity, patterns) in detection.FAMILIES.items() for p in patterns]
FAMILY_BASE = {family: round(0.7 + 0.1 * (len(patterns) > 3) + 0.1 * (severity == "critical"), 9) for family, (severity, patterns) in detection.FAMILIES.items()}


@query(f"WITH l AS ({sql_lines('doc_id', FAMILY_LINES)}), m AS (" + " UNION ALL ".join(
    f"SELECT doc_id, line_number, '{family}' AS type, '{severity}' AS severity, {FAMILY_BASE[family]}::DOUBLE AS base, unnest(regexp_extract_all(line, '{p.replace(chr(39), chr(39) * 2)}', 0, 'i')) AS code FROM l" for family, severity, p in FAMILY_ROWS) + """)
SELECT doc_id, line_number::INT AS line, type, severity, code, round(least(1::DOUBLE, base + CASE WHEN length(code) > 20 THEN 0.1::DOUBLE ELSE 0 END), 6) AS confidence FROM m""")
def advanced_patterns(t: Tables) -> DataFrame:
    rows = detection.findings(with_line(t.documents, F.col("doc_id"), FAMILY_LINES, F.col("text")), "doc_id")
    return rows.withColumn("confidence", F.round("confidence", 6))


@query("""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls, (doc_id % 7 + 1)::INT AS n FROM documents) SELECT doc_id, md5(CASE WHEN n <= len(ls) THEN array_to_string(ls[greatest(n - 3, 1):least(n + 3, len(ls))], chr(10)) END) AS context FROM l""")
def context_window(t: Tables) -> DataFrame:
    context = false_positives.context_lines(F.col("text"), (F.col("doc_id") % 7 + 1).cast("int"))
    return t.documents.select("doc_id", F.md5(context.cast("binary")).alias("context"))


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10)))))::INT AS pos FROM documents),
h AS (SELECT *, max((contains(lower(line), 'license') OR contains(lower(line), 'reserved'))::INT) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS hit FROM l),
k AS (SELECT doc_id, pos, pos - lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS d FROM h WHERE hit = 1) SELECT doc_id, pos + 1 AS line, coalesce(d > 1, false) AS gap FROM k""")
def keyword_context(t: Tables) -> DataFrame:
    rows = detection.keyword_context(t.documents.select("doc_id", F.col("text").alias("content")), ["license", "reserved"], "doc_id")
    return rows.select("doc_id", "line", "gap")


@query(f"""
SELECT page_id, (CASE WHEN regexp_matches(lower(regexp_extract({PATH}, '[^/]*$')), 'auth|login|admin|user|security|api|controller') THEN 10 ELSE 0 END + CASE WHEN regexp_matches(lower({PATH}), 'api|controller|service|handler') THEN 5 ELSE 0 END - CASE WHEN regexp_matches(lower(regexp_extract({PATH}, '[^/]*$')), 'test|spec') THEN 5 ELSE 0 END)::INT AS priority,
 CASE WHEN length(html) > 1048576 THEN 'too_large' WHEN regexp_matches(lower(regexp_extract({PATH}, '[^/]*$')), 'test|spec|mock') THEN 'test' END AS skip_reason FROM pages""")
def file_priority(t: Tables) -> DataFrame:
    rows = sources.described(t.pages_with_path())
    return rows.select("page_id", detection.priority(F.col("path"), F.coalesce("language", F.lit(""))).alias("priority"), detection.skip_reason(F.col("name"), F.char_length("html")).alias("skip_reason"))
