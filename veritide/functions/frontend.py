"""Pages of web front ends: how to look at them, hot spots and where input comes in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritide.functions.patterns import any_of
from veritide.functions.prefilter import bitmap, has, marked_lines

# Signs of static and of dynamic pages. They are looked for in lower-case text, so those with capitals never match.
STATIC = ["<!DOCTYPE html>", "<html>", "<head>", "<title>", "<meta", "<link", "<style>", "text-align:", "font-size:", "color:", "background:"]
DYNAMIC = [
    "<script", "javascript:", "onclick=", "onload=", "onsubmit=", "<form", "<input", "<textarea", "<select", "ajax", "fetch(", "XMLHttpRequest", "$.post", "$.get", "axios.", "document.cookie", "localStorage", "sessionStorage",
]
# Patterns of hot spots by type, in order, and the types' severities.
HOT_SPOTS = {
    "XSS_RISK": [
        r"innerHTML\s*=\s*[^;]+['\"][^'\";]*\+", r"outerHTML\s*=\s*[^;]+['\"][^'\";]*\+", r"document\.write\s*\([^)]*\+", r"eval\s*\([^)]*['\"][^'\";]*\+",
        r"setTimeout\s*\(\s*['\"][^'\";]*\+", r"setInterval\s*\(\s*['\"][^'\";]*\+",
    ],
    "SENSITIVE_INFO": [
        r"password\s*[:=]\s*['\"][^'\"]{6,}['\"]", r"api[_-]?key\s*[:=]\s*['\"][^'\"]{10,}['\"]", r"token\s*[:=]\s*['\"][^'\"]{20,}['\"]",
        r"secret\s*[:=]\s*['\"][^'\"]{8,}['\"]", r"jdbc:[^'\";]+password[=:][^'\";]+",
    ],
    "UNSAFE_EVAL": [r"eval\s*\(", r"Function\s*\(", r"setTimeout\s*\(\s*['\"][^'\";]*['\"]", r"setInterval\s*\(\s*['\"][^'\";]*['\"]"],
    "DOM_XSS": [r"location\.hash", r"location\.search", r"document\.referrer", r"window\.name", r"document\.URL"],
}
SEVERITY = {"XSS_RISK": "high", "SENSITIVE_INFO": "high", "UNSAFE_EVAL": "high", "DOM_XSS": "medium"}
# Forms, their fields, requests and URL parameters; handlers of light pages.
FORM = r"(?is)<form[^>]*action\s*=\s*['\"]([^'\"]*)['\"][^>]*method\s*=\s*['\"]([^'\"]*)['\"][^>]*>"
FIELD = r"(?i)<input[^>]*name\s*=\s*['\"]([^'\"]*)['\"][^>]*>"
REQUESTS = [
    r"\$\.post\s*\(\s*['\"]([^'\"]*)['\"]", r"\$\.get\s*\(\s*['\"]([^'\"]*)['\"]", r"fetch\s*\(\s*['\"]([^'\"]*)['\"]", r"axios\.post\s*\(\s*['\"]([^'\"]*)['\"]",
    r"XMLHttpRequest.*open\s*\(\s*['\"]([^'\"]*)['\"]\s*,\s*['\"]([^'\"]*)['\"]",
]
URL_PARAMETERS = [r"location\.search", r"location\.hash", r"window\.location\.href", r"getParameter\s*\(\s*['\"]([^'\"]*)['\"]", "URLSearchParams"]
LIGHT = ["onclick=", "onchange=", "onsubmit=", "addEventListener", "document.getElementById", "document.querySelector"]
INPUT = "array<struct<type:string,element:string,name:string,action:string,method:string>>"


def n_signs(content: Column, signs: list[str]) -> Column:
    low = F.lower(content)
    return sum((low.contains(s).cast("int") for s in signs), F.lit(0))


def is_static(content: Column) -> Column:
    """No dynamic sign; or far more static ones and fewer than three; or a large page with fewer than five."""
    static, dynamic = n_signs(content, STATIC), n_signs(content, DYNAMIC)
    return (dynamic == 0) | ((static > 0) & (static / (static + dynamic) > 0.8) & (dynamic < 3)) | ((F.char_length(content) > 5000) & (dynamic < 5))


RULES = [(t, p) for t, some in HOT_SPOTS.items() for p in some]


def hits(line: Column, bits: Column) -> Column:
    """How often each pattern matches in a line that has its bit."""
    return F.array(*(F.when(has(bits, i), F.regexp_count(line, F.lit(f"(?i){p}"))).otherwise(0) for i, (_, p) in enumerate(RULES)))


def n_hot_spots(content: Column) -> Column:
    """Matches of all patterns; none of them spans lines."""
    marked = lambda line: F.transform(F.array(F.lower(line)), lambda low: F.struct(line.alias("line"), bitmap(low, [p for _, p in RULES]).alias("bits")))
    lines = F.filter(F.flatten(F.transform(F.split(content, "\n"), marked)), lambda x: x["bits"] != 0)
    return F.aggregate(lines, F.lit(0), lambda n, x: n + F.aggregate(hits(x["line"], x["bits"]), F.lit(0), lambda a, k: a + k))


def hot_spots(pages: DataFrame, key: str, content: str = "content") -> DataFrame:
    """A row for each match: type, severity, line number, snippet and pattern."""
    lines = marked_lines(pages, key, F.col(content), [p for _, p in RULES]).withColumnRenamed("text", "line")
    found = lines.select(key, "at", "line", F.posexplode(hits(F.col("line"), F.col("bits"))).alias("rule", "n")).filter("n > 0")
    of_rule = F.array(*(F.struct(F.lit(t).alias("type"), F.lit(SEVERITY[t]).alias("severity"), F.lit(p).alias("pattern")) for t, p in RULES))
    r = F.get(of_rule, F.col("rule"))
    return found.select(key, (F.col("at") + 1).alias("line_number"), F.trim("line").alias("code_snippet"), r["type"].alias("type"), r["severity"].alias("severity"), r["pattern"].alias("pattern"), F.explode(F.sequence(F.lit(1), F.col("n"))).alias("nth"))


def form_inputs(content: Column) -> Column:
    """Named fields of forms whose action stands before their method, up to ``</form>``."""
    after = F.transform(F.slice(F.split(F.regexp_replace(content, FORM, "\x01$0\x02"), "\x01"), 2, 1_000_000), lambda p: F.split(p, "\x02", 2))

    def fields(part: Column) -> Column:
        head, body = F.get(part, F.lit(0)), F.element_at(F.split(F.coalesce(F.get(part, F.lit(1)), F.lit("")), "</form>", 2), 1)
        named = F.regexp_extract_all(body, F.lit(FIELD), F.lit(0))
        point = lambda e: F.struct(F.lit("form").alias("type"), e.alias("element"), F.regexp_extract(e, FIELD, 1).alias("name"), F.regexp_extract(head, FORM, 1).alias("action"), F.regexp_extract(head, FORM, 2).alias("method"))
        return F.transform(named, point)

    return F.flatten(F.transform(after, fields)).cast(INPUT)


def scripted_inputs(content: Column) -> Column:
    """Requests and URL parameters, by pattern, each in order of occurrence."""

    def of(kind: str, pattern: str) -> Column:
        flagged, grouped = f"(?i){pattern}", "(" in pattern.replace(r"\(", "")
        first = lambda e: F.regexp_extract(e, flagged, 1) if grouped else F.lit(None).cast("string")
        name = (lambda e: F.lit("ajax_request")) if kind == "ajax" else (lambda e: F.coalesce(first(e), F.lit("url_parameter")))
        action = first if kind == "ajax" else (lambda e: F.lit(None).cast("string"))
        found = F.regexp_extract_all(content, F.lit(flagged), F.lit(0))
        return F.transform(found, lambda e: F.struct(F.lit(kind).alias("type"), e.alias("element"), name(e).alias("name"), action(e).alias("action"), F.lit(None).cast("string").alias("method"))).cast(INPUT)

    return F.concat(*(of("ajax", p) for p in REQUESTS), *(of("url_param", p) for p in URL_PARAMETERS))


def strategy(pages: DataFrame, content: str = "content") -> DataFrame:
    """Pages with inputs, number of hot spots, analysis_type, should_skip and the time that saves."""
    text = F.coalesce(F.col(content), F.lit(""))
    rows = pages.withColumns({"input_points": F.concat(form_inputs(text), scripted_inputs(text)), "n_hotspots": n_hot_spots(text), "_static": is_static(text)})
    seconds = F.greatest(F.lit(1.0), F.char_length(text) / 1000)
    light = any_of([text.contains(x) for x in LIGHT])
    kind = F.when(F.col("_static"), "static").when(F.col("n_hotspots") > 0, "hotspot").when(F.size("input_points") > 0, "input_extraction").when(light, "light").otherwise("no_risk")
    rows = rows.withColumn("analysis_type", kind)
    saved = F.when(F.col("analysis_type").isin("static", "no_risk"), seconds).when(F.col("analysis_type") == "input_extraction", seconds * 0.7).when(F.col("analysis_type") == "light", seconds * 0.5).otherwise(0.0)
    return rows.withColumns({"should_skip": F.col("analysis_type").isin("static", "no_risk"), "estimated_time_saved": saved}).drop("_static")
