"""Deterministic findings from code: pattern families, line numbers, snippets, hints, priorities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritide.functions.patterns import any_of, name_of, suffix_of
from veritide.functions.prefilter import has, marked_lines

# Families of patterns with their severities.
FAMILIES = {
    "workflow_bypass": ("high", [r"if\s+step\s*==\s*\d+\s*:", r"state\s*=\s*['\"].*['\"]", r"workflow\[.*\]\s*=", r"process_step\s*\(", r"validate_step\s*\(", r"skip_step\s*\("]),
    "state_manipulation": ("critical", [r"session\[.*\]\s*=.*user", r"state\s*=\s*request\.", r"status\s*=\s*.*input", r"role\s*=\s*.*get\(", r"permission\s*=\s*.*user"]),
    "template_injection": ("critical", [r"render_template_string\s*\(", r"Template\s*\(.*\{.*\}", r"format\s*\(.*user.*\)", r"\.format\s*\(.*request\.", r"%\s*\(.*user.*\)", r"f['\"].*\{.*user.*\}"]),
    "deserialization": ("critical", [r"pickle\.loads?\s*\(", r"yaml\.load\s*\(", r"json\.loads?\s*\(.*user", r"marshal\.loads?\s*\(", r"eval\s*\(.*user", r"exec\s*\(.*user", r"__import__\s*\(.*user"]),
    "race_conditions": ("high", [r"threading\.", r"multiprocessing\.", r"async\s+def", r"await\s+", r"lock\s*=", r"with\s+.*lock", r"time\.sleep\s*\(", r"check.*then.*use"]),
    "crypto_flaws": ("high", [r"hashlib\.md5\s*\(", r"hashlib\.sha1\s*\(", r"random\.random\s*\(", r"time\.time\s*\(\)", r"DES\s*\(", r"RC4\s*\(", r"ECB\s*mode", r"key\s*=\s*['\"].*['\"]", r"iv\s*=\s*['\"].*['\"]", r"salt\s*=\s*['\"].*['\"]"]),
    "session_flaws": ("medium", [r"session_id\s*=\s*.*user", r"cookie\[.*\]\s*=.*user", r"session\.permanent\s*=\s*True", r"remember_me\s*=\s*True", r"session_timeout\s*=\s*None", r"secure\s*=\s*False", r"httponly\s*=\s*False"]),
}
# Groups of business logic; the third is known but not looked for.
BUSINESS = {
    "price_manipulation": [r"price\s*=\s*.*request\.", r"amount\s*=\s*.*user", r"total\s*=\s*.*input", r"discount\s*=\s*.*get\(", r"quantity\s*\*\s*price"],
    "privilege_escalation": [r"admin\s*=\s*.*user", r"role\s*=\s*.*request\.", r"permission\s*=\s*.*input", r"is_admin\s*=\s*.*get\(", r"user_type\s*=\s*.*user"],
    "workflow_manipulation": [r"step\s*=\s*.*request\.", r"stage\s*=\s*.*user", r"phase\s*=\s*.*input", r"status\s*=\s*.*get\(", r"state\s*=\s*.*user"],
}
LOOKED_FOR = ("price_manipulation", "privilege_escalation")


def line_of(code: Column, offset: Column) -> Column:
    """Line breaks before an offset, plus one."""
    return F.size(F.split(F.substring(code, F.lit(1), offset), "\n"))


def line_of_inclusive(code: Column, offset: Column) -> Column:
    """The other count: an offset on a line's break belongs to that line."""
    ends = F.transform(F.split(code, "\n"), lambda x: F.char_length(x))
    cumulative = F.transform(F.sequence(F.lit(1), F.size(ends)), lambda i: F.aggregate(F.slice(ends, 1, i), F.lit(0), lambda a, n: a + n) + i - 1)
    return F.least(F.size(F.filter(cumulative, lambda e: e < offset)) + 1, F.size(ends))


def findings(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """A row for each match of each pattern, with its line, as code is read line by line."""
    rules = [(family, severity, len(patterns), p) for family, (severity, patterns) in FAMILIES.items() for p in patterns]
    lines = marked_lines(files, key, F.coalesce(content, F.lit("")), [p for *_, p in rules])

    def case(i: int, pattern: str) -> Column:
        return F.when(has(F.col("bits"), i), F.regexp_extract_all("text", F.lit(f"(?i){pattern}"), F.lit(0))).otherwise(F.array().cast("array<string>"))

    found = lines.select(key, "at", F.posexplode(F.array(*(case(i, r[3]) for i, r in enumerate(rules)))).alias("rule", "codes"))
    flat = found.filter(F.size("codes") > 0).select(key, (F.col("at") + 1).alias("line"), "rule", F.explode("codes").alias("code"))
    # What a rule says is constant, so it is looked up by number.
    of_rule = F.array(*(F.struct(F.lit(family).alias("type"), F.lit(severity).alias("severity"), F.lit(0.7 + 0.1 * (n > 3) + 0.1 * (severity == "critical")).alias("base")) for family, severity, n, _ in rules))
    r = F.get(of_rule, F.col("rule"))
    confidence = F.least(F.lit(1.0), r["base"] + F.when(F.char_length("code") > 20, 0.1).otherwise(0.0))
    return flat.select(key, "line", r["type"].alias("type"), r["severity"].alias("severity"), "code", confidence.alias("confidence"))


def business_logic(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """A finding for each group of which any pattern occurs."""
    groups = F.array(*(F.when(any_of([F.col(content).rlike(f"(?im){p}") for p in BUSINESS[g]]), F.lit(g)) for g in LOOKED_FOR))
    return files.select(key, F.explode(F.array_compact(groups)).alias("type"))


# Names, folders and languages that make a file urgent, and suffixes that don't need a look.
URGENT_NAMES = ["auth", "login", "admin", "user", "security", "api", "controller"]
URGENT_PATHS = ["api", "controller", "service", "handler"]
URGENT_LANGUAGES = ["python", "java", "php", "javascript"]
CONFIG_SUFFIXES = [".json", ".xml", ".yaml", ".yml", ".ini", ".cfg"]
DOCUMENT_SUFFIXES = [".md", ".txt", ".rst", ".doc"]
# Words of a language's code, any or all of them, and the hints they give.
HINTS = {
    "python": [(["subprocess"], ["os.system"], "检查命令注入漏洞"), (["execute", "sql"], ["execute", "query"], "检查SQL注入漏洞"), (["pickle"], ["pickle"], "检查反序列化漏洞"), (["eval"], ["exec"], "检查代码注入漏洞")],
    "java": [(["runtime"], ["processbuilder"], "检查命令注入漏洞"), (["statement", "execute"], ["statement", "execute"], "检查SQL注入漏洞"), (["request.getparameter"], ["request.getparameter"], "检查输入验证")],
    "javascript": [(["eval"], ["eval"], "检查代码注入漏洞"), (["innerhtml"], ["innerhtml"], "检查XSS漏洞"), (["document.write"], ["document.write"], "检查XSS漏洞")],
}


DEFINITION = r"^(async def |def |class |function |func |fn |(public|private|protected) .*(class |interface |\()|const |let |var )"


def skip_reason(name: Column, size: Column) -> Column:
    """Why a file isn't worth a look: too large, a test, configuration, documentation; null if it is."""
    low, suffix = F.lower(name), suffix_of(name)
    return (
        F.when(size > 1024 * 1024, "too_large").when(any_of([low.contains(w) for w in ("test", "spec", "mock")]), "test")
        .when(suffix.isin(CONFIG_SUFFIXES), "config").when(suffix.isin(DOCUMENT_SUFFIXES), "documentation")
    )


def priority(path: Column, language: Column) -> Column:
    """+10 for a telling name, +5 for a telling path, +3 for a risky language, -5 for tests."""
    low, name = F.lower(path), F.lower(name_of(path))
    has = lambda c, words: any_of([c.contains(w) for w in words])
    return (
        F.when(has(name, URGENT_NAMES), 10).otherwise(0) + F.when(has(low, URGENT_PATHS), 5).otherwise(0)
        + F.when(F.lower(language).isin(URGENT_LANGUAGES), 3).otherwise(0) - F.when(has(name, ["test", "spec"]), 5).otherwise(0)
    )


def hints(code: Column, language: Column) -> Column:
    """What a model should look for, by language, in the order above."""
    low = F.lower(code)
    every = lambda words: any_of([~low.contains(w) for w in words]) == F.lit(False)
    cases = [F.when((F.lower(language) == lang) & (every(first) | every(second)), F.lit(hint)) for lang, some in HINTS.items() for first, second, hint in some]
    return F.array_compact(F.array(*cases))


def definitions(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """Lines that define functions, classes or imports."""
    lines = files.select(key, F.posexplode(F.split(content, "\n")).alias("at", "text")).withColumn("text", F.trim("text"))
    kind = F.when(F.col("text").rlike(r"^(async\s+)?def |^function |^func |^fn |^(public|private|protected)\b.*\("), "function").when(F.col("text").rlike(r"^class |^struct |^interface |\bclass \w+"), "class").when(F.col("text").rlike(r"^import |^from \w|^#include|^using |^require"), "import")
    return lines.withColumn("kind", kind).filter("kind is not null").select(key, (F.col("at") + 1).alias("line"), "kind", "text")


def truncated(code: Column, most: int = 2000, marker: str = "\n... (truncated)") -> Column:
    return F.concat(F.substring(code, 1, most), F.when(F.char_length(code) > most, F.lit(marker)).otherwise(F.lit("")))


# Words that make a line worth reading, by language.
RELEVANT = {
    "python": ["execute", "eval", "exec", "subprocess", "os.system", "input", "raw_input", "pickle", "yaml.load", "sql", "query", "cursor", "request", "session", "open", "file", "read", "write", "import", "from", "__import__"],
    "java": ["execute", "Runtime", "ProcessBuilder", "Statement", "PreparedStatement", "request", "response", "session", "cookie", "parameter", "header", "file", "path", "stream", "reader", "writer", "reflection"],
    "javascript": ["eval", "Function", "setTimeout", "setInterval", "innerHTML", "outerHTML", "document.write", "location", "window", "require", "import", "fetch", "XMLHttpRequest", "localStorage", "sessionStorage", "cookie"],
    "php": ["eval", "exec", "system", "shell_exec", "passthru", "include", "require", "file_get_contents", "fopen", "mysql_query", "mysqli_query", "$_GET", "$_POST", "$_REQUEST", "$_SESSION", "$_COOKIE", "unserialize"],
}


def relevant_code(code: Column, language: str, most: int = 100) -> Column:
    """Lines within two of a telling word, the first so many, numbered, with a mark where lines are left out.

    If those are fewer than half of what may stay, lines that define something are added;
    without any, the first lines stay. Lines are counted from 1, left out ones from 0.
    """
    lines = F.split(code, "\n")
    n = F.size(lines)
    words = [w.lower() for w in RELEVANT.get(language, [])]
    hits = F.transform(lines, lambda x: any_of([F.lower(x).contains(w) for w in words]))
    every = F.sequence(F.lit(1), n)
    near = F.filter(every, lambda i: F.exists(F.slice(hits, F.greatest(i - 2, F.lit(1)), F.least(i + 2, n) - F.greatest(i - 2, F.lit(1)) + 1), lambda h: h))
    defined = F.filter(every, lambda i: F.trim(F.get(lines, i - 1)).rlike(DEFINITION))
    kept = F.when(F.size(near) < most // 2, F.array_sort(F.array_union(near, defined))).otherwise(near)
    kept = F.slice(F.when(F.size(kept) == 0, every).otherwise(kept), 1, most)

    def shown(at: Column) -> Column:
        before = lambda k: F.when(k > 0, F.get(at, k - 1)).otherwise(0)
        gap = lambda i, k: F.when(i > before(k) + 1, F.format_string("# ... (省略第%d-%d行)\n", before(k), i - 2)).otherwise("")
        return F.array_join(F.transform(at, lambda i, k: F.concat(gap(i, k), F.format_string("%4d: %s", i, F.get(lines, i - 1)))), "\n")

    return F.get(F.transform(F.array(kept), shown), F.lit(0))


def optimised(code: Column, language: str, quick: bool = False) -> Column:
    """What of a file is analysed: all of it up to 200 lines, else 150 relevant ones; quick: a head of 20 and 30 relevant ones."""
    n = F.size(F.split(code, "\n"))
    whole = F.when(n > 200, relevant_code(code, language, 150)).otherwise(code)
    if not quick:
        return whole
    head = F.array_join(F.slice(F.split(code, "\n"), 1, 20), "\n")
    return F.when(n > 50, F.concat(head, F.lit("\n\n# ... (省略中间部分)\n\n"), relevant_code(code, language, 30))).otherwise(whole)


def token_estimate(text: Column) -> Column:
    return F.floor(F.char_length(text) / 4)


def keyword_context(files: DataFrame, words: list[str], key: str = "path", content: str = "content", around: int = 2) -> DataFrame:
    """Lines within two of a keyword, each once, with a mark where lines were left out before it."""
    lines = files.select(key, F.posexplode(F.split(content, "\n")).alias("at", "text"))
    near = Window.partitionBy(key).orderBy("at").rowsBetween(-around, around)
    hit = F.max(any_of([F.lower("text").contains(w) for w in words]).cast("int")).over(near)
    kept = lines.withColumn("hit", hit).filter("hit = 1")
    return kept.withColumn("gap", F.coalesce(F.col("at") - F.lag("at").over(Window.partitionBy(key).orderBy("at")) > 1, F.lit(False))).select(key, (F.col("at") + 1).alias("line"), "text", "gap")
