"""False positives: rule tables and the ordered checks that drop a finding."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritide.functions.patterns import any_of

SECRET, LEAK, BYPASS, SQL, COMMAND, CODE = "硬编码密钥和敏感信息", "信息泄露", "权限验证绕过", "SQL注入漏洞", "命令注入漏洞", "代码注入漏洞"


class Rule(NamedTuple):
    name: str
    pattern: str
    types: tuple[str, ...]
    most: float  # applies up to this confidence
    languages: tuple[str, ...] = ()


# Rules of the project filter, in order.
PROJECT_RULES = (
    Rule("java_package_declaration", r"package\s+[a-zA-Z][a-zA-Z0-9_.]*;", (SECRET, LEAK), 0.9),
    Rule("business_constants", r"(2L|1L|0L|\d+L?)\s*[,;)]", (SECRET,), 0.9),
    Rule("legitimate_ip_acquisition", r"InetAddress\.getLocalHost\(\)|getHostAddress\(\)", (SECRET, LEAK), 0.7),
    Rule("pagination_parameters", r"PageHelper\.startPage\(\s*\d+\s*,\s*\d+\s*\)", (SECRET,), 0.8),
    Rule("status_codes", r"(200|404|500|401|403)\s*[,;)]", (SECRET,), 0.9),
    Rule("normal_permission_check", r"session\.getAttribute\([\"']userId[\"']\)", (BYPASS,), 0.8),
    Rule("normal_user_info_access", r"Long\.parseLong\(session\.getAttribute\([\"']userId[\"']\)", (BYPASS,), 0.9),
    Rule("jpa_findone_safe", r"\.findOne\(\s*\w+\s*\)", (SQL,), 0.8),
    Rule("normal_database_query", r"findOne\(\s*\w+\s*\)|findBy\w+\(", (SQL,), 0.8),
    Rule("excessive_permission_warnings", r"session\.getAttribute.*userId.*findOne", (BYPASS,), 0.7),
    Rule("normal_controller_operations", r"@RequestMapping|@GetMapping|@PostMapping", (BYPASS,), 0.6),
)
# Rules of the universal filter, in order; those with languages hold for them alone.
UNIVERSAL_RULES = (
    Rule("numeric_constants", r"\b\d+[LlFfDd]?\b\s*[,;)\]}]", (SECRET,), 0.8),
    Rule("http_status_codes", r"\b(200|201|400|401|403|404|500|502|503)\b", (SECRET,), 0.9),
    Rule("logging_statements", r"(console\.log|print|println|printf|log\.|logger\.|logging\.)", (COMMAND, CODE), 0.7),
    Rule("configuration_constants", r"(true|false|null|undefined|None|nil)\b", (SECRET,), 0.9),
    Rule("version_numbers", r"\b\d+\.\d+(\.\d+)?\b", (SECRET, LEAK), 0.8),
    Rule("url_paths", r"['\"]/([\w/\-]+)['\"]", (SECRET,), 0.7),
    Rule("java_package_declaration", r"package\s+[a-zA-Z][a-zA-Z0-9_.]*;", (SECRET, LEAK), 0.9, ("java",)),
    Rule("java_annotations", r"@\w+(\([^)]*\))?", (SECRET,), 0.8, ("java",)),
    Rule("spring_mvc_annotations", r"@(RequestMapping|GetMapping|PostMapping|PutMapping|DeleteMapping)", (BYPASS,), 0.6, ("java",)),
    Rule("jpa_safe_methods", r"\.(findOne|findBy\w+|save|delete)\s*\(", (SQL,), 0.7, ("java",)),
    Rule("python_imports", r"(import\s+\w+|from\s+\w+\s+import)", (SECRET, LEAK), 0.9, ("python",)),
    Rule("django_safe_patterns", r"@(login_required|permission_required|csrf_exempt)", (BYPASS,), 0.6, ("python",)),
    Rule("js_imports", r"(import\s+.*from|require\s*\()", (SECRET,), 0.8, ("javascript",)),
    Rule("express_middleware", r"app\.(use|get|post|put|delete)\s*\(", (BYPASS,), 0.5, ("javascript",)),
    Rule("csharp_using", r"using\s+[\w.]+;", (SECRET,), 0.9, ("csharp",)),
    Rule("aspnet_attributes", r"\[(Authorize|AllowAnonymous|ValidateAntiForgeryToken)\]", (BYPASS,), 0.6, ("csharp",)),
)
# What descriptions of doubtful findings say.
DOUBT = ["可能存在", "可能会导致", "可能造成", "未明确说明", "未充分检查", "如果.*能够控制", "如果.*被不当调用", "建议.*应.*确保"]
UNIVERSAL_DOUBT = ["可能存在", "可能会导致", "可能造成", "虽然.*但", "如果.*能够控制", "建议.*应.*确保"]
BYPASS_DOUBT = ["虽然检查了session中的userid", "未对用户角色或权限进行", "可能导致未授权访问", "应增加权限校验逻辑"]
SQL_DOUBT = ["可能未使用参数化查询", "如果.*参数未经过严格过滤", "可能存在sql注入风险"]
# Context, three lines around a finding, that makes it harmless, by type; (pattern, any case).
HARMLESS_CONTEXT = {
    SECRET: [(r"PageHelper\.startPage|分页|page", True), (r"status|状态|type|类型", True)],
    BYPASS: [(r"Objects\.isNull|权限|permission|auth", True), (r"redirect.*notlimit|redirect.*error", True), (r"session\.getAttribute.*userId.*findOne", True), (r"Long\.parseLong.*session.*getAttribute.*userId", True)],
    SQL: [(r"\.findOne\(|\.findBy\w+\(|\.save\(|\.delete\(", True), (r"\d+L?\s*\)", False)],
}
# Code of frameworks that makes a finding harmless, by type.
HARMLESS_CODE = {SQL: [r"\.findOne\(|\.findBy\w+\(|\.save\(", r"#\{[^}]+\}"], BYPASS: [r"@PreAuthorize|@Secured|@RolesAllowed"]}


def by_rules(rules: tuple[Rule, ...], kind: Column, snippet: Column, confidence: Column, language: Column) -> Column:
    """Name of the first rule that applies, null if none does."""
    out = None
    for r in rules:
        hit = kind.isin(*r.types) & snippet.rlike(f"(?i){r.pattern}") & (confidence <= r.most)
        if r.languages:
            hit = hit & language.isin(*r.languages)
        out = F.when(hit, F.lit(r.name)) if out is None else out.when(hit, F.lit(r.name))
    return out


def context_lines(code: Column, line: Column, before: int = 3, after: int = 3) -> Column:
    """The lines around a line number that exists, null otherwise."""
    lines = F.split(code, "\n")
    first = F.greatest(line - before, F.lit(1))
    n = F.least(line + after, F.size(lines)) - first + 1
    return F.when((line > 0) & (line <= F.size(lines)), F.array_join(F.slice(lines, first, F.greatest(n, F.lit(0))), "\n"))


def with_drop_reasons(findings: DataFrame, mode: str = "intended") -> DataFrame:
    """Findings with ``drop_reason``: the first check that calls them false, null for those that stay.

    Reads type, code_snippet, description, confidence, severity, line, file, code (the
    file's text) and language. ``intended`` looks at the snippet and at severities in any
    case; ``compat`` has the empty snippet, the fixed confidence 0.5 and the upper-case
    severity only, as the audited tool's own filters see findings.
    """
    compat = mode == "compat"
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    kind, description, code, path = text("type"), F.lower(text("description")), text("code"), text("file")
    snippet = F.lit("") if compat else text("code_snippet")
    confidence = F.lit(0.5) if compat else F.coalesce(F.col("confidence"), F.lit(0.5))
    severity = text("severity") if compat else F.upper(text("severity"))
    context = context_lines(code, F.col("line"))
    low = F.lower(snippet)
    says = lambda words: any_of([description.rlike(w) for w in words])
    has = lambda words: any_of([description.contains(w) for w in words])
    comment = F.coalesce(context.contains("//") if compat else (snippet != "") & context.rlike(r"//") & (F.instr(F.regexp_extract(context, r"//(.*)", 1), snippet) > 0), F.lit(False))
    harmless = any_of([(kind == SECRET) & comment, *((kind == t) & F.coalesce(any_of([context.rlike(f"(?i){p}" if i else p) for p, i in some]), F.lit(False)) for t, some in HARMLESS_CONTEXT.items())])
    business = (kind == SECRET) & ((path.contains("AttendceController") & snippet.contains("InetAddress")) | (path.contains("Mail") & low.contains("email") & ~low.contains("password")))
    framework = any_of([(kind == t) & any_of([snippet.rlike(p) for p in some]) for t, some in HARMLESS_CODE.items()])
    password = low.contains("password") & (low.contains("=") | low.contains('"') | low.contains("'"))
    doubtful = ~password & (says(DOUBT) | ((kind == BYPASS) & has(BYPASS_DOUBT)) | ((kind == SQL) & has(SQL_DOUBT)))
    language = text("language")
    universal = F.coalesce(by_rules(UNIVERSAL_RULES, kind, snippet, confidence, language), F.when(confidence < 0.4, F.lit("low_confidence")), F.when(says(UNIVERSAL_DOUBT), F.lit("doubtful_description")))
    project = F.coalesce(
        F.when(confidence < 0.4, F.lit("low_confidence")), by_rules(PROJECT_RULES, kind, snippet, confidence, language), F.when((severity == "HIGH") & (confidence < 0.6), F.lit("high_without_confidence")),
        F.when(harmless, F.lit("harmless_context")), F.when(business, F.lit("business_logic")), F.when(framework, F.lit("framework")), F.when(doubtful, F.lit("doubtful_description")),
    )
    return findings.withColumn("drop_reason", F.coalesce(universal, project))


def filtered(findings: DataFrame, mode: str = "intended") -> DataFrame:
    return with_drop_reasons(findings, mode).filter("drop_reason is null").drop("drop_reason")


def simply_false(kind: Column, snippet: Column, path: Column, confidence: Column) -> Column:
    """The quick check: low confidence, SQL with placeholders, permissions in data access."""
    low = F.lower(path)
    return (confidence < 0.3) | (kind.contains("SQL") & (snippet.contains("?") | snippet.contains(":"))) | (kind.contains("权限") & (low.contains("dao") | low.contains("mapper")))


def rule_counts(spark) -> DataFrame:
    """How many rules there are, by filter and language."""
    rows = [("project", "any", r.name) for r in PROJECT_RULES] + [("universal", x, r.name) for r in UNIVERSAL_RULES for x in (r.languages or ("any",))]
    return spark.createDataFrame(rows, "scope string, language string, name string").groupBy("scope", "language").agg(F.count("*").alias("n"))


# Code that is certainly a problem, and code that certainly is none, by kind.
DEFINITE = {
    "hardcoded_credentials": [r"password\s*=\s*[\"'][^\"']+[\"']", r"secret\s*=\s*[\"'][^\"']+[\"']", r"key\s*=\s*[\"'][^\"']+[\"']"],
    "sql_injection": [r"\+.*[\"'].*SELECT.*FROM", r"String.*sql.*\+.*request\.getParameter", r"\$\{[^}]+\}.*WHERE"],
    "path_traversal": [r"new\s+File\(.*request\.getParameter", r"FileInputStream\(.*request\.getParameter"],
}
SAFE = {
    "spring_security": [r"@PreAuthorize", r"@Secured", r"@RolesAllowed"],
    "parameterized_queries": [r"#\{[^}]+\}", r"\.findOne\(", r"\.findBy\w+\("],
    "normal_operations": [r"session\.getAttribute\([\"']userId[\"']", r"Long\.parseLong\(.*userId", r"@RequestMapping", r"@GetMapping", r"@PostMapping"],
}


def kinds_in(code: Column, rules: dict[str, list[str]]) -> Column:
    """The kinds of which any pattern occurs in the code, in order."""
    return F.array_compact(F.array(*(F.when(any_of([code.rlike(p) for p in some]), F.lit(kind)) for kind, some in rules.items())))
