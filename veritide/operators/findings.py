"""Findings from answers of a model, and what related files say about them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritide.functions.patterns import any_of, name_of, stem_of, suffix_of
from veritide.operators.substrings import first_containing
from veritide.scratch import written

ITEM = "type string, severity string, line int, description string, code_snippet string, impact string, recommendation string"
# Words that make an answer without JSON worth reading, and a line a finding.
ANSWER_WORDS = ["漏洞", "安全问题"]
LINE_WORDS = ["SQL注入", "命令注入", "路径遍历", "XSS", "CSRF", "漏洞", "安全问题"]
# Types that related files are looked at for, references in code, and names of configuration files.
CROSS_TYPES = ["文件上传", "XSS", "路径遍历", "权限"]
REFERENCES = [r"include\s*['\"]([^'\"]+)['\"]", r"require\s*['\"]([^'\"]+)['\"]", r"import\s+['\"]([^'\"]+)['\"]", r"from\s+['\"]([^'\"]+)['\"]"]
TEMPLATES = [r"template\s*['\"]([^'\"]+)['\"]", r"render\s*['\"]([^'\"]+)['\"]", r"include\s*['\"]([^'\"]+\.html?)['\"]"]
CONFIGS = ["config.php", "config.ini", "settings.py", "application.properties", "web.xml", ".htaccess"]
SEARCHED = [".php", ".java", ".py", ".js", ".html", ".jsp", ".xml"]
RESOLVED = ["", ".php", ".html", ".js", ".py"]
DEFAULTS = {"type": "security_issue", "severity": "medium", "description": "", "code_snippet": "", "impact": "", "recommendation": ""}


STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
OBJECT = r"\{[^{}]*+\}"
for _depth in range(4):  # objects in objects, so many levels deep; braces within strings don't count
    OBJECT = r"\{(?:[^{}\"]++|" + STRING + ("|" + OBJECT if _depth else "") + r")*+\}"
LIST = r'"findings"\s*:\s*\['


def complete_objects(part: Column) -> Column:
    """The objects at the beginning of a list, up to its end or to one that is cut."""
    tokens = lambda t: F.when(F.exists(t, ends), F.slice(t, 1, F.array_position(F.transform(t, ends), True).cast("int") - 1)).otherwise(t)
    ends = lambda x: x.isin("{", "]")
    return F.flatten(F.transform(F.array(F.regexp_extract_all(part, F.lit(f"(?s){OBJECT}|[{{\\]]"), F.lit(0))), tokens))


def parsed(responses: DataFrame) -> DataFrame:
    """Findings of each answer (file, language, response).

    Behind the first JSON fence every list of findings counts, in one block or several, with
    text around it or cut anywhere: each complete object that is JSON gives a finding, whatever
    else is broken. A field that is missing or of another type than it should be has its
    default. An answer without such a list that speaks of problems gives a finding for each line
    that names a kind of problem.
    """
    text = F.coalesce("response", F.lit(""))
    rows = responses.select("file", "language", text.alias("text"), F.split(F.coalesce(F.get(F.split(text, "```json", 2), F.lit(1)), F.lit("")), LIST).alias("parts"))
    lists = F.slice("parts", F.lit(2), F.size("parts"))
    names = [x.split() for x in ITEM.split(", ")]

    def listed(v: Column, at: Column) -> Column:
        return F.struct(at.cast("int").alias("seq"), *(F.coalesce(F.try_variant_get(v, f"$.{n}", t), F.lit(DEFAULTS.get(n, 0))).alias(n) for n, t in names))

    def named(line: Column, at: Column) -> Column:
        own = {"type": F.lit("security_issue"), "severity": F.lit("medium"), "line": F.lit(0), "description": F.trim(line)}
        return F.struct(at.cast("int").alias("seq"), *(own.get(n, F.lit("")).alias(n) for n, _ in names))

    objects = F.filter(F.transform(F.flatten(F.transform(lists, complete_objects)), F.try_parse_json), lambda v: v.isNotNull())
    speaks = any_of([F.col("text").contains(w) for w in ANSWER_WORDS]) | F.lower("text").contains("vulnerability")
    lines = F.filter(F.transform(F.split("text", "\n"), named), lambda x: any_of([x["description"].contains(w) for w in LINE_WORDS]))
    items = F.when(F.size(lists) > 0, F.transform(objects, listed)).when(speaks, lines)
    flat = rows.select("file", "language", F.explode(items).alias("f")).select("file", "language", "f.*")
    return flat.withColumn("issues", F.array("description"))


def caller_edges(files: DataFrame, most: int = 5, searched: int = 100, size: int = 500 * 1024, read: int | None = 10_240, mode: str = "first", called: DataFrame | None = None) -> DataFrame:
    """(path, caller, pattern): files whose first characters name another's stem or name; five for a pattern, by path.

    ``mode="first"``: only the first hundred files by path that can call are searched, as a
    feature; so one side of the comparison has a hundred rows, whatever the number of files.
    ``mode="all"``: all of them are, by windows of the names; ``read=None`` reads them whole.
    ``called`` (path): only callers of these files are looked for, else of all.
    """
    callers = files.filter(suffix_of(name_of(F.col("path"))).isin(SEARCHED) & (F.col("size") <= size))
    head = F.col("content") if read is None else F.substring("content", 1, read)
    name = name_of(F.col("path"))
    patterns = (files if called is None else called).select("path", F.posexplode(F.array_distinct(F.array(stem_of(name), name))).alias("rank", "pattern"))
    if mode == "all":
        # One more than are kept, as a file isn't its own caller. Many files may share a name.
        named = first_containing(callers.select(F.col("path").alias("id"), head.alias("text")), patterns.select(F.col("pattern").alias("string")), most + 1)
        first = written(named.select(F.col("string").alias("pattern"), F.col("id").alias("caller")), "callers")
        lists = first.groupBy("pattern").agg(F.sort_array(F.collect_list("caller")).alias("callers"))
        rows = patterns.join(lists, "pattern")
        others = F.slice(F.filter("callers", lambda c: c != F.col("path")), 1, most)
        return rows.select("path", "pattern", "rank", F.posexplode(others).alias("at", "caller")).select("path", "caller", "pattern", "rank", (F.col("at") + 1).alias("n"))
    callers = F.broadcast(callers.orderBy("path").limit(searched).select(F.col("path").alias("caller"), head.alias("head")))
    hits = patterns.join(callers, F.col("head").contains(F.col("pattern"))).filter("caller <> path")
    nth = F.row_number().over(Window.partitionBy("path", "pattern").orderBy("caller"))
    return hits.withColumn("n", nth).filter(F.col("n") <= most).select("path", "caller", "pattern", "rank", "n")


def normal_path(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, r"(^|/)(\./)+", "$1"), r"(^|/)[^/.]+/\.\./", "$1")


def reference_edges(files: DataFrame, patterns: list[str], relation: str) -> DataFrame:
    """(path, related, relation): what a file's code refers to, beside it or from the root, if it is there."""
    found = F.concat(*(F.regexp_extract_all("content", F.lit(f"(?i){p}"), F.lit(1)) for p in patterns))
    refs = files.select("path", F.posexplode(F.array_distinct(found)).alias("at", "ref"))
    folder = F.regexp_extract("path", "^(.*/)?[^/]*$", 1)
    candidates = F.array(*(F.concat(base, F.col("ref"), F.lit(ext)) for base in (folder, F.lit("")) for ext in RESOLVED))
    some = refs.select("path", "at", F.posexplode(F.transform(candidates, normal_path)).alias("k", "related"))
    there = files.select(F.col("path").alias("related"))
    hits = some.join(there, "related", "left_semi").groupBy("path", "related").agg(F.min(F.struct("at", "k")).alias("at"))
    return hits.select("path", "related", F.lit(relation).alias("relation"), F.col("at.at").alias("at"))


def parent_edges(paths: DataFrame, files: DataFrame) -> DataFrame:
    """(path, related, relation) of paths that name an upload or a file: controllers in any folder above, nearest first."""
    folder = F.regexp_extract("path", "^(.*/)?[^/]*$", 1)
    named = paths.filter(F.lower("path").rlike("upload|file")).select("path", F.split(folder, "/").alias("parts"))
    depths = F.sequence(F.size("parts") - 1, F.lit(0), F.lit(-1))
    above = named.select("path", F.posexplode(F.transform(depths, lambda n: F.array_join(F.transform(F.slice("parts", F.lit(1), n), lambda x: F.concat(x, F.lit("/"))), ""))).alias("at", "folder"))
    controllers = files.filter(name_of(F.col("path")).contains("Controller")).select(F.col("path").alias("related"), folder.alias("folder"))
    return above.join(controllers, "folder").select("path", "related", F.lit("parent").alias("relation"), "at")


def related_files(findings: DataFrame, files: DataFrame) -> DataFrame:
    """Up to five related files of each finding (path, type): callers, callees, configuration, templates, controllers."""
    keys = findings.select("path", "type").distinct()
    calls = caller_edges(files).select("path", F.col("caller").alias("related"), F.lit("caller").alias("relation"), (F.col("rank") * 10 + F.col("n")).alias("at"))
    callees = reference_edges(files, REFERENCES, "callee")
    templates = reference_edges(files, TEMPLATES, "template")
    configs = F.broadcast(files.filter(name_of(F.col("path")).isin(CONFIGS)).orderBy("path").limit(2).select(F.col("path").alias("related")))
    cap = {"caller": 3, "callee": 3, "config": 2, "template": 2, "parent": 2}
    rank = F.create_map(*(F.lit(x) for i, r in enumerate(cap) for x in (r, i)))
    of_path = keys.join(calls.unionByName(callees), "path").unionByName(keys.filter(F.col("type").contains("XSS")).join(templates, "path"))
    with_config = keys.filter(F.col("type").rlike("路径遍历|文件上传")).join(configs).select("path", "type", "related", F.lit("config").alias("relation"), F.lit(0).alias("at"))
    parents = keys.join(parent_edges(keys.select("path").distinct(), files), "path")
    rows = of_path.unionByName(with_config).unionByName(parents).withColumn("rank", rank[F.col("relation")])
    nth = F.row_number().over(Window.partitionBy("path", "type", "relation").orderBy("at", "related"))
    most = F.create_map(*(F.lit(x) for kv in cap.items() for x in kv))[F.col("relation")]
    rows = rows.withColumn("n", nth).filter(F.col("n") <= most)
    place = F.row_number().over(Window.partitionBy("path", "type").orderBy("rank", "n"))
    return rows.withColumn("place", place).filter("place <= 5").select("path", "type", "related", "relation", "place")


def needs_related(kind: Column, confidence: Column) -> Column:
    return ((confidence > 0.4) & (confidence < 0.98)) | any_of([kind.contains(t) for t in CROSS_TYPES])


def adjusted(findings: DataFrame, related: DataFrame) -> DataFrame:
    """Confidence after related files' findings (path, type of the first; found_type, found_description).

    Each of the same type adds 0.2, each that speaks of protection takes 0.1; the result
    stays within 0.1 and 1. Findings above 0.99 are left alone.
    """
    same = F.col("found_type") == F.col("type")
    safe = F.col("found_description").contains("安全") | F.col("found_description").contains("验证")
    changes = related.groupBy("path", "type").agg(F.sum(F.when(same, 0.2).when(safe, -0.1).otherwise(0.0)).alias("change"))
    rows = findings.join(changes, ["path", "type"], "left")
    new = F.greatest(F.lit(0.1), F.least(F.lit(1.0), F.col("confidence") + F.coalesce("change", F.lit(0.0))))
    rows = rows.withColumn("adjusted_confidence", F.when(F.col("confidence") > 0.99, F.col("confidence")).otherwise(new)).drop("change")
    return rows.withColumn("recommendation", recommendation(F.col("confidence"), F.col("adjusted_confidence")))


def recommendation(before: Column, after: Column) -> Column:
    """The texts."""
    both = lambda verb, end: F.format_string(f"跨文件分析{verb}了问题的置信度 (%.2f → %.2f)，{end}", before, after)
    return F.when(after > before + 0.1, both("增加", "建议优先修复")).when(after < before - 0.1, both("降低", "可能存在安全控制")).otherwise("跨文件分析未显著改变置信度，建议进一步人工审查")


def analysis_key(path: Column, kind: Column, line: Column) -> Column:
    return F.md5(F.concat_ws(":", path, kind, line.cast("string")).cast("binary"))
