"""Source trees as tables: scan, decode, hash, and decide which files are looked at."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritide.functions.languages import EXTENSIONS, by_extension
from veritide.functions.patterns import any_of, ignored_by_globs, matches_globs, name_of, suffix_of
from veritide.sources import trees

# What scans leave out, and names of source files without an extension.
IGNORED = [".git", ".svn", ".hg", "__pycache__", "node_modules", "target", "build", "dist", ".pytest_cache", ".mypy_cache", ".coverage", "*.pyc", "*.pyo", "*.pyd", "*.so", "*.dll", "*.dylib", "*.log", "*.tmp", "*.temp"]
BARE_NAMES = ["Makefile", "makefile", "Dockerfile", "dockerfile", "Jenkinsfile", "Vagrantfile", "Rakefile"]


@dataclass(frozen=True)
class Filtering:
    """The defaults of file filtering."""

    enabled: bool = True
    ignore: tuple[str, ...] = (
        "node_modules/**", "vendor/**", "venv/**", ".venv/**", "__pycache__/**", "dist/**", "build/**", ".next/**", ".nuxt/**", "*.min.js", "*.bundle.js",
        "*.min.css", "*.png", "*.jpg", "*.gif", "*.svg", "*.ico", "*.woff", "*.ttf", ".git/**", ".vscode/**", ".idea/**", "*.iml", ".DS_Store",
    )
    force_include: tuple[str, ...] = ("*.env*", "*.config.*", "*.conf", "*.ini", "*.secret*", "*.key", "*.pem", "*.crt")
    gitignore: tuple[str, ...] = ()
    max_size: int = 512_000
    css_files: bool = True
    js_files: bool = True
    test_files: bool = True
    doc_files: bool = False
    log_files: bool = True
    detect_libraries: bool = True
    test: tuple[str, ...] = ("*test.*", "*spec.*", "test/**", "tests/**", "__tests__/**", "spec/**")
    css: tuple[str, ...] = ("*.css", "*.scss", "*.sass", "*.less", "*.styl")
    js: tuple[str, ...] = ("*.js", "*.jsx", "*.ts", "*.tsx", "*.mjs", "*.cjs")
    doc: tuple[str, ...] = ("*.md", "*.txt", "*.rst", "*.adoc", "docs/**", "documentation/**")
    log: tuple[str, ...] = ("*.log", "logs/**", "log/**")
    library_keywords: tuple[str, ...] = ("jQuery", "Bootstrap", "Lodash", "React", "Vue", "Angular", "Generated by", "Auto-generated", "This file is automatically generated", "Do not edit this file")
    include_extensions: tuple[str, ...] = field(default=())
    exclude_extensions: tuple[str, ...] = field(default=())
    include_paths: tuple[str, ...] = field(default=())
    exclude_paths: tuple[str, ...] = field(default=())


def text_of(content: Column) -> Column:
    """UTF-8 with bad bytes left out."""
    return F.replace(F.make_valid_utf8(content.cast("string")), F.lit("�"), F.lit(""))


def scan(spark: SparkSession, root: str, project_id: str = "", by: Filtering | None = None, ignored: list[str] | None = None) -> DataFrame:
    """All files below a folder that any file system Spark reads may hold, with hashes and text.

    With a filtering, executors list paths and sizes, put them through the scan's gates and
    open only files that pass; no list of files crosses the driver. File systems that
    only Spark reads are listed by Spark, whose list of what passes the driver does hold.
    """
    read = spark.read.format("binaryFile")
    base = "/" + root.split(":", 1)[-1].strip("/")

    def named(raw: DataFrame) -> DataFrame:
        absolute = F.regexp_replace("uri", "^[a-z]+:/*", "/")
        rows = raw.withColumnsRenamed({"path": "uri", "length": "size", "modificationTime": "last_modified"})
        return rows.withColumns({"project_id": F.lit(project_id), "absolute_path": absolute, "path": F.substring(absolute, len(base) + 2, 1_000_000)})

    if by is not None and (root.split(":", 1)[0] if ":" in root else "") in trees.SCHEMES:
        trees.register(spark)
        listed = spark.read.format("source_tree").options(content="false", ignored="").load(root)
        listed = listed.withColumns({"project_id": F.lit(project_id), "absolute_path": F.concat(F.lit(f"{base}/"), "path")}).select("project_id", "path", "absolute_path", "size", "last_modified")
        found = trees.with_bytes(scanned(described(listed), by, ignored), root).withColumnRenamed("data", "content")
    else:
        raw = read.option("recursiveFileLookup", "true").load(root)
        if by is not None:
            listed = scanned(described(named(raw.select("path", "length", "modificationTime"))), by, ignored)
            paths = [r["uri"] for r in listed.select("uri").collect()]
            raw = spark.read.format("binaryFile").load(paths) if paths else raw.limit(0)
        found = named(raw)
    rows = found.select("project_id", "path", "absolute_path", "size", content_hash(F.col("content")).alias("hash"), "last_modified", text_of(F.col("content")).alias("content"))
    none = F.array().cast("array<string>")
    return described(rows).withColumns({"functions": none, "classes": none, "imports": none})


def content_hash(content: Column) -> Column:
    """SHA-256 in hexadecimal, of text or bytes."""
    return F.sha2(content, 256)


def of_language(files: DataFrame, *languages: str) -> DataFrame:
    return files.filter(F.lower("language").isin([x.lower() for x in languages]))


def of_size(files: DataFrame, least: int = 0, most: int | None = None) -> DataFrame:
    """Files of so many bytes, both ends included."""
    return files.filter((F.col("size") >= least) & (F.lit(True) if most is None else F.col("size") <= most))


def described(files: DataFrame) -> DataFrame:
    """Files with name, extension and language."""
    name = name_of(F.col("path"))
    return files.withColumns({"name": name, "ext": suffix_of(name), "language": by_extension(name)})


def extension_ok(name: Column, include: tuple[str, ...], exclude: tuple[str, ...]) -> Column:
    dotted = lambda xs: [x.lower() if x.startswith(".") else f".{x.lower()}" for x in xs]
    ext = suffix_of(name)
    ok = ext.isin(dotted(include)) if include else F.lit(True)
    return ok & ~ext.isin(dotted(exclude)) if exclude else ok


def path_ok(path: Column, include: tuple[str, ...], exclude: tuple[str, ...]) -> Column:
    """Part of the path anywhere; what is excluded goes first."""
    clean = lambda p: p.replace("\\", "/").strip("/")
    p = F.trim(F.replace(path, F.lit("\\"), F.lit("/")), F.lit("/"))
    hit = lambda xs: any_of([p.contains(clean(x)) for x in xs])
    return F.when(hit(exclude), False).otherwise(hit(include) if include else F.lit(True))


def is_source(name: Column) -> Column:
    return suffix_of(name).isin(list(EXTENSIONS)) | ((suffix_of(name) == "") & name.isin(BARE_NAMES))


def is_library(content: Column, words: tuple[str, ...]) -> Column:
    """A keyword in the first ten lines, in any case."""
    head = F.lower(F.array_join(F.slice(F.split(content, "\n", 11), 1, 10), "\n"))
    return F.coalesce(any_of([head.contains(w.lower()) for w in words]), F.lit(False))


def decision(path: Column, size: Column, content: Column, by: Filtering) -> Column:
    """Why a file is in or out: the first of twelve checks that says so."""
    if not by.enabled:
        return F.lit("filtering_disabled")
    name = name_of(path)
    fits = lambda patterns: matches_globs(path, list(patterns))
    steps = [
        (fits(by.force_include), "force_included"), (~extension_ok(name, by.include_extensions, by.exclude_extensions), "extension_filter"),
        (~path_ok(path, by.include_paths, by.exclude_paths), "path_filter"), (fits(by.ignore), "ignore_pattern"), (fits(by.gitignore), "gitignore"), (size > by.max_size, "too_large"),
        (fits(by.css) if by.css_files else F.lit(False), "css_file"), (fits(by.js) if by.js_files else F.lit(False), "js_file"), (fits(by.test) if by.test_files else F.lit(False), "test_file"),
        (fits(by.doc) if by.doc_files else F.lit(False), "doc_file"), (fits(by.log) if by.log_files else F.lit(False), "log_file"),
        (is_library(content, by.library_keywords) if by.detect_libraries else F.lit(False), "library_file"),
    ]
    out = F.when(steps[0][0], steps[0][1])
    for condition, reason in steps[1:]:
        out = out.when(condition, reason)
    return out.otherwise("included")


INCLUDED = ("filtering_disabled", "force_included", "included")


def decided(files: DataFrame, by: Filtering | None = None) -> DataFrame:
    rows = files.withColumn("reason", decision(F.col("path"), F.col("size"), F.col("content"), by or Filtering()))
    return rows.withColumn("included", F.col("reason").isin(*INCLUDED))


def filter_stats(decisions: DataFrame) -> DataFrame:
    """One row of counts by reason, and the share that was left out in percent."""
    n = lambda c: F.count(F.when(c, 1))
    why = lambda r: n(F.col("reason") == r)
    out = n(~F.col("included"))
    return decisions.agg(
        F.count("*").alias("total_files"), n(F.col("included")).alias("included_files"), out.alias("filtered_files"), why("ignore_pattern").alias("filtered_by_pattern"), why("too_large").alias("filtered_by_size"),
        why("gitignore").alias("filtered_by_gitignore"), why("library_file").alias("filtered_by_library"), why("force_included").alias("force_included"),
        F.round(100 * out / F.nullif(F.count("*"), F.lit(0)), 1).alias("efficiency"),
    )


def gitignore(spark: SparkSession, path: str) -> list[str]:
    """The patterns of an ignore file: a rule table, so it is read to the driver."""
    line = F.trim("value")
    return [r[0] for r in spark.read.text(path).filter((line != "") & ~line.startswith("#")).select(line).collect()]


def scanned(files: DataFrame, by: Filtering | None = None, ignored: list[str] | None = None) -> DataFrame:
    """Files after the scan's four gates: extension, path, ignore list and size, source file (unless extensions are given)."""
    by = by or Filtering()
    rows = files.filter(extension_ok(F.col("name"), by.include_extensions, by.exclude_extensions) & path_ok(F.col("path"), by.include_paths, by.exclude_paths))
    force = matches_globs(F.col("path"), list(by.force_include))
    rows = rows.filter(force | ((F.col("size") <= by.max_size) & ~ignored_by_globs(F.col("path"), ignored or IGNORED)))
    return rows if by.include_extensions else rows.filter(is_source(F.col("name")))


def estimated_lines(files: DataFrame) -> DataFrame:
    """One row: a line for each fifty characters, one at least, of files with a language."""
    n = F.greatest(F.lit(1).cast("long"), F.floor(F.col("size") / 50))
    return files.filter(F.col("language").isNotNull() & (F.col("size") > 0)).agg(F.coalesce(F.sum(n), F.lit(0).cast("long")).alias("total_lines"))
