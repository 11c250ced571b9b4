"""Dependencies from manifests, each format by built-in functions over lines or JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Manifests by name; those without a parser give no rows.
MANIFESTS = ["requirements.txt", "pyproject.toml", "setup.py", "Pipfile", "package.json", "yarn.lock", "package-lock.json", "pom.xml", "build.gradle", "Cargo.toml", "go.mod", "composer.json", "Gemfile"]
COLUMNS = ["project_id", "manifest", "seq", "name", "version", "source"]


def lines_of(files: DataFrame, name: str) -> DataFrame:
    """Lines of one kind of manifest at project roots."""
    return files.filter((F.col("name") == name) & (F.col("path") == name)).select("project_id", F.col("name").alias("manifest"), F.posexplode(F.split("content", "\r?\n")).alias("seq", "raw")).withColumn("line", F.regexp_replace("raw", r"^\s+|\s+$", ""))


def rows_of(lines: DataFrame, name: Column, version: Column, source: str) -> DataFrame:
    found = lines.select("project_id", "manifest", "seq", name.alias("name"), F.nullif(version, F.lit("")).alias("version"), F.lit(source).alias("source"))
    return found.filter("name is not null and name <> ''")


def carried(lines: DataFrame, mark: Column) -> DataFrame:
    """Lines with the last mark before or on them, per file."""
    w = Window.partitionBy("project_id", "manifest").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("section", F.last(mark, ignorenulls=True).over(w))


def requirements(files: DataFrame) -> DataFrame:
    lines = lines_of(files, "requirements.txt")
    line = F.trim(F.element_at(F.split("line", "#", 2), 1))
    kept = lines.filter((F.col("line") != "") & ~F.col("line").rlike(r"^(#|-r|-e|-f)")).withColumn("line", line)
    pattern = r"^([a-zA-Z0-9_-]+)([><=!~]+)?([0-9.]+.*)?"
    return rows_of(kept, F.regexp_extract("line", pattern, 1), F.regexp_extract("line", pattern, 3), "pip")


def key_values(files: DataFrame, manifest: str, sections: list[str], source: str, skipped: tuple[str, ...] = ()) -> DataFrame:
    """``key = value`` lines in some sections of a TOML file; inline tables stay text."""
    lines = carried(lines_of(files, manifest), F.when(F.col("line").startswith("["), F.col("line")))
    kept = lines.filter(F.col("section").isin(sections) & F.col("line").contains("=") & ~F.col("line").startswith("#") & ~F.col("line").startswith("["))
    name = F.trim(F.element_at(F.split("line", "=", 2), 1))
    value = F.regexp_replace(F.trim(F.element_at(F.split("line", "=", 2), 2)), "^[\"']+|[\"']+$", "")
    rows = rows_of(kept, F.regexp_replace(name, "^[\"']+|[\"']+$", ""), value, source)
    return rows.filter(~F.col("name").isin(list(skipped))) if skipped else rows


def package_json(files: DataFrame) -> DataFrame:
    spec = F.from_json("content", "dependencies map<string,string>, devDependencies map<string,string>")
    rows = files.filter((F.col("name") == "package.json") & (F.col("path") == "package.json")).select("project_id", F.col("name").alias("manifest"), spec.alias("s"))
    entries = lambda m: F.coalesce(F.map_entries(m), F.array().cast("array<struct<key:string,value:string>>"))
    both = rows.select("project_id", "manifest", F.posexplode(F.concat(entries(F.col("s.dependencies")), entries(F.col("s.devDependencies")))).alias("seq", "e"))
    return rows_of(both, F.col("e.key"), F.col("e.value"), "npm")


def go_mod(files: DataFrame) -> DataFrame:
    lines = lines_of(files, "go.mod")
    lines = carried(lines, F.when(F.col("line").rlike(r"^require\s*\("), "in").when(F.col("line").startswith(")"), "out"))
    inside = (F.col("section") == "in") & ~F.col("line").rlike(r"^require\b|^//") & (F.col("line") != "")
    line = F.when(F.col("line").rlike(r"^require\s+[^\s(]"), F.regexp_replace("line", r"^require\s+", "")).when(inside, F.col("line"))
    kept = lines.withColumn("entry", line).filter("entry is not null")
    return rows_of(kept, F.regexp_extract("entry", r"^(\S+)\s+\S+", 1), F.regexp_extract("entry", r"^\S+\s+(\S+)", 1), "go")


def dependencies(files: DataFrame) -> DataFrame:
    """All manifests' dependencies; the first of each name and source stays."""
    parts = [
        requirements(files), key_values(files, "pyproject.toml", ["[tool.poetry.dependencies]", "[project.dependencies]"], "pip", ("python",)),
        package_json(files), go_mod(files), key_values(files, "Cargo.toml", ["[dependencies]"], "cargo"),
    ]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    order = F.create_map(*(F.lit(x) for i, m in enumerate(MANIFESTS) for x in (m, i)))[F.col("manifest")]
    first = F.row_number().over(Window.partitionBy("project_id", "name", "source").orderBy(order, "seq"))
    return rows.withColumn("_k", first).filter("_k = 1").select(COLUMNS)
