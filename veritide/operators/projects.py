"""What a project is: its type, architecture, entry points, languages and summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veritide.functions.languages import SUPPORTED
from veritide.functions.patterns import any_of, name_of

# File names and folders that speak for a type, in order of types.
TYPES = {
    "web_application": ["package.json", "requirements.txt", "Gemfile", "composer.json", "app.py", "server.js", "index.html"],
    "api_service": ["openapi.yaml", "swagger.json", "api/", "routes/", "controllers/", "endpoints/"],
    "desktop_application": ["main.py", "main.java", "main.cpp", "Program.cs", "src/main/"],
    "library": ["setup.py", "pyproject.toml", "pom.xml", "build.gradle", "Cargo.toml", "package.json"],
    "microservice": ["Dockerfile", "docker-compose.yml", "kubernetes/", "k8s/", "helm/"],
}
WEB_DEPENDENCIES = ["flask", "django", "fastapi", "express", "react", "vue", "angular"]
API_DEPENDENCIES = ["fastapi", "flask-restful", "express", "gin", "actix-web"]
# Folders of architectures, in order.
ARCHITECTURES = {
    "MVC": ["models", "views", "controllers"],
    "MVP": ["models", "views", "presenters"],
    "MVVM": ["models", "views", "viewmodels"],
    "Clean Architecture": ["entities", "usecases", "adapters", "frameworks"],
    "Hexagonal": ["domain", "application", "infrastructure"],
    "Layered": ["presentation", "business", "data", "persistence"],
    "Microservices": ["services", "api", "gateway"],
    "Component-based": ["components", "modules", "widgets"],
}
# Entry points; names are compared in lower case, so those with capitals never match.
ENTRIES = ["main.py", "app.py", "server.py", "index.py", "run.py", "main.js", "app.js", "server.js", "index.js", "main.java", "Application.java", "Main.java", "main.go", "main.rs", "main.cpp", "main.c", "index.html", "index.php"]
WEB_ENTRIES = ["wsgi.py", "asgi.py", "manage.py", "app.py"]


def project_type(files: DataFrame, dependencies: DataFrame) -> DataFrame:
    """(project_id, project_type): +2 for a whole name, +1 for each name with the pattern in it, bonuses; ties to the first type."""
    low = F.lower("path")
    names = files.select("project_id", F.explode(F.array(low, name_of(low))).alias("name")).distinct()
    scores = []
    for kind, patterns in TYPES.items():
        hits = sum((F.when(F.col("name").contains(p.lower()), 1).otherwise(0) + F.when(F.col("name") == p.lower(), 2).otherwise(0) for p in patterns), F.lit(0))
        extra = {"library": F.when(F.max(F.col("name").isin("setup.py", "pyproject.toml")), 2).otherwise(0), "microservice": F.when(F.max(F.col("name").contains("docker")), 2).otherwise(0)}
        scores.append((F.sum(hits) + extra.get(kind, F.lit(0))).alias(kind))
    totals = names.groupBy("project_id").agg(*scores)
    deps = dependencies.groupBy("project_id").agg(F.max(F.lower("name").isin(WEB_DEPENDENCIES)).alias("web"), F.max(F.lower("name").isin(API_DEPENDENCIES)).alias("api"))
    rows = totals.join(deps, "project_id", "left")
    bonus = {"web_application": "web", "api_service": "api"}
    cases = F.array(*(F.struct((F.col(t) + (F.when(F.col(bonus[t]), 3).otherwise(0) if t in bonus else 0)).alias("n"), F.lit(-i).alias("o"), F.lit(t).alias("t")) for i, t in enumerate(TYPES)))
    best = F.array_max(cases)
    return rows.select("project_id", F.when(best["n"] > 0, best["t"]).otherwise("unknown").alias("project_type"))


def architecture(files: DataFrame) -> DataFrame:
    """(project_id, architecture): the first pattern with three fifths of its folders, a standard layout, or null."""
    parts = F.split(F.lower("path"), "/")
    folders = files.select("project_id", F.explode(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).alias("folder")).groupBy("project_id").agg(F.collect_set(F.when(F.col("folder").isin([x for xs in ARCHITECTURES.values() for x in xs] + ["src", "test"]), F.col("folder"))).alias("have"))
    out = None
    for name, needed in ARCHITECTURES.items():
        hit = F.size(F.array_intersect("have", F.array(*map(F.lit, needed)))) >= len(needed) * 0.6
        out = F.when(hit, name) if out is None else out.when(hit, name)
    out = out.when(F.array_contains("have", "src") & F.array_contains("have", "test"), "Standard Source Layout")
    return folders.select("project_id", out.alias("architecture"))


def entry_points(files: DataFrame, types: DataFrame) -> DataFrame:
    """Likely entry points, each once: by name first, then those of web applications."""
    rows = files.join(types, "project_id", "left")
    rank = F.when(F.lower(name_of(F.col("path"))).isin(ENTRIES), 0).when((F.col("project_type") == "web_application") & any_of([F.lower("path").contains(x) for x in WEB_ENTRIES]), 1)
    found = rows.withColumn("rank", rank).filter("rank is not null")
    return found.withColumn("n", F.row_number().over(Window.partitionBy("project_id").orderBy("rank", "path"))).select("project_id", "path", "n")


def summary(files: DataFrame) -> DataFrame:
    """Files, size, estimated lines and sorted supported languages of each project."""
    lines = F.greatest(F.lit(1).cast("long"), F.floor(F.col("size") / 50))
    return files.groupBy("project_id").agg(
        F.count("*").alias("n_files"), F.sum("size").alias("size"), F.sum(F.when(F.col("language").isNotNull() & (F.col("size") > 0), lines)).alias("total_lines"),
        F.sort_array(F.collect_set(F.when(F.col("language").isin(SUPPORTED), F.col("language")))).alias("languages"),
    )


def language_counts(files: DataFrame) -> DataFrame:
    return files.filter("language is not null and language <> ''").groupBy("language").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
