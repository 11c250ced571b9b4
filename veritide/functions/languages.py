"""Languages and file types: by extension, name, first line and content."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veritide.functions.patterns import any_of, name_of, regex, suffix_of
from veritide.functions.prefilter import lowered, might

# Supported languages.
SUPPORTED = ["python", "javascript", "typescript", "java", "go", "rust", "cpp", "c", "csharp", "php", "ruby", "kotlin", "swift", "scala"]
# Languages by extension.
EXTENSIONS = {
    ".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript", ".java": "java", ".go": "go", ".rs": "rust",
    ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".c": "c", ".cs": "csharp", ".php": "php", ".rb": "ruby", ".kt": "kotlin", ".swift": "swift", ".scala": "scala",
    ".css": "css", ".scss": "css", ".sass": "css", ".less": "css", ".html": "html", ".htm": "html", ".xml": "xml", ".json": "json",
}
# Names that tell a language, in order.
NAMES = {
    "python": ["setup.py", "manage.py", "__init__.py"],
    "javascript": ["package.json", "webpack.config.js", "gulpfile.js"],
    "typescript": ["tsconfig.json"],
    "java": ["pom.xml", "build.gradle"],
    "go": ["go.mod", "go.sum"],
    "rust": ["Cargo.toml", "Cargo.lock"],
    "cpp": ["CMakeLists.txt", "Makefile"],
    "csharp": ["*.csproj", "*.sln"],
    "php": ["composer.json", "composer.lock"],
    "ruby": ["Gemfile", "Gemfile.lock", "Rakefile"],
}
# First lines that tell a language, in order.
FIRST_LINES = {"python": r"#!/.*python[0-9.]*", "javascript": r"#!/.*node", "ruby": r"#!/.*ruby", "php": r"#!/.*php", "go": r"#!/.*go"}
# What sources of a language contain, in order.
CONTENT = {
    "python": [r"import\s+\w+", r"from\s+\w+\s+import", r"def\s+\w+\s*\(", r"class\s+\w+\s*\(", r"if\s+__name__\s*==\s*[\"']__main__[\"']"],
    "javascript": [r"function\s+\w+\s*\(", r"var\s+\w+\s*=", r"let\s+\w+\s*=", r"const\s+\w+\s*=", r"require\s*\(", r"module\.exports", r"export\s+(default\s+)?"],
    "typescript": [r"interface\s+\w+", r"type\s+\w+\s*=", r":\s*(string|number|boolean|any)", r"export\s+(interface|type|class)", r"import.*from\s+[\"'].*[\"']"],
    "java": [r"public\s+class\s+\w+", r"private\s+\w+\s+\w+", r"public\s+static\s+void\s+main", r"import\s+java\.", r"package\s+\w+"],
    "go": [r"package\s+\w+", r"import\s+\(", r"func\s+\w+\s*\(", r"type\s+\w+\s+struct", r"var\s+\w+\s+\w+"],
    "rust": [r"fn\s+\w+\s*\(", r"let\s+\w+\s*=", r"struct\s+\w+", r"impl\s+\w+", r"use\s+\w+", r"extern\s+crate"],
    "cpp": [r"#include\s*<.*>", r"#include\s*\".*\"", r"using\s+namespace", r"class\s+\w+", r"int\s+main\s*\(", r"std::"],
    "c": [r"#include\s*<.*\.h>", r"int\s+main\s*\(", r"printf\s*\(", r"malloc\s*\(", r"typedef\s+struct"],
    "csharp": [r"using\s+System", r"namespace\s+\w+", r"public\s+class\s+\w+", r"static\s+void\s+Main", r"Console\.WriteLine"],
    "php": [r"<\?php", r"\$\w+\s*=", r"function\s+\w+\s*\(", r"class\s+\w+", r"echo\s+", r"require_once"],
    "ruby": [r"def\s+\w+", r"class\s+\w+", r"require\s+[\"']", r"puts\s+", r"end\s*$", r"@\w+\s*="],
    "kotlin": [r"fun\s+\w+\s*\(", r"class\s+\w+", r"val\s+\w+\s*=", r"var\s+\w+\s*=", r"package\s+\w+"],
    "swift": [r"func\s+\w+\s*\(", r"class\s+\w+", r"var\s+\w+\s*=", r"let\s+\w+\s*=", r"import\s+\w+"],
    "scala": [r"object\s+\w+", r"class\s+\w+", r"def\s+\w+\s*\(", r"val\s+\w+\s*=", r"var\s+\w+\s*=", r"import\s+\w+"],
}
# Folders of architecture layers, in order.
LAYERS = {
    "controller": ["controller", "rest", "api", "endpoint"],
    "service": ["service", "business", "logic"],
    "dao": ["dao", "repository", "mapper", "model"],
    "entity": ["entity", "domain", "pojo"],
    "config": ["config"],
}
READ = 10_240


def by_extension(name: Column) -> Column:
    pairs = [F.lit(x) for kv in EXTENSIONS.items() for x in kv]
    return F.create_map(*pairs)[suffix_of(name)]


def first_case(cases: list[tuple[Column, str]]) -> Column:
    out = None
    for condition, value in cases:
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out


def by_name(name: Column) -> Column:
    return first_case([(any_of([F.lower(name).endswith(x.lower()) for x in names]), lang) for lang, names in NAMES.items()])


def by_first_line(content: Column) -> Column:
    line = F.element_at(F.split(content, "\n", 2), 1)
    return F.when(line.startswith("#!"), first_case([(line.rlike(regex(p, ignore_case=True)), lang) for lang, p in FIRST_LINES.items()]))


def content_hits(content: Column, language: str) -> Column:
    """Matches of the language's patterns; one runs only where all its plain pieces are. Equal terms of several languages are evaluated once."""
    head = F.substring(content, 1, READ)

    def hits(pattern: str) -> Column:
        n, there = F.regexp_count(head, F.lit(regex(pattern, ignore_case=True, multiline=True))), might(lowered(head), pattern)
        return n if there is None else F.when(there, n).when(head.isNotNull(), 0)

    return sum((hits(p) for p in CONTENT[language]), F.lit(0))


def by_content(content: Column) -> Column:
    """Most hits, two at least; ties to the language listed first."""
    hits = F.array(*(F.struct(content_hits(content, lang).alias("n"), F.lit(-i).alias("o"), F.lit(lang).alias("lang")) for i, lang in enumerate(CONTENT)))
    best = F.array_max(hits)
    return F.when(best["n"] >= 2, best["lang"])


def detect(name: Column, content: Column) -> Column:
    """Supported extension, name, first line, content, any known extension."""
    ext = by_extension(name)
    return F.coalesce(F.when(ext.isin(SUPPORTED), ext), by_name(name), by_first_line(content), by_content(content), ext)


def confidences(name: Column, content: Column) -> Column:
    """Language -> score: 0.5 for the extension, 0.3 name, 0.8 first line, 0.1 a hit up to 0.7; the highest is 1 at most."""
    langs = list(dict.fromkeys([*CONTENT, *EXTENSIONS.values()]))

    def score(lang: str) -> Column:
        is_it = lambda c, w: F.when(c == lang, w).otherwise(0.0)
        hits = F.least(content_hits(content, lang) * 0.1, F.lit(0.7)) if lang in CONTENT else F.lit(0.0)
        return is_it(by_extension(name), 0.5) + is_it(by_name(name), 0.3) + is_it(by_first_line(content), 0.8) + hits

    rows = F.filter(F.array(*(F.struct(F.lit(x).alias("lang"), score(x).alias("score")) for x in langs)), lambda r: r["score"] > 0)
    top = F.greatest(F.lit(1.0), F.coalesce(F.array_max(F.transform(rows, lambda r: r["score"])), F.lit(0.0)))
    return F.map_from_entries(F.transform(rows, lambda r: F.struct(r["lang"], r["score"] / top)))


def layer(path: Column) -> Column:
    """The first layer of which a word is in the path."""
    low = F.lower(path)
    return F.coalesce(first_case([(any_of([low.contains(w) for w in words]), name) for name, words in LAYERS.items()]), F.lit("unknown"))


def is_frontend(path: Column, language: Column) -> Column:
    return path.rlike(r"(?i)\.(html?|jsx?|tsx?|vue|css|scss|less)$") | F.coalesce(F.lower(language).isin("html", "javascript", "typescript", "css"), F.lit(False))


def file_name(path: Column) -> Column:
    return name_of(path)
