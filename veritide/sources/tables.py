"""Tables in and out: Parquet, JDBC, JSON and Markdown reports, and the response cache."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def parquet(spark: SparkSession, folder: str, *names: str) -> dict[str, DataFrame]:
    """Tables of a folder, also as temporary views."""
    found = {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in names}
    for name, rows in found.items():
        rows.createOrReplaceTempView(name)
    return found


def jdbc(spark: SparkSession, url: str, name: str, column: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 32, **options: str) -> DataFrame:
    """A database table, read in parts by a numeric column if one is given."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=name, **options)
    if column and bounds:
        reader = reader.options(partitionColumn=column, lowerBound=str(bounds[0]), upperBound=str(bounds[1]), numPartitions=str(parts))
    return reader.load()


def append(rows: DataFrame, path: str, by: str | None = None) -> None:
    writer = rows.write.mode("append")
    (writer.partitionBy(by) if by else writer).parquet(path)


def json_report(findings: DataFrame, path: str) -> None:
    """One JSON object a line."""
    findings.write.mode("overwrite").json(path)


def cache_key(*parts: Column) -> Column:
    """Digest of parts with bars between; a null part counts as empty."""
    return F.md5(F.concat_ws("|", *(F.coalesce(p, F.lit("")) for p in parts)).cast("binary"))


def from_cache(requests: DataFrame, cache: DataFrame, as_of: str, hours: int = 24) -> tuple[DataFrame, DataFrame]:
    """(requests with answers that haven't expired, requests that must be made)."""
    fresh = cache.filter(F.col("cached_at") + F.expr(f"interval {hours} hours") >= F.lit(as_of).cast("timestamp_ntz"))
    return requests.join(fresh.select("key", "response"), "key"), requests.join(fresh.select("key"), "key", "left_anti")


def cache_stats(cache: DataFrame, as_of: str, hours: int = 24) -> DataFrame:
    old = F.col("cached_at") + F.expr(f"interval {hours} hours") < F.lit(as_of).cast("timestamp_ntz")
    return cache.agg(F.count("*").alias("total"), F.count(F.when(old, 1)).alias("expired"), F.count(F.when(~old, 1)).alias("valid"), F.round(F.sum(F.octet_length("response")) / 1048576, 2).alias("size_mb"))


def report_lines(findings: DataFrame, *key: str) -> DataFrame:
    """A Markdown report as rows: section 0 counts by severity, then each file's findings, numbered.

    Findings are ordered by line, type, severity and the given key; only equal ones are interchangeable.
    """
    severity = F.coalesce("severity", F.lit("unknown"))
    head = findings.groupBy(severity.alias("s")).agg(F.count("*").alias("n")).select(F.lit(0).alias("section"), F.lit("").alias("file"), F.lit(0).alias("number"), F.concat(F.lit("- "), "s", F.lit(": "), F.col("n").cast("string")).alias("text"))
    nth = F.row_number().over(Window.partitionBy("file").orderBy("line", "type", severity, *(key or ("description",) * ("description" in findings.columns))))
    text = F.format_string("%d. [%s] %s (line %d)", F.col("number"), severity, F.col("type"), F.col("line"))
    body = findings.withColumn("number", nth).select(F.lit(1).alias("section"), "file", "number", text.alias("text"))
    return head.unionByName(body)


def html_text(text: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(sign), F.lit(name))
    return text


def html_report(findings: DataFrame, path: str, *key: str) -> None:
    """The same report as list items of one HTML text; texts are escaped."""
    lines = report_lines(findings, *key)
    item = F.when(F.col("number") == 1, F.concat(F.lit("<h2>"), html_text(F.col("file")), F.lit("</h2>\n"))).otherwise("")
    rows = lines.select("section", "file", "number", F.concat(item, F.lit("<p>"), html_text(F.col("text")), F.lit("</p>")).alias("value"))
    rows.orderBy("section", "file", "number", "value").select("value").write.mode("overwrite").text(path)


def markdown_report(findings: DataFrame, path: str, *key: str) -> None:
    lines = report_lines(findings, *key).orderBy("section", "file", "number", "text")
    lines.select("text").write.mode("overwrite").text(path)
