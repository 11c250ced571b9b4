"""Registered queries and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritide.session import ship

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


class Tables:
    """Tables of a folder, and audit tables derived from them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def users(self) -> DataFrame:
        return self.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("username"), F.col("c_mktsegment").alias("user_level"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"), (F.col("c_acctbal") > 0).alias("is_active"))

    def usage(self) -> DataFrame:
        return self.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"), F.col("o_totalprice").alias("tokens_consumed"), (F.col("o_totalprice") * 0.5).alias("cost"), F.col("o_orderpriority").alias("provider"), F.col("o_orderdate").alias("created_at"))

    def tasks(self) -> DataFrame:
        status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "pending").otherwise("P")
        return self.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"), status.alias("status"), F.col("o_orderdate").alias("created_at"), F.col("o_orderpriority").alias("priority_name"))

    def logs(self) -> DataFrame:
        return self.events.select(F.col("event_id").alias("id"), "user_id", F.col("event_type").alias("action"), F.col("props").alias("details"), F.col("ts").alias("created_at"), "value")

    def pages_with_path(self) -> DataFrame:
        return self.pages.select("page_id", "url", "html", F.regexp_extract("url", r"^[a-z]+://[^/]+/([^?#]*)", 1).alias("path"))

    def findings(self) -> DataFrame:
        """Finding rows made from documents: type by language, severity by length, snippet of three lines."""
        kind = F.when(F.col("lang") == "en", "SQL注入").when(F.col("lang") == "fr", "权限验证绕过").when(F.col("lang") == "de", "XSS攻击").otherwise("其他")
        severity = F.when(F.col("n_chars") > 4000, "high").when(F.col("n_chars") > 1000, "medium").when(F.col("n_chars") > 200, "low").otherwise("info")
        lines = F.split("text", "\n")
        layer = F.when(F.col("doc_id") % 3 == 0, "dao").when(F.col("doc_id") % 3 == 1, "entity").otherwise("unknown")
        return self.documents.select(
            "doc_id", F.concat(F.lit("src/"), F.col("source"), F.lit(".java")).alias("file"), kind.alias("type"), severity.alias("severity"), (F.col("doc_id") % 50 + 1).cast("int").alias("line"),
            F.array_join(F.slice(lines, 1, 3), "\n").alias("code_snippet"), F.col("text").alias("code"), F.element_at(lines, 1).alias("description"), layer.alias("layer"), F.lit("java").alias("language"), ((F.col("doc_id") % 11) / 10).alias("confidence"),
        )


def query(sql: str | None = None):
    """Register a function of Tables under its name, with SQL if it has an equal."""

    def register(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            ship(spark)
            return f(Tables(spark, folder))

        QUERIES[f.__name__] = run
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register
