"""Prompt templates and weakness lists as small tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritide.operators.analysis import template_problems, template_variables

TEMPLATE = "name string, type string, version int, text string, variables array<string>"
# Categories of standards and the weakness numbers in them.
STANDARDS = {
    "OWASP": {
        "A01_Broken_Access_Control": ["CWE-22", "CWE-284", "CWE-862"], "A02_Cryptographic_Failures": ["CWE-327", "CWE-328", "CWE-329"], "A03_Injection": ["CWE-79", "CWE-89", "CWE-78"],
        "A04_Insecure_Design": ["CWE-209", "CWE-256", "CWE-501"], "A05_Security_Misconfiguration": ["CWE-16", "CWE-2", "CWE-11"], "A06_Vulnerable_Components": ["CWE-1104", "CWE-937"],
        "A07_Auth_Failures": ["CWE-287", "CWE-384", "CWE-613"], "A08_Integrity_Failures": ["CWE-502", "CWE-829"], "A09_Logging_Failures": ["CWE-778", "CWE-117"], "A10_SSRF": ["CWE-918"],
    },
    "CWE-25": {
        "Input_Validation": ["CWE-20", "CWE-79", "CWE-89"], "Memory_Safety": ["CWE-125", "CWE-787", "CWE-476"], "Access_Control": ["CWE-862", "CWE-863", "CWE-269"],
        "Path_Traversal": ["CWE-22", "CWE-434"], "Command_Injection": ["CWE-78", "CWE-77"], "Cryptographic": ["CWE-327", "CWE-330"],
    },
    "PCI": {"Data_Protection": ["CWE-311", "CWE-312", "CWE-319"], "Access_Control": ["CWE-284", "CWE-862", "CWE-863"], "Encryption": ["CWE-327", "CWE-328", "CWE-329"], "Logging": ["CWE-778", "CWE-117", "CWE-532"]},
    "GDPR": {"Data_Exposure": ["CWE-200", "CWE-209", "CWE-532"], "Access_Control": ["CWE-284", "CWE-862"], "Data_Integrity": ["CWE-345", "CWE-353"], "Privacy_Controls": ["CWE-359", "CWE-201"]},
}


def standards(spark: SparkSession) -> DataFrame:
    rows = [(s, k, c) for s, categories in STANDARDS.items() for k, some in categories.items() for c in some]
    return spark.createDataFrame(rows, "standard string, category string, cwe string")


def by_standard(findings: DataFrame) -> DataFrame:
    """Findings with a weakness number (cwe) under every standard that names it."""
    return findings.join(F.broadcast(standards(findings.sparkSession)), "cwe")


def with_variables(templates: DataFrame) -> DataFrame:
    return templates.withColumn("used", template_variables(F.col("text")))


def invalid(templates: DataFrame) -> DataFrame:
    """Templates whose declared variables aren't those in their texts, or without a name or text."""
    rows = templates.withColumn("problems", template_problems(F.col("text"), F.coalesce("variables", F.array().cast("array<string>"))))
    nameless = F.coalesce("name", F.lit("")) == ""
    return rows.filter(nameless | (F.coalesce("text", F.lit("")) == "") | (F.size("problems.undeclared") > 0) | (F.size("problems.unused") > 0))


def latest(templates: DataFrame) -> DataFrame:
    """The highest version of each name."""
    return templates.groupBy("name").agg(F.max(F.struct("version", "type", "text", "variables")).alias("t")).select("name", "t.type", "t.version", "t.text", "t.variables")


def added(templates: DataFrame, more: DataFrame) -> DataFrame:
    """Both, names in ``more`` going first."""
    return templates.join(more.select("name"), "name", "left_anti").unionByName(more)


def removed(templates: DataFrame, names: list[str]) -> DataFrame:
    return templates.filter(~F.col("name").isin(names)) if names else templates

