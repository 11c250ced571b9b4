"""The step that a model takes: a table function from files to answers, and prompts for it.

No network is used here: the model is a function that is handed in, by default a
deterministic one that answers from patterns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ANSWER = "file string, language string, response string, provider string, error string"
# Weakness number, severity and category of each kind of problem.
WEAKNESSES = {
    "sql_injection": "CWE-89", "xss": "CWE-79", "csrf": "CWE-352", "authentication_bypass": "CWE-287", "authorization_failure": "CWE-285", "data_validation": "CWE-20", "sensitive_data_exposure": "CWE-200",
    "insecure_crypto": "CWE-327", "code_injection": "CWE-94", "path_traversal": "CWE-22", "buffer_overflow": "CWE-120", "race_condition": "CWE-362", "privilege_escalation": "CWE-269",
}
SEVERITIES = {
    "sql_injection": "high", "xss": "medium", "csrf": "medium", "authentication_bypass": "critical", "authorization_failure": "high", "data_validation": "medium", "sensitive_data_exposure": "high", "insecure_crypto": "high",
    "code_injection": "critical", "path_traversal": "high", "buffer_overflow": "critical", "race_condition": "medium", "privilege_escalation": "critical", "session_management": "medium", "error_handling": "low",
}
CATEGORIES = {
    "sql_injection": "A03:2021 – Injection", "xss": "A03:2021 – Injection", "authentication_bypass": "A07:2021 – Identification and Authentication Failures", "authorization_failure": "A01:2021 – Broken Access Control",
    "sensitive_data_exposure": "A02:2021 – Cryptographic Failures", "insecure_crypto": "A02:2021 – Cryptographic Failures", "code_injection": "A03:2021 – Injection", "path_traversal": "A01:2021 – Broken Access Control",
}


def looked_up(kind: Column, values: dict[str, str]) -> Column:
    """The value of a kind of problem, null for one that isn't listed."""
    return F.create_map(*(F.lit(x) for kv in values.items() for x in kv))[kind]


def classified(findings: DataFrame) -> DataFrame:
    """Findings with weakness number, usual severity and category of their kind."""
    kind = F.lower("type")
    return findings.withColumns({"cwe": looked_up(kind, WEAKNESSES), "usual_severity": looked_up(kind, SEVERITIES), "category": looked_up(kind, CATEGORIES)})


def prompt(template: str, **columns: Column) -> Column:
    """A template with ``{name}`` filled from columns; unknown names stay as they are."""
    out = F.lit(template)
    for name, value in columns.items():
        out = F.replace(out, F.lit(f"{{{name}}}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def template_variables(template: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(template, F.lit(r"\{(\w+)\}"), F.lit(1)))


def template_problems(template: Column, declared: Column) -> Column:
    """(undeclared, unused) variables of a template."""
    used = template_variables(template)
    return F.struct(F.array_except(used, declared).alias("undeclared"), F.array_except(declared, used).alias("unused"))


def quiet(prompt_text: str) -> str:
    """The default model: nothing is found."""
    return '```json\n{"findings": []}\n```'


def analyse(files: DataFrame, *providers: tuple[str, Callable[[str], str]]) -> DataFrame:
    """An answer for each file (path, language, prompt); the next provider is asked if one fails.

    Files that no provider answers give a row with the last error and no answer.
    """
    asked = providers or (("quiet", quiet),)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, language, text in zip(pdf["path"], pdf["language"], pdf["prompt"]):
                row = (path, language, None, None, "no provider")
                for name, ask in asked:
                    try:
                        row = (path, language, ask(text), name, None)
                        break
                    except Exception as e:  # a provider may fail in any way; the row says how
                        row = (path, language, None, name, f"{type(e).__name__}: {e}")
                rows.append(row)
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in ANSWER.split(", ")])

    return files.select("path", "language", "prompt").mapInPandas(run, ANSWER)


def provider_order(providers: DataFrame, preferred: str | None, by: str = "cost") -> DataFrame:
    """Providers (name, cost, performance, ord): the preferred one first, then by a weight, then as listed."""
    first = F.when(F.col("name") == preferred, 0).otherwise(1) if preferred else F.lit(1)
    return providers.orderBy(first, F.col(by), "ord")


def random_order(providers: DataFrame, seed: int) -> DataFrame:
    """Providers in an order that a seed draws."""
    return providers.orderBy(F.xxhash64(F.lit(seed), "name"), "name")
