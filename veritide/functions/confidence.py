"""Confidence of findings: six factors, their weighted sum, risk level and reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritide.functions.patterns import any_of

# How often reports of a type proved false.
FALSE_RATES = {"SQL注入": 0.85, "权限验证绕过": 0.75, "XSS攻击": 0.60, "命令注入": 0.40, "路径遍历": 0.50, "硬编码密钥": 0.20, "弱加密算法": 0.30}
# How far a framework protects against a type.
PROTECTIONS = {
    "spring_data_jpa": {"SQL注入": 0.95, "权限验证绕过": 0.0},
    "mybatis": {"SQL注入": 0.5},
    "spring_security": {"权限验证绕过": 0.90, "CSRF攻击": 0.85},
    "django": {"SQL注入": 0.90, "XSS攻击": 0.80, "CSRF攻击": 0.90},
}
# Patterns of safe and of dangerous code by type, and words that show branching.
SAFE = {"SQL注入": [r"@Query.*\?\d+", r"@Query.*:\w+", r"#\{[^}]+\}", r"\.objects\.", r"findBy\w+Like"], "权限验证绕过": ["@PreAuthorize", "@Secured", "SecurityContext", "@login_required"]}
DANGEROUS = {"SQL注入": [r"\$\{[^}]+\}", r"String.*\+.*sql", r"execute\s*\(\s*[\"'].*\+"]}
BRANCHING = ["if", "for", "while", "try", "catch", "switch"]
# Weights, in the order in which they are summed.
WEIGHTS = {"framework_protection": 0.25, "architecture_appropriateness": 0.20, "code_complexity": 0.15, "pattern_reliability": 0.20, "context_completeness": 0.10, "historical_accuracy": 0.10}


def framework_factor(kind: Column, frameworks: Column) -> Column:
    """Product of what each detected framework leaves; ``frameworks`` is an array of names."""
    out = F.lit(1.0)
    for name, rates in PROTECTIONS.items():
        left = F.lit(1.0)
        for t, rate in rates.items():
            left = F.when(kind == t, 1 - rate).otherwise(left)
        out = out * F.when(F.coalesce(F.array_contains(frameworks, name), F.lit(False)), left).otherwise(1.0)
    return out


def architecture_factor(kind: Column, layer: Column) -> Column:
    return F.when((layer == "dao") & kind.contains("权限"), 0.2).when((layer == "entity") & kind.contains("SQL注入"), 0.3).otherwise(1.0)


def n_lines(snippet: Column) -> Column:
    return F.size(F.split(snippet, "\n"))


def branching(snippet: Column) -> Column:
    total = F.lit(0).cast("double")
    for w in BRANCHING:
        total = total + F.regexp_count(snippet, F.lit(w)) * F.lit(0.1)
    return total


def complexity_factor(snippet: Column) -> Column:
    return F.when(n_lines(snippet) < 3, 0.8).otherwise(1.0) * F.when(branching(snippet) < 0.2, 0.9).otherwise(1.0)


def matching(kind: Column, snippet: Column, patterns: dict[str, list[str]]) -> Column:
    return any_of([(kind == t) & any_of([snippet.rlike(p) for p in some]) for t, some in patterns.items()])


def pattern_factor(kind: Column, snippet: Column) -> Column:
    return F.when(matching(kind, snippet, SAFE), 0.2).otherwise(1.0) * F.when(matching(kind, snippet, DANGEROUS), 1.5).otherwise(1.0)


def context_factor(call_chain: Column, tech_stack: Column, security_config: Column) -> Column:
    there = lambda c: F.coalesce(c, F.lit(False))
    return F.when(there(call_chain), 1.0).otherwise(0.9) * F.when(there(tech_stack), 1.0).otherwise(0.9) * F.when(there(security_config), 1.0).otherwise(0.95)


def history_factor(kind: Column, rates: dict[str, float] | None = None) -> Column:
    out = F.lit(1.0)
    for t, rate in (rates or FALSE_RATES).items():
        out = F.when(kind == t, 1 - rate * 0.5).otherwise(out)
    return out


def final_score(factors: dict[str, Column]) -> Column:
    total = None
    for name, weight in WEIGHTS.items():
        part = factors[name] * F.lit(weight)
        total = part if total is None else total + part
    return F.greatest(F.lit(0.1), F.least(F.lit(1.0), total))


def risk_level(score: Column) -> Column:
    return F.when(score >= 0.8, "high").when(score >= 0.6, "medium").when(score >= 0.4, "low").otherwise("very_low")


def scored(findings: DataFrame) -> DataFrame:
    """Findings with factors, confidence, risk level and reasons.

    Reads type, code_snippet, layer, frameworks (array), call_chain, tech_stack and
    security_config (booleans: is it known). Missing ones of these columns count as
    unknown, null text as empty.
    """
    have = set(findings.columns)
    col = lambda c, default: F.coalesce(F.col(c), default) if c in have else default
    kind, snippet, layer = col("type", F.lit("")), col("code_snippet", F.lit("")), col("layer", F.lit("unknown"))
    frameworks = col("frameworks", F.array().cast("array<string>"))
    known = [col(c, F.lit(False)) for c in ("call_chain", "tech_stack", "security_config")]
    factors = {
        "framework_protection": framework_factor(kind, frameworks), "architecture_appropriateness": architecture_factor(kind, layer), "code_complexity": complexity_factor(snippet),
        "pattern_reliability": pattern_factor(kind, snippet), "context_completeness": context_factor(*known), "historical_accuracy": history_factor(kind),
    }
    rows = findings.withColumn("confidence_factors", F.struct(*(c.alias(n) for n, c in factors.items())))
    rows = rows.withColumn("confidence", final_score({n: F.col(f"confidence_factors.{n}") for n in factors}))
    reasons = [
        F.when(F.col("confidence_factors.framework_protection") < 1, F.lit("framework protection")), F.when(F.col("confidence_factors.architecture_appropriateness") < 1, F.lit("layer isn't responsible")),
        F.when(n_lines(snippet) < 3, F.format_string("short snippet (%d lines)", n_lines(snippet))), F.when(branching(snippet) < 0.2, F.lit("little branching")),
        F.when(matching(kind, snippet, SAFE), F.lit("safe pattern")), F.when(matching(kind, snippet, DANGEROUS), F.lit("dangerous pattern")),
        *(F.when(~k, F.lit(f"no {n}")) for k, n in zip(known, ("call chain", "technology stack", "security configuration"))), F.when(history_factor(kind) < 1, F.lit("often false in the past")),
    ]
    return rows.withColumns({"risk_level": risk_level(F.col("confidence")), "confidence_reasoning": F.array_compact(F.array(*reasons))})


def moving_false_rate(was_false: Column, start: float = 0.5) -> Column:
    """A type's rate after an ordered array of outcomes: each step keeps nine tenths, within 0.1 and 0.9."""
    step = lambda r, x: F.greatest(F.lit(0.1), F.least(F.lit(0.9), r * 0.9 + F.when(x, 0.1).otherwise(0.0)))
    return F.aggregate(was_false, F.lit(start), step)
