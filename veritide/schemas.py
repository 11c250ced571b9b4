"""Schemas of the tables that audits leave behind, and the checks their rows must pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILES = (
    "project_id string, path string, absolute_path string, name string, ext string, language string, size bigint, hash string, last_modified timestamp, content string, functions array<string>, classes array<string>, imports array<string>"
)
DEPENDENCIES = "project_id string, manifest string, seq int, name string, version string, source string, vulnerabilities array<string>"
FINDINGS = "file string, language string, type string, severity string, line int, description string, code_snippet string, impact string, recommendation string, confidence double"
USERS = "id bigint, username string, email string, role string, user_level string, daily_token_limit int, used_tokens_today int, is_active boolean, created_at timestamp, updated_at timestamp, last_login timestamp"
TOKEN_USAGE = "id bigint, user_id bigint, task_id bigint, tokens_consumed int, provider string, model_name string, cost decimal(10,4), created_at timestamp"
AUDIT_TASKS = "id bigint, user_id bigint, project_name string, description string, status string, config_params string, error_message string, total_files int, analyzed_files int, progress_percent decimal(5,2), created_at timestamp, started_at timestamp, completed_at timestamp"
AUDIT_RESULTS = "id bigint, task_id bigint, findings string, statistics string, summary string, high_issues int, medium_issues int, low_issues int, total_confidence decimal(5,2), created_at timestamp"
SYSTEM_LOGS = "id bigint, user_id bigint, action string, details string, ip_address string, user_agent string, created_at timestamp"
INVITATIONS = "id bigint, code string, user_level string, token_limit int, max_uses int, used_count int, is_active boolean, expires_at timestamp, created_at timestamp, created_by bigint, description string"
EXPORT_CONFIGS = "id bigint, user_level string, allowed_formats string, max_exports_per_day bigint, max_file_size_mb double, description string, is_active boolean"
EXPORT_LOGS = "id bigint, user_id bigint, task_id bigint, export_format string, file_size_mb double, export_status string, blocked_reason string, created_at timestamp"
USER_EXPORTS = "id bigint, user_id bigint, allowed_formats string, max_exports_per_day bigint, max_file_size_mb double, description string, is_active boolean"

# What a valid row fulfils, by kind of row.
VALID: dict[str, dict[str, str]] = {
    "file": {"path": "path is not null and path <> ''", "size": "size >= 0"},
    "dependency": {"name": "name is not null and name <> ''", "source": "source is not null and source <> ''"},
    "project": {"name": "name is not null and name <> ''"},
    "module": {"name": "name is not null and name <> ''"},
    "finding": {"confidence": "confidence is null or (confidence >= 0 and confidence <= 1)", "line": "line is null or line > 0"},
    "call": {"depth": "depth > 0"},
}


def violations(kind: str) -> Column:
    """Names of the rules of ``kind`` that a row breaks; a null outcome breaks the rule."""
    rules = [F.when(~F.coalesce(F.expr(rule), F.lit(False)), F.lit(name)) for name, rule in VALID[kind].items()]
    return F.array_compact(F.array(*rules))


def quarantine(rows: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rows that break a rule with the rules' names)."""
    checked = rows.withColumn("violations", violations(kind))
    return checked.filter(F.size("violations") == 0).drop("violations"), checked.filter(F.size("violations") > 0)
