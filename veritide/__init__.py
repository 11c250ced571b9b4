"""Spark-first analytics engine for source-code audits and their operational data."""
