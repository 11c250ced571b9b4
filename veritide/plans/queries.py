"""All registered queries of the audit engine."""

from veritide.plans import audit, content, relational, stateful
from veritide.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "audit", "content", "relational", "stateful"]
