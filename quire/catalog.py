"""All queries of the core, and SQL for those that SQL can express."""

from __future__ import annotations

from .plans import alignment, checks, findings, lexicons, metrics, segments, sequences, structures
from .plans.registry import Query

MODULES = (segments, lexicons, findings, alignment, structures, metrics, sequences, checks)


def queries() -> dict[str, Query]:
    return {name: q for module in MODULES for name, (q, _) in module.catalogue.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, (_, sql) in module.catalogue.items() if sql}
