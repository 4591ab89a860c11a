"""Every query of the library, with its oracle SQL."""

from __future__ import annotations

from . import compliance_queries, document_queries, export_queries, layout_queries, page_queries, record_queries, rule_queries, structure_queries, tree_queries, value_queries  # noqa: F401  they register themselves
from .base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
