"""All scene queries by name, with the SQL that gives the same rows."""

from __future__ import annotations

from . import contract_queries, derived_queries, graph_queries, pair_queries, pose_queries, registry_queries, rule_queries, storage_queries
from .base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "contract_queries", "derived_queries", "graph_queries", "pair_queries", "pose_queries", "registry_queries", "rule_queries", "storage_queries"]
