"""Collects the queries of the query modules with their SQL."""

from __future__ import annotations

from siltstone.plans import engine_queries, interval_queries, reduction_queries, rule_queries, state_queries

_MODULES = (reduction_queries, engine_queries, interval_queries, state_queries, rule_queries)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
