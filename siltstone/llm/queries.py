"""The queries of the subpackage with their SQL."""

from __future__ import annotations

from siltstone.llm import (
    decontamination,
    licenses,
    lm_scoring,
    mixing,
    near_duplicates,
    quality_classifier,
    quality_rules,
    repeated_passages,
    sharding,
    token_counts,
)

_MODULES = (token_counts, lm_scoring, sharding, licenses, quality_rules, repeated_passages, mixing, quality_classifier, near_duplicates, decontamination)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
