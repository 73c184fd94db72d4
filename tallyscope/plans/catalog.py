"""All registered queries and their SQL twins."""

from __future__ import annotations

from tallyscope.plans import data_queries, finance_queries, journal_queries, universe_queries
from tallyscope.plans.finance_queries import screen_candidates

_MODULES = (finance_queries, data_queries, universe_queries, journal_queries)

QUERIES = {name: build for module in _MODULES for name, build in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}

__all__ = ["ORACLES", "QUERIES", "screen_candidates"]
