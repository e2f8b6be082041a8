"""All registered queries of the engine and the SQL each is compared with, over the driver's tables."""

from __future__ import annotations

from .plans import derived_queries, evidence_queries, search_queries, star_queries, unit_queries, view_queries

QUERIES: dict = {}
ORACLES: dict = {}
for module in (unit_queries, search_queries, evidence_queries, star_queries, derived_queries, view_queries):
    QUERIES |= module.QUERIES
    ORACLES |= module.ORACLES
