"""All queries of the library and their SQL."""

from __future__ import annotations

from quartermill.plans import choice_queries, evidence_queries, extract_queries, range_queries, rules_queries, series_queries, structure_queries, text_queries

_PARTS = (series_queries, structure_queries, text_queries, extract_queries, choice_queries, rules_queries, evidence_queries, range_queries)
QUERIES = {k: v for part in _PARTS for k, v in part.QUERIES.items()}
ORACLES = {k: v for part in _PARTS for k, v in part.ORACLES.items()}
