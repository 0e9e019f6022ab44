"""Queries of the training-data operators, and their SQL."""

from __future__ import annotations

from sitewright.llm import guide_queries, text_queries

_MODULES = (guide_queries, text_queries)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
SQL = {name: text for module in _MODULES for name, text in module.SQL.items()}
