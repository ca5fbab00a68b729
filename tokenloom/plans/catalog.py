"""All queries of the core, and the SQL they are held against."""

from __future__ import annotations

from tokenloom.plans import feature_queries, pipeline_queries, skew_queries, token_queries, vector_queries

_MODULES = (feature_queries, vector_queries, token_queries, pipeline_queries, skew_queries)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
SQL = {name: text for module in _MODULES for name, text in module.SQL.items()}

FLAGSHIP = "discriminative_features"
