"""Registered queries: every operator run over the given tables, with an equal SQL text where SQL can say it."""

from mesograph.queries.registry import all_queries, all_sql

__all__ = ["all_queries", "all_sql"]
