"""Registered queries over the catalogue operators, with their DuckDB oracles."""

from lumenloom.plans import match_queries, name_queries, pipeline_queries, record_queries, route_queries, sequence_queries

QUERIES = {**sequence_queries.QUERIES, **name_queries.QUERIES, **match_queries.QUERIES, **route_queries.QUERIES, **pipeline_queries.QUERIES, **record_queries.QUERIES}
ORACLES = {**sequence_queries.ORACLES, **name_queries.ORACLES, **match_queries.ORACLES, **route_queries.ORACLES, **pipeline_queries.ORACLES, **record_queries.ORACLES}
