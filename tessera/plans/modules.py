"""Imports every plan module, so that its queries are registered."""

from tessera.plans import graph_queries, law_queries, more_queries, reading_queries, time_queries  # noqa: F401
