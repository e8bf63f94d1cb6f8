"""All queries over the reference's operators."""

from . import queries_links, queries_sources, queries_text, queries_traces, queries_views
from .register import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "queries_links", "queries_sources", "queries_text", "queries_traces", "queries_views"]
