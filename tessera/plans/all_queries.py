"""Importing the modules of queries registers them."""

from . import audit_queries, graph_queries, index_queries, knowledge_queries, more_queries, reasoning_queries, relational_queries, retrieval_queries, search_queries, stream_queries, text_queries, vector_queries  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
