"""Registered queries over the given tables, each with the SQL that must give the same rows."""

from . import catalog_queries, history_queries, metadata_queries, scan_queries, shelf_queries, stream_queries
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "catalog_queries", "history_queries", "metadata_queries", "scan_queries", "shelf_queries", "stream_queries"]
