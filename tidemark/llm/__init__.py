"""Operators for preparing training text: token files, deduplication, scans, counts, shards, filters, packing.

Nothing else in the library imports this subpackage. ``queries`` and ``oracle_sql`` list what it registers.
"""

from tidemark.llm.registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
