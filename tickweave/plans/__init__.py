"""Registered queries: the operators applied to tables, and the SQL that gives the same rows."""

from .registry import oracles, queries

__all__ = ["oracles", "queries"]
