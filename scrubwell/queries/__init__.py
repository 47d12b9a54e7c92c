"""Queries over the test tables, each with the SQL that says what it must return."""

from scrubwell.queries.catalog import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
