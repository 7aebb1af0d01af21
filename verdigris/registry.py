"""All queries of the engine and the SQL that gives the same rows."""

from .plans.queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
