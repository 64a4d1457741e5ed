"""Queries over the driver's tables, one for each operator, with the SQL that says the same."""

from . import catalogue, controls, lineage_runs, movement, profiles, relations, series, tools  # noqa: F401
from .catalogue import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
