"""Registered queries: one per operator, each over the whole given tables, with SQL to check it."""

from .registry import ORACLES, QUERIES
from . import series, cross_section, sources_joins, scoring, checks, portfolio, records  # noqa: F401

__all__ = ["QUERIES", "ORACLES"]
