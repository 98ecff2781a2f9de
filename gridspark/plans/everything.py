"""Loads every module of queries."""

from __future__ import annotations

from gridspark.plans import catalogue, coords, curvilinear, extract, stats, timeaxis
from gridspark.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "catalogue", "coords", "curvilinear", "extract", "stats", "timeaxis"]
