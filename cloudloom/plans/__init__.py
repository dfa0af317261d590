"""Registered queries and their SQL."""

from . import files, grids, models, neighbors, points
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "files", "grids", "models", "neighbors", "points"]
