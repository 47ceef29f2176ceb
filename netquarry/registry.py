"""Registered queries and their SQL, gathered from the modules of ``plans``."""

from __future__ import annotations

from .plans import discover, files, formats, labels, layout, names, polygons, raster, samples, stats  # noqa: F401
from .plans.base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
