"""Registered queries over the driver's tables, each beside the SQL that gives the same rows where SQL can express it."""

from __future__ import annotations

from .plans import bands, filters_and_smoothing, masks_and_guides, points_and_lines, roles_and_mainline, sequences_and_graphs, turnouts  # noqa: F401  they register their queries
from .plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
