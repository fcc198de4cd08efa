"""The registered queries and their oracle SQL."""

from __future__ import annotations

from vicinal.plans import classaxes, nulls, objectives, structure  # noqa: F401  register their queries
from vicinal.plans.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
