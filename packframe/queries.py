"""The registry of queries over the engine's own operators, and their SQL."""

from __future__ import annotations

from packframe.plans import catalog, pixels, streams, transforms  # noqa: F401  they register their queries
from packframe.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
