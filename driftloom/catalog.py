"""Every query of the engine over the tables of a folder, and its SQL."""

from __future__ import annotations

from .plans.queries import ORACLES, QUERIES

FLAGSHIP = "history_fds"
__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
