"""All queries over the driver's tables that this package registers, and their SQL."""

from __future__ import annotations

from tidewell.plans import forecast, graph, intel, streams, text  # noqa: F401
from tidewell.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
