"""Lengths of time as people write them, and moments as text."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

#: Milliseconds of each unit.
UNITS = {"ms": 1, "s": 1000, "m": 60_000, "h": 3_600_000, "d": 86_400_000, "w": 604_800_000}


def parse_duration(text: str) -> timedelta:
    """``15m``, ``1.5 h``, ``7D``; rounded to milliseconds, halves up. Anything else is a ``ValueError``."""
    shape = re.fullmatch(r"([0-9]+(?:\.[0-9]+)?)\s*([a-z]+)", text.strip().lower())
    if shape is None or shape[2] not in UNITS:
        raise ValueError(f"not a duration: {text!r}; a number and one of {', '.join(UNITS)}, as in 15m")
    return timedelta(milliseconds=int(float(shape[1]) * UNITS[shape[2]] + 0.5))


def iso(at: datetime) -> str:
    """UTC with milliseconds; a moment without a zone is taken as UTC."""
    return at.replace(tzinfo=None).isoformat(timespec="milliseconds") + "Z"


def since(as_of: datetime, duration: str) -> datetime:
    return as_of - parse_duration(duration)
