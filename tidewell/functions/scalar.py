"""Scalar expressions shared by the operators. All are built-in column functions."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F


def moment(at: datetime) -> Column:
    """A time without zone as a literal, whatever the zones of driver and session; comparisons with it reach the files."""
    return F.to_timestamp_ntz(F.lit(at.isoformat(sep=" ")))


def half_up(x: Column, digits: int = 0) -> Column:
    """floor(x * 10^d + 0.5) / 10^d: halves go up, also below zero."""
    scale = float(10**digits)
    return F.floor(x * scale + 0.5).cast("double") / F.lit(scale)


def ratio(a: Column, b: Column, default: float = 0.0) -> Column:
    """a / b, or ``default`` where b is zero or missing."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(default))


def acceleration(now: Column, before: Column) -> Column:
    """(now - before) / before; 1 where only ``now`` is positive; else 0."""
    return F.when(before > 0, (now - before) / before.cast("double")).when(now > 0, 1.0).otherwise(0.0)


def event_time() -> Column:
    return F.coalesce("published_at", "fetched_at")


def story() -> Column:
    """What counts as one story: its canonical address, else the event."""
    return F.coalesce("canonical_url", "event_id")


def domain(topic: Column) -> Column:
    return F.split_part(topic, F.lit("."), F.lit(1))
