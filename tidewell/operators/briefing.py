"""One event in full, and the pack: what trends now, by which events, from how healthy sources."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions.scalar import moment
from tidewell.functions.spans import parse_duration
from tidewell.functions.text import sanitized
from tidewell.operators import intel

#: Limits of a pack.
MOST_TRENDS, MOST_EVENTS = 50, 20


def event(ev: DataFrame, event_topics: DataFrame, event_id: str) -> DataFrame:
    """The event's row with its topics in order; no row if there is none of that id."""
    own = event_topics.where(F.col("event_id") == event_id).groupBy("event_id").agg(F.array_sort(F.collect_set("topic")).alias("topics"))
    rows = ev.where(F.col("event_id") == event_id).drop("topic", "topics").join(own, "event_id", "left")
    return rows.withColumn("topics", F.coalesce("topics", F.array().cast("array<string>")))


def pack(te: DataFrame, as_of: datetime, since: str = "6h", top: int = 10, most_events: int = 5) -> DataFrame:
    """A row per trend and event: (topic, score, volume, acceleration, rn, event_id, title, snippet). Trends have at least one event by definition."""
    window = parse_duration(since)
    found = intel.trends(te, as_of, window, max(1, min(top, MOST_TRENDS)))
    best = intel.trend_events(te, found, as_of, window, max(1, min(most_events, MOST_EVENTS))).drop("score")  # the trend's score is shown
    text, _ = sanitized(F.col("title"))
    return best.join(F.broadcast(found), "topic").select("topic", "score", "volume", "acceleration", "rn", "event_id", F.substring("title", 1, 200).alias("title"), text.alias("snippet"))


def source_health(ev: DataFrame, health: DataFrame, as_of: datetime, since: str = "6h") -> DataFrame:
    """(source, status, events_in_window) of a pack: how healthy the sources are that its trends rest on."""
    inside = ev.where(F.col("fetched_at") >= moment(as_of - parse_duration(since))).groupBy("source").agg(F.count("*").alias("events_in_window"))
    rows = intel.sources(ev, health, as_of).select("source", "status").join(inside, "source", "left")
    return rows.select("source", "status", F.coalesce("events_in_window", F.lit(0)).cast("long").alias("events_in_window"))
