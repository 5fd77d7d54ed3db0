"""Queries that run a stream over the events and return its final state."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tidewell.plans.registry import query
from tidewell.streaming import ingest
from tidewell.streaming.store import EventStore


def _stream(spark, sf):
    path = f"{sf}/events.parquet"
    raw = ingest.read_stream(spark, path, spark.read.parquet(path).schema)
    topic = F.concat("event_type", F.lit(".t"), (F.col("user_id") % 10).cast("string"))
    return raw.select("event_id", "user_id", topic.alias("topic"), F.col("ts").cast("timestamp").alias("at"), "value")


TOPIC = "event_type || '.t' || CAST(user_id % 10 AS VARCHAR)"


@query("stream_daily_counts", f"SELECT {TOPIC} AS topic, strftime(ts, '%Y-%m-%d') AS day, count(*) AS events FROM events GROUP BY 1, 2")
def stream_daily_counts(spark, sf):
    rows = ingest.collected(ingest.daily_counts(_stream(spark, sf)), ["topic", "day"], "update")
    return rows.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("stream_sliding_7d", f"SELECT {TOPIC} AS topic, strftime(CAST(ts AS DATE) - CAST(k AS INTEGER), '%Y-%m-%d') AS window_start, count(*) AS events FROM events, range(7) r(k) GROUP BY 1, 2")
def stream_sliding_7d(spark, sf):
    rows = ingest.collected(ingest.sliding_counts(_stream(spark, sf)), ["topic", "window_start"], "update")
    return rows.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd"))


@query("stream_dedup", "SELECT event_id // 2 AS event_id, count(*) // count(*) AS kept FROM events GROUP BY 1")
def stream_dedup(spark, sf):
    """Ids are halved, so that each comes twice; both lie within the watermark."""
    twice = _stream(spark, sf).withColumn("event_id", F.floor(F.col("event_id") / 2))
    return ingest.collected(ingest.deduplicated(twice, "40 days").select("event_id")).groupBy("event_id").agg(F.count("*").alias("kept"))


UPSERTED = """WITH a AS (SELECT CAST(event_id // 3 AS VARCHAR) AS id, event_id, CASE WHEN event_id % 2 = 0 THEN 'c' || event_id END AS content, CASE WHEN event_id % 3 = 1 THEN 'u' || event_id END AS canonical_url, CASE WHEN event_id % 5 = 2 THEN 'f' || event_id END AS content_flags, CAST(floor(value) AS BIGINT) AS score, user_id AS comments, ts FROM events),
b AS (SELECT *, count(*) OVER p AS k, count(content) OVER p AS c, count(canonical_url) OVER p AS u, count(content_flags) OVER p AS f, max(score) OVER p AS s, max(comments) OVER p AS m FROM a WINDOW p AS (PARTITION BY id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
w AS (SELECT *, coalesce(k, 0) = 0 OR (c = 0 AND content IS NOT NULL) OR (u = 0 AND canonical_url IS NOT NULL) OR (f = 0 AND content_flags IS NOT NULL) OR score > s OR comments > m AS better FROM b),
st AS (SELECT id AS event_id, min_by(content, ts) FILTER (WHERE content IS NOT NULL) AS content, min_by(canonical_url, ts) FILTER (WHERE canonical_url IS NOT NULL) AS canonical_url, min_by(content_flags, ts) FILTER (WHERE content_flags IS NOT NULL) AS content_flags, max(score) AS score, max(comments) AS comments, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS created_at, strftime(max(ts) FILTER (WHERE better), '%Y-%m-%d %H:%M:%S') AS fetched_at FROM w GROUP BY id)"""


@query("stream_upsert_state", UPSERTED + " SELECT * FROM st")
def stream_upsert_state(spark, sf):
    """Three arrivals make an event."""
    rows = ingest.collected(ingest.upsert(_arrivals(spark, sf)), ["event_id"], "update")
    return _shown(rows)


def _shown(rows):
    return rows.select("event_id", "content", "canonical_url", "content_flags", "score", "comments", *[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("created_at", "fetched_at")])


def _arrivals(spark, sf):
    n = F.col("event_id")
    return _stream(spark, sf).select(F.floor(n / 3).cast("string").alias("event_id"), F.when(n % 2 == 0, F.concat(F.lit("c"), n.cast("string"))).alias("content"), F.when(n % 3 == 1, F.concat(F.lit("u"), n.cast("string"))).alias("canonical_url"), F.when(n % 5 == 2, F.concat(F.lit("f"), n.cast("string"))).alias("content_flags"), F.floor("value").cast("long").alias("score"), F.col("user_id").alias("comments"), F.col("at").alias("fetched_at"))


def _stored(spark, sf):
    """The events' arrivals through a stream into a store, topics by the last digit of their ids."""
    store = EventStore(spark, ingest.shared_folder(spark, "store"))

    def topics(events):
        return events.select("event_id", F.concat(F.lit("t."), F.coalesce(F.substring("event_id", -1, 1), F.lit(""))).alias("topic"), F.lit(0.5).alias("confidence"))

    ingest.run_durably(_arrivals(spark, sf), store.sink(classify=topics), ingest.shared_folder(spark, "stream-offsets"))
    return store


@query("store_events", UPSERTED + " SELECT * FROM st")
def store_events(spark, sf):
    """What the store says of each event after its arrivals were appended in batches."""
    return _shown(_stored(spark, sf).events())


@query("store_retained", UPSERTED + " SELECT 't.' || right(event_id, 1) AS topic, count(*) AS events, sum(score) AS score FROM st WHERE fetched_at >= '2024-01-16 00:00:00' GROUP BY 1")
def store_retained(spark, sf):
    """Events by topic after those last fetched over 15 days ago went, with their topics."""
    store = _stored(spark, sf)
    store.retain(datetime(2024, 1, 31), days=15)
    return store.topics().join(store.events(), "event_id").groupBy("topic").agg(F.count("*").alias("events"), F.sum("score").alias("score"))


@query("stream_sessions", """WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM e), g AS (SELECT user_id, min(ts) AS a, max(ts) AS b, count(*) AS events FROM s GROUP BY user_id, n)
SELECT user_id, strftime(a, '%Y-%m-%d %H:%M:%S') AS session_start, events FROM g WHERE b + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 1 DAY FROM events)""")
def stream_sessions(spark, sf):
    """Sessions that the watermark has closed: those that ended a day before the last event."""
    rows = ingest.collected(ingest.sessions(_stream(spark, sf)))
    return rows.withColumn("session_start", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss"))
