"""Registration of queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def put(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


#: Events and their topics as SQL, matching the adapters.
EV = """WITH ev AS (
  SELECT CAST(event_id AS VARCHAR) AS event_id, event_id AS n, event_type || '.t' || CAST(user_id % 10 AS VARCHAR) AS topic,
    's' || CAST(user_id % 4 AS VARCHAR) AS source, ts AS fetched_at,
    CASE WHEN event_id % 10 <> 0 THEN ts - to_hours(CAST(event_id % 5 AS INTEGER)) END AS published_at,
    CASE WHEN event_id % 3 = 0 THEN 'u' || CAST(event_id // 6 AS VARCHAR) END AS canonical_url,
    CAST(floor(value) AS BIGINT) AS score, event_type || ' ' || CAST(event_id AS VARCHAR) AS title FROM events
), et AS (
  SELECT event_id, topic FROM ev UNION
  SELECT CAST(event_id AS VARCHAR), event_type || '.t' || CAST(event_id % 10 AS VARCHAR) FROM events WHERE event_id % 4 = 0
), te AS (SELECT ev.* EXCLUDE (topic), et.topic FROM ev JOIN et USING (event_id)
), now AS (SELECT max(ts) AS t FROM events)
"""


def half_up(x: str, d: int) -> str:
    return f"floor(({x}) * {10**d}.0 + 0.5) / {10**d}.0"
