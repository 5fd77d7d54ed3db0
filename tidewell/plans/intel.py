"""Queries over events: trends, pages, topics, sources, statistics, audits."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from tidewell.functions import jsons
from tidewell.operators import briefing, intel
from tidewell.plans.registry import EV, half_up, query
from tidewell.sources import adapters as src

TYPES = ("click", "error", "purchase", "signup", "view")


def _trends_sql(hours: int, top: int = 10, dedup: bool = True) -> str:
    what = "DISTINCT coalesce(canonical_url, event_id)" if dedup else "*"
    return EV + f""", v AS (
  SELECT topic, count({what}) FILTER (WHERE fetched_at >= t - INTERVAL {hours} HOUR) AS volume,
    count({what}) FILTER (WHERE fetched_at < t - INTERVAL {hours} HOUR AND fetched_at >= t - INTERVAL {2 * hours} HOUR) AS prev_volume
  FROM te, now GROUP BY topic
), a AS (SELECT *, CASE WHEN prev_volume > 0 THEN (volume - prev_volume) / CAST(prev_volume AS DOUBLE) ELSE 1.0 END AS acc FROM v WHERE volume > 0
), r AS (SELECT *, volume + greatest(0.0, acc * volume) AS raw FROM a ORDER BY raw DESC, topic LIMIT {top}
), trending AS (
  SELECT topic, volume, prev_volume, {half_up('acc', 2)} AS acceleration,
    CASE WHEN max(raw) OVER () = min(raw) OVER () THEN 10.0 ELSE {half_up('10.0 * (raw - min(raw) OVER ()) / (max(raw) OVER () - min(raw) OVER ())', 1)} END AS score
  FROM r)
"""


def _trends(hours: int, dedup: bool = True):
    def run(spark, sf):
        te = src.topic_events(spark, sf)
        return intel.trends(te, src.latest(te), timedelta(hours=hours), dedup=dedup)

    return run


query("trends_24h", _trends_sql(24) + "SELECT * FROM trending")(_trends(24))
query("trends_7d", _trends_sql(168) + "SELECT * FROM trending")(_trends(168))
query("trends_nodedup", _trends_sql(24, dedup=False) + "SELECT * FROM trending")(_trends(24, dedup=False))


def _trend_events(hours: int, top: int, n: int):
    def run(spark, sf):
        te = src.topic_events(spark, sf)
        now, window = src.latest(te), timedelta(hours=hours)
        return intel.trend_events(te, intel.trends(te, now, window, top), now, window, n)

    return run


def _trend_events_sql(hours: int, top: int, n: int) -> str:
    return _trends_sql(hours, top) + f"""SELECT topic, CAST(rn AS INTEGER) AS rn, event_id, title, score FROM (
  SELECT te.*, row_number() OVER (PARTITION BY topic ORDER BY score DESC, fetched_at DESC, event_id) AS rn
  FROM te SEMI JOIN trending USING (topic), now WHERE fetched_at >= t - INTERVAL {hours} HOUR) WHERE rn <= {n}"""


query("trend_top_titles", _trend_events_sql(24, 10, 3))(_trend_events(24, 10, 3))
query("pack_events", _trend_events_sql(6, 10, 5))(_trend_events(6, 10, 5))

PAGE = "SELECT event_id, source, substr(title, 1, 200) AS title, score FROM ev ORDER BY fetched_at DESC, n DESC LIMIT 20"


@query("events_page_1", EV + PAGE)
def events_page_1(spark, sf):
    return intel.events_page(src.events(spark, sf))


@query("events_page_2", EV + PAGE + " OFFSET 20")
def events_page_2(spark, sf):
    ev = src.events(spark, sf)
    last = ev.select("fetched_at", "n").orderBy(F.desc("fetched_at"), F.desc("n")).limit(20).collect()[-1]  # the cursor: one page
    return intel.events_page(ev, after=tuple(last))


@query("events_by_topic", EV + "SELECT event_id, source, substr(title, 1, 200) AS title, score FROM te, now WHERE topic = 'click.t3' AND source = 's1' AND fetched_at >= t - INTERVAL 7 DAY ORDER BY fetched_at DESC, n DESC LIMIT 20")
def events_by_topic(spark, sf):
    te = src.topic_events(spark, sf)
    return intel.events_page(te.where("topic = 'click.t3'"), source="s1", since=src.latest(te) - timedelta(days=7))


def _taxonomy(spark):
    rows = [(f"{t}.t{k}",) for t in TYPES for k in range(9)] + [("system.quiet",)]
    return spark.createDataFrame(rows, "topic string").withColumn("configured", F.lit(True))


@query("topics_active", EV + """, c AS (SELECT topic, count(*) AS events FROM te, now WHERE fetched_at >= t - INTERVAL 7 DAY GROUP BY topic),
tax AS (SELECT x || '.t' || CAST(k AS VARCHAR) AS topic FROM unnest(['click','error','purchase','signup','view']) a(x), range(9) b(k) UNION ALL SELECT 'system.quiet')
SELECT coalesce(tax.topic, c.topic) AS topic, tax.topic IS NOT NULL AS configured, coalesce(events, 0) AS events, coalesce(events, 0) > 0 AS active FROM tax FULL JOIN c ON tax.topic = c.topic""")
def topics_active(spark, sf):
    te = src.topic_events(spark, sf)
    return intel.topics(te, _taxonomy(spark), src.latest(te)).orderBy(F.desc("active"), F.desc("events"), "topic")


@query("sources_health", EV + """SELECT source, CASE WHEN source = 's3' THEN 'error' WHEN max(fetched_at) < t - INTERVAL 600 SECOND THEN 'stale' ELSE 'healthy' END AS status,
count(*) FILTER (WHERE fetched_at >= t - INTERVAL 1 DAY) AS events_24h, count(*) AS events_total FROM ev, now GROUP BY source, t""")
def sources_health(spark, sf):
    ev = src.events(spark, sf)
    return intel.sources(ev, intel.health_of(ev), src.latest(ev))


@query("stats_overview", EV + f""", per AS (SELECT event_id, count(*) AS k FROM et GROUP BY event_id), top AS (SELECT source, count(*) AS c FROM ev GROUP BY source ORDER BY c DESC, source LIMIT 1),
b AS (SELECT count(*) AS total_events, count(*) FILTER (WHERE fetched_at >= t - INTERVAL 1 DAY) AS events_24h, count(*) FILTER (WHERE fetched_at >= t - INTERVAL 7 DAY) AS events_7d,
 count(DISTINCT source) AS sources, count(*) FILTER (WHERE k IS NULL) / CAST(count(*) AS DOUBLE) AS none, count(*) FILTER (WHERE k >= 4) / CAST(count(*) AS DOUBLE) AS many FROM ev LEFT JOIN per USING (event_id), now)
SELECT total_events, events_24h, events_7d, sources, (SELECT count(DISTINCT topic) FROM et) AS active_topics, {half_up('none', 4)} AS unclassified_share, {half_up('many', 4)} AS multi_topic_share,
 source AS top_source, {half_up('c / CAST(total_events AS DOUBLE)', 4)} AS top_source_share, CASE WHEN none > .5 THEN 'critical' WHEN none > .2 THEN 'warning' ELSE 'ok' END AS unclassified_level,
 CASE WHEN c / CAST(total_events AS DOUBLE) > .6 THEN 'critical' WHEN c / CAST(total_events AS DOUBLE) > .3 THEN 'warning' ELSE 'ok' END AS concentration_level FROM b, top""")
def stats_overview(spark, sf):
    ev = src.events(spark, sf)
    return intel.stats(ev, src.event_topics(spark, sf), src.latest(ev))


@query("topic_count_hist", EV + "SELECT topics, count(*) AS events FROM (SELECT event_id, count(*) AS topics FROM et GROUP BY event_id) GROUP BY topics")
def topic_count_hist(spark, sf):
    return intel.topic_count_histogram(src.event_topics(spark, sf))


@query("unclassified_events", EV + "SELECT event_id, source FROM ev WHERE NOT EXISTS (SELECT 1 FROM et WHERE et.event_id = ev.event_id AND topic NOT LIKE 'error.%')")
def unclassified_events(spark, sf):
    return intel.unclassified(src.events(spark, sf), src.event_topics(spark, sf).where(~F.col("topic").startswith("error.")))


@query("top_source", EV + "SELECT source, count(*) AS events FROM ev GROUP BY source ORDER BY events DESC, source LIMIT 1")
def top_source(spark, sf):
    return intel.top_source(src.events(spark, sf))


@query("topic_counts", EV + "SELECT topic, count(*) AS events FROM te, now WHERE fetched_at >= t - INTERVAL 7 DAY GROUP BY topic")
def topic_counts(spark, sf):
    te = src.topic_events(spark, sf)
    return intel.topic_counts(te, src.latest(te))


@query("data_span", EV + """, x AS (SELECT CASE WHEN published_at IS NULL OR fetched_at - published_at > INTERVAL 365 DAY THEN fetched_at ELSE published_at END AS p FROM ev)
SELECT min(p) AS first_at, max(p) AS last_at, CAST(floor((epoch_us(max(p)) - epoch_us(min(p))) / 86400000000) AS BIGINT) AS days FROM x""")
def data_span(spark, sf):
    return intel.data_span(src.events(spark, sf))


VOLUME = """, vol AS (SELECT topic, count(*) FILTER (WHERE fetched_at >= t - INTERVAL 30 DAY) AS recent, count(*) FILTER (WHERE fetched_at >= t - INTERVAL 60 DAY AND fetched_at < t - INTERVAL 30 DAY) AS mid,
 count(*) FILTER (WHERE fetched_at < t - INTERVAL 60 DAY) AS old FROM te, (SELECT max(ts) + INTERVAL 40 DAY AS t FROM events) now WHERE fetched_at >= t - INTERVAL 90 DAY GROUP BY topic)"""


def _volume(te):
    """Audited 40 days after the last event, so that the middle and old buckets hold some."""
    return intel.audit_volume(te, src.latest(te) + timedelta(days=40))


@query("audit_volume", EV + VOLUME + """SELECT *, CASE WHEN recent > mid AND mid >= old THEN 'increasing' WHEN recent < mid AND mid <= old THEN 'decreasing' WHEN recent = 0 AND mid = 0 AND old = 0 THEN 'flat' ELSE 'stable' END AS trend FROM vol""")
def audit_volume(spark, sf):
    return _volume(src.topic_events(spark, sf))


OVERLAP = """, sz AS (SELECT topic, count(*) AS n FROM et GROUP BY topic),
pr AS (SELECT a.topic AS ta, b.topic AS tb, count(*) AS shared FROM et a JOIN et b ON a.event_id = b.event_id AND a.topic < b.topic GROUP BY 1, 2),
ov AS (SELECT ta, tb, shared, shared / CAST(least(x.n, y.n) AS DOUBLE) AS o FROM pr JOIN sz x ON ta = x.topic JOIN sz y ON tb = y.topic WHERE shared / CAST(least(x.n, y.n) AS DOUBLE) > {share}),
sd AS (SELECT ta AS topic, tb AS other, shared, o FROM ov UNION ALL SELECT tb, ta, shared, o FROM ov),
lap AS (SELECT topic, other, shared, floor(o * 10000.0 + 0.5) / 10000.0 AS overlap, CAST(rn AS INTEGER) AS rn FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY o DESC, other) AS rn FROM sd) WHERE rn <= 5)"""


@query("audit_overlap", EV + OVERLAP.format(share=0.01) + "SELECT * FROM lap")
def audit_overlap(spark, sf):
    return intel.audit_overlap(src.event_topics(spark, sf), share=0.01)


@query("audit_domains", EV + VOLUME + "SELECT split_part(topic, '.', 1) AS domain, count(*) AS topics, CAST(sum(recent + mid + old) AS BIGINT) AS events FROM vol GROUP BY 1")
def audit_domains(spark, sf):
    return intel.domain_rollup(_volume(src.topic_events(spark, sf)))


@query("event_detail", EV + "SELECT ev.event_id, title, source, score, canonical_url, (SELECT string_agg(topic, ',' ORDER BY topic) FROM et WHERE et.event_id = '44') AS topics FROM ev WHERE event_id = '44'")
def event_detail(spark, sf):
    rows = briefing.event(src.events(spark, sf), src.event_topics(spark, sf), "44")
    return rows.select("event_id", "title", "source", "score", "canonical_url", F.array_join("topics", ",").alias("topics"))


@query("pack", _trends_sql(6) + """SELECT topic, trending.score AS score, volume, acceleration, CAST(rn AS INTEGER) AS rn, event_id, title, title AS snippet FROM trending JOIN (
  SELECT te.topic, event_id, title, row_number() OVER (PARTITION BY te.topic ORDER BY te.score DESC, fetched_at DESC, event_id) AS rn FROM te, now WHERE fetched_at >= t - INTERVAL 6 HOUR) USING (topic) WHERE rn <= 5""")
def pack(spark, sf):
    te = src.topic_events(spark, sf)
    return briefing.pack(te, src.latest(te))


@query("json_columns", """SELECT turn, count(*) FILTER (WHERE json_valid(text)) AS valid, count(*) AS total FROM (SELECT turn, CASE WHEN turn % 2 = 0 THEN '["' || role || '"]' ELSE role || '{' END AS text FROM conversations) GROUP BY 1""")
def json_columns(spark, sf):
    text = F.when(F.col("turn") % 2 == 0, F.concat(F.lit('["'), "role", F.lit('"]'))).otherwise(F.concat("role", F.lit("{")))
    rows = src.table(spark, sf, "conversations").select("turn", text.alias("text"))
    return rows.groupBy("turn").agg(F.count_if(jsons.is_json(F.col("text"))).alias("valid"), F.count("*").alias("total"))


HEALTH = EV + """, hl AS (SELECT source, CASE WHEN source = 's3' THEN 'error' WHEN max(fetched_at) < t - INTERVAL 600 SECOND THEN 'stale' ELSE 'healthy' END AS status, max(fetched_at) AS last_success_at,
count(*) FILTER (WHERE fetched_at >= t - INTERVAL 1 DAY) AS events_24h, count(*) AS events_total, count(*) FILTER (WHERE fetched_at >= t - INTERVAL 6 HOUR) AS events_in_window, t FROM ev, now GROUP BY source, t) """


@query("sources_stale", HEALTH + "SELECT source, status, events_24h, events_total FROM hl WHERE status <> 'healthy' OR last_success_at < t - INTERVAL 120 SECOND")
def sources_stale(spark, sf):
    """Sources in error or without a success in the last two minutes."""
    ev = src.events(spark, sf)
    now, health = src.latest(ev), intel.health_of(ev)
    return intel.stale_sources(intel.sources(ev, health, now), health, now - timedelta(minutes=2))


@query("pack_sources", HEALTH + "SELECT source, status, events_in_window FROM hl")
def pack_sources(spark, sf):
    ev = src.events(spark, sf)
    return briefing.source_health(ev, intel.health_of(ev), src.latest(ev))


@query("health_warnings", EV + f""", per AS (SELECT event_id, count(*) AS k FROM et GROUP BY event_id), top AS (SELECT count(*) AS c FROM ev GROUP BY source ORDER BY c DESC, source LIMIT 1),
sp AS (SELECT date_diff('microsecond', min(a), max(a)) // 86400000000 AS days FROM (SELECT CASE WHEN published_at IS NULL OR fetched_at - published_at > INTERVAL 365 DAY THEN fetched_at ELSE published_at END AS a FROM ev)),
b AS (SELECT {half_up("count(*) FILTER (WHERE k IS NULL) / CAST(count(*) AS DOUBLE)", 4)} AS none, {half_up("count(*) FILTER (WHERE k >= 2) / CAST(count(*) AS DOUBLE)", 4)} AS many, {half_up("(SELECT c FROM top) / CAST(count(*) AS DOUBLE)", 4)} AS top FROM ev LEFT JOIN per USING (event_id)),
w AS (SELECT 'unclassified' AS type, none AS value, 0.2 AS warn, 0.5 AS crit FROM b UNION ALL SELECT 'concentration', top, 0.3, 0.6 FROM b UNION ALL SELECT 'over_classification', many, 0.1, 0.25 FROM b UNION ALL SELECT 'data_age', -CAST(days AS DOUBLE), -90, -30 FROM sp)
SELECT type, CASE WHEN value > crit THEN 'critical' ELSE 'warning' END AS severity, abs(value) AS value FROM w WHERE value > warn""")
def health_warnings(spark, sf):
    """With two topics counting as many, since events here have two at most."""
    ev = src.events(spark, sf)
    return intel.health_warnings(intel.stats(ev, src.event_topics(spark, sf), src.latest(ev), many=2), intel.data_span(ev))
