"""Event intelligence: trends, pages, topics, sources, statistics, packs and audits.

Every function takes its time ``as_of`` explicitly. ``te`` is events joined with their topics.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewell.functions.scalar import acceleration, domain, half_up, moment, ratio, story
from tidewell.operators.relational import keyset_page, top_n_per_group

#: Days of data below which lifecycles and chains are doubtful, and below which they say nothing.
LEAST_DAYS = (90, 30)


def _since(as_of: datetime, **delta: float) -> Column:
    return moment(as_of - timedelta(**delta))


def trends(te: DataFrame, as_of: datetime, window: timedelta, top: int = 10, dedup: bool = True) -> DataFrame:
    """Topics by volume and growth against the window before; scores spread from 0 to 10 over the top."""
    what = story() if dedup else F.struct("event_id", "topic")
    start, before = moment(as_of - window), moment(as_of - 2 * window)
    at = F.col("fetched_at")
    count = F.count_distinct if dedup else F.count
    by = te.where(at >= before).groupBy("topic").agg(count(F.when(at >= start, what)).alias("volume"), count(F.when(at < start, what)).alias("prev_volume"))
    by = by.where("volume > 0").withColumn("acc", acceleration(F.col("volume"), F.col("prev_volume")))
    raw = F.col("volume") + F.greatest(F.lit(0.0), F.col("acc") * F.col("volume"))
    best = by.withColumn("raw", raw).orderBy(F.desc("raw"), "topic").limit(min(top, 50))
    low, high = F.min("raw").over(Window.partitionBy()), F.max("raw").over(Window.partitionBy())
    score = F.when(high == low, 10.0).otherwise(half_up(ratio(F.lit(10.0) * (F.col("raw") - low), high - low), 1))
    return best.select("topic", "volume", "prev_volume", half_up(F.col("acc"), 2).alias("acceleration"), score.alias("score"))


def trend_events(te: DataFrame, found: DataFrame, as_of: datetime, window: timedelta, n: int) -> DataFrame:
    """The ``n`` best events of each trending topic inside the window."""
    inside = te.where(F.col("fetched_at") >= moment(as_of - window)).join(F.broadcast(found.select("topic")), "topic", "left_semi")  # at most 50 topics
    return top_n_per_group(inside, ["topic"], [F.desc("score"), F.desc("fetched_at"), F.asc("event_id")], n).select("topic", "rn", "event_id", "title", "score")


def events_page(ev: DataFrame, after: tuple | None = None, limit: int = 20, source: str | None = None, since: datetime | None = None) -> DataFrame:
    if source:
        ev = ev.where(F.col("source") == source)
    if since:
        ev = ev.where(F.col("fetched_at") >= moment(since))
    return keyset_page(ev, "fetched_at", "n", after, limit).select("event_id", "source", F.substring("title", 1, 200).alias("title"), "score")


def topic_counts(te: DataFrame, as_of: datetime, days: int = 7) -> DataFrame:
    return te.where(F.col("fetched_at") >= _since(as_of, days=days)).groupBy("topic").agg(F.count("*").alias("events"))


def topics(te: DataFrame, taxonomy: DataFrame, as_of: datetime, match: str | None = None) -> DataFrame:
    """Configured topics and those seen, with their counts of seven days."""
    rows = taxonomy.join(topic_counts(te, as_of), "topic", "full")
    if match:
        rows = rows.where(F.lower("topic").contains(match.lower()))
    n = F.coalesce("events", F.lit(0)).cast("long")
    return rows.select("topic", F.coalesce("configured", F.lit(False)).alias("configured"), n.alias("events"), (n > 0).alias("active"))


def sources(ev: DataFrame, health: DataFrame, as_of: datetime, stale_after: timedelta = timedelta(seconds=600)) -> DataFrame:
    """Health of each source: error, stale or healthy, with its volumes."""
    day = F.col("fetched_at") >= _since(as_of, days=1)
    counts = ev.groupBy("source").agg(F.count_if(day).alias("events_24h"), F.count("*").alias("events_total"))
    status = F.when(F.col("last_error").isNotNull(), "error").when(F.coalesce(F.col("last_success_at") < moment(as_of - stale_after), F.lit(True)), "stale").otherwise("healthy")
    rows = health.join(counts, "source", "left")
    return rows.select("source", status.alias("status"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("events_24h", "events_total")])


def stale_sources(found: DataFrame, health: DataFrame, before: datetime | None = None) -> DataFrame:
    """Of ``sources`` those that are stale or in error, and those whose last success lies ``before`` a time."""
    rows = found.join(health.select("source", "last_success_at"), "source")
    old = F.col("status") != "healthy"
    if before is not None:
        old = old | F.coalesce(F.col("last_success_at") < moment(before), F.lit(True))
    return rows.where(old).select(*found.columns)


def health_warnings(overview: DataFrame, span: DataFrame) -> DataFrame:
    """(type, severity, value): what ``stats`` and the span of the data in days say against conclusions from them, a row for each warning."""
    row = overview.select("unclassified_share", "top_source_share", "multi_topic_share").crossJoin(span.select("days"))  # one row each
    least, few = LEAST_DAYS
    age = F.when(F.col("days") < few, "critical").when(F.col("days") < least, "warning").otherwise("ok")
    kinds = {
        "unclassified": (level(F.col("unclassified_share"), 0.20, 0.50), F.col("unclassified_share")), "concentration": (level(F.col("top_source_share"), 0.30, 0.60), F.col("top_source_share")),
        "data_age": (age, F.col("days").cast("double")), "over_classification": (level(F.col("multi_topic_share"), 0.10, 0.25), F.col("multi_topic_share")),
    }
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("type"), severity.alias("severity"), value.alias("value")) for k, (severity, value) in kinds.items()]))
    return row.select(each.alias("x")).select("x.*").where("severity <> 'ok'")


def health_of(ev: DataFrame) -> DataFrame:
    """Health rows from the events themselves; source s3 is given an error."""
    return ev.groupBy("source").agg(F.max("fetched_at").alias("last_success_at")).withColumn("last_error", F.when(F.col("source") == "s3", F.lit("timeout")))


def stats(ev: DataFrame, et: DataFrame, as_of: datetime, many: int = 4) -> DataFrame:
    """One row of totals and quality shares with their alert levels; events with ``many`` topics or more count as multi-topic."""
    at = F.col("fetched_at")
    per = et.groupBy("event_id").agg(F.count("*").alias("topics"))
    joined = ev.join(per, "event_id", "left")
    row = joined.agg(
        F.count("*").alias("total_events"), F.count_if(at >= _since(as_of, days=1)).alias("events_24h"), F.count_if(at >= _since(as_of, days=7)).alias("events_7d"),
        F.count_distinct("source").alias("sources"), F.count_if(F.col("topics").isNull()).alias("_none"), F.count_if(F.col("topics") >= many).alias("_many"),
    )
    active = et.agg(F.count_distinct("topic").alias("active_topics"))
    best = top_source(ev).select(F.col("source").alias("top_source"), F.col("events").alias("_top"))
    row = row.crossJoin(active).crossJoin(best)  # one row each
    n = F.col("total_events")
    none, top = ratio(F.col("_none"), n), ratio(F.col("_top"), n)
    return row.select("total_events", "events_24h", "events_7d", "sources", "active_topics", half_up(none, 4).alias("unclassified_share"), half_up(ratio(F.col("_many"), n), 4).alias("multi_topic_share"),
                      "top_source", half_up(top, 4).alias("top_source_share"), level(none, 0.20, 0.50).alias("unclassified_level"), level(top, 0.30, 0.60).alias("concentration_level"))


def level(share: Column, warning: float, critical: float) -> Column:
    return F.when(share > critical, "critical").when(share > warning, "warning").otherwise("ok")


def top_source(ev: DataFrame) -> DataFrame:
    return ev.groupBy("source").agg(F.count("*").alias("events")).orderBy(F.desc("events"), "source").limit(1)


def topic_count_histogram(et: DataFrame) -> DataFrame:
    per = et.groupBy("event_id").agg(F.count("*").alias("topics"))
    return per.groupBy("topics").agg(F.count("*").alias("events"))


def unclassified(ev: DataFrame, et: DataFrame) -> DataFrame:
    return ev.join(et, "event_id", "left_anti").select("event_id", "source")


def data_span(ev: DataFrame) -> DataFrame:
    """Whole days between the first and last time, publication dates over a year before fetching set aside."""
    far = F.unix_micros(F.col("fetched_at").cast("timestamp")) - F.unix_micros(F.col("published_at").cast("timestamp")) > 365 * 86_400_000_000
    at = F.when(F.col("published_at").isNull() | far, F.col("fetched_at")).otherwise(F.col("published_at"))
    row = ev.agg(F.min(at).alias("first_at"), F.max(at).alias("last_at"))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return row.select("first_at", "last_at", F.floor((micros("last_at") - micros("first_at")) / 86_400_000_000).cast("long").alias("days"))


def audit_volume(te: DataFrame, as_of: datetime) -> DataFrame:
    """Events of the last 90 days in three buckets of 30, and their trend."""
    at = F.col("fetched_at")
    d30, d60, d90 = _since(as_of, days=30), _since(as_of, days=60), _since(as_of, days=90)
    by = te.where(at >= d90).groupBy("topic").agg(F.count_if(at >= d30).alias("recent"), F.count_if((at >= d60) & (at < d30)).alias("mid"), F.count_if(at < d60).alias("old"))
    recent, mid, old = F.col("recent"), F.col("mid"), F.col("old")
    trend = F.when((recent == 0) & (mid == 0) & (old == 0), "flat").when((recent > mid) & (mid >= old), "increasing").when((recent < mid) & (mid <= old), "decreasing").otherwise("stable")
    return by.withColumn("trend", trend)


def audit_overlap(et: DataFrame, share: float = 0.1, top: int = 5) -> DataFrame:
    """Pairs of topics with the share of the smaller topic's events they have in common."""
    sizes = et.groupBy("topic").agg(F.count("*").alias("n"))
    a, b = et.alias("a"), et.alias("b")
    pairs = a.join(b, (F.col("a.event_id") == F.col("b.event_id")) & (F.col("a.topic") < F.col("b.topic")))
    pairs = pairs.groupBy(F.col("a.topic").alias("topic_a"), F.col("b.topic").alias("topic_b")).agg(F.count("*").alias("shared"))
    sa, sb = sizes.select(F.col("topic").alias("topic_a"), F.col("n").alias("na")), sizes.select(F.col("topic").alias("topic_b"), F.col("n").alias("nb"))
    rows = pairs.join(sa, "topic_a").join(sb, "topic_b").withColumn("overlap", F.col("shared") / F.least("na", "nb"))
    rows = rows.where(F.col("overlap") > share)
    sides = rows.select(F.explode(F.array(F.struct(F.col("topic_a").alias("topic"), F.col("topic_b").alias("other")), F.struct(F.col("topic_b").alias("topic"), F.col("topic_a").alias("other")))).alias("s"), "shared", "overlap")
    best = top_n_per_group(sides.select("s.topic", "s.other", "shared", "overlap"), ["topic"], [F.desc("overlap"), F.asc("other")], top)
    return best.select("topic", "other", "shared", half_up(F.col("overlap"), 4).alias("overlap"), "rn")


def audit_flags(volume: DataFrame, overlaps: DataFrame, weights: DataFrame, chains: DataFrame) -> DataFrame:
    """Flags a reviewer looks at, one row each."""
    rows = volume.withColumn("domain", domain(F.col("topic")))
    number = rows.groupBy("domain").agg(F.count("*").alias("in_domain"))
    total = rows.agg(F.count("*").alias("topics"))
    rows = rows.join(number, "domain").crossJoin(total).join(weights, "topic", "left").join(chains.select("topic", "cross_domain"), "topic", "left")
    high = overlaps.where("overlap > 0.5").select("topic", F.concat(F.lit("high_overlap:"), "other").alias("flag"))
    small = (F.col("recent") < 5) & (F.col("mid") < 5) & (F.col("old") < 5)
    flags = F.array_compact(F.array(
        F.when(small, F.lit("below_minimum_volume")), F.when(F.coalesce("weight", F.lit(1.0)) < 0.65, F.lit("low_learning_weight")),
        F.when(F.coalesce("cross_domain", F.lit(0)) == 0, F.lit("no_cross_domain_chains")), F.when(F.col("in_domain") / F.col("topics") > 0.3, F.lit("domain_imbalance")),
    ))
    return rows.select("topic", F.explode(flags).alias("flag")).unionByName(high)


def domain_rollup(volume: DataFrame) -> DataFrame:
    n = F.col("recent") + F.col("mid") + F.col("old")
    return volume.groupBy(domain(F.col("topic")).alias("domain")).agg(F.count("*").alias("topics"), F.sum(n).alias("events"))


def review_warning(metadata: DataFrame, as_of: datetime, days: int = 90) -> DataFrame:
    """Whether the last topic review (key last_topic_review, ISO date) lies over ``days`` back or is missing."""
    last = metadata.where(F.col("key") == "last_topic_review").agg(F.max(F.to_date("value")).alias("last_review"))
    age = F.datediff(moment(as_of).cast("date"), "last_review")
    return last.select("last_review", age.alias("age_days"), F.coalesce(age > days, F.lit(True)).alias("overdue"))
