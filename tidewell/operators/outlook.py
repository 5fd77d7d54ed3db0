"""The whole forecast: its sections together, filtered by topic, cut to a mode's limits."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.scalar import event_time
from tidewell.operators import forecast as fc
from tidewell.operators.relational import top_n_per_group

#: Rows of each section, by mode. A section without a limit here is never cut; 0 leaves it out.
COMPACT = {"lifecycles": 15, "chains": 15, "ranked_chains": 10, "scenarios": 10, "multiscale": 15, "transitive_chains": 10, "entropy": 15, "dynamics": 5}
SUMMARY = {"lifecycles": 0, "chains": 0, "ranked_chains": 5, "scenarios": 3, "multiscale": 0, "transitive_chains": 0, "entropy": 0, "dynamics": 1}
#: Fewer scenarios than this widen a summary.
THIN = 3


@dataclass(frozen=True)
class Section:
    """Rows with the order they are listed in, the columns that name topics, and the column whose values are limited one by one."""

    rows: DataFrame
    order: tuple[Column, ...]
    topics: tuple[str, ...]
    within: str | None = None

    def about(self, wanted: list[str]) -> Section:
        match = F.lit(False)
        for c in self.topics:
            match = match | F.coalesce(F.col(c).isin(wanted), F.lit(False))
        return Section(self.rows.where(match), self.order, self.topics, self.within)

    def cut(self, n: int) -> Section:
        rows = top_n_per_group(self.rows, [self.within], list(self.order), n, "_rn").drop("_rn") if self.within else self.rows.orderBy(*self.order).limit(n)
        return Section(rows, self.order, self.topics, self.within)


def dynamics(loops: DataFrame, late: DataFrame, growing: DataFrame, damped: DataFrame) -> DataFrame:
    """(type, topic, other, place) of all dynamics: what reinforces itself, what follows late, what builds up, what fades."""
    place = {
        "reinforcing_loop": (loops.withColumnsRenamed({"topic_a": "topic", "topic_b": "other"}), -F.col("mutual_lift")),
        "delay": (late.withColumnsRenamed({"from_topic": "topic", "to_topic": "other"}), F.col("lag_stddev")),
        "accumulation": (growing.withColumn("other", F.lit(None).cast("string")), -F.col("normalized_entropy")),
        "dampening": (damped.withColumn("other", F.lit(None).cast("string")), F.col("days_ago").cast("double")),
    }
    parts = [rows.select(F.lit(kind).alias("type"), "topic", "other", by.alias("place")) for kind, (rows, by) in place.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def sections(te: DataFrame, daily: DataFrame, volumes: DataFrame, counts: DataFrame, as_of: datetime, events: DataFrame | None = None, topics: DataFrame | None = None) -> dict[str, Section]:
    """Every section of the forecast. The tables are given once and shared; nothing runs before a section is read.

    With ``events`` and their ``topics`` (event_id, topic) there is also the section on the quality of the data.
    """
    life, scales, evenness, changes = fc.lifecycles(volumes), fc.multiscale(volumes), fc.entropy(daily), fc.cusum(daily, as_of)
    found = fc.tiers(fc.chains(daily, te, volumes, as_of), counts)
    down, up = F.desc, F.asc
    moves = dynamics(fc.reinforcing_loops(found), fc.delays(found), fc.accumulations(life, scales, evenness, fc.fresh_topics(te, as_of)), fc.dampening(life, changes))
    pair = ("from_topic", "to_topic")
    quality = {} if events is None or topics is None else {"data_quality": Section(fc.data_quality(events, topics, as_of), (), ())}
    return quality | {
        "lifecycles": Section(life, (up("topic"),), ("topic",)),
        "chains": Section(found, (down("lift"), down("support"), up("from_topic"), up("to_topic")), pair),
        "ranked_chains": Section(fc.ranked_chains(found, volumes), (down("cross_domain"), down("score"), up("from_topic"), up("to_topic")), pair),
        "scenarios": Section(fc.scenarios(found, fc.base_rates(daily), changes, evenness), (down("score"), up("topic")), ("topic",)),
        "multiscale": Section(scales, (up("topic"),), ("topic",)),
        "transitive_chains": Section(fc.transitive_chains(found), (down("combined_lift"), up("a"), up("b"), up("c")), ("a", "b", "c")),
        "entropy": Section(evenness, (up("topic"),), ("topic",)),
        "dynamics": Section(moves, (up("place"), up("topic"), up("other")), ("topic", "other"), "type"),
        "change_points_summary": Section(changes, (up("days_ago"), up("topic")), ("topic",)),
        "context": Section(fc.context_titles(te, daily.select("topic").distinct(), changes, as_of), (up("topic"),), ("topic",)),
    }


def outlook(every: dict[str, Section], mode: str = "full", topics: list[str] | None = None, only: list[str] | None = None) -> dict[str, Section]:
    """The sections a caller asked for. ``mode`` is full, compact or summary.

    Topics are filtered after everything is computed, so scores stay those of the whole. A summary with fewer than
    three scenarios takes the compact limits for lifecycles, ranked chains and dynamics. An unknown section is an error.
    The section on the quality of the data stays whole, whatever is asked for.
    """
    unknown = sorted(set(only or ()) - set(every))
    if unknown:
        raise ValueError(f"unknown sections: {', '.join(unknown)}; valid: {', '.join(every)}")
    found = {k: s.about(topics) if s.topics else s for k, s in every.items()} if topics else dict(every)
    limits = dict({"full": {}, "compact": COMPACT, "summary": SUMMARY}[mode])
    if mode == "summary" and found["scenarios"].rows.limit(THIN).count() < THIN:
        limits |= {k: COMPACT[k] for k in ("lifecycles", "ranked_chains", "dynamics")}
    return {k: s.cut(limits[k]) if k in limits else s for k, s in found.items() if limits.get(k, 1) > 0 and (not only or k in only or not s.topics)}


def listed(chosen: dict[str, Section]) -> DataFrame:
    """One table (section, topics) of what every chosen section is about."""
    out = None
    for name, s in chosen.items():
        if not s.topics:
            continue
        rows = s.rows.select(F.lit(name).alias("section"), F.concat_ws(">", *s.topics).alias("topics"))
        out = rows if out is None else out.unionByName(rows)
    return out


def warnings(every: dict[str, Section], days: int, span_days: int, least_events: int = 1) -> list[str]:
    """What a reader should know before the figures: a window longer than the data, or a window without events."""
    out = []
    if days > span_days:
        out.append(f"the window of {days} days is longer than the {span_days} days of data")
    quality = every.get("data_quality")
    row = quality.rows.first() if quality else None
    if quality and (row is None or row["events_analyzed"] < least_events):
        out.append("there are no events in the window")
    return out


def evidence(te: DataFrame, targets: DataFrame, start: Column, n: int = 5) -> DataFrame:
    """The ``n`` best events of each target topic since ``start``; an event that has many topics says less of each."""
    inside = te.join(F.broadcast(targets.select("topic").distinct()), "topic", "left_semi").where(event_time() >= start)  # one row a topic of the taxonomy
    best = top_n_per_group(inside, ["topic"], [F.desc("score"), event_time().desc(), F.asc("event_id")], n)
    many = te.join(best.select("event_id").distinct(), "event_id", "left_semi").groupBy("event_id").agg(F.count("*").alias("topic_count"))
    factor = F.when(F.col("topic_count") <= 2, 1.0).when(F.col("topic_count") <= 4, 0.7).otherwise(0.4)
    relevance = F.when(factor >= 0.7, "high").when(factor >= 0.4, "medium").otherwise("low")
    return best.join(many, "event_id").where(F.trim(F.coalesce("title", F.lit(""))) != "").select("topic", "rn", "title", "topic_count", relevance.alias("relevance"))
