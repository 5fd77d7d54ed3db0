"""The event store that streams write to: events, their topics and forecast snapshots, in versions that change together.

A batch appends its arrivals and the topics of events that had none; nothing is rewritten. What an event is now
follows from all its arrivals (``ingest.upsert``), so the order of batches doesn't matter. ``compact`` folds arrivals into one row an event
from time to time. Everything is one commit of ``Versions``: readers see events with their topics or neither, and a batch that is
replayed after a failure changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions.scalar import moment
from tidewell.sources.versions import Part, Versions
from tidewell.streaming import ingest

#: What an event keeps of its first arrival.
FIXED = ["source", "feed", "url", "title", "author", "tags", "published_at", "form", "cik"]
STATE = ["content", "canonical_url", "content_flags", "score", "comments", "fetched_at"]
KINDS = dict(part.split(" ") for part in "event_id string, source string, feed string, url string, title string, author string, tags array<string>, published_at timestamp, form string, cik string, content string, canonical_url string, content_flags string, score long, comments long, fetched_at timestamp, created_at timestamp".split(", "))

Classify = Callable[[DataFrame], DataFrame]


def arrivals(batch: DataFrame) -> DataFrame:
    """``batch`` with all columns of the store; those it lacks are null."""
    have = set(batch.columns)
    return batch.select(*[(F.col(c) if c in have else F.lit(None)).cast(kind).alias(c) for c, kind in KINDS.items()]).where("event_id is not null")


def states(rows: DataFrame) -> DataFrame:
    """One row an event."""
    at = F.coalesce("created_at", "fetched_at")
    first = rows.groupBy("event_id").agg(F.min(F.struct(at.alias("at"), F.xxhash64(*FIXED[:-3], "form", "cik").alias("h"), *FIXED)).alias("f")).select("event_id", *[F.col(f"f.{c}").alias(c) for c in FIXED])
    return ingest.upsert(rows.select("event_id", *STATE, "created_at")).join(first, "event_id").select(*KINDS)


class EventStore:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.versions = spark, Versions(spark, root)

    def _read(self, name: str, like: str, version: int | None = None) -> DataFrame:
        found = self.versions.read(name, version)
        return self.spark.createDataFrame([], like) if found is None else found

    def events(self, version: int | None = None) -> DataFrame:
        return states(self._read("arrivals", ", ".join(" ".join(x) for x in KINDS.items()), version))

    def topics(self, version: int | None = None) -> DataFrame:
        return self._read("topics", "event_id string, topic string, confidence double, classifier string", version)

    def snapshots(self, version: int | None = None) -> DataFrame:
        return self._read("snapshots", "snapshot_at timestamp, kind string, topic string, value double", version)

    def write(self, batch: DataFrame, number: int, stream: str = "feeds", classify: Classify | None = None, classifier: str = "first") -> int:
        """A batch of arrivals; ``classify`` gives (event_id, topic, confidence) of events. The first classification of an event stays."""
        base = self.versions.record()
        if base["streams"].get(stream, -1) >= number:
            return base["version"]
        rows = arrivals(batch).persist()
        try:
            add = {"arrivals": rows}
            if classify:
                # only this batch's events can be new, so the known topics are looked up by its ids
                found = classify(rows.dropDuplicates(["event_id"])).select("event_id", "topic", F.col("confidence").cast("double").alias("confidence"), F.lit(classifier).alias("classifier"))
                done = self.topics(base["version"]).join(F.broadcast(rows.select("event_id").distinct()), "event_id", "left_semi") if base["version"] else self.topics()
                add["topics"] = found.dropDuplicates(["event_id", "topic"]).join(done.select("event_id").distinct(), "event_id", "left_anti")
            return self.versions.commit(append=add, batch=(stream, number), base=base)
        finally:
            rows.unpersist()

    def sink(self, stream: str = "feeds", classify: Classify | None = None) -> Callable[[DataFrame, int], None]:
        """For ``foreachBatch``."""

        def put(batch: DataFrame, number: int) -> None:
            self.write(batch, number, stream, classify)

        return put

    def add_snapshots(self, rows: DataFrame, batch: int) -> int:
        return self.versions.commit(append={"snapshots": rows}, batch=("snapshots", batch))

    def reclassify(self, classify: Classify, classifier: str) -> int:
        """All topics anew by a later classifier, whose name each row holds; earlier versions keep the earlier ones."""
        base = self.versions.record()
        found = classify(self.events(base["version"])).select("event_id", "topic", F.col("confidence").cast("double").alias("confidence"), F.lit(classifier).alias("classifier"))
        return self.versions.commit(replace={"topics": found.dropDuplicates(["event_id", "topic"])}, base=base)

    def compact(self) -> int:
        """Arrivals become states, one row an event, in few files."""
        base = self.versions.record()
        return self.versions.commit(replace={"arrivals": self.events(base["version"])}, base=base)

    def _without(self, name: str, base: dict, gone: DataFrame, key: str) -> tuple:
        """A table's parts after ``gone`` (key) is deleted: those without such rows stay as they are, the others become one."""
        parts, table = self.versions.parts(name, base), self.versions.read(name, record=base)
        where = F.element_at(F.split(F.input_file_name(), "/"), -2).alias("part")
        touched = {r["part"] for r in table.select(key, where).join(gone, key, "left_semi").select("part").distinct().collect()}  # names of parts
        kept: list[Part] = [p for p in parts if p.path not in touched]
        if touched:
            rest = self.spark.read.schema(table.schema).parquet(*[f"{self.versions.root}/data/{p.path}" for p in parts if p.path in touched])
            kept.append(self.versions.stage(name, rest.join(gone, key, "left_anti").select(*table.columns)))
        return table.schema, kept

    def retain(self, as_of: datetime, days: int = 120, snapshot_days: int = 90) -> int:
        """Delete events last fetched before ``days``, their arrivals and their topics, and snapshots before ``snapshot_days``, in one commit.

        Only parts with such rows are written anew. Where nothing is old there is no new version.
        """
        base = self.versions.record()
        old = self.events(base["version"]).where(F.col("fetched_at") < moment(as_of - timedelta(days=days))).select("event_id").persist()
        try:
            parts = {name: self._without(name, base, old, "event_id") for name in ("arrivals", "topics") if name in base["tables"]}
            if "snapshots" in base["tables"]:
                late = self.snapshots(base["version"]).where(F.col("snapshot_at") < moment(as_of - timedelta(days=snapshot_days))).select("snapshot_at").distinct()
                parts["snapshots"] = self._without("snapshots", base, late, "snapshot_at")
            if all([p.path for p in kept] == [p.path for p in self.versions.parts(name, base)] for name, (_, kept) in parts.items()):
                return base["version"]
            return self.versions.commit(parts=parts, base=base)
        finally:
            old.unpersist()
