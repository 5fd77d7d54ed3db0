"""Streams: ingestion with enrichment upserts, duplicate suppression, windows, health and retention.

``run_once`` drives any of them as far as data goes (availableNow) and returns what the sink holds.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidewell.functions.scalar import moment


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``; a temporary one where that is unset."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tidewell-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def read_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1000) -> DataFrame:
    """Parquet at exactly ``path`` as a stream. The path becomes a pattern, since the source takes single files only so."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{path[:-1]}[{path[-1]}]")


def run_once(stream: DataFrame, mode: str = "append", each: Callable[[DataFrame, int], None] | None = None) -> str | None:
    """Process everything there is. Without ``each``, batches are written below the returned folder, a replayed batch over itself."""
    spark = stream.sparkSession
    out = shared_folder(spark, "stream-out")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", shared_folder(spark, "stream-offsets")).trigger(availableNow=True)
    writer.foreachBatch(each or write).start().awaitTermination()
    return None if each else out


def run_durably(stream: DataFrame, put: Callable[[DataFrame, int], None], offsets: str, every: str | None = None) -> None:
    """Go on from where the query with these offsets stood, to the end of what there is, or ``every`` so often without end.

    ``put`` may get a batch twice, with one number, if an earlier run ended between its write and the engine's commit.
    """
    writer = stream.writeStream.option("checkpointLocation", offsets).foreachBatch(put)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    writer.start().awaitTermination()


def collected(stream: DataFrame, keys: list[str] | None = None, mode: str = "append") -> DataFrame:
    """What a stream has emitted; with ``keys``, the last emission of each key."""
    spark, schema = stream.sparkSession, stream.schema
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.IntegerType())])).parquet(run_once(stream, mode))
    if keys:
        rows = rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("batch")))).where("_rn = 1").drop("_rn")
    return rows.drop("batch")


def upsert(arrivals: DataFrame) -> DataFrame:
    """State of each event after all its arrivals: first known content, address and flags; best score and comments; created when first seen; fetched when something last improved.

    An arrival improves an event if it brings a content, address or flags where there were none, or a higher score or more
    comments; so the last improvement is the latest of the times at which each reached what it is now. That makes the
    state plain aggregates, which serve a batch as well as a stream in update mode, in any order of arrival. A column
    ``created_at`` of the arrivals, where there is one, marks rows that are states already, with ``fetched_at`` theirs.
    """
    at = F.col("fetched_at")
    known = F.coalesce("created_at", at) if "created_at" in arrivals.columns else at
    firsts, bests = ("content", "canonical_url", "content_flags"), ("score", "comments")
    rows = arrivals.withColumns({"_at": known, "_was": F.when(known < at, at)})
    reached = [F.min(F.when(F.col(c).isNotNull(), F.col("_at"))).alias(f"_{c}") for c in firsts]
    best = [F.max(F.when(F.col(c).isNotNull(), F.struct(c, (-F.unix_micros(F.col("_at").cast("timestamp"))).alias("t"), "_at"))).alias(f"_{c}") for c in bests]
    first = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col("_at"))).alias(c) for c in firsts]
    by = rows.groupBy("event_id").agg(*first, *reached, *best, F.min("_at").alias("created_at"), F.max("_was").alias("_was"))
    fetched = F.greatest("created_at", "_was", *[f"_{c}" for c in firsts], *[F.col(f"_{c}._at") for c in bests])
    return by.select("event_id", *firsts, *[F.col(f"_{c}.{c}").alias(c) for c in bests], "created_at", fetched.alias("fetched_at"))


def merge(current: DataFrame, arrived: DataFrame) -> DataFrame:
    """Table after a batch: a full-key grouping over both, since files have no MERGE."""
    return upsert(current.unionByName(arrived.withColumn("created_at", F.lit(None).cast(current.schema["created_at"].dataType))))


def first_topics(known: DataFrame, arrived: DataFrame) -> DataFrame:
    """Topic rows to append: the first classification of an event wins."""
    return arrived.join(known, ["event_id", "topic"], "left_anti").dropDuplicates(["event_id", "topic"])


def deduplicated(stream: DataFrame, late: str = "1 day") -> DataFrame:
    return stream.withWatermark("at", late).dropDuplicatesWithinWatermark(["event_id"])


def daily_counts(stream: DataFrame) -> DataFrame:
    return stream.groupBy("topic", F.window("at", "1 day").alias("w")).agg(F.count("*").alias("events")).select("topic", F.col("w.start").alias("day"), "events")


def sliding_counts(stream: DataFrame, width: str = "7 days", step: str = "1 day") -> DataFrame:
    return stream.groupBy("topic", F.window("at", width, step).alias("w")).agg(F.count("*").alias("events")).select("topic", F.col("w.start").alias("window_start"), "events")


def sessions(stream: DataFrame, gap: str = "6 hours") -> DataFrame:
    return stream.withWatermark("at", "1 day").groupBy("user_id", F.session_window("at", gap).alias("w")).agg(F.count("*").alias("events")).select("user_id", F.col("w.start").alias("session_start"), "events")


def health(log: DataFrame) -> DataFrame:
    """State of each feed from its polls: the last success survives errors, the last error does not survive a success, headers stick."""
    ok = F.col("error").isNull()
    return log.groupBy("source", "feed").agg(
        F.max("polled_at").alias("last_polled_at"), F.max(F.when(ok, F.col("polled_at"))).alias("last_success_at"), F.max_by("error", "polled_at").alias("last_error"),
        F.max_by("events", "polled_at").alias("events_in_poll"), F.max_by("etag", F.when(F.col("etag").isNotNull(), F.col("polled_at"))).alias("http_etag"),
    )


def retained(events: DataFrame, as_of: datetime, days: int = 120) -> DataFrame:
    return events.where(F.col("fetched_at") >= moment(as_of - timedelta(days=days)))


def compact(spark: SparkSession, source: str, target: str, files: int) -> None:
    """Archival copy with few files."""
    spark.read.parquet(source).coalesce(files).write.mode("errorifexists").parquet(target)
