"""Operator 8, exact dedup: a stateful stream of digests with disk-backed state that never expires.

The documents are read as a stream. Its state, kept by RocksDB on the executors' disks and logged
in the shared checkpoint folder, holds for each digest of the normalised text (A-Z lower-cased) the
stable identifier that stays so far (the largest doc_id), how many rows came, and a content locator
(file and place of the row that stays). State is never dropped, so a copy is found however late it
comes, and a batch that is lost with its executor is replayed from offsets and state log. Arrivals
are aggregated before the exchange, so a digest that a third of all rows share costs one state row a task.

A hit is a digest with more than one row. Hits are checked on their full bytes: the text at the
locator is read again and compared with every member's, in partial aggregates, so no task gathers the
texts of a group. Should equal digests ever hide different bytes, those digests are grouped anew by
the bytes themselves.

Cases. A null text counts as empty. Exactly one row of a group stays, also where rows share the largest ``doc_id``,
repeat each other or all have no id: of equal ids the one furthest on by file, then place in the file. A null ``doc_id``
stays only if no row of the group has an id. Ids may be of any type with an order. Very long texts are
only hashed and compared. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import ascii_lower, documents, scratch_path, written

#: Digests of hits up to this number (32 bytes each, so 3.2 MB) are broadcast to filter the texts to check; more are joined by shuffle.
BROADCAST_DIGESTS = 100_000
#: Groups of fewer rows are never set apart.
OFTEN = 1_000
ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # many small stores would each reserve megabytes
    "spark.sql.streaming.stateStore.minDeltasForSnapshot": "50",
}


def normalised(text: Column) -> Column:
    return ascii_lower(F.coalesce(text, F.lit("")))


def locator() -> list[Column]:
    """Where a row lies: its file, and its place in it. Only tables read from Parquet files have one."""
    return [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place")]


def stream_state(spark: SparkSession, path: str, schema, files_per_batch: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Run the stream over all files at ``path`` and return its final state: (digest, keep_id, group_size, file, place)."""
    session = spark.newSession()
    for k, v in ROCKSDB.items():
        session.conf.set(k, v)
    session.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    session.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    pattern = f"{path[:-1]}[{path[-1]}]"  # a pattern of this one path: the stream source takes files by pattern only
    source = session.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(pattern)
    rows = source.select(F.unhex(F.sha2(normalised(F.col(text_col)), 256)).alias("digest"), F.col(id_col).alias("keep_id"), *locator())
    state = rows.groupBy("digest").agg(F.max(F.struct("keep_id", "file", "place")).alias("kept"), F.count("*").alias("group_size"))
    out, offsets = scratch_path(spark, "dedup-updates"), scratch_path(spark, "dedup-offsets")

    def append(batch: DataFrame, number: int) -> None:
        # the folder of a batch is overwritten, so that one replayed after a loss counts once
        batch.write.mode("overwrite").option("compression", "zstd").parquet(f"{out}/batch={number}")

    query = state.writeStream.outputMode("update").option("checkpointLocation", offsets).trigger(availableNow=True).foreachBatch(append).start()
    query.awaitTermination()
    kind = schema[id_col].dataType.simpleString()
    fields = f"digest binary, kept struct<keep_id:{kind},file:string,place:long>, group_size long, batch int"
    if not _exists(spark, out):
        updates = spark.createDataFrame([], fields)
    else:
        updates = spark.read.schema(fields).option("basePath", out).parquet(out)
    return updates.groupBy("digest").agg(F.max_by(F.struct("kept", "group_size"), "batch").alias("s")).select("digest", "s.kept.*", "s.group_size")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _joined(rows: DataFrame, state: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` with the state of their digest. Digests with more than one in ``BROADCAST_DIGESTS`` of all rows, at most so many, are broadcast, so none of them is gathered in a task."""
    total = state.agg(F.sum("group_size")).first()[0] or 0
    often = state.where(F.col("group_size") > max(OFTEN, total // BROADCAST_DIGESTS))
    if often.isEmpty():
        return rows.join(state, "digest", how)
    names = often.select("digest")
    rest = state.join(F.broadcast(names), "digest", "left_anti")
    return rows.join(F.broadcast(often), "digest", how).unionByName(rows.join(F.broadcast(names), "digest", "left_anti").join(rest, "digest", how))


def confirmed(docs: DataFrame, state: DataFrame, text_col: str = "text") -> DataFrame:
    """(digest) of hits whose members don't all have the bytes found at the locator.

    Members meet in one aggregate a digest, of which each task passes on three texts at most.
    """
    hits = state.where("group_size > 1").select("digest", "group_size", F.col("file").alias("at_file"), F.col("place").alias("at_place"))
    members = docs.select(*locator(), normalised(docs[text_col]).alias("bytes")).withColumn("digest", F.unhex(F.sha2("bytes", 256)))
    few = hits.count() <= BROADCAST_DIGESTS
    members = members.join(F.broadcast(hits), "digest") if few else _joined(members, hits)
    held = F.max(F.when((F.col("file") == F.col("at_file")) & (F.col("place") == F.col("at_place")), F.col("bytes")))
    by = members.groupBy("digest").agg(F.min("bytes").alias("low"), F.max("bytes").alias("high"), held.alias("held"))
    return by.where(~(F.col("low").eqNullSafe(F.col("held")) & F.col("high").eqNullSafe(F.col("held")))).select("digest")


def exact_groups(docs: DataFrame, state: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) of every row; exactly one row of each group is kept."""
    state = written(state, "dedup-state")
    collided = written(confirmed(docs, state, text_col), "collided")
    rows = docs.select(docs[id_col].alias("id"), *locator(), F.unhex(F.sha2(normalised(docs[text_col]), 256)).alias("digest"))
    found = state.withColumnsRenamed({"file": "keep_file", "place": "keep_place"})
    groups = _joined(rows, found)
    if not collided.isEmpty():
        texts = docs.select(docs[id_col].alias("id"), *locator(), normalised(docs[text_col]).alias("bytes")).withColumn("digest", F.unhex(F.sha2("bytes", 256)))
        texts = texts.join(collided, "digest", "left_semi")
        by_bytes = texts.groupBy("digest", "bytes").agg(F.max(F.struct("id", "file", "place")).alias("k"), F.count("*").alias("group_size"))
        by_bytes = by_bytes.select("digest", "bytes", "group_size", F.col("k.id").alias("keep_id"), F.col("k.file").alias("keep_file"), F.col("k.place").alias("keep_place"))
        anew = texts.join(by_bytes, ["digest", "bytes"]).drop("bytes")
        groups = groups.join(collided, "digest", "left_anti").unionByName(anew)
    kept = (F.col("file") == F.col("keep_file")) & (F.col("place") == F.col("keep_place"))
    return groups.select("id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def exact_dedup(spark: SparkSession, path: str, files_per_batch: int = 4096) -> DataFrame:
    """Groups of equal texts in the table at ``path``."""
    docs = spark.read.parquet(path)
    return exact_groups(docs, stream_state(spark, path, docs.schema, files_per_batch))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup(spark, f"{sf_dir}/documents.parquet")
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


ORACLE = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
"""
