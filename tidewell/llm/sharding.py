"""Operator 10, sharding: proportional stratified interleaving.

Rows are ranked in a seeded shuffle inside their source; the rank over the size of the source is a
fraction in (0, 1), and all rows sorted by it interleave the sources in proportion. Cutting that
sequence into equal parts gives shards that match the mixture, with counts at most one apart (the
law ``rows``). Both ranks come from bounded buckets of an evenly spread key, so neither a source
with most rows nor the whole sequence is ever sorted in one task.

Cases. A null source is a source of its own; a null text has size 16 and checksum 0. Repeated rows
are rows like any other, and ties between them are broken by all that tells them apart; rows that
agree in doc_id, source and text are interchangeable. A null ``doc_id`` takes part as a value. An
empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewell.llm.common import buckets_for, documents, global_rank, written


#: Equal rows above this number, and above one in so many of all rows, are spread; the second bounds how many hashes are broadcast.
OFTEN, MOST_OFTEN = 1_000, 10_000


def stratified_shards(docs: DataFrame, shards: int = 40, seed: int = 42, stratum: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, stratum, size, text_crc32, shard, slot) of every row; slots count from 0 without gaps in each shard."""
    text = F.coalesce(docs[text_col], F.lit(""))
    rows = docs.select(
        docs[id_col].alias("id"), docs[stratum].alias("stratum"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(F.lit(seed), docs[id_col], F.xxhash64(text)).alias("h"),
    )
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "shard-rows")
    # rows that repeat each other share their hash; where they are many, their places in the table spread them
    often = rows.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > max(OFTEN, rows.count() // MOST_OFTEN)).select("h", F.lit(True).alias("often"))
    rows = rows.join(F.broadcast(often), "h", "left").withColumn("h", F.when(F.col("often"), F.xxhash64("h", "row")).otherwise(F.col("h"))).drop("often", "row")
    sizes = rows.groupBy("stratum").agg(F.count("*").alias("n_stratum"))
    total = rows.count()
    n = buckets_for(total, least=256)
    tie = [F.col("h"), F.col("id"), F.col("text_crc32"), F.col("size")]
    # rank inside the source: bucket by the even hash, offset by the smaller buckets of the same source
    spread = F.floor((F.shiftright("h", 32).cast("double") + 2.0**31) / 2.0**32 * n).cast("long")
    placed = rows.withColumn("b", spread)
    counts = placed.groupBy("stratum", "b").agg(F.count("*").alias("w"))
    before = F.sum("w").over(Window.partitionBy("stratum").orderBy("b").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(F.col("stratum").alias("s"), F.col("b").alias("sb"), F.coalesce(before, F.lit(0)).alias("before"))
    placed = placed.withColumn("rn", F.row_number().over(Window.partitionBy("stratum", "b").orderBy(*tie)))
    placed = placed.join(counts, placed["stratum"].eqNullSafe(counts["s"]) & (placed["b"] == counts["sb"]))
    placed = placed.select("id", "stratum", "size", "text_crc32", "h", (F.col("rn") + F.col("before")).alias("rank"))
    sizes = sizes.withColumnRenamed("stratum", "s")
    placed = placed.join(sizes, placed["stratum"].eqNullSafe(sizes["s"]))
    # each source starts at a place of its own in its first interval, else sources of one size would move in step
    phase = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit("phase"), "stratum"), 11).cast("double") + 0.5) / 2.0**53
    placed = placed.withColumn("fraction", (F.col("rank") - phase) / F.col("n_stratum"))
    placed = global_rank(placed, F.floor(F.col("fraction") * n).cast("long"), [F.col("fraction"), F.xxhash64(F.lit(seed), "stratum"), F.col("stratum"), *tie], "g")
    q, r = divmod(total, shards)
    g, head = F.col("g"), r * (q + 1)
    shard = F.when(g < head, F.floor(g / (q + 1))).otherwise(r + F.floor((g - head) / max(q, 1))).cast("int")
    placed = placed.withColumn("shard", shard)
    s = F.col("shard").cast("long")
    start = F.when(s <= r, s * (q + 1)).otherwise(head + (s - r) * q)
    return placed.select("id", "stratum", "size", "text_crc32", "shard", (g - start).cast("long").alias("slot"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stratified_shards(documents(spark, sf_dir))
    return out.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), F.col("stratum").alias("source"))
