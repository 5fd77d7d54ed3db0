"""Driver tables as the domain's inputs. Every adapter is one projection, so scans stay pruned and filters reach the files."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _topic(number: str, topics: int = 10):
    return F.concat(F.col("event_type"), F.lit(".t"), (F.col(number) % topics).cast("string"))


def events(spark: SparkSession, sf_dir: str, topics: int = 10) -> DataFrame:
    """Events under ``topics`` topics of each kind."""
    n = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        n.cast("string").alias("event_id"), n.alias("n"), _topic("user_id", topics).alias("topic"),
        F.concat(F.lit("s"), (F.col("user_id") % 4).cast("string")).alias("source"), F.col("ts").alias("fetched_at"),
        F.when(n % 10 != 0, F.col("ts") - F.make_dt_interval(F.lit(0), (n % 5).cast("int"))).alias("published_at"),
        F.when(n % 3 == 0, F.concat(F.lit("u"), F.floor(n / 6).cast("string"))).alias("canonical_url"),
        F.floor("value").cast("long").alias("score"), F.concat("event_type", F.lit(" "), n.cast("string")).alias("title"),
    )


def event_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "events")
    both = F.when(F.col("event_id") % 4 == 0, F.array_distinct(F.array(_topic("user_id"), _topic("event_id")))).otherwise(F.array(_topic("user_id")))
    return raw.select(F.col("event_id").cast("string").alias("event_id"), F.explode(both).alias("topic"))


def topic_events(spark: SparkSession, sf_dir: str, topics: int = 10) -> DataFrame:
    """Events joined with their topics, made in the same projection: both come from one row, so no join is needed."""
    ev = events(spark, sf_dir, topics)
    second = F.concat(F.split_part(F.col("topic"), F.lit("."), F.lit(1)), F.lit(".t"), (F.col("n") % topics).cast("string"))
    both = F.when(F.col("n") % 4 == 0, F.array_distinct(F.array(F.col("topic"), second))).otherwise(F.array(F.col("topic")))
    return ev.withColumn("topic", F.explode(both))


def latest(df: DataFrame, column: str = "fetched_at") -> datetime:
    """The default for ``as_of``: the newest time in the table."""
    return df.agg(F.max(column)).first()[0]


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line of an order is a change of a path in a commit; return flags A, N, R stand for added, modified, deleted.

    Orders grow with the lines, and the files' sizes say too little of the rows' in memory, so they are merged and never broadcast.
    """
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return li.join(o.hint("merge"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_orderkey").alias("commit_sha"), F.col("l_partkey").alias("path"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("commit_ts"),
        (F.col("o_custkey") % 20).alias("author"), F.when(F.col("l_returnflag") == "A", "A").when(F.col("l_returnflag") == "N", "M").otherwise("D").alias("status"),
    )


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("path"), F.regexp_extract("p_brand", r"(\d+)", 1).cast("int").alias("cluster_id"))


def imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directed counts: supplier's nation imports customer's nation."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    s, c = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    rows = li.join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    return rows.groupBy(F.col("s_nationkey").alias("source_path"), F.col("c_nationkey").alias("resolved_path")).agg(F.count("*").alias("count"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("path"), F.col("embedding").alias("vector"), "label")
