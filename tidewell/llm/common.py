"""What the training-data operators share: scratch tables, distributed ranks, whole-row packing.

Rows are packed whole into one struct (``pack``) while an operator works, so that columns of the
caller can have any name, also one an operator uses for itself.
"""

from __future__ import annotations

import atexit
import functools
import hashlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_scratch: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for written intermediates: ``spark.checkpoint.dir``, or a temporary one where unset (tests)."""
    app = spark.sparkContext.applicationId
    if app not in _scratch:
        base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="tidewell-")
        _scratch[app] = f"{base.rstrip('/')}/tidewell-{uuid.uuid4().hex}"
        atexit.register(discard, spark, _scratch[app])
    return _scratch[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def discard(spark: SparkSession, path: str) -> None:
    """Delete an intermediate that nothing reads any more."""
    if spark.sparkContext._jsc is None:
        return
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage through a Parquet table in the shared folder, which survives the loss of executors.

    The path is kept in ``df._tidewell_path`` so that loops can discard what they have replaced.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tidewell_path = path
    return out


def drop_written(df: DataFrame) -> None:
    discard(df.sparkSession, df._tidewell_path)


def pack(df: DataFrame, **extra: Column) -> DataFrame:
    """``_row`` holds the row of the caller; the columns in ``extra`` are worked with."""
    return df.select(F.struct(*[df[c] for c in df.columns]).alias("_row"), *[v.alias(k) for k, v in extra.items()])


def unpacked(columns: list[str], **replaced: Column) -> list[Column]:
    return [(replaced[c] if c in replaced else F.col("_row").getField(c)).alias(c) for c in columns]


def buckets_for(rows: int, per_bucket: int = 50_000, least: int = 16, most: int = 65_536) -> int:
    """How many buckets keep a sort task small; bounded, so the table of bucket offsets always is."""
    return max(least, min(most, -(-rows // per_bucket)))


def prefix_totals(df: DataFrame, buckets: list[str], weight: Column, out: str) -> DataFrame:
    """Per bucket, the total weight of all smaller buckets. One row a bucket reaches the window."""
    totals = df.groupBy(*buckets).agg(F.sum(weight).alias("_w"))
    w = Window.orderBy(*buckets).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(*buckets, F.coalesce(F.sum("_w").over(w), F.lit(0)).cast("long").alias(out))


def global_rank(df: DataFrame, bucket: Column, order: list[Column], out: str) -> DataFrame:
    """0-based rank of every row in a total order without one task seeing all rows.

    ``bucket`` must be monotone in ``order`` and bounded in number (see ``buckets_for``): rows are
    numbered inside their bucket and moved by the number of rows in smaller buckets.
    """
    df = df.withColumn("_b", bucket)
    offsets = prefix_totals(df, ["_b"], F.lit(1), "_before").withColumnRenamed("_b", "_ob")
    w = Window.partitionBy("_b").orderBy(*order)
    return (
        df.withColumn("_rn", F.row_number().over(w))
        .join(F.broadcast(offsets), F.col("_b").eqNullSafe(F.col("_ob")))
        .withColumn(out, (F.col("_rn") - 1 + F.col("_before")).cast("long"))
        .drop("_b", "_ob", "_rn", "_before")
    )


def unit_hash(*cols: Column, seed: int) -> Column:
    """A seeded hash of a row, spread evenly over the longs."""
    return F.xxhash64(F.lit(seed), *cols)


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only. Text of one byte a character takes the quick built-in."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(col) == F.char_length(col), F.lower(col)).otherwise(F.translate(col, upper, upper.lower()))


def text_hash(col: Column) -> Column:
    return F.xxhash64(col.cast("string"))


def first_rows(docs: DataFrame, grouped: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Of each group of ``grouped`` (id, h, group) the row of ``docs`` with the smallest id, then text hash ``h``; null ids come last, equal rows stay once."""
    least = grouped.groupBy("group").agg(F.min(F.struct(F.col("id").isNull().alias("void"), "id", "h")).alias("k"))
    # one key without nulls for the join and for equal rows, so that texts are shuffled once
    key = lambda c: F.coalesce(c.cast("string"), F.lit("")).alias("key")
    least = least.select("k.void", key(F.col("k.id")), "k.h").distinct()
    rows = pack(docs, void=docs[id_col].isNull(), key=key(docs[id_col]), h=text_hash(docs[text_col]))
    kept = rows.join(least, ["void", "key", "h"], "left_semi")
    return kept.dropDuplicates(["void", "key", "h"]).select(*unpacked(docs.columns))


@functools.lru_cache(maxsize=1)
def empty_sha256() -> str:
    return hashlib.sha256(b"").hexdigest()
