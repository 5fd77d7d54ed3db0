"""Operator 9, quality classifier by importance resampling.

Two generative models over hashed word 1- and 2-grams, one of target text and one of raw text; a
document's log weight is the logarithm of their ratio for its n-grams. Adding seeded Gumbel noise and
taking the top k draws k documents without replacement with probabilities that follow the weights.

Raw counts cover all documents. The target model is counted over a sample of labelled rows (good and
not toxic) of at most ``TARGET_ROWS``, those whose seeded hash is smallest. k is the share of
good rows among all labels, applied to all documents, unless given. The k-th key is found by
counting keys in ever finer bins, so nothing is sorted whole; what reaches the driver is a model of
``BUCKETS`` pairs of numbers and bin counts.

Cases. Null or empty text: no n-grams, log weight 0. Repeated rows get equal keys and are selected together, so
ties at the threshold may exceed k. Without target rows all weights are 0 and the draw is uniform; without labels
everything is selected. A null ``doc_id`` is scored like any other. Long texts are counted in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import documents, table, written
from tidewell.llm.substring_dedup import BASE, _word_array, mixed

BUCKETS = 10_000
TARGET_ROWS = 20_000
BLOCK = 1 << 16
BINS = 1_000


def buckets(text: bytes) -> Iterator[np.ndarray]:
    """Hash buckets of the words and word pairs of a text, block by block."""
    words = text.split()
    for k in range(0, len(words), BLOCK):
        h = _word_array(words[k : k + BLOCK + 1])
        one = mixed(h[:BLOCK]) % np.uint64(BUCKETS)
        two = mixed(h[:-1] * BASE + h[1:]) % np.uint64(BUCKETS)
        yield np.concatenate([one, two]).astype(np.int64)


def models(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """Log ratio of the target's to the raw model's probability, for each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, BUCKETS), np.int64)
        for x in batches:
            for text, good in zip(x["text"].to_pylist(), x["good"].to_pylist(), strict=True):
                for b in buckets(text):
                    n = np.bincount(b, minlength=BUCKETS)
                    counts[0] += n
                    if good:
                        counts[1] += n
        yield pa.record_batch({"bucket": np.arange(BUCKETS, dtype=np.int32), "raw": counts[0], "target": counts[1]})

    text = F.coalesce(docs[text_col].cast("binary"), F.lit(b""))
    rows = docs.select(docs[id_col].alias("id"), text.alias("text"))
    target = target.select(F.col("id").alias("t")).withColumn("good", F.lit(True))
    rows = rows.join(F.broadcast(target), rows["id"] == target["t"], "left")  # at most TARGET_ROWS ids
    counted = rows.select("text", F.coalesce("good", F.lit(False)).alias("good")).mapInArrow(run, "bucket int, raw long, target long")
    total = np.zeros((2, BUCKETS))
    for r in counted.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect():
        total[:, r["bucket"]] = r["raw"], r["target"]
    if not total[1].any():
        return np.zeros(BUCKETS)
    p = (total + 1) / (total + 1).sum(axis=1, keepdims=True)
    return np.log(p[1]) - np.log(p[0])


def log_weights(docs: DataFrame, ratio: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(ratio)  # BUCKETS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            got = [float(sum((shared.value[b].sum() for b in buckets(t)), 0.0)) for t in x["text"].to_pylist()]
            yield pa.record_batch([x["id"], pa.array(got, pa.float64())], names=["id", "log_weight"])

    text = F.coalesce(docs[text_col].cast("binary"), F.lit(b""))
    return docs.select(docs[id_col].alias("id"), text.alias("text")).mapInArrow(run, f"id {kind}, log_weight double")


def gumbel(*cols: Column, seed: int) -> Column:
    """Standard Gumbel noise from a hash of ``cols``."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 11).cast("double") + 0.5) / 2.0**53
    return -F.log(-F.log(u))


def threshold(keys: DataFrame, k: int, column: str = "key") -> float:
    """The k-th largest of a column of finite doubles (-inf if there are fewer, +inf for k = 0), by counting in bins."""
    low, high, n = keys.agg(F.min(column), F.max(column), F.count(column)).first()
    if k <= 0:
        return float("inf")
    if n <= k:
        return float("-inf")
    left, inside = k, keys
    while True:
        width = (high - low) / BINS
        inside = keys.where(F.col(column).between(low, high))
        if width <= 0 or low + width <= low:
            return low
        place = F.least(F.lit(BINS - 1), F.floor((F.col(column) - low) / width))
        bins = inside.groupBy(place.alias("b")).agg(F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).orderBy(F.desc("b")).collect()  # at most BINS rows
        for r in bins:
            if r["n"] >= left:
                low, high = r["lo"], r["hi"]
                break
            left -= r["n"]
        if r["n"] <= BINS:
            rest = keys.where(F.col(column).between(low, high)).select(column).orderBy(F.desc(column)).limit(left).collect()  # at most BINS rows
            return rest[-1][0]


def resampled(docs: DataFrame, labels: DataFrame, keep: float | None = None, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, log_weight, key, selected) of every row."""
    good = F.coalesce((F.col("quality") == 1) & (F.col("toxic") == 0), F.lit(False))
    if keep is None:
        keep = labels.agg(F.avg(good.cast("double"))).first()[0]
    known = labels.where(good).select(F.col("doc_id").alias("id"), F.xxhash64(F.lit(seed), "doc_id").alias("h")).where("id is not null").distinct()
    # the hash is even, so a quantile leaves enough rows for the limit, and few go into the exchange
    share = min(1.0, 2.0 * (TARGET_ROWS + 50) / max(known.count(), 1))
    target = known.where(F.shiftrightunsigned("h", 11) / 2.0**53 < share).orderBy("h", "id").limit(TARGET_ROWS).select("id")
    keyed = log_weights(docs, models(docs, target, id_col, text_col), id_col, text_col)
    keyed = written(keyed.withColumn("key", F.col("log_weight") + gumbel("id", "log_weight", seed=seed)), "keys")
    k = keyed.count() if keep is None else round(keep * keyed.count())
    return keyed.withColumn("selected", F.col("key") >= threshold(keyed, k))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resampled(documents(spark, sf_dir), table(spark, sf_dir, "labels"))
    return out.withColumnRenamed("id", "doc_id")
