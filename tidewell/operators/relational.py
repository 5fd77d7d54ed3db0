"""Relational shapes the domain operators are made of."""

from __future__ import annotations

import math
from datetime import datetime

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewell.functions import cursor
from tidewell.functions.scalar import moment
from tidewell.streaming.ingest import shared_folder


def top_n_per_group(df: DataFrame, group: list[str], order: list[Column], n: int, rank: str = "rn") -> DataFrame:
    """The first ``n`` rows of each group. Spark applies the limit before the exchange too."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(rank) <= n)


def capped_scan(df: DataFrame, group: list[str], order: list[Column], per_group: int, total: int) -> DataFrame:
    """A scan in ``order`` that takes at most ``per_group`` rows of a group and ``total`` rows in all."""
    return top_n_per_group(df, group, order, per_group, "_cap").drop("_cap").orderBy(*order).limit(total)


def keyset_page(df: DataFrame, first: str, second: str, after: tuple | None, limit: int, descending: bool = True) -> DataFrame:
    """A page of ``limit`` rows in (first, second desc) order that begins behind the row ``after``; see ``with_next`` for whether there is another."""
    a, b = F.col(first), F.col(second)
    if after is not None:
        x, y = (moment(v) if isinstance(v, datetime) else F.lit(v) for v in after)
        df = df.where((a < x if descending else a > x) | ((a == x) & (b < y)))
    return df.orderBy(a.desc() if descending else a.asc(), b.desc()).limit(max(1, min(limit, 100)))


def with_next(df: DataFrame, order: list[Column], limit: int, command: str, keys: list[str]) -> tuple[list[Row], str | None]:
    """The first ``limit`` rows and the cursor of the page behind them, None at the end. One row more is read to tell."""
    rows = df.orderBy(*order).limit(limit + 1).collect()  # a page
    if len(rows) <= limit:
        return rows, None
    last = rows[limit - 1]
    return rows[:limit], cursor.encode(command, {k: last[k].isoformat() if isinstance(last[k], datetime) else last[k] for k in keys})


def band_join(left: DataFrame, right: DataFrame, day: str, within: int, condition: Column) -> DataFrame:
    """Rows with ``0 < right.day - left.day <= within``: an equi-join on each lag instead of a nested loop. Aliases: a, b."""
    shifted = left.withColumn("lag", F.explode(F.sequence(F.lit(1), F.lit(within)))).withColumn("to_day", F.date_add(day, F.col("lag")))
    return shifted.alias("a").join(right.alias("b"), (F.col("a.to_day") == F.col(f"b.{day}")) & condition)


def both_ends(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Every undirected edge seen from each of its ends: columns ``node`` and ``other`` beside the rest."""
    rest = [c for c in edges.columns if c not in (a, b)]
    ends = F.explode(F.array(F.struct(F.col(a).alias("node"), F.col(b).alias("other")), F.struct(F.col(b).alias("node"), F.col(a).alias("other"))))
    return edges.select(*rest, ends.alias("_e")).select("_e.node", "_e.other", *rest)


def average_rank(df: DataFrame, value: str, out: str) -> DataFrame:
    """Percentile rank with ties averaged, over the distinct values only."""
    counts = df.groupBy(value).agg(F.count("*").alias("_ties"))
    w = Window.orderBy(value)
    below = F.coalesce(F.sum("_ties").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("_ties").over(Window.partitionBy())
    ranks = counts.select(F.col(value).alias("_v"), ((below + (F.col("_ties") + 1) / 2) / total).alias(out))
    return df.join(ranks, F.col(value) == F.col("_v")).drop("_v")


def upper_median(df: DataFrame, value: str) -> Column:
    """Aggregate: element floor(n / 2) of the sorted values."""
    return F.element_at(F.array_sort(F.collect_list(value)), (F.floor(F.count(value) / 2) + 1).cast("int"))


#: Ranges that a round of counting splits the values into, and rows that the driver sorts at the end.
RANGES, FEW = 1024, 4096


def _at_rank(values: DataFrame, rank: int, low: float, high: float, rows: int) -> float:
    """The value of a 0-based rank: count in equal ranges, go on in the range that holds it."""
    v, below = F.col("v"), 0
    while rows > FEW and low < high:
        part = F.least(F.lit(RANGES - 1), F.floor((v - low) / ((high - low) / RANGES)))
        counts = values.where(v.between(low, high)).groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        for r in counts.orderBy("part").collect():  # a row a range
            if below + r["n"] > rank:
                low, high, rows = r["low"], r["high"], r["n"]
                break
            below += r["n"]
    if low == high:
        return low
    left = values.where(v.between(low, high)).groupBy("v").agg(F.count("*").alias("n")).orderBy("v").collect()  # at most ``FEW`` rows
    for r in left:
        below += r["n"]
        if below > rank:
            return r["v"]
    raise AssertionError("the values changed while they were counted")


def exact_percentile(df: DataFrame, column: str, share: float) -> float | None:
    """The percentile with linear interpolation, as ``percentile`` has it, by counts alone: no task holds or sorts the values. Nulls don't count; None without values."""
    values = df.select(F.col(column).cast("double").alias("v")).where("v is not null")
    n, low, high = values.agg(F.count("*"), F.min("v"), F.max("v")).first()
    if not n:
        return None
    at = share * (n - 1)
    first = math.floor(at)
    one = _at_rank(values, first, low, high, n)
    if at == first:
        return one
    upto, after = values.agg(F.count_if(F.col("v") <= one), F.min(F.when(F.col("v") > one, F.col("v")))).first()
    two = one if upto > first + 1 else after
    return (first + 1 - at) * one + (at - first) * two


def global_number(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """``df`` with a 0-based number in a total order; rows are sorted in ranges, and only a row a range meets in one window."""
    ranged = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    ranged = cut(ranged, "numbered")
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = ranged.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return ranged.join(F.broadcast(before), "_part").withColumn(out, (own + F.col("_before")).cast("int")).drop("_part", "_before")  # a row a range


def cut(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, which cuts its lineage and survives lost executors."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
