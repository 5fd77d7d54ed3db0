"""Operator 13, Merkle manifest of a dataset, in Pregel-style supersteps over RDDs.

Every row is a leaf: the digest of its fields, taken by the JVM over whole texts. Only digests travel from
there on. Leaves are numbered within their group (``source``) by id through a range sort, so that a group
that holds a third of all rows lies in as many tasks as its share.

Upward: a superstep sends each node's digest to its parent, the node of its run of 16; a parent that has all
its children hashes them and is a node of the next superstep. A group that has come down to one node halts: that is
its subroot. Subroots, ordered by group, climb to the root by the same supersteps. Downward, the same supersteps in
reverse: a parent sends its run and its own path to its children, a group that is less high waits with its message,
and the leaves, which stay with their first parent, prove themselves: digests of the siblings on the path, and the root
recomputed from their own digest.

A message names a parent, so a key has 16 messages at most, whatever the sizes of groups. Supersteps number
log16 of the largest group and of the number of groups; each ends with a checkpoint in the shared folder, so a
lost executor costs one superstep. Paths are sent to first parents, not to leaves: a 16th of the rows.

Cases. A null field is written ``-``; a null group is a group of its own and comes first. Leaves of equal id in a
group stand in the order of their digests; rows that repeat each other are leaves each. A row without an
id comes first in its group and is never tampered with. An empty table has no rows. Columns other than those named are
left out, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

from pyspark import RDD
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewell.llm.common import ascii_lower, buckets_for, documents, scratch_root, written

FANOUT = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Nodes of a superstep in a task.
PER_TASK = 20_000
#: The group number of the tree over subroots.
TOP = -1


class Path(NamedTuple):
    """What comes down to a node: the root, its group's subroot, and the runs on its way up with its place in each."""

    root: str
    subroot: str | None
    runs: tuple[tuple[int, list[str]], ...]


def digest(parts: Iterable[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_digest(fields: Iterable[Column]) -> Column:
    """Each field as its byte count, a colon and the value, or ``-`` where null, all in one hash."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def ranked(df: DataFrame, group: list[str], order: list[str], rows: int) -> DataFrame:
    """``df`` with ``rank`` (from 0) in its group by ``order`` and the group's size ``n``.

    The range sort splits a group wherever it is large; a range's number in its group is a sum over as many rows as there are ranges.
    """
    ranges = df.repartitionByRange(buckets_for(rows, PER_TASK, least=1), *[F.asc_nulls_first(c) for c in [*group, *order]])
    df = written(ranges.withColumn("part", F.spark_partition_id()), "ranged")
    w = Window.partitionBy(*group)
    parts = df.groupBy(*group, "part").agg(F.count("*").alias("size"))
    before = F.coalesce(F.sum("size").over(w.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(*[F.col(c).alias(f"{c}_") for c in [*group, "part"]], before.alias("before"), F.sum("size").over(w).alias("n"))
    inside = F.row_number().over(Window.partitionBy("part", *group).orderBy(*[F.asc_nulls_first(c) for c in order]))
    on = [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in [*group, "part"]]
    return df.withColumn("inside", inside).join(parts, on).withColumn("rank", F.col("before") + F.col("inside") - 1).select(*df.drop("part").columns, "rank", "n")


def _superstep(states: RDD) -> RDD:
    """The end of a superstep: its states stand in the shared folder."""
    states.checkpoint()
    states.count()
    return states


def climb(nodes: RDD, most: int, fanout: int, rows: int) -> tuple[list[RDD], RDD]:
    """Upward supersteps from ``nodes`` ((group, place), (digest, nodes in the group, payload)).

    Returns each superstep's parents, ((group, place), (children in the group, digests, payloads)), and the nodes that are left, one a group.
    """

    def message(node: tuple) -> tuple:
        (group, place), (own, n, payload) = node
        return (group, place // fanout), (place % fanout, own, n, payload)

    def gathered(parent: tuple) -> tuple:
        (group, place), messages = parent
        run = sorted(messages, key=lambda m: m[0])
        n = run[0][2]
        if [m[0] for m in run] != list(range(min(fanout, n - place * fanout))):
            raise ValueError(f"node {place} of group {group} hasn't heard from each child once")
        return (group, place), (n, [m[1] for m in run], [m[3] for m in run])

    def forwarded(parent: tuple) -> tuple:
        key, (n, run, _) = parent
        return key, (run[0] if n == 1 else digest(run), -(-n // fanout), None)

    levels, halted = [], []
    while not levels or most > 1:
        if levels:
            halted.append(nodes.filter(lambda x: x[1][1] == 1))
            nodes = nodes.filter(lambda x: x[1][1] > 1)
        parents = nodes.map(message).groupByKey(-(-rows // PER_TASK)).map(gathered, preservesPartitioning=True)
        levels.append(_superstep(parents))
        nodes = levels[-1].map(forwarded, preservesPartitioning=True)
        most, rows = -(-most // fanout), max(1, rows // fanout)
    return levels, nodes.context.union([*halted, nodes])


def descend(levels: list[RDD], messages: RDD, fanout: int) -> RDD:
    """Downward supersteps: ((group, place), (path, parent)) for each first parent."""

    def meet(item: tuple) -> Iterator[tuple]:
        (group, place), (parents, paths) = item
        path = next(iter(paths))
        for n, run, _ in parents:
            for k, _ in enumerate(run):
                yield (group, place * fanout + k), path._replace(runs=((k, run), *path.runs)) if n > 1 else path
        if not parents:  # this group is less high
            yield (group, place), path

    for parents in levels[:0:-1]:
        messages = parents.cogroup(messages, parents.getNumPartitions()).mapValues(lambda x: (list(x[0]), list(x[1]))).flatMap(meet)
    return levels[0].join(messages, levels[0].getNumPartitions())


def fold(own: str, runs: Iterable[tuple[int, list[str]]]) -> str:
    """The root that a digest leads to by its path."""
    for place, run in runs:
        own = digest([*run[:place], own, *run[place + 1 :]])
    return own


def siblings(runs: Iterable[tuple[int, list[str]]]) -> Iterator[str]:
    for place, run in runs:
        yield from run[:place]
        yield from run[place + 1 :]


def _proofs(parent: tuple) -> Iterator[tuple]:
    _, ((n, run, payloads), path) = parent
    above = "".join(siblings(path.runs))
    for k, (own, (key, tampered)) in enumerate(zip(run, payloads, strict=True)):
        runs = path.runs if n == 1 else ((k, run), *path.runs)
        beside = [] if n == 1 else [*run[:k], *run[k + 1 :]]
        folded = fold(tampered or own, runs)
        yield key, own, path.subroot, path.root, digest([*beside, above]), folded, folded == path.root


class Manifest(NamedTuple):
    """``leaves``: a row a document with its proof. ``nodes``: (source, top, level, place, digest) of all nodes over leaves, those over subroots marked, to be kept with the data."""

    leaves: DataFrame
    nodes: DataFrame


def manifest(
    docs: DataFrame, fields: Iterable[str] = FIELDS, id_col: str = "doc_id", group_col: str = "source", fanout: int = FANOUT, where: Column | None = None, tampered: dict[str, Column] | None = None
) -> Manifest:
    """The tree over ``docs`` and each leaf's proof. Leaves ``where`` a condition holds are checked with the ``tampered`` fields in place of their own."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():  # set by spark.checkpoint.dir, but for tests
        sc.setCheckpointDir(scratch_root(spark))
    plain = {f: docs[f] for f in fields}
    moved = F.when(F.lit(False) if where is None else where, leaf_digest((plain | (tampered or {})).values()))
    leaves = docs.select(F.monotonically_increasing_id().alias("row"), docs[id_col].alias("id"), docs[group_col].alias("grp"), leaf_digest(plain.values()).alias("leaf"), moved.alias("moved"))
    leaves = written(leaves, "leaves")
    rows = leaves.count()
    kind = docs.schema[id_col].dataType.simpleString()
    out = f"id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    if not rows:
        return Manifest(spark.createDataFrame([], out), spark.createDataFrame([], "source string, top boolean, level int, place long, digest string"))
    leaves = ranked(leaves, ["grp"], ["id", "leaf", "row"], rows)
    groups = written(leaves.where("rank = 0").select("grp", "n"), "groups")
    count, most = groups.agg(F.count("*"), F.max("n")).first()
    groups = written(ranked(groups.select("grp"), [], ["grp"], count).select(F.col("grp").alias("grp_"), F.col("rank").alias("gid")), "numbered")
    placed = leaves.join(groups, leaves["grp"].eqNullSafe(groups["grp_"])).select("gid", "rank", "n", "leaf", "id", "moved")
    nodes = placed.rdd.map(lambda r: ((r[0], r[1]), (r[3], r[2], (r[4], None if r[5] == r[3] else r[5]))))
    low, subroots = climb(nodes, most, fanout, rows)
    high, roots = climb(subroots.map(lambda x: ((TOP, x[0][0]), (x[1][0], count, x[1][0]))), count, fanout, count)
    down = descend(high, roots.map(lambda x: (x[0], Path(x[1][0], None, ()))), fanout)

    def to_groups(parent: tuple) -> Iterator[tuple]:
        (_, place), ((n, run, own), path) = parent
        for k, subroot in enumerate(own):
            yield (place * fanout + k, 0), Path(path.root, subroot, path.runs if n == 1 else ((k, run), *path.runs))

    found = descend(low, down.flatMap(to_groups), fanout).flatMap(_proofs)

    def inner(levels: list[RDD]) -> list[RDD]:
        return [p.filter(lambda x: x[1][0] > 1).map(lambda x, k=k: (x[0][0], k + 1, x[0][1], digest(x[1][1]))) for k, p in enumerate(levels)]

    named = spark.createDataFrame(sc.union(inner(low) + inner(high)), "gid long, level int, place long, digest string", verifySchema=False)
    named = named.join(groups, "gid", "left").select(F.col("grp_").alias("source"), (F.col("gid") == TOP).alias("top"), "level", "place", "digest")
    return Manifest(spark.createDataFrame(found, out, verifySchema=False), named)


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    dealt = F.crc32(docs["doc_id"].cast("string")) % 5 == 0
    return manifest(docs, where=dealt, tampered={"text": ascii_lower(docs["text"])}).leaves.withColumnRenamed("id", "doc_id")
