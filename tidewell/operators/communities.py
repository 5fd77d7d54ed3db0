"""Communities of a weighted graph by Leiden's method, with one set of rounds at every size.

A level has three phases. *Moving*: nodes go to the neighbouring community of the largest gain. *Refinement*: inside
each community nodes start alone and join neighbours, so that what comes out is connected, and may be several parts of
one community. *Aggregation*: parts become the nodes of the next level, with their communities to start from. Levels
end when moving leaves every node alone or refinement joins none. Communities whose nodes hang together only through others are
split at last, so each one is connected.

Nodes act at once, not one after another: in a round a share of them, dealt by a hash, may act while the others stand
still; first halves, then eighths. Weights are whole millionths, so sums don't depend on their order, and a round has one
result however it is computed. There are three ways: DataFrame steps, where a node of high degree is a sum that is aggregated before it is
shuffled and each round is cut off as a table in the shared folder; packed rows, one of all ends of a node, that meet the labels of up to
``SPREAD_NODES`` nodes as a broadcast array, so that a round shuffles nothing and returns its moves; and arrays, once the graph, or what
levels have left of it, has ``ARRAY_EDGES`` edges or fewer; a round of these takes up the edges of acting nodes only. All give the same communities, so the bounds change the time alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.operators.relational import both_ends, cut

#: Edges of a graph that is small enough for arrays: some 70 MB, and as much again while a round lasts.
ARRAY_EDGES = 1_000_000
#: Nodes whose labels, weights and totals are broadcast: three arrays of 32 MB at most. Their edges stay in tasks.
SPREAD_NODES = 4_000_000
#: Ends that a task looks at together, and edges a partition of packed rows.
ENDS, PACKED_EDGES = 500_000, 200_000
UNIT = 1_000_000
#: (shares that nodes are dealt in, rounds without growth of the quality after which the next begins).
DEALS = ((2, 3), (8, 8))
FIRST, SECOND, PRIME = 7919, 104_729, 1_000_003


def _acts(turn: int, shares: int) -> Column:
    """Whether it is ``node``'s turn; the deal changes once all shares have had theirs."""
    mixed = F.pmod(F.col("node"), F.lit(PRIME)) * FIRST + (turn // shares) * SECOND
    return F.pmod(F.pmod(mixed * mixed, F.lit(PRIME)), F.lit(shares)) == turn % shares


def _array_acts(nodes: np.ndarray, turn: int, shares: int) -> np.ndarray:
    mixed = nodes % PRIME * FIRST + (turn // shares) * SECOND
    return mixed * mixed % PRIME % shares == turn % shares


def _gain(w, k, t, m2: float, resolution: float):
    return w - resolution * k * t / m2


def _rounds(step, start):
    """The labels of the best round. ``step(labels, turn, shares)`` gives the next labels, the quality of those before, and the number of moves."""
    best, highest, labels = start, None, start
    for shares, patience in DEALS:
        idle, turn, still, labels = 0, 0, 0, best
        while idle < patience and still < shares:
            after, quality, moves = step(labels, turn, shares)
            if highest is None or quality > highest + 1e-9:
                best, highest, idle = labels, quality, 0
            elif turn:
                idle += 1
            still = 0 if moves else still + 1
            labels, turn = after, turn + 1
    return best


# DataFrame steps


def _moved(ends: DataFrame, loops: int, labels: DataFrame, m2: float, resolution: float) -> DataFrame:
    """Labels (node, k, label) after moving."""

    def step(labels: DataFrame, turn: int, shares: int) -> tuple[DataFrame, float, int]:
        total = labels.groupBy("label").agg(F.sum("k").alias("t"))
        # its own community stands among a node's choices, with no weight where no neighbour is in it
        near = ends.join(labels.select(F.col("node").alias("other"), "label"), "other").select("node", "label", "w").union(labels.select("node", "label", F.lit(0).cast("long")))
        near = near.groupBy("node", "label").agg(F.sum("w").alias("w")).join(total, "label").join(labels.select("node", "k", F.col("label").alias("here")), "node")
        own = F.col("label") == F.col("here")
        rest = F.col("t") - F.when(own, F.col("k")).otherwise(0)
        gain = _gain(F.col("w").cast("double"), F.col("k").cast("double"), rest.cast("double"), m2, resolution)
        to = near.select("*", gain.alias("gain")).groupBy("node", "k", "here").agg(
            F.min(F.struct((-F.col("gain")).alias("g"), "label")).alias("to"), F.max(F.when(own, F.col("gain"))).alias("stay"), F.max(F.when(own, F.col("w"))).alias("inside")
        )
        go = _acts(turn, shares) & (-F.col("to.g") > F.col("stay"))
        after = cut(to.select("node", "k", "here", "inside", F.when(go, F.col("to.label")).otherwise(F.col("here")).alias("label")), "moved")
        # the quality of the labels before this round comes with it
        at = after.groupBy("here").agg(F.sum("k").cast("double").alias("t"), F.sum("inside").alias("inside"), F.count_if(F.col("label") != F.col("here")).alias("moves"))
        inside, squares, moves = at.agg(F.sum("inside"), F.sum(F.col("t") * F.col("t")), F.sum("moves")).first()
        return after.select("node", "k", "label"), (inside + loops) / m2 - resolution * squares / m2**2, moves

    return _rounds(step, labels)


def _inner(ends: DataFrame, labels: DataFrame) -> DataFrame:
    a, b = labels.select("node", "label"), labels.select(F.col("node").alias("other"), F.col("label").alias("l2"))
    return cut(ends.join(a, "node").join(b, "other").where("label = l2").select("node", "other", "w"), "inner")


def _refined(ends: DataFrame, labels: DataFrame, m2: float, resolution: float) -> DataFrame:
    """(node, label, part): nodes that are alone join a neighbouring part of their community that gains by it and isn't itself acting."""
    inner = _inner(ends, labels)
    state, idle, turn = labels.select("node", "k", "label", F.col("node").alias("part")), 0, 0
    while idle < 2:
        parts = state.groupBy("part").agg(F.sum("k").alias("t"), F.count("*").alias("n"))
        alone = parts.where("n = 1").select(F.col("part").alias("node")).where(_acts(turn, 2))
        still = parts.join(alone.select(F.col("node").alias("part")), "part", "left_anti").select("part", "t")
        near = inner.join(alone, "node").join(state.select(F.col("node").alias("other"), "part"), "other").groupBy("node", "part").agg(F.sum("w").alias("w"))
        near = near.join(still, "part").join(state.select("node", "k"), "node")
        gain = _gain(F.col("w").cast("double"), F.col("k").cast("double"), F.col("t").cast("double"), m2, resolution)
        to = near.select("node", "part", gain.alias("gain")).where("gain > 0").groupBy("node").agg(F.min(F.struct((-F.col("gain")).alias("g"), "part")).alias("to"))
        state = cut(state.join(to, "node", "left").select("node", "k", "label", F.coalesce("to.part", "part").alias("part"), F.col("to").isNotNull().alias("joined")), "refined")
        idle, turn = 0 if state.agg(F.count_if("joined")).first()[0] else idle + 1, turn + 1
    return state.select("node", "label", "part")


def _connected(ends: DataFrame, labels: DataFrame) -> DataFrame:
    """(node, label): communities cut into their connected parts, each called after its smallest node."""
    inner, roots = _inner(ends, labels), labels.select("node", F.col("node").alias("root"))
    while True:
        least = inner.join(roots.select(F.col("node").alias("other"), "root"), "other").groupBy("node").agg(F.min("root").alias("near"))
        step = roots.join(least, "node", "left").select("node", "root", F.least("root", F.coalesce("near", "root")).alias("new"))
        # and at once to where that root has got
        jump = step.select(F.col("node").alias("new"), F.col("new").alias("far"))
        step = cut(step.join(jump, "new").select("node", "root", F.least("new", "far").alias("new")), "roots")
        if not step.agg(F.count_if(F.col("root") != F.col("new"))).first()[0]:
            return step.select("node", F.col("root").alias("label"))
        roots = step.select("node", F.col("new").alias("root"))


# arrays: nodes are places in a sorted list, labels and parts are places too


class ArrayGraph:
    """A graph of sorted ``ids`` and edges (a, b, w) between their places; loops are kept apart."""

    def __init__(self, ids: np.ndarray, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> None:
        self.ids, self.edges = ids, (a, b, w)
        loop = a == b
        self.loops = 2 * int(w[loop].sum())
        self.node, self.other, self.w = np.concatenate([a[~loop], b[~loop]]), np.concatenate([b[~loop], a[~loop]]), np.concatenate([w[~loop], w[~loop]])
        self.k = np.bincount(self.node, self.w, len(ids)) + np.bincount(a[loop], 2.0 * w[loop], len(ids))

    def sums(self, label: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(node, label, weight) of the edges in ``which`` into each label, sorted."""
        return _summed(self.node[which], label[self.other[which]], self.w[which], len(self.ids))

    @staticmethod
    def best(node: np.ndarray, to: np.ndarray, gain: np.ndarray) -> np.ndarray:
        """Of each node the row of the largest gain, then the smallest label."""
        order = np.lexsort((to, -gain, node))
        return order[np.unique(node[order], return_index=True)[1]]

    def _each(self, of: Callable, *state) -> tuple[np.ndarray, np.ndarray]:
        """What ``of`` finds for the nodes, at most a row a node."""
        return of(self.node, self.other, self.w, *state)

    def moved(self, label: np.ndarray, m2: float, resolution: float) -> np.ndarray:
        def step(label: np.ndarray, turn: int, shares: int) -> tuple[np.ndarray, float, int]:
            t = np.bincount(label, self.k, len(self.ids))
            node, to = self._each(_moves, label, self.k, t, _array_acts(self.ids, turn, shares), m2, resolution)
            go, after = node >= 0, label.copy()
            after[node[go]] = to[go]
            return after, (float(to[~go].sum()) + self.loops) / m2 - resolution * (t * t).sum() / m2**2, int(go.sum())

        return _rounds(step, label)

    def refined(self, label: np.ndarray, m2: float, resolution: float) -> np.ndarray:
        inner, part, idle, turn = label[self.node] == label[self.other], np.arange(len(self.ids)), 0, 0
        while idle < 2:
            t, n = np.bincount(part, self.k, len(self.ids)), np.bincount(part, minlength=len(self.ids))
            alone = (n == 1) & _array_acts(self.ids, turn, 2)
            node, to, w = self.sums(part, inner & alone[self.node])
            still = ~alone[to]
            node, to, w = node[still], to[still], w[still]
            gain = _gain(w, self.k[node], t[to], m2, resolution)
            node, to, gain = node[gain > 0], to[gain > 0], gain[gain > 0]
            first = self.best(node, to, gain)
            part = part.copy()
            part[node[first]] = to[first]
            idle, turn = 0 if len(first) else idle + 1, turn + 1
        return part

    def connected(self, label: np.ndarray) -> np.ndarray:
        inner, root = label[self.node] == label[self.other], np.arange(len(self.ids))
        while True:
            new = root.copy()
            np.minimum.at(new, self.node[inner], root[self.other[inner]])
            new = new[new]
            if (new == root).all():
                return root
            root = new

    def joined(self, part: np.ndarray) -> tuple[ArrayGraph, np.ndarray]:
        """The graph of the parts, and each node's place in it."""
        kept, place = np.unique(part, return_inverse=True)
        a, b, w = self.edges
        x, y = np.minimum(place[a], place[b]), np.maximum(place[a], place[b])
        key, at = np.unique(x * len(kept) + y, return_inverse=True)
        return ArrayGraph(self.ids[kept], key // len(kept), key % len(kept), np.bincount(at, w, len(key)).astype(np.int64)), place


# packed rows: places and labels as above, edges in tasks


def _summed(node: np.ndarray, to: np.ndarray, w: np.ndarray, nodes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    key, at = np.unique(node * nodes + to, return_inverse=True)
    return key // nodes, key % nodes, np.bincount(at, w, len(key))


def _moves(node, other, w, label, k, t, acts, m2, resolution) -> tuple[np.ndarray, np.ndarray]:
    """Acting nodes that gain by a move, and where they go; under node -1 the weight inside communities."""
    to = label[other]
    inside = int(w[to == label[node]].sum())
    acting = acts[node]
    every = np.unique(node[acting])
    node, to, w = np.concatenate([node[acting], every]), np.concatenate([to[acting], label[every]]), np.concatenate([w[acting], np.zeros(len(every), w.dtype)])
    node, to, w = _summed(node, to, w, len(label))
    own = to == label[node]
    gain = _gain(w, k[node], t[to] - np.where(own, k[node], 0), m2, resolution)
    first = ArrayGraph.best(node, to, gain)
    first = first[gain[first] > gain[own]]
    return np.append(node[first], -1), np.append(to[first], inside)


def _joins(node, other, w, label, part, alone, k, t, m2, resolution) -> tuple[np.ndarray, np.ndarray]:
    """Nodes that are alone and gain by joining a part that isn't acting, and that part."""
    chosen = alone[node] & (label[node] == label[other]) & ~alone[part[other]]
    node, to, w = _summed(node[chosen], part[other[chosen]], w[chosen], len(label))
    gain = _gain(w, k[node], t[to], m2, resolution)
    node, to, gain = node[gain > 0], to[gain > 0], gain[gain > 0]
    first = ArrayGraph.best(node, to, gain)
    return node[first], to[first]


def _lower(node, other, w, label, root) -> tuple[np.ndarray, np.ndarray]:
    """Nodes with a neighbour of their community that has a smaller root, and the smallest such root."""
    chosen = (label[node] == label[other]) & (root[other] < root[node])
    node, to = node[chosen], root[other[chosen]]
    order = np.lexsort((to, node))
    first = np.unique(node[order], return_index=True)
    return first[0], to[order][first[1]]


class SpreadGraph(ArrayGraph):
    """The graph of ``ids`` whose edges (a, b, w), as places, are a table; of each node the driver holds its label and its weight."""

    def __init__(self, ids: np.ndarray, edges: DataFrame, rows: int) -> None:
        self.ids, self.edges, self.k = ids, edges, np.zeros(len(ids))
        loops = edges.where("a = b").select("a", "w").toArrow()  # a row a node, as below
        ends = both_ends(edges.where("a <> b"), "a", "b").repartition(max(8, rows // PACKED_EDGES), "node")
        ends = ends.groupBy("node").agg(F.collect_list(F.struct("other", "w")).alias("e")).select("node", F.col("e.other").alias("other"), F.col("e.w").alias("w"))
        self.packed = cut(ends, "packed")
        weights = self.packed.select("node", F.aggregate("w", F.lit(0).cast("long"), lambda s, v: s + v).alias("k")).toArrow()
        self.k[weights["node"].to_numpy()] = weights["k"].to_numpy()
        self.k[loops["a"].to_numpy()] += 2.0 * loops["w"].to_numpy()
        self.loops = 2 * int(loops["w"].to_numpy().sum())

    def _each(self, of: Callable, *state) -> tuple[np.ndarray, np.ndarray]:
        """What ``of`` finds for the nodes of each few rows: at most a row a node."""
        shared = self.packed.sparkSession.sparkContext.broadcast(state)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for x in batches:
                sizes = np.diff(x["other"].offsets.to_numpy())
                groups = np.cumsum(sizes) // ENDS
                for k in np.unique(groups):
                    at = np.nonzero(groups == k)[0]
                    y = x.slice(int(at[0]), len(at))
                    node = np.repeat(y["node"].to_numpy(), sizes[at])
                    found, value = of(node, y["other"].flatten().to_numpy(), y["w"].flatten().to_numpy(), *shared.value)
                    yield pa.record_batch({"node": found.astype(np.int64), "value": value.astype(np.int64)})

        out = self.packed.mapInArrow(run, "node long, value long").toArrow()
        shared.unpersist()
        return out["node"].to_numpy(), out["value"].to_numpy()

    def refined(self, label: np.ndarray, m2: float, resolution: float) -> np.ndarray:
        part, idle, turn = np.arange(len(self.ids)), 0, 0
        while idle < 2:
            t, n = np.bincount(part, self.k, len(self.ids)), np.bincount(part, minlength=len(self.ids))
            node, to = self._each(_joins, label, part, (n == 1) & _array_acts(self.ids, turn, 2), self.k, t, m2, resolution)
            part = part.copy()
            part[node] = to
            idle, turn = 0 if len(node) else idle + 1, turn + 1
        return part

    def connected(self, label: np.ndarray) -> np.ndarray:
        root = np.arange(len(self.ids))
        while True:
            new = root.copy()
            node, to = self._each(_lower, label, root)
            new[node] = to
            new = new[new]
            if (new == root).all():
                return root
            root = new

    def joined(self, part: np.ndarray) -> tuple[ArrayGraph, np.ndarray]:
        kept, place = np.unique(part, return_inverse=True)
        return graph_of(self.ids[kept], placed(self.edges, place)), place


def placed(edges: DataFrame, place: np.ndarray, ids: np.ndarray | None = None) -> DataFrame:
    """Edges (a, b, w) with the places that ``place`` has for theirs, or for those of their ids in ``ids``; edges that become one are summed."""
    shared = edges.sparkSession.sparkContext.broadcast((place, ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, ids = shared.value
        for e in batches:
            a, b = (place[x if ids is None else np.searchsorted(ids, x)] for x in (e["a"].to_numpy(), e["b"].to_numpy()))
            yield pa.record_batch({"a": np.minimum(a, b), "b": np.maximum(a, b), "w": e["w"]})

    return edges.mapInArrow(run, "a long, b long, w long").groupBy("a", "b").agg(F.sum("w").alias("w"))


def graph_of(ids: np.ndarray, edges: DataFrame) -> ArrayGraph:
    """The graph of ``ids`` and edges (a, b, w) between their places: as arrays where it is small."""
    edges = cut(edges, "graph")
    rows = edges.count()
    if rows > ARRAY_EDGES:
        return SpreadGraph(ids, edges, rows)
    e = edges.toArrow()
    return ArrayGraph(ids, *(e[c].to_numpy() for c in ("a", "b", "w")))


def _on_arrays(graph: ArrayGraph, label: np.ndarray, m2: float, resolution: float) -> tuple[np.ndarray, np.ndarray]:
    """(node id, community's id) of the nodes of ``graph``."""
    ids, at = graph.ids, np.arange(len(graph.ids))
    while True:
        label = graph.moved(label, m2, resolution)
        if len(np.unique(label)) == len(label):
            break
        part = graph.refined(label, m2, resolution)
        if len(np.unique(part)) == len(part):
            break
        # a community is called after the smallest label of its parts, as places of parts
        called = graph.ids[label]
        graph, place = graph.joined(part)
        least = np.full(len(graph.ids), np.iinfo(np.int64).max)
        np.minimum.at(least, place, called)
        label = _places(least)
        at = place[at]
    return ids, graph.ids[graph.connected(label)][at]


def _places(names: np.ndarray) -> np.ndarray:
    """Names of communities as places, in the same order."""
    return np.unique(names, return_inverse=True)[1]


def leiden(edges: DataFrame, resolution: float = 1.0, start: DataFrame | None = None) -> DataFrame:
    """(path, label) of every path of ``edges`` (path_a, path_b, weight; to six digits). ``start`` (path, label) may give communities to begin with."""
    spark = edges.sparkSession
    a, b = F.least("path_a", "path_b").cast("long"), F.greatest("path_a", "path_b").cast("long")
    whole = F.floor(F.col("weight") * UNIT + 0.5).cast("long")
    graph = cut(edges.groupBy(a.alias("a"), b.alias("b")).agg(F.sum(whole).alias("w")).where("w > 0"), "graph")
    own = cut(both_ends(graph, "a", "b").select(F.col("node").alias("path"), F.col("node").alias("at")).distinct(), "own")
    rows, weight = graph.agg(F.count("*"), F.sum("w")).first()
    if not rows:
        return own.select("path", F.col("at").alias("label"))
    m2, labels = 2.0 * weight, None if start is None else start.select(F.col("path").cast("long").alias("node"), F.col("label").cast("long").alias("label"))
    nodes = own.count()
    while rows > ARRAY_EDGES and nodes > SPREAD_NODES:
        ends = cut(both_ends(graph.where("a <> b"), "a", "b"), "ends")
        loops = graph.where("a = b").select(F.col("a").alias("node"), (2 * F.col("w")).alias("w"))
        degree = ends.select("node", "w").union(loops).groupBy("node").agg(F.sum("w").alias("k"))
        known = degree.withColumn("label", F.col("node")) if labels is None else degree.join(labels, "node", "left").select("node", "k", F.coalesce("label", "node").alias("label"))
        labels = _moved(ends, loops.agg(F.sum("w")).first()[0] or 0, cut(known, "labels"), m2, resolution)
        now, communities = labels.agg(F.count("*"), F.count_distinct("label")).first()
        refined = None if communities == now else _refined(ends, labels, m2, resolution)
        if refined is None or refined.agg(F.count_distinct("part")).first()[0] == now:
            return own.join(_connected(ends, labels).toDF("at", "label"), "at").select("path", "label")
        part = refined.select("node", "part")
        own = cut(own.join(part.toDF("at", "part"), "at").select("path", F.col("part").alias("at")), "own")
        x, y = F.least("pa", "pb"), F.greatest("pa", "pb")
        graph = cut(graph.join(part.toDF("a", "pa"), "a").join(part.toDF("b", "pb"), "b").groupBy(x.alias("a"), y.alias("b")).agg(F.sum("w").alias("w")), "graph")
        nodes = part.agg(F.count_distinct("part")).first()[0]
        rows, labels = graph.count(), cut(refined.groupBy(F.col("part").alias("node")).agg(F.min("label").alias("label")), "labels")
    members = graph.select("a").union(graph.select("b")).distinct().toDF("node")
    ids = np.sort(members.toArrow()["node"].to_numpy())  # ``SPREAD_NODES`` at most, or those of ``ARRAY_EDGES`` edges
    small, names = graph_of(ids, placed(graph, np.arange(len(ids)), ids)), ids.copy()
    if labels is not None:
        given = labels.join(members, "node", "left_semi").select("node", "label").toArrow()
        names[np.searchsorted(ids, given["node"].to_numpy())] = given["label"].to_numpy()
    at, label = _on_arrays(small, _places(names), m2, resolution)
    found = spark.createDataFrame(pa.table({"at": at, "label": label}))
    return own.join(found, "at").select("path", "label")
