"""Graph operators on sizes at which the older forms failed by time or memory, and equal results of all their forms."""

import heapq
import random
import threading
import tracemalloc
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.operators import communities
from tidewell.operators import graph as g
from tidewell.operators.communities import leiden


def random_edges(seed, nodes, edges):
    rng = random.Random(seed)
    pairs = {tuple(sorted(rng.sample(range(nodes), 2))) for _ in range(edges)}
    return [(a * 3, b * 3, rng.choice([1.0, 0.5, 0.25, round(rng.random(), 6) + 1e-6])) for a, b in sorted(pairs)]


def brandes(edges, source):
    """Dependencies by one heap, as the textbook has them."""
    near = defaultdict(list)
    for a, b, w in edges:
        near[a].append((b, 1 / w))
        near[b].append((a, 1 / w))
    at, count, before, order, heap, done = {source: 0.0}, defaultdict(float, {source: 1.0}), defaultdict(list), [], [(0.0, source)], set()
    while heap:
        d, v = heapq.heappop(heap)
        if v in done:
            continue
        done.add(v)
        order.append(v)
        for u, w in near[v]:
            if u not in at or d + w < at[u] - 1e-12:
                at[u], count[u], before[u] = d + w, count[v], [v]
                heapq.heappush(heap, (d + w, u))
            elif u not in done and abs(d + w - at[u]) <= 1e-12:
                count[u] += count[v]
                before[u].append(v)
    out = defaultdict(float)
    for u in reversed(order):
        for v in before[u]:
            out[v] += count[v] / count[u] * (1 + out[u])
    out.pop(source)
    return out


@pytest.mark.parametrize(("nodes", "edges", "at_once"), [(12, 30, 4), (80, 90, 1 << 18), (200, 2000, 64)])
def test_path_search_on_arrays_equals_brandes(monkeypatch, nodes, edges, at_once):
    """A task went edge by edge in Python."""
    monkeypatch.setattr(g, "AT_ONCE", at_once)
    rows = random_edges(nodes, nodes, edges)
    a, b, w = (np.array(c) for c in zip(*rows, strict=True))
    ids = np.union1d(a, b)
    graph = g.adjacency(ids, np.searchsorted(ids, a), np.searchsorted(ids, b), 1 / w)
    for s in random.Random(1).sample(range(len(ids)), 5):
        want = brandes(rows, int(ids[s]))
        assert g.dependencies(graph, s) == pytest.approx([want.get(int(v), 0.0) for v in ids], rel=1e-12, abs=1e-9)


@pytest.mark.parametrize("spread", [4_000_000, 0])
def test_packed_rows_and_steps_give_the_communities_of_arrays(spark, monkeypatch, spread):
    """beyond ``ARRAY_EDGES`` each round was some joins and a table."""
    rng = random.Random(5)
    rows = [(a, b, 1.0) for c in range(4) for a in range(c * 6, c * 6 + 6) for b in range(a + 1, c * 6 + 6)] if not spread else random_edges(2, 60, 400)
    edges = spark.createDataFrame([*rows, *[(rng.randrange(20), 20 + rng.randrange(4), 0.05) for _ in range(3)]], "path_a long, path_b long, weight double")
    want = {tuple(r) for r in leiden(edges).collect()}
    monkeypatch.setattr(communities, "ARRAY_EDGES", 5)
    monkeypatch.setattr(communities, "SPREAD_NODES", spread)
    monkeypatch.setattr(communities, "ENDS", 40)
    if spread:
        monkeypatch.setattr(communities, "_moved", None)  # the steps are not taken
    assert {tuple(r) for r in leiden(edges).collect()} == want


def test_windows_of_drift_run_together(spark, monkeypatch):
    """windows were worked out one after another."""
    commits = spark.createDataFrame([(f"c{k}", 100 + k * 40 * g.DAY, p) for k in range(4) for p in (k, k + 1, k + 2)], "commit_sha string, commit_ts long, path long")
    none = spark.createDataFrame([], "path_a long, path_b long, w_sem double, w_dep double")
    both, met = threading.Barrier(2), []

    def found(edges):
        if len(met) < 2:
            met.append(1)
            both.wait(60)
        return edges.selectExpr("path_a AS path", "0 AS cluster_id").union(edges.selectExpr("path_b", "0")).distinct()

    monkeypatch.setattr(g, "communities", found)
    rows = g.drift(commits, none, none).collect()
    assert len(rows) > 1 and [r["window_end_ts"] for r in rows] == sorted(r["window_end_ts"] for r in rows) and {r["ari_prev"] for r in rows} == {1.0}


def test_similarities_are_held_in_blocks_of_one_size():
    """512 rows against all others were held at once, several times over."""
    rng = np.random.default_rng(1)
    x, ids = g._unit(rng.standard_normal((40_000, 8))), np.arange(40_000)
    tracemalloc.start()
    found = g._top(ids[:300], x[:300], ids, x, 3, 0.9)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6
    sims = np.floor(x[:5] @ x.T * 1e6 + 0.5) / 1e6
    for i in range(5):
        want = sorted((-v, j) for j, v in enumerate(sims[i]) if v >= 0.9 and j != i)[:3]
        assert [(-s, j) for k, j, s in found if k == i] == want


def test_blocks_of_vectors_meet_once_and_are_large(spark, monkeypatch):
    """Every vector went to two tasks for each block of 4,096, in place of one for each block of 16 MB."""
    rng = np.random.default_rng(3)
    v = spark.createDataFrame([(int(i), x.tolist()) for i, x in enumerate(rng.standard_normal((300, 4)).astype(np.float32))], "path long, vector array<float>")
    want = sorted(map(tuple, g.neighbours(v, 3, 0.5).collect()))
    monkeypatch.setattr(g, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(g, "BLOCK_BYTES", 60 * 4 * 8)
    found = g.neighbours(v, 3, 0.5)
    assert sorted(map(tuple, found.collect())) == want
    met, real = spark.sparkContext.accumulator(0), g._top

    def counted(ids, x, other_ids, other, k, tau):
        met.add(len(ids))
        return real(ids, x, other_ids, other, k, tau)

    monkeypatch.setattr(g, "_top", counted)
    g.neighbours(v, 3, 0.5).collect()
    assert met.value == 300 * 5  # once a block of 60


def test_neighbours_that_are_found_are_no_objects():
    """Every hit was a tuple of Python's numbers, and every similarity was rounded."""
    rng = np.random.default_rng(2)
    x, ids = g._unit(np.concatenate([rng.standard_normal((3_900, 8)), np.ones((100, 8))])), np.arange(4_000)[::-1]
    tracemalloc.start()
    found = g._top(ids, x, ids, x, 60, 0.1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == 4_000 * 60 and peak < 30e6
    sims = np.floor(x @ x.T * 1e6 + 0.5) / 1e6
    for i in (0, 17, 3_950):  # the last is one of many copies
        want = sorted((-v, j) for j, v in zip(ids, sims[i], strict=True) if v >= 0.1 and j != ids[i])[:60]
        assert [(-s, j) for k, j, s in found if k == ids[i]] == want


def test_hashing_shuffles_texts_and_not_tokens(spark):
    """tokens of each text were shuffled, then its sums twice."""
    texts = spark.createDataFrame([(1, "a b a"), (2, None), (1, "c"), (3, " ")], "path long, text string")
    got = g.hashed_vectors(texts)
    assert got.groupBy("path").agg(F.round(F.sum(F.col("weight") ** 2), 4)).collect() == [(1, 1.0)]
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_edges_too_many_for_the_driver_are_read_by_tasks(spark, monkeypatch):
    """Beyond the bound every state met every edge in joins, a table a round."""
    edges = spark.createDataFrame([(a, b, round(w, 6)) for a, b, w in random_edges(7, 12, 18)], "path_a long, path_b long, weight double")
    want = {r["path"]: r["betweenness"] for r in g.betweenness(edges, pivots=4).collect()}
    monkeypatch.setattr(g, "DRIVER_EDGES", 5)
    for way in ("_spread_betweenness", "_read_betweenness"):  # either alone
        with monkeypatch.context() as only:
            only.setattr(g, way, None)
            if way == "_read_betweenness":
                only.setattr(g, "TASK_BYTES", 0)
            got = {r["path"]: r["betweenness"] for r in g.betweenness(edges.repartition(5), pivots=4).collect()}
        assert got == pytest.approx(want, abs=2e-9) and any(want.values())


def test_a_round_on_arrays_takes_up_acting_nodes_only(monkeypatch):
    """each round sorted the ends of all nodes, also where an eighth of them acts."""
    rows = random_edges(9, 400, 4000)
    a, b, w = (np.array(c) for c in zip(*rows, strict=True))
    ids = np.union1d(a, b)
    graph = communities.ArrayGraph(ids, np.searchsorted(ids, a), np.searchsorted(ids, b), (w * 1e6 + 0.5).astype(np.int64))
    seen, real = [], communities._summed
    monkeypatch.setattr(communities, "_summed", lambda node, *rest: (seen.append(len(node)), real(node, *rest))[1])
    graph.moved(np.arange(len(ids)), float(graph.k.sum()), 1.0)
    assert max(seen) < 0.7 * len(graph.node) and min(seen) < 0.25 * len(graph.node)
