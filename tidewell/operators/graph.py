"""Repository graph: edges from commits, imports and meaning; their fusion; metrics of files and clusters."""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewell.functions.scalar import half_up, ratio
from tidewell.operators.communities import UNIT, leiden
from tidewell.operators.relational import average_rank, both_ends, cut, exact_percentile, global_number

DAY = 86_400
#: Largest matrix that is broadcast; beyond it blocks are joined, of so many bytes as doubles.
BROADCAST_BYTES = BLOCK_BYTES = 16 << 20
#: Most edges that a task's path search takes from a broadcast, 24 bytes each.
DRIVER_EDGES = 12_000_000
#: Bytes of the edges that a task reads from a table for its path search, 16 an edge of whole millionths; beyond, the search runs in DataFrame steps.
TASK_BYTES = 512 << 20
#: Tasks that the starts of a path search are dealt to where each reads all edges.
SEARCHES = 12
#: Edges that a path search looks at together, and numbers of a block of similarities: some MB of memory.
AT_ONCE, SIMILARITIES = 1 << 18, 1 << 20
#: A pair that was found, eight bytes a field.
HIT = np.dtype([("src", "i8"), ("dst", "i8"), ("similarity", "f8")])
WINDOWS_AT_ONCE = 3


def _scaled(raw: DataFrame, out: str) -> DataFrame:
    """``raw`` over its 95th percentile (over its maximum where that is zero), at most one."""
    raw = cut(raw, "raw")  # read once for each round of counting
    top = exact_percentile(raw, "raw", 0.95) or raw.agg(F.max("raw")).first()[0]
    return raw.withColumn(out, half_up(F.least(F.lit(1.0), ratio(F.col("raw"), F.lit(top))), 6))


def _pairs(commits: DataFrame, cap: int) -> DataFrame:
    """(path_a, path_b, commit_ts, m) of paths changed in one commit of ``m``. Commits over ``cap`` paths go before pairs are made, which bounds the pairs of a commit."""
    # counted before they are collected, so that a commit over the cap never makes a row
    m = F.count("*").over(Window.partitionBy("commit_sha", "commit_ts"))
    rows = commits.select("commit_sha", "commit_ts", "path").distinct().withColumn("m", m).where(F.col("m").between(2, cap))
    by = rows.groupBy("commit_sha", "commit_ts").agg(F.array_sort(F.collect_list("path")).alias("paths"))
    one = by.select("commit_ts", F.size("paths").alias("m"), "paths", F.posexplode("paths").alias("i", "path_a"))
    return one.select("path_a", "commit_ts", "m", F.explode(F.expr("slice(paths, i + 2, size(paths))")).alias("path_b"))


def _near_or_strong(raw: DataFrame, tau: float, k: int) -> DataFrame:
    """Scaled weights of pairs, those of ``tau`` or more and the ``k`` best of either end."""
    rows = _scaled(raw, "w_co")
    ends = both_ends(rows.select("path_a", "path_b", "w_co"), "path_a", "path_b")
    near = ends.withColumn("rn", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("w_co"), F.least("node", "other"), F.greatest("node", "other")))).where(F.col("rn") <= k)
    near = near.select(F.least("node", "other").alias("path_a"), F.greatest("node", "other").alias("path_b")).distinct().withColumn("near", F.lit(True))
    kept = rows.join(near, ["path_a", "path_b"], "left").where((F.col("w_co") >= tau) | F.col("near"))
    return kept.select("path_a", "path_b", half_up(F.col("raw"), 6).alias("w_co_raw"), "w_co")


def _halved(age: Column, half_life: float) -> Column:
    return F.pow(F.lit(2.0), -age / float(DAY) / half_life)


def cochange_edges(commits: DataFrame, cap: int = 50, half_life: float = 180.0, tau: float = 0.10, k: int = 10) -> DataFrame:
    """Pairs of paths changed in one commit, weighted by its size and age."""
    last = commits.agg(F.max("commit_ts").alias("last"))
    age = F.greatest(F.lit(0), F.col("last") - F.col("commit_ts"))
    pairs = _pairs(commits, cap).crossJoin(F.broadcast(last))  # one row
    return _near_or_strong(pairs.groupBy("path_a", "path_b").agg(half_up(F.sum(_halved(age, half_life) / (F.col("m") - 1)), 9).alias("raw")), tau, k)


def cochange_windows(commits: DataFrame, ends: list[int], cap: int = 50, half_life: float = 180.0, tau: float = 0.10, k: int = 10) -> list[DataFrame]:
    """``cochange_edges`` of the commits up to each of ``ends``, from one pass over the pairs.

    Each pair has a sum for each end, all of ages at one time; at another time every age is longer or shorter by
    the same, so a sum is carried there by one factor.
    """
    lasts = commits.agg(F.max("commit_ts").alias("l"), *[F.max(F.when(F.col("commit_ts") <= e, F.col("commit_ts"))).alias(f"l{n}") for n, e in enumerate(ends)]).first()
    share = _halved(F.lit(lasts["l"]) - F.col("commit_ts"), half_life) / (F.col("m") - 1)
    sums = _pairs(commits, cap).groupBy("path_a", "path_b").agg(*[F.sum(F.when(F.col("commit_ts") <= e, share)).alias(f"s{n}") for n, e in enumerate(ends)])
    sums, out = cut(sums, "pair-sums"), []
    for n, _ in enumerate(ends):
        later = 2.0 ** ((lasts["l"] - (lasts[f"l{n}"] if lasts[f"l{n}"] is not None else lasts["l"])) / DAY / half_life)
        raw = sums.where(F.col(f"s{n}").isNotNull()).select("path_a", "path_b", half_up(F.col(f"s{n}") * later, 9).alias("raw"))
        out.append(_near_or_strong(raw, tau, k))
    return out


def ignored_commits(commits: DataFrame, cap: int = 50) -> DataFrame:
    """Number of commits over ``cap`` paths. Only those of more than ``cap`` rows can be; so tasks hold a count a commit, and paths of those alone."""
    many = commits.groupBy("commit_sha").agg(F.count("path").alias("rows")).where(F.col("rows") > cap).select(F.col("commit_sha").alias("many"))
    rows = commits.join(cut(many, "large-commits"), F.col("commit_sha").eqNullSafe(F.col("many")), "left_semi")  # a table, so that its size is known
    by = rows.groupBy("commit_sha").agg(F.count_distinct("path").alias("m"))
    return by.agg(F.count_if(F.col("m") > cap).alias("ignored_commits"))


def dependency_edges(imports: DataFrame, tau: float = 0.0) -> DataFrame:
    """Undirected edges from directed import counts."""
    a, b = F.least("source_path", "resolved_path"), F.greatest("source_path", "resolved_path")
    forth = F.col("source_path") < F.col("resolved_path")
    rows = imports.where("source_path <> resolved_path").groupBy(a.alias("path_a"), b.alias("path_b")).agg(
        F.sum(F.when(forth, F.col("count")).otherwise(0)).alias("imports_ab"), F.sum(F.when(forth, 0).otherwise(F.col("count"))).alias("imports_ba"))
    rows = rows.withColumn("raw", half_up(F.log1p(F.col("imports_ab").cast("double")) + F.log1p(F.col("imports_ba").cast("double")), 9))
    return _scaled(rows, "w_dep").where(F.col("w_dep") >= tau).select("path_a", "path_b", "imports_ab", "imports_ba", half_up(F.col("raw"), 6).alias("w_dep_raw"), "w_dep")


def hashed_vectors(texts: DataFrame, dims: int = 256) -> DataFrame:
    """Signed hashing of lower-cased tokens by SHA-1: long form (path, index, weight), scaled to length one.

    Texts are shuffled once, whole, which is far less than their tokens; all groupings below go by path.
    """
    token = F.explode(F.array_compact(F.transform(F.split(F.lower("text"), r"\s+"), lambda t: F.when(t != "", t))))
    rows = texts.select("path", "text").repartition("path").select("path", token.alias("token")).groupBy("path", "token").agg(F.count("*").alias("n"))
    digest = F.sha1(F.col("token").cast("binary"))
    index = F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(dims)).cast("int")
    sign = F.when(F.conv(F.substring(digest, 9, 2), 16, 10).cast("int") % 2 == 0, 1).otherwise(-1)
    sums = rows.select("path", index.alias("index"), (F.col("n") * sign).alias("w")).groupBy("path", "index").agg(F.sum("w").alias("w")).where("w <> 0")
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("path")).cast("double"))
    return sums.select("path", "index", half_up(F.col("w") / norm, 6).alias("weight"))


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n == 0, 1, n)


def _top(ids: np.ndarray, x: np.ndarray, other_ids: np.ndarray, other: np.ndarray, k: int, tau: float) -> np.ndarray:
    """(src, dst, similarity) of the ``k`` best of ``other`` for each row of ``x``, of length one or zero; no hit becomes an object.

    Single precision says which pairs may reach ``tau``, with room for its largest error and for the rounding; those are multiplied exactly.
    """
    out, step = [np.empty(0, HIT)], max(1, min(512, SIMILARITIES // max(1, len(other_ids))))
    rough, others, least = x.astype(np.float32), other.astype(np.float32), np.float32(tau - 2e-6 - (x.shape[1] + 2) * 2.0**-23)
    for s in range(0, len(ids), step):
        near = rough[s : s + step] @ others.T >= least
        # where vectors are copies nearly all are near: the block is multiplied whole, and rows go one by one
        many = np.count_nonzero(near) * x.shape[1] > SIMILARITIES
        whole = x[s : s + step] @ other.T if many else None
        each = 1 if many else len(near)
        for r in range(0, len(near), each):
            row, col = np.divmod(np.flatnonzero(near[r : r + each]), len(other_ids))
            exact = whole[r, col] if many else np.einsum("ij,ij->i", x[s + r + row], other[col])
            src, dst, similarity = ids[s + r + row], other_ids[col], np.floor(exact * 1e6 + 0.5) / 1e6
            kept = (similarity >= tau) & (src != dst)
            row, src, dst, similarity = (c[kept] for c in (row, src, dst, similarity))
            order = np.lexsort((dst, -similarity, row))
            row = row[order]
            best = order[np.arange(len(row)) - np.searchsorted(row, row) < k]
            found = np.empty(len(best), HIT)
            found["src"], found["dst"], found["similarity"] = src[best], dst[best], similarity[best]
            out.append(found)
    return np.concatenate(out)


def _vectors(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A column of lists of one length as a matrix; no number becomes an object."""
    flat = pa.concat_arrays([c.flatten() for c in (column.chunks if isinstance(column, pa.ChunkedArray) else [column])]) if len(column) else pa.array([], pa.float64())
    return flat.to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def neighbours(vectors: DataFrame, k: int, tau: float, block: int | None = None) -> DataFrame:
    """Exact (src, dst, similarity): each row's ``k`` nearest by cosine with ``tau`` or more.

    A matrix of up to ``BROADCAST_BYTES`` is broadcast and multiplied in Arrow batches; beyond the bound, every two
    blocks of ``block`` vectors (as many as ``BLOCK_BYTES`` hold) meet once in a task, and their best are merged.
    """
    schema = "src long, dst long, similarity double"
    rows = vectors.select(F.col("path").cast("long").alias("path"), "vector").where("path is not null and vector is not null")
    n, dims = rows.agg(F.count("*"), F.max(F.size("vector"))).first()
    as_batch = lambda out: pa.record_batch([pa.array(np.ascontiguousarray(out[c])) for c in HIT.names], names=list(HIT.names))
    if n * (dims or 0) * 8 <= BROADCAST_BYTES:
        held = rows.toArrow()  # size checked
        shared = rows.sparkSession.sparkContext.broadcast((held["path"].to_numpy(), _unit(_vectors(held["vector"]))))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield as_batch(_top(b["path"].to_numpy(), _unit(_vectors(b["vector"])), *shared.value, k, tau) if b.num_rows else np.empty(0, HIT))

        return rows.mapInArrow(run, schema)
    blocks = -(-n // (block or max(1, BLOCK_BYTES // (8 * max(1, dims)))))
    placed = rows.withColumn("own", F.pmod(F.xxhash64("path"), F.lit(blocks)))
    from_, upto = F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")
    left = placed.select(F.col("own").alias("i"), F.explode(F.sequence("own", upto)).alias("j"), "path", "vector")
    right = placed.select(F.explode(F.sequence(from_, F.col("own"))).alias("i"), F.col("own").alias("j"), "path", "vector")

    def pair(key: tuple[pa.Scalar, ...], a: pa.Table, b: pa.Table) -> pa.Table:
        (p, x), (q, y) = ((t["path"].to_numpy(), _unit(_vectors(t["vector"]))) for t in (a, b))
        sides = [(p, x, q, y), (q, y, p, x)][: 1 if key[0] == key[1] else 2]
        return pa.Table.from_batches([as_batch(_top(own, u, others, v, k, tau) if len(own) and len(others) else np.empty(0, HIT)) for own, u, others, v in sides])

    best = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(pair, schema)
    w = Window.partitionBy("src").orderBy(F.desc("similarity"), "dst")
    return best.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k).drop("rn")


def semantic_edges(vectors: DataFrame, k: int = 20, tau: float = 0.35) -> DataFrame:
    """Mutual nearest neighbours."""
    return mutual_edges(neighbours(vectors, k, tau), tau)


def mutual_edges(near: DataFrame, tau: float) -> DataFrame:
    """Edges that both ends list, also for hits (src, dst, similarity) of an outside search."""
    back = near.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    both = near.join(back, ["src", "dst"], "left_semi").where("src < dst")
    return both.select(F.col("src").alias("path_a"), F.col("dst").alias("path_b"), "similarity", half_up((F.col("similarity") - tau) / (1 - tau), 6).alias("w_sem"))


def fused_edges(sem: DataFrame, co: DataFrame, dep: DataFrame, alpha: float = 0.45, beta: float = 0.35, gamma: float = 0.20) -> DataFrame:
    """One weighted graph: tagged edges in one union and one grouping instead of two outer joins."""
    zero = F.lit(0.0)
    parts = [(sem, "w_sem"), (co, "w_co"), (dep, "w_dep")]
    tagged = [e.select(F.col("path_a").cast("long").alias("path_a"), F.col("path_b").cast("long").alias("path_b"), *[(F.col(n) if n == own else zero).alias(n) for _, n in parts]) for e, own in parts]
    rows = tagged[0].unionByName(tagged[1]).unionByName(tagged[2]).groupBy("path_a", "path_b").agg(*[F.max(n).alias(n) for _, n in parts])
    return rows.withColumn("weight", half_up(alpha * F.col("w_sem") + beta * F.col("w_co") + gamma * F.col("w_dep"), 6)).where("weight > 0")


def degrees(edges: DataFrame) -> DataFrame:
    return both_ends(edges.select("path_a", "path_b", "weight"), "path_a", "path_b").groupBy(F.col("node").alias("path")).agg(half_up(F.sum("weight"), 6).alias("weighted_degree"), F.count("*").alias("degree"))


def _with_clusters(ends: DataFrame, clusters: DataFrame) -> DataFrame:
    a, b = clusters.select(F.col("path").alias("node"), F.col("cluster_id").alias("cluster")), clusters.select(F.col("path").alias("other"), F.col("cluster_id").alias("other_cluster"))
    rows = ends.join(a, "node", "left").join(b, "other", "left")
    return rows.withColumns({c: F.coalesce(c, F.lit(-1)) for c in ("cluster", "other_cluster")})


def xnbr(sem: DataFrame, clusters: DataFrame) -> DataFrame:
    """Share of a path's semantic neighbours in other clusters."""
    rows = _with_clusters(both_ends(sem.select("path_a", "path_b"), "path_a", "path_b"), clusters)
    return rows.groupBy(F.col("node").alias("path")).agg(half_up(F.avg((F.col("cluster") != F.col("other_cluster")).cast("double")), 6).alias("xnbr"))


def volatility(commits: DataFrame, days: int = 30, windows: int = 6) -> DataFrame:
    """Variance of a path's changes per window, windows without any counted as zero: a closed form over the windows that have some."""
    last = commits.agg(F.max("commit_ts").alias("last"))
    index = F.floor((F.col("last") - F.col("commit_ts")) / (days * DAY))
    rows = commits.crossJoin(F.broadcast(last)).where(F.col("commit_ts") > F.col("last") - windows * days * DAY).withColumn("w", index).where(F.col("w") < windows)
    by = rows.groupBy("path", "w").agg(F.count("*").alias("c")).groupBy("path").agg(F.sum("c").alias("s"), F.sum(F.col("c") * F.col("c")).alias("q"))
    return by.select("path", half_up(F.col("q") / float(windows) - F.pow(F.col("s") / float(windows), F.lit(2.0)), 6).alias("variance"))


def file_metrics(clusters: DataFrame, edges: DataFrame, sem: DataFrame, commits: DataFrame, between: DataFrame | None = None) -> DataFrame:
    """Degree, hubness, volatility and risk of every path of ``clusters``."""
    rows = clusters.select("path", "cluster_id").join(degrees(edges), "path", "left").join(xnbr(sem, clusters), "path", "left").join(volatility(commits), "path", "left")
    rows = rows.join(between, "path", "left") if between is not None else rows.withColumn("betweenness", F.lit(0.0))
    columns = ("weighted_degree", "degree", "betweenness", "xnbr", "variance")
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0)).cast("long" if c == "degree" else "double") for c in columns})
    tops = rows.agg(*[F.max(c).alias(f"_{c}") for c in ("weighted_degree", "betweenness", "variance")])
    over = lambda c: F.when(F.col(f"_{c}") > 0, F.col(c) / F.col(f"_{c}")).otherwise(0.0)
    rows = rows.crossJoin(F.broadcast(tops))
    rows = rows.withColumn("hubness", half_up(0.5 * over("weighted_degree") + 0.5 * over("betweenness"), 6)).withColumn("volatility", half_up(over("variance"), 6))
    risk = half_up(0.5 * F.col("xnbr") + 0.3 * F.col("hubness") + 0.2 * F.col("volatility"), 6)
    return rows.select("path", "cluster_id", "weighted_degree", "degree", "betweenness", "xnbr", "hubness", "volatility", risk.alias("risk"))


def cluster_metrics(clusters: DataFrame, edges: DataFrame, files: DataFrame) -> DataFrame:
    ends = _with_clusters(both_ends(edges.select("path_a", "path_b", "weight"), "path_a", "path_b"), clusters)
    same = F.col("cluster") == F.col("other_cluster")
    by = ends.groupBy(F.col("cluster").alias("cluster_id")).agg(F.sum(F.when(same, F.col("weight") / 2).otherwise(0.0)).alias("inner"), F.sum(F.when(same, 0.0).otherwise(F.col("weight"))).alias("outer"), F.sum("weight").alias("volume"))
    total = both_ends(edges.select("path_a", "path_b", "weight"), "path_a", "path_b").agg(F.sum("weight").alias("total"))
    own = files.groupBy("cluster_id").agg(F.count("*").alias("size"), F.avg("risk").alias("risk_mean"), F.max("risk").alias("risk_max"), F.slice(F.array_sort(F.collect_list("path")), 1, 50).alias("first"))
    rows = own.join(by, "cluster_id", "left").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("inner", "outer", "volume")}).crossJoin(F.broadcast(total))
    cohesion = ratio(F.col("inner"), F.col("inner") + F.col("outer"))
    rows = rows.withColumn("external_weight", half_up(F.col("outer"), 6))
    rows = average_rank(rows, "external_weight", "external_inbound_rank")
    return rows.select(
        "cluster_id", "size", half_up(cohesion, 6).alias("cohesion"), half_up(F.when(F.col("inner") + F.col("outer") > 0, 1 - cohesion).otherwise(0.0), 6).alias("leakage"),
        half_up(ratio(F.col("outer"), F.least("volume", F.col("total") - F.col("volume"))), 6).alias("conductance"), half_up(F.col("inner"), 6).alias("internal_weight"), "external_weight",
        F.col("external_weight").alias("external_inbound_weight"), half_up(F.col("external_inbound_rank"), 6).alias("external_inbound_rank"), half_up(F.col("risk_mean"), 6).alias("risk_mean"), "risk_max", F.array_join(F.transform("first", lambda p: p.cast("string")), "\n").alias("paths"),
    )


def modularity(edges: DataFrame, clusters: DataFrame) -> DataFrame:
    """One row: weighted modularity of the clusters."""
    ends = _with_clusters(both_ends(edges.select("path_a", "path_b", "weight"), "path_a", "path_b"), clusters)
    by = ends.groupBy("cluster").agg(F.sum(F.when(F.col("cluster") == F.col("other_cluster"), F.col("weight")).otherwise(0.0)).alias("inside"), F.sum("weight").alias("degree"))
    two_m = by.agg(F.sum("degree").alias("m2"))
    part = F.col("inside") / F.col("m2") - F.pow(F.col("degree") / F.col("m2"), F.lit(2.0))
    return by.crossJoin(F.broadcast(two_m)).agg(half_up(F.coalesce(F.sum(part), F.lit(0.0)), 6).alias("modularity"))


def adjusted_rand(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: agreement of two partitions (path, cluster_id) on the paths both hold."""
    both = left.select("path", F.col("cluster_id").alias("l")).join(right.select("path", F.col("cluster_id").alias("r")), "path")
    cells = both.groupBy("l", "r").agg(F.count("*").alias("n"))
    pairs = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2.0)
    a = cells.groupBy("l").agg(F.sum("n").alias("n")).agg(pairs("n").alias("a"))
    b = cells.groupBy("r").agg(F.sum("n").alias("n")).agg(pairs("n").alias("b"))
    c = cells.agg(pairs("n").alias("c"), F.sum("n").alias("n"))
    row = c.crossJoin(a).crossJoin(b)
    expected = ratio(F.col("a") * F.col("b"), F.col("n") * (F.col("n") - 1) / 2.0)
    most = (F.col("a") + F.col("b")) / 2 - expected
    value = F.when(F.coalesce("n", F.lit(0)) < 2, 1.0).when(most == 0, 1.0).otherwise((F.col("c") - expected) / most)
    return row.select(half_up(value, 6).alias("ari"))


def communities(edges: DataFrame, resolution: float = 1.0, start: DataFrame | None = None) -> DataFrame:
    """(path, cluster_id): Leiden's communities, each connected, numbered by size, then first member. ``start`` (path, cluster_id) are communities to begin with."""
    labels = leiden(edges, resolution, None if start is None else start.select("path", F.col("cluster_id").alias("label")))
    sizes = labels.groupBy("label").agg(F.count("*").alias("n"), F.min("path").alias("first"))
    order = global_number(sizes, [F.desc("n"), F.asc("first")], "cluster_id")
    return labels.join(order.select("label", "cluster_id"), "label").select("path", "cluster_id")


def betweenness(edges: DataFrame, pivots: int = 200, seed: int = 42) -> DataFrame:
    """(path, betweenness): weighted shortest paths from every node up to ``pivots``, else from that many drawn by hash; one Brandes pass a pivot, in parallel."""
    spark = edges.sparkSession
    rows = edges.select(F.col("path_a").cast("long"), F.col("path_b").cast("long"), F.col("weight").cast("double"))
    count = rows.count()
    if count > DRIVER_EDGES:
        whole = rows.where(F.abs(F.col("weight") * UNIT) > (1 << 31) - 2).isEmpty() and rows.where(F.col("weight") != F.floor(F.col("weight") * UNIT + 0.5) / UNIT).isEmpty()
        if whole and 16 * count <= TASK_BYTES:
            return _read_betweenness(rows, count, pivots, seed)
        return _spread_betweenness(edges, pivots, seed)
    e = rows.toArrow()  # size checked
    a, b, w = (e[c].to_numpy() for c in ("path_a", "path_b", "weight"))
    ids = np.union1d(a, b)
    n = len(ids)
    shared = spark.sparkContext.broadcast((ids, np.searchsorted(ids, a).astype(np.int32), np.searchsorted(ids, b).astype(np.int32), 1 / np.maximum(w, 1e-9)))
    nodes = cut(spark.createDataFrame(pa.table({"path": ids})), "nodes")
    starts = nodes.orderBy(F.xxhash64(F.lit(seed), "path"), "path").limit(pivots)
    scale = (1 / ((n - 1) * (n - 2)) if n > 2 else 0.0) * (n / min(n, pivots) if n else 0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, graph, out = shared.value[0], None, 0.0
        for b in batches:
            for s in b["path"].to_numpy():
                graph = graph or adjacency(*shared.value)
                out = out + dependencies(graph, int(np.searchsorted(ids, s)))
        if graph:
            named = np.nonzero(out)[0]
            yield pa.record_batch({"path": ids[named], "part": out[named]})

    sums = starts.repartition(min(pivots, 32), "path").mapInArrow(run, "path long, part double").groupBy("path").agg(F.sum("part").alias("part"))
    return nodes.join(sums, "path", "left").select("path", half_up(F.coalesce("part", F.lit(0.0)) * scale, 9).alias("betweenness"))


def _read_betweenness(rows: DataFrame, count: int, pivots: int, seed: int) -> DataFrame:
    """``betweenness`` of edges in whole millionths, too many for the driver: each of a few tasks reads all of them from a table and searches from its share of the starts.

    A row of the table has all ends of a node, by places in the sorted paths. Nothing is shuffled for the search, and a task holds eight bytes an end.
    """
    spark = rows.sparkSession
    nodes = cut(rows.select(F.explode(F.array("path_a", "path_b")).alias("path")).distinct(), "nodes")
    ids = np.sort(nodes.toArrow()["path"].to_numpy())  # a number a node
    n = len(ids)
    starts = nodes.orderBy(F.xxhash64(F.lit(seed), "path"), "path").limit(pivots).toArrow()["path"].to_numpy()
    places = rows.sparkSession.sparkContext.broadcast(ids)
    scale = 1 / ((n - 1) * (n - 2)) * (n / len(starts))
    units = rows.select("path_a", "path_b", F.floor(F.col("weight") * UNIT + 0.5).cast("int").alias("u"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            yield pa.record_batch({**{c: np.searchsorted(places.value, x[c].to_numpy()).astype(np.int32) for c in ("path_a", "path_b")}, "u": x["u"]})

    ends = both_ends(units.mapInArrow(place, "path_a int, path_b int, u int"), "path_a", "path_b").repartition(max(8, count // 500_000), "node")
    ends = ends.groupBy("node").agg(F.collect_list(F.struct("other", "u")).alias("e")).select("node", F.col("e.other").alias("other"), F.col("e.u").alias("u"))
    packed = cut(ends, "packed")
    tasks = min(SEARCHES, len(starts))
    mine = spark.sparkContext.broadcast([np.searchsorted(ids, starts[k::tasks]) for k in range(tasks)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin, size, share = np.zeros(n, np.int64), np.zeros(n, np.int64), None
        other, u, at = np.empty(2 * count, np.int32), np.empty(2 * count, np.int32), 0
        for x in batches:
            if x.num_rows:
                node, sizes, more = x["node"].to_numpy(), np.diff(x["other"].offsets.to_numpy()), x["other"].flatten().to_numpy()
                begin[node], size[node] = at + np.cumsum(sizes) - sizes, sizes
                other[at : at + len(more)], u[at : at + len(more)] = more, x["u"].flatten().to_numpy()
                at, share = at + len(more), x["share"][0].as_py()
        if share is None:
            return
        graph, out = (begin, size, other[:at], Lengths(u[:at])), np.zeros(n)
        for s in mine.value[share]:
            out += _searched(graph, int(s))
        named = np.nonzero(out)[0]
        for k in range(0, len(named), AT_ONCE):
            yield pa.record_batch({"at": named[k : k + AT_ONCE], "part": out[named[k : k + AT_ONCE]]})

    # a union of single partitions alone would be one partition; the last part has no rows
    each = [*[packed.coalesce(1).withColumn("share", F.lit(k)) for k in range(tasks)], packed.where("node < 0").withColumn("share", F.lit(0))]
    sums = cut(reduce(DataFrame.union, each).mapInArrow(run, "at long, part double"), "parts").groupBy("at").agg(F.sum("part").alias("part"))

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            yield pa.record_batch({"path": places.value[x["at"].to_numpy()], "part": x["part"]})

    sums = sums.mapInArrow(named, "path long, part double")
    return nodes.join(sums, "path", "left").select("path", half_up(F.coalesce("part", F.lit(0.0)) * scale, 9).alias("betweenness"))


class Lengths:
    """Lengths of edges, worked out from whole millionths where they are looked up."""

    def __init__(self, units: np.ndarray) -> None:
        self.units = units

    def __len__(self) -> int:
        return len(self.units)

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        return 1 / np.maximum(self.units[at] / UNIT, 1e-9)

    def min(self) -> float:
        return 1 / max(int(self.units.max()) / UNIT, 1e-9)


def _spread_betweenness(edges: DataFrame, pivots: int, seed: int) -> DataFrame:
    """``betweenness`` with no task holding the adjacency: (source, node) states meet the edges in joins until they stand still."""
    ends = both_ends(edges.select(F.col("path_a").cast("long"), F.col("path_b").cast("long"), F.col("weight").cast("double")), "path_a", "path_b")
    ends = cut(ends.select("node", "other", (1 / F.greatest("weight", F.lit(1e-9))).alias("d")), "ends")
    nodes = cut(ends.select(F.col("node").alias("path")).distinct(), "nodes")
    n = nodes.count()
    scale = (1 / ((n - 1) * (n - 2)) if n > 2 else 0.0) * (n / min(n, pivots) if n else 0.0)
    known = cut(nodes.orderBy(F.xxhash64(F.lit(seed), "path"), "path").limit(pivots).select(F.col("path").alias("s"), F.col("path").alias("node"), F.lit(0.0).alias("at")), "known")
    fresh = known
    while not fresh.isEmpty():
        through = fresh.join(ends, "node").groupBy("s", F.col("other").alias("node")).agg(F.min(F.col("at") + F.col("d")).alias("new"))
        both = cut(known.join(through, ["s", "node"], "full").withColumn("better", F.col("new").isNotNull() & (F.col("at").isNull() | (F.col("new") < F.col("at") - 1e-12))), "both")
        known = both.select("s", "node", F.when(F.col("better"), F.col("new")).otherwise(F.col("at")).alias("at"))
        fresh = both.where("better").select("s", "node", F.col("new").alias("at"))
    after = known.toDF("s", "other", "then")
    steps = cut(known.join(ends, "node").join(after, ["s", "other"]).where(F.abs(F.col("at") + F.col("d") - F.col("then")) <= 1e-12).select("s", "node", "other"), "steps")

    def summed(level: DataFrame, moved) -> DataFrame:
        """The sum of a state and of all it becomes step by step; the steps have no cycle."""
        total = level
        while not level.isEmpty():
            level = cut(moved(level), "level")
            total = cut(total.union(level).groupBy("s", "node").agg(F.sum("x").alias("x")), "total")
        return total

    starts = known.where(F.col("at") == 0).select("s", "node", F.lit(1.0).alias("x"))
    count = summed(starts, lambda level: level.join(steps, ["s", "node"]).groupBy("s", F.col("other").alias("node")).agg(F.sum("x").alias("x")))
    shares = cut(steps.join(count, ["s", "node"]).join(count.toDF("s", "other", "y"), ["s", "other"]).select("s", "node", "other", (F.col("x") / F.col("y")).alias("share")), "shares")
    back = lambda level: shares.join(level.toDF("s", "other", "z"), ["s", "other"]).groupBy("s", "node").agg(F.sum(F.col("share") * F.col("z")).alias("x"))
    sums = summed(shares.groupBy("s", "node").agg(F.sum("share").alias("x")), back).where("s <> node").groupBy(F.col("node").alias("path")).agg(F.sum("x").alias("part"))
    return nodes.join(sums, "path", "left").select("path", half_up(F.coalesce("part", F.lit(0.0)) * scale, 9).alias("betweenness"))


def adjacency(ids: np.ndarray, a: np.ndarray, b: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges between places by their first end: where each node's begin, the other ends, and lengths."""
    node = np.concatenate([a, b])
    order = np.argsort(node, kind="stable")
    begin = np.concatenate([[0], np.cumsum(np.bincount(node, minlength=len(ids)))])
    return begin, np.concatenate([b, a])[order], np.concatenate([d, d])[order]


def _out_of(begin: np.ndarray, size: np.ndarray, nodes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The edges that leave ``nodes``, some at once: (first end, place in the adjacency)."""
    sizes = size[nodes]
    groups = np.cumsum(sizes) // AT_ONCE
    cuts = [0, *(np.nonzero(np.diff(groups))[0] + 1).tolist(), len(nodes)]
    for i, j in zip(cuts, cuts[1:], strict=False):
        own, count = nodes[i:j], sizes[i:j]
        yield np.repeat(own, count), np.arange(count.sum()) + np.repeat(begin[own] - (np.cumsum(count) - count), count)


def dependencies(graph: tuple[np.ndarray, np.ndarray, np.ndarray], source: int) -> np.ndarray:
    """Dependency of every node on shortest paths from ``source``: distances first, of all open nodes within a stretch at once, then counts and shares along the steps of those paths."""
    begin, other, length = graph
    return _searched((begin[:-1], np.diff(begin), other, length), source)


def _searched(graph: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | Lengths], source: int) -> np.ndarray:
    """``dependencies`` of an adjacency that says where each node's edges begin and how many there are, in any order of nodes."""
    begin, size, other, length = graph
    n = len(begin)
    at, open_ = np.full(n, np.inf), np.zeros(n, bool)
    at[source], open_[source] = 0.0, True
    stretch = float(length.min()) if len(length) else 1.0
    while len(left := np.nonzero(open_)[0]):
        now = left[at[left] <= at[left].min() + stretch]
        open_[now] = False
        for v, e in _out_of(begin, size, now):
            to, through = other[e], at[v] + length[e]
            better = through < at[to] - 1e-12
            np.minimum.at(at, to[better], through[better])
            open_[to[better]] = True
    reached, steps = np.nonzero(np.isfinite(at))[0], []
    for v, e in _out_of(begin, size, reached):
        on = np.abs(at[v] + length[e] - at[other[e]]) <= 1e-12
        steps.append((v[on], other[e][on]))
    v, u = (np.concatenate(x) for x in zip(*steps, strict=True))
    # a node's level is the longest way to it: all that leads there is known when its turn comes
    level, rank = np.zeros(n, np.int64), 0
    waiting = np.bincount(u, minlength=n)
    by = np.argsort(v, kind="stable")
    out_of = np.bincount(v, minlength=n)
    start, to = np.cumsum(out_of) - out_of, u[by]
    now = np.array([source])
    while len(now):
        level[now], rank, found = rank, rank + 1, [to[e] for _, e in _out_of(start, out_of, now)]
        found = np.concatenate(found)
        np.subtract.at(waiting, found, 1)
        found = np.unique(found)
        now = found[waiting[found] == 0]
    order = np.argsort(level[u], kind="stable")
    v, u = v[order], u[order]
    ends = np.searchsorted(level[u], np.arange(rank + 1))
    count, out = np.zeros(n), np.zeros(n)
    count[source] = 1.0
    for i, j in zip(ends[1:], [*ends[2:], len(u)], strict=True):
        np.add.at(count, u[i:j], count[v[i:j]])
    for i, j in reversed(list(zip(ends[1:], [*ends[2:], len(u)], strict=True))):
        np.add.at(out, v[i:j], count[v[i:j]] / count[u[i:j]] * (1 + out[u[i:j]]))
    out[source] = 0.0
    return out


def drift_windows(first: int, last: int, days: int = 30, count: int = 6) -> list[int]:
    """Window ends ``days`` apart back from ``last`` where they fit, else ``count`` ends evenly spaced."""
    ends = [e for k in range(count) if (e := last - k * days * DAY) >= first]
    if len(ends) < count and last > first:
        ends = [first + (last - first) * (k + 1) // count for k in range(count)]
    return sorted(ends)


def drift(commits: DataFrame, sem: DataFrame, dep: DataFrame, days: int = 30, count: int = 6) -> DataFrame:
    """Clusters, modularity and agreement with the window before, over a few window ends."""
    first, last = commits.agg(F.min("commit_ts"), F.max("commit_ts")).first()
    if first is None:
        return commits.sparkSession.createDataFrame([], "window_end_ts long, cluster_count long, modularity double, ari_prev double")
    spark, before, out, ends = commits.sparkSession, None, [], drift_windows(first, last, days, count)
    sem, dep = cut(sem, "semantic"), cut(dep, "dependency")

    def window(co: DataFrame) -> tuple[DataFrame, int, float]:
        edges = cut(fused_edges(sem, co, dep), "fused")
        now = cut(communities(edges), "communities")
        return now, now.select("cluster_id").distinct().count(), modularity(edges, now).first()[0]

    # some windows at a time, since rounds of communities are short jobs that leave cores idle
    with ThreadPoolExecutor(WINDOWS_AT_ONCE) as pool:
        found = list(pool.map(window, cochange_windows(commits, ends)))
    for end, (now, clusters, quality) in zip(ends, found, strict=True):  # a few windows, a row each
        ari = 1.0 if before is None else adjusted_rand(before, now).first()[0]
        out.append((end, clusters, quality, ari))
        before = now
    return spark.createDataFrame(out, "window_end_ts long, cluster_count long, modularity double, ari_prev double")


def drift_trend(windows: DataFrame) -> DataFrame:
    """One word for the course of ari_prev."""
    w = Window.orderBy("window_end_ts")  # a row a window
    rows = windows.withColumn("d", F.col("ari_prev") - F.lag("ari_prev").over(w)).withColumn("turn", F.signum("d") * F.signum(F.lag("d").over(w)) < 0)
    row = rows.agg(F.count("*").alias("n"), F.count_if("turn").alias("turns"), F.max_by("d", "window_end_ts").alias("d"), F.max_by("ari_prev", "window_end_ts").alias("last"))
    return row.select(F.when((F.col("n") >= 3) & (F.col("turns") >= 2), "volatile").when((F.col("d") > 0) & (F.col("last") >= 0.6), "stabilizing").when(F.col("d") < 0, "degrading").otherwise("stable").alias("trend"))


def graph_summary(edges: DataFrame, clusters: DataFrame) -> DataFrame:
    d = degrees(edges).agg(F.count("*").alias("nodes"), F.max("degree").alias("m"), F.avg("degree").alias("a"))
    return d.crossJoin(edges.agg(F.count("*").alias("edges"))).crossJoin(clusters.agg(F.count_distinct("cluster_id").alias("clusters"))).select("nodes", "edges", "clusters", half_up(ratio(F.col("m"), F.col("a")), 6).alias("hub_dominance"))


def focus_graph(edges: DataFrame, files: DataFrame, per_node: int = 4, risky: int = 20, per_risky: int = 2, most: int = 220, nodes: int = 120) -> DataFrame:
    """The edges of highest priority for a small picture: some of every node and of the riskiest. Priority is the weight and a tenth of both ends' risk.

    Where the picture has too many nodes, those of the highest risk, then weighted degree, stay; if that leaves no edge, the first one does.
    """
    risk = files.select(F.col("path"), F.coalesce("risk", F.lit(0.0)).alias("risk"))
    rows = edges.select("path_a", "path_b", "weight")
    for end in ("path_a", "path_b"):
        rows = rows.join(risk.toDF(end, f"{end}_risk"), end, "left")
    rows = rows.select("path_a", "path_b", "weight", half_up(F.col("weight") + 0.10 * F.coalesce("path_a_risk", F.lit(0.0)) + 0.10 * F.coalesce("path_b_risk", F.lit(0.0)), 9).alias("priority"))
    order = [F.desc("priority"), F.least("node", "other"), F.greatest("node", "other")]
    ends = both_ends(rows, "path_a", "path_b").withColumn("rn", F.row_number().over(Window.partitionBy("node").orderBy(*order))).where(F.col("rn") <= max(per_node, per_risky))
    top = risk.orderBy(F.desc("risk"), "path").limit(risky).select(F.col("path").alias("node"), F.lit(True).alias("top"))
    ends = ends.join(F.broadcast(top), "node", "left").where((F.col("rn") <= per_node) | (F.col("top") & (F.col("rn") <= per_risky)))  # ``risky`` rows
    chosen = ends.select(F.least("node", "other").alias("path_a"), F.greatest("node", "other").alias("path_b"), "weight", "priority").distinct()
    chosen = chosen.orderBy(F.desc("priority"), "path_a", "path_b").limit(most).withColumn("n", F.row_number().over(Window.orderBy(F.desc("priority"), "path_a", "path_b")))
    ranked = degrees(chosen).join(risk, "path", "left").orderBy(F.desc(F.coalesce("risk", F.lit(0.0))), F.desc("weighted_degree"), "path").limit(nodes)
    kept = ranked.select(F.col("path").alias("k"), F.lit(True).alias("in"))
    both = chosen.join(kept.toDF("path_a", "a"), "path_a", "left").join(kept.toDF("path_b", "b"), "path_b", "left").withColumn("both", F.coalesce(F.col("a") & F.col("b"), F.lit(False)))
    any_ = F.max("both").over(Window.partitionBy())  # at most ``most`` rows
    return both.withColumn("any", any_).where(F.col("both") | (~F.col("any") & (F.col("n") == 1))).select("path_a", "path_b", "weight")
