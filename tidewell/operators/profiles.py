"""Clusters as people read them: their names, listings, what is active and where they leak."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.scalar import half_up
from tidewell.operators.graph import DAY, _with_clusters
from tidewell.operators.relational import both_ends, top_n_per_group

#: Fixed values that labels depend on.
ROOTS = ["src", "packages", "apps", "lib"]
GENERIC_STEMS = [
    "src", "services", "controllers", "routes", "schemas", "packages", "lib", "test", "tests", "utils", "helpers", "common", "shared",
    "middleware", "config", "types", "interfaces", "models", "modules", "core", "app", "apps", "index", "main", "init", "__init__",
]


def show_clusters(metrics: DataFrame, recent: DataFrame, min_size: int = 2) -> DataFrame:
    """Clusters of ``min_size`` files or more with their recent changes; sort by any of the columns."""
    rows = metrics.where(F.col("size") >= min_size).join(recent, "cluster_id", "left")
    names = ["cluster_id", "size", "cohesion", "leakage", "conductance", "internal_weight", "external_weight", "external_inbound_weight", "risk_mean", "risk_max"]
    return rows.select(*names, *[F.coalesce(f"recent_file_changes_{d}d", F.lit(0)).alias(f"recent_file_changes_{d}d") for d in (30, 90)])


def top_active(commits: DataFrame, clusters: DataFrame, n: int = 3, days: int = 30) -> DataFrame:
    """The ``n`` clusters with most changes in the last window; of equal counts the smaller id first."""
    rows = commits.select("path", "commit_ts").join(clusters, "path")
    last = rows.agg(F.max("commit_ts").alias("last"))
    by = rows.crossJoin(F.broadcast(last)).where(F.col("commit_ts") >= F.col("last") - days * DAY).groupBy("cluster_id").agg(F.count("*").alias("file_change_count"))
    return by.orderBy(F.desc("file_change_count"), "cluster_id").limit(n)


def _name(path: Column) -> tuple[Column, Column]:
    """The prefix and the stem that a path lends its cluster's label; null where it lends none."""
    parts = F.split(path, "/")
    segments = F.when(parts[0].isin(ROOTS), F.slice(parts, 2, 3)).otherwise(F.slice(parts, 1, 2))
    word = F.lower(F.split_part(F.replace(F.split_part(F.element_at(parts, -1), F.lit("."), F.lit(1)), F.lit("-"), F.lit("_")), F.lit("_"), F.lit(1)))
    return F.when(F.size(segments) > 0, F.array_join(segments, "/")), F.when((F.length(word) > 1) & ~word.isin(GENERIC_STEMS), word)


def _two_best(rows: DataFrame, what: str) -> DataFrame:
    by = rows.where(F.col(what).isNotNull()).groupBy("cluster_id", what).agg(F.sum("w").alias("w"))
    best = top_n_per_group(by, ["cluster_id"], [F.desc("w"), F.asc(what)], 2)
    first = lambda k, c: F.max(F.when(F.col("rn") == k, F.col(c)))
    return best.groupBy("cluster_id").agg(*[first(k, c).alias(f"{name}{k}") for k in (1, 2) for c, name in ((what, what), ("w", f"{what}_w"))])


def cluster_labels(files: DataFrame, weight: str | None = None) -> DataFrame:
    """(cluster_id, label) from the paths of ``files`` (cluster_id, path): the two heaviest prefixes, behind a stem or two that stand out.

    ``weight`` names a column of significance; without it every path counts one. Larger clusters need smaller shares.
    Of equal weights the smaller text comes first. A cluster whose paths have no prefix has an empty label.
    """
    prefix, stem = _name(F.col("path"))
    w = F.coalesce(F.col(weight).cast("double"), F.lit(1.0)) if weight else F.lit(1.0)
    rows = files.where("path is not null").select("cluster_id", "path", prefix.alias("prefix"), stem.alias("stem"), w.alias("w"))
    total = rows.groupBy("cluster_id").agg(F.count("*").alias("n"), F.sum("w").alias("total"), F.max("w").alias("most"), F.min_by("stem", F.struct(-F.col("w"), F.col("path"))).alias("heaviest"))
    rows = total.join(_two_best(rows, "prefix"), "cluster_id", "left").join(_two_best(rows, "stem"), "cluster_id", "left")
    large = F.col("n") > 100
    longest, least = F.when(large, 70).otherwise(50), F.when(large, 0.15).when(F.col("n") > 30, 0.25).otherwise(0.40)
    share, both = F.col("stem_w1") / F.col("total"), (F.col("stem_w1") + F.col("stem_w2")) / F.col("total")
    structural = F.concat_ws(" + ", "prefix1", "prefix2")
    named = lambda x: F.concat(x, F.lit(" ("), structural, F.lit(")"))
    forced = F.lit(weight is not None) & large & F.col("heaviest").isNotNull() & (F.col("most") * F.col("n") > 3 * F.col("total"))
    label = (
        F.when(F.col("prefix1").isNull(), "").when(forced, named(F.col("heaviest")))
        .when((share > least) & ~(large & F.col("stem2").isNotNull() & (share < 0.25)), named(F.col("stem1")))
        .when(both > least, named(F.concat_ws("/", "stem1", "stem2"))).otherwise(structural)
    )
    rows = rows.select("cluster_id", label.alias("label"), longest.alias("longest"))
    return rows.select("cluster_id", F.when(F.length("label") > F.col("longest"), F.concat(F.col("label").substr(F.lit(1), F.col("longest") - 3), F.lit("..."))).otherwise(F.col("label")).alias("label"))


def boundary_profiles(edges: DataFrame, clusters: DataFrame, metrics: DataFrame, most: int = 5, neighbours: int = 3, examples: int = 3) -> DataFrame:
    """The ``most`` leakiest clusters with their heaviest neighbours and a few edges of each in the order of their paths.

    Files without a cluster count to cluster -1. Equal leakage: smaller cluster id first.
    """
    leaky = F.broadcast(metrics.orderBy(F.desc("leakage"), "cluster_id").limit(most).select("cluster_id", "leakage"))  # ``most`` rows
    ends = _with_clusters(both_ends(edges.select("path_a", "path_b", "weight"), "path_a", "path_b"), clusters).where(F.col("cluster") != F.col("other_cluster"))
    ends = ends.withColumnsRenamed({"cluster": "cluster_id", "other_cluster": "neighbour"}).join(leaky, "cluster_id")
    by = ends.groupBy("cluster_id", "leakage", "neighbour").agg(half_up(F.sum("weight"), 3).alias("weight"))
    by = top_n_per_group(by, ["cluster_id"], [F.desc("weight"), F.asc("neighbour")], neighbours, "place")
    a, b = F.least("node", "other"), F.greatest("node", "other")
    shown = top_n_per_group(ends, ["cluster_id", "neighbour"], [a.asc(), b.asc()], examples)
    text = F.concat_ws("-", F.col("node").cast("string"), F.col("other").cast("string"))
    shown = shown.groupBy("cluster_id", "neighbour").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", text.alias("t")))), lambda s: s["t"]), ",").alias("examples"))
    return by.join(shown, ["cluster_id", "neighbour"])


def path_domain(path: Column) -> Column:
    """The folders of a path that name its domain: up to four below a source root, else up to three; a bare name is its own."""
    parts = F.split(path, "/")
    folders = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    kept = F.array_join(F.slice(folders, F.lit(1), F.when(parts[0].isin("src", "packages"), 4).otherwise(3)), "/")
    return F.when((F.size(parts) <= 1) | (kept == ""), path).otherwise(kept)
