"""Questions about a repository: team, velocity, listings, fitness and suggestions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewell.functions.scalar import half_up, ratio
from tidewell.operators.graph import DAY, _with_clusters
from tidewell.operators.relational import both_ends, top_n_per_group


def _rounded(x, digits: int):
    """Halves to even, as the published figures have them."""
    return F.bround(x, digits)


def author_stats(commits: DataFrame, clusters: DataFrame) -> DataFrame:
    rows = commits.join(clusters, "path")
    by = rows.groupBy("cluster_id", "author").agg(F.count_distinct("commit_sha").alias("commit_count"), F.count_distinct("path").alias("file_count"))
    share = F.col("commit_count") / F.sum("commit_count").over(Window.partitionBy("cluster_id"))
    return by.withColumn("pct_of_cluster", _rounded(share, 4))


def bus_factor(stats: DataFrame, share: float = 0.8) -> DataFrame:
    """Fewest authors of a cluster who together reach ``share``."""
    w = Window.partitionBy("cluster_id").orderBy(F.desc("pct_of_cluster"), "author")
    run = stats.withColumn("rn", F.row_number().over(w)).withColumn("cum", F.sum("pct_of_cluster").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    by = run.groupBy("cluster_id").agg(F.min(F.when(half_up(F.col("cum"), 6) >= share, F.col("rn"))).alias("k"), F.count("*").alias("authors"))
    return by.select("cluster_id", F.coalesce("k", "authors").cast("long").alias("bus_factor"))


def concentration(stats: DataFrame) -> DataFrame:
    return stats.groupBy("cluster_id").agg(half_up(F.sum(F.col("pct_of_cluster") * F.col("pct_of_cluster")), 4).alias("hhi"), F.count("*").alias("author_count"))


def team(bus: DataFrame, hhi: DataFrame, sizes: DataFrame, min_size: int = 2) -> DataFrame:
    return bus.join(hhi, "cluster_id", "full").join(sizes, "cluster_id", "left").where(F.coalesce("size", F.lit(0)) >= min_size)


def velocity(commits: DataFrame, clusters: DataFrame, days: int = 30) -> DataFrame:
    """Changes of each cluster in the last window against the one before, from one scan."""
    last = commits.agg(F.max("commit_ts").alias("last"))
    rows = commits.join(clusters, "path").crossJoin(F.broadcast(last)).withColumn("age", F.col("last") - F.col("commit_ts")).where(F.col("age") < 2 * days * DAY)
    cur, status = F.col("age") < days * DAY, F.col("status")
    by = rows.groupBy("cluster_id").agg(
        F.count_distinct(F.when(cur, F.col("commit_sha"))).alias("commits"), F.count_if(cur).alias("changes"), F.count_if(cur & (status == "A")).alias("added"), F.count_if(cur & (status == "M")).alias("modified"),
        F.count_if(cur & (status == "D")).alias("deleted"), F.count_if(~cur).alias("prior_changes"),
    )
    total = F.greatest("changes", F.lit(1))
    rows = by.select("*", half_up(F.col("added") / total, 4).alias("growth"), half_up(F.col("modified") / total, 4).alias("churn"), half_up(F.col("changes") / F.greatest("prior_changes", F.lit(1)), 2).alias("acceleration"))
    return rows.withColumn("is_emerging", (F.col("prior_changes") == 0) & (F.col("changes") > 0))


def recent_changes(commits: DataFrame, clusters: DataFrame) -> DataFrame:
    last = commits.agg(F.max("commit_ts").alias("last"))
    rows = commits.join(clusters, "path").crossJoin(F.broadcast(last)).withColumn("age", F.col("last") - F.col("commit_ts"))
    return rows.groupBy("cluster_id").agg(*[F.count_if(F.col("age") <= d * DAY).alias(f"recent_file_changes_{d}d") for d in (30, 90)])


def list_commits(commits: DataFrame, clusters: DataFrame, since_days: int = 30, limit: int = 50) -> DataFrame:
    last = commits.agg(F.max("commit_ts").alias("last"))
    rows = commits.crossJoin(F.broadcast(last)).where(F.col("commit_ts") >= F.col("last") - since_days * DAY).join(clusters, "path", "left")
    rows = rows.groupBy("commit_sha", "path").agg(F.max("commit_ts").alias("commit_ts"), F.min("status").alias("status"), F.coalesce(F.min("cluster_id"), F.lit(-1)).alias("cluster_id"))
    return rows.orderBy(F.desc("commit_ts"), "commit_sha", "path").limit(limit)


def hot_files(commits: DataFrame, files: DataFrame, days: int = 90, limit: int = 20) -> DataFrame:
    last = commits.agg(F.max("commit_ts").alias("last"))
    rows = commits.crossJoin(F.broadcast(last)).where(F.col("commit_ts") >= F.col("last") - days * DAY)
    by = rows.groupBy("path").agg(F.count_distinct("commit_sha").alias("commits"))
    return by.join(files.select("path", "cluster_id", "risk"), "path", "left").orderBy(F.desc("commits"), "path").limit(limit)


def cluster_edges(edges: DataFrame, clusters: DataFrame, metrics: DataFrame, examples: int = 3) -> DataFrame:
    """What ties each cluster to each neighbour: weight, count, share of its outside weight, strongest pairs."""
    ends = _with_clusters(both_ends(edges.select("path_a", "path_b", "weight"), "path_a", "path_b"), clusters).where(F.col("cluster") != F.col("other_cluster"))
    by = ends.groupBy(F.col("cluster").alias("cluster_id"), F.col("other_cluster").alias("neighbour")).agg(half_up(F.sum("weight"), 6).alias("weight"), F.count("*").alias("edges"))
    best = top_n_per_group(ends, ["cluster", "other_cluster"], [F.desc("weight"), F.asc("node"), F.asc("other")], examples)
    best = best.groupBy(F.col("cluster").alias("cluster_id"), F.col("other_cluster").alias("neighbour")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "node", "other"))), lambda s: F.concat_ws("-", s["node"].cast("string"), s["other"].cast("string"))), ",").alias("top_pairs"))
    rows = by.join(best, ["cluster_id", "neighbour"]).join(metrics.select("cluster_id", "external_weight"), "cluster_id")
    return rows.select("cluster_id", "neighbour", "weight", "edges", half_up(ratio(F.col("weight"), F.col("external_weight")), 4).alias("leakage_share"), "top_pairs")


def risks(files: DataFrame, min_risk: float = 0.0, limit: int = 20) -> DataFrame:
    return files.where(F.col("risk") >= min_risk).orderBy(F.desc("risk"), "path").limit(limit)


def fitness(files: DataFrame, metrics: DataFrame, bus: DataFrame | None = None, max_file_risk: float = 0.8, max_leakage: float = 0.6, min_cohesion: float = 0.4, max_risk_mean: float = 0.5, min_bus: int = 2, min_size: int = 2) -> DataFrame:
    """Violations of the thresholds: (category, entity, metric, value, threshold)."""
    def violations(df: DataFrame, category: str, key: str, metric: str, threshold: float) -> DataFrame:
        return df.select(F.lit(category).alias("category"), F.col(key).cast("string").alias("entity"), F.lit(metric).alias("metric"), F.col(metric).cast("double").alias("value"), F.lit(float(threshold)).alias("threshold"))

    big = metrics.where(F.col("size") >= min_size)
    out = violations(files.where(F.col("risk") > max_file_risk), "file_risk", "path", "risk", max_file_risk)
    out = out.unionByName(violations(big.where(F.col("leakage") > max_leakage), "boundary_leakage", "cluster_id", "leakage", max_leakage))
    out = out.unionByName(violations(big.where(F.col("cohesion") < min_cohesion), "cohesion", "cluster_id", "cohesion", min_cohesion))
    out = out.unionByName(violations(big.where(F.col("risk_mean") > max_risk_mean), "cluster_risk", "cluster_id", "risk_mean", max_risk_mean))
    if bus is not None:
        few = bus.join(big.select("cluster_id"), "cluster_id", "left_semi").where(F.col("bus_factor") < min_bus)
        out = out.unionByName(violations(few, "bus_factor", "cluster_id", "bus_factor", min_bus))
    return out


def suggestions(files: DataFrame, metrics: DataFrame, between: DataFrame, speed: DataFrame, limit: int = 20) -> DataFrame:
    """Rule-based suggestions: (priority, title, reason), each title once, most urgent first."""
    def rule(df: DataFrame, priority, title, reason) -> DataFrame:
        return df.select((F.lit(priority) if isinstance(priority, str) else priority).alias("priority"), title.alias("title"), reason.alias("reason"))

    name = lambda c: F.col(c).cast("string")
    top = top_n_per_group(between.join(metrics.where("leakage >= 0.2").select("cluster_id"), "cluster_id", "left_semi"), ["cluster_id"], [F.desc("weight"), F.asc("neighbour")], 1)
    hubs = top.groupBy("neighbour").agg(F.count("*").alias("n")).where("n >= 2")
    rows = [
        rule(hubs, "High", F.concat(F.lit("Separate the hub cluster "), name("neighbour")), F.concat(name("n"), F.lit(" leaky clusters lean on it most"))),
        rule(metrics.where("leakage >= 0.2"), F.when(F.col("leakage") >= 0.4, "High").otherwise("Medium"), F.concat(F.lit("Tighten the boundary of cluster "), name("cluster_id")), F.concat(F.lit("leakage "), name("leakage"))),
        rule(files.where("xnbr >= 0.35"), F.when(F.col("xnbr") >= 0.5, "Medium").otherwise("Low"), F.concat(F.lit("Review the place of path "), name("path")), F.concat(F.lit("neighbours elsewhere "), name("xnbr"))),
        rule(files.where("hubness >= 0.45"), "Medium", F.concat(F.lit("Split the hub path "), name("path")), F.concat(F.lit("hubness "), name("hubness"))),
        rule(speed.where("acceleration >= 1.5 and growth >= 0.3"), "Medium", F.concat(F.lit("Watch the growth of cluster "), name("cluster_id")), F.concat(F.lit("acceleration "), name("acceleration"))),
        rule(speed.where("added >= 20"), "Low", F.concat(F.lit("Review what cluster "), name("cluster_id"), F.lit(" has added")), F.concat(name("added"), F.lit(" additions"))),
        rule(speed.where("acceleration <= 0.5 and growth < 0.1"), "Low", F.concat(F.lit("Check whether cluster "), name("cluster_id"), F.lit(" is finished")), F.concat(F.lit("acceleration "), name("acceleration"))),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    rank = F.when(F.col("priority") == "High", 0).when(F.col("priority") == "Medium", 1).otherwise(2)
    once = out.groupBy("title").agg(F.min_by(F.struct("priority", "reason"), rank).alias("s")).select("s.priority", "title", "s.reason")
    return once.orderBy(rank, "title").limit(limit)


def file_status(files: DataFrame) -> DataFrame:
    """Verdict on each path and the strongest reason for it."""
    verdict = F.when(F.col("risk") > 0.8, "critical").when(F.col("risk") > 0.5, "attention").otherwise("ok")
    parts = F.array(F.struct((0.5 * F.col("xnbr")).alias("x"), F.lit("cross-cluster neighbours").alias("r")), F.struct((0.3 * F.col("hubness")).alias("x"), F.lit("hub").alias("r")), F.struct((0.2 * F.col("volatility")).alias("x"), F.lit("volatile").alias("r")))
    return files.select("path", "risk", verdict.alias("status"), F.array_max(parts)["r"].alias("reason"))
