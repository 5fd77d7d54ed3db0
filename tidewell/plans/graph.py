"""Queries over the repository graph."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.operators import graph as g
from tidewell.operators import profiles as pf
from tidewell.operators import repo as r
from tidewell.operators.relational import cut
from tidewell.plans.registry import half_up, query
from tidewell.sources import adapters as src

BASE = """WITH cm AS (SELECT l_orderkey AS commit_sha, l_partkey AS path, CAST(epoch(o_orderdate) AS BIGINT) AS commit_ts, o_custkey % 20 AS author, CASE l_returnflag WHEN 'A' THEN 'A' WHEN 'N' THEN 'M' ELSE 'D' END AS status FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
cl AS (SELECT p_partkey AS path, CAST(regexp_extract(p_brand, '(\\d+)', 1) AS INTEGER) AS cluster_id FROM part),
lst AS (SELECT max(commit_ts) AS last FROM cm)
"""


def co_sql(cap: int = 50) -> str:
    return f""", cp AS MATERIALIZED (SELECT DISTINCT commit_sha, commit_ts, path FROM cm), cz AS (SELECT commit_sha, commit_ts, count(*) AS m FROM cp GROUP BY 1, 2 HAVING count(*) BETWEEN 2 AND {cap}),
pr AS MATERIALIZED (SELECT a.path AS path_a, b.path AS path_b, {half_up("sum(pow(2.0, -greatest(0.0, (last - a.commit_ts) / 86400.0) / 180.0) / (m - 1))", 9)} AS raw FROM cp a JOIN cp b ON a.commit_sha = b.commit_sha AND a.commit_ts = b.commit_ts AND a.path < b.path JOIN cz ON cz.commit_sha = a.commit_sha AND cz.commit_ts = a.commit_ts, lst GROUP BY 1, 2),
pp AS (SELECT CASE WHEN quantile_cont(raw, 0.95) > 0 THEN quantile_cont(raw, 0.95) ELSE max(raw) END AS p FROM pr),
pw AS MATERIALIZED (SELECT path_a, path_b, raw, {half_up('least(1.0, raw / p)', 6)} AS w_co FROM pr, pp),
pn AS (SELECT node, path_a, path_b, row_number() OVER (PARTITION BY node ORDER BY w_co DESC, path_a, path_b) AS rn FROM (SELECT path_a AS node, * FROM pw UNION ALL SELECT path_b, * FROM pw)),
pk AS (SELECT DISTINCT path_a, path_b, 1 AS near FROM pn WHERE rn <= 10),
co AS (SELECT path_a, path_b, {half_up('raw', 6)} AS w_co_raw, w_co FROM pw LEFT JOIN pk USING (path_a, path_b) WHERE w_co >= 0.10 OR near = 1)
"""


DEP = f""", im AS (SELECT s_nationkey AS s, c_nationkey AS d, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
de AS (SELECT least(s, d) AS path_a, greatest(s, d) AS path_b, CAST(sum(CASE WHEN s < d THEN n ELSE 0 END) AS BIGINT) AS imports_ab, CAST(sum(CASE WHEN s < d THEN 0 ELSE n END) AS BIGINT) AS imports_ba FROM im WHERE s <> d GROUP BY 1, 2),
dr AS (SELECT *, {half_up('ln(1.0 + imports_ab) + ln(1.0 + imports_ba)', 9)} AS raw FROM de),
dp AS (SELECT path_a, path_b, imports_ab, imports_ba, {half_up('raw', 6)} AS w_dep_raw, {half_up('least(1.0, raw / (SELECT quantile_cont(raw, 0.95) FROM dr))', 6)} AS w_dep FROM dr)
"""
SEM = f""", vn AS (SELECT vec_id AS path, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
vu AS (SELECT path, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM vn),
sm AS (SELECT a.path AS src, b.path AS dst, {half_up('list_inner_product(a.v, b.v) / (a.n * b.n)', 6)} AS similarity FROM vu a JOIN vu b ON a.path <> b.path),
kn AS (SELECT src, dst, similarity FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY similarity DESC, dst) AS rn FROM sm WHERE similarity >= 0.35) WHERE rn <= 20),
se AS (SELECT x.src AS path_a, x.dst AS path_b, x.similarity, {half_up('(x.similarity - 0.35) / (1 - 0.35)', 6)} AS w_sem FROM kn x JOIN kn y ON x.src = y.dst AND x.dst = y.src WHERE x.src < x.dst)
"""
FUSED = BASE + co_sql() + DEP + SEM + f""", un AS (SELECT path_a, path_b, w_sem, 0.0::DOUBLE AS w_co, 0.0::DOUBLE AS w_dep FROM se UNION ALL SELECT path_a, path_b, 0.0, w_co, 0.0 FROM co UNION ALL SELECT path_a, path_b, 0.0, 0.0, w_dep FROM dp),
fu AS (SELECT * FROM (SELECT path_a, path_b, max(w_sem) AS w_sem, max(w_co) AS w_co, max(w_dep) AS w_dep, {half_up('0.45 * max(w_sem) + 0.35 * max(w_co) + 0.20 * max(w_dep)', 6)} AS weight FROM un GROUP BY 1, 2) WHERE weight > 0),
en AS (SELECT path_a AS node, path_b AS other, weight FROM fu UNION ALL SELECT path_b, path_a, weight FROM fu),
dg AS (SELECT node AS path, {half_up('sum(weight)', 6)} AS weighted_degree, count(*) AS degree FROM en GROUP BY 1),
xs AS (SELECT path_a AS node, path_b AS other FROM se UNION ALL SELECT path_b, path_a FROM se),
xn AS (SELECT node AS path, {half_up('avg(CASE WHEN coalesce(a.cluster_id, -1) <> coalesce(b.cluster_id, -1) THEN 1.0 ELSE 0.0 END)', 6)} AS xnbr FROM xs LEFT JOIN cl a ON a.path = node LEFT JOIN cl b ON b.path = other GROUP BY 1),
vw AS (SELECT path, (last - commit_ts) // 2592000 AS w, count(*) AS c FROM cm, lst WHERE commit_ts > last - 6 * 2592000 GROUP BY 1, 2),
vl AS (SELECT path, {half_up('sum(c * c) / 6.0 - pow(sum(c) / 6.0, 2)', 6)} AS variance FROM vw WHERE w < 6 GROUP BY 1),
f0 AS (SELECT cl.path, cluster_id, coalesce(weighted_degree, 0.0) AS weighted_degree, coalesce(degree, 0) AS degree, 0.0::DOUBLE AS betweenness, coalesce(xnbr, 0.0) AS xnbr, coalesce(variance, 0.0) AS variance FROM cl LEFT JOIN dg USING (path) LEFT JOIN xn USING (path) LEFT JOIN vl USING (path)),
f1 AS (SELECT *, {half_up('0.5 * (weighted_degree / max(weighted_degree) OVER ())', 6)} AS hubness, {half_up('variance / max(variance) OVER ()', 6)} AS volatility FROM f0),
fm AS (SELECT path, cluster_id, weighted_degree, degree, betweenness, xnbr, hubness, volatility, {half_up('0.5 * xnbr + 0.3 * hubness + 0.2 * volatility', 6)} AS risk FROM f1),
ec AS (SELECT en.*, coalesce(a.cluster_id, -1) AS c, coalesce(b.cluster_id, -1) AS oc FROM en LEFT JOIN cl a ON a.path = node LEFT JOIN cl b ON b.path = other),
k0 AS (SELECT c AS cluster_id, sum(CASE WHEN c = oc THEN weight / 2 ELSE 0.0 END) AS inner_w, sum(CASE WHEN c = oc THEN 0.0 ELSE weight END) AS outer_w, sum(weight) AS vol FROM ec GROUP BY 1),
k1 AS (SELECT cluster_id, count(*) AS size, avg(risk) AS rm, max(risk) AS risk_max, array_to_string(list_sort(list(path))[1:50], chr(10)) AS paths FROM fm GROUP BY 1),
k2 AS (SELECT k1.*, coalesce(inner_w, 0.0) AS i, coalesce(outer_w, 0.0) AS o, coalesce(vol, 0.0) AS vol, {half_up('coalesce(outer_w, 0.0)', 6)} AS external_weight, (SELECT sum(weight) FROM en) AS total FROM k1 LEFT JOIN k0 USING (cluster_id)),
km AS (SELECT cluster_id, size, {half_up('CASE WHEN i + o > 0 THEN i / (i + o) ELSE 0.0 END', 6)} AS cohesion, {half_up('CASE WHEN i + o > 0 THEN 1 - i / (i + o) ELSE 0.0 END', 6)} AS leakage, {half_up('CASE WHEN least(vol, total - vol) > 0 THEN o / least(vol, total - vol) ELSE 0.0 END', 6)} AS conductance,
 {half_up('i', 6)} AS internal_weight, external_weight, external_weight AS external_inbound_weight, {half_up('(rank() OVER (ORDER BY external_weight) + (count(*) OVER (PARTITION BY external_weight) - 1) / 2.0) / count(*) OVER ()', 6)} AS external_inbound_rank, {half_up('rm', 6)} AS risk_mean, risk_max, paths FROM k2),
au AS (SELECT cluster_id, author, count(DISTINCT commit_sha) AS commit_count, count(DISTINCT path) AS file_count FROM cm JOIN cl USING (path) GROUP BY 1, 2),
ap AS (SELECT *, round_even(commit_count / CAST(sum(commit_count) OVER (PARTITION BY cluster_id) AS DOUBLE), 4) AS pct_of_cluster FROM au),
ac AS (SELECT cluster_id, row_number() OVER w AS rn, {half_up('sum(pct_of_cluster) OVER (w ROWS UNBOUNDED PRECEDING)', 6)} AS cum FROM ap WINDOW w AS (PARTITION BY cluster_id ORDER BY pct_of_cluster DESC, author)),
bf AS (SELECT cluster_id, coalesce(min(rn) FILTER (WHERE cum >= 0.8), count(*)) AS bus_factor FROM ac GROUP BY 1),
hh AS (SELECT cluster_id, {half_up('sum(pct_of_cluster * pct_of_cluster)', 4)} AS hhi, count(*) AS author_count FROM ap GROUP BY 1),
va AS (SELECT cluster_id, commit_sha, status, last - commit_ts < 2592000 AS cur FROM cm JOIN cl USING (path), lst WHERE last - commit_ts < 2 * 2592000),
vb AS (SELECT cluster_id, count(DISTINCT commit_sha) FILTER (WHERE cur) AS commits, count(*) FILTER (WHERE cur) AS changes, count(*) FILTER (WHERE cur AND status = 'A') AS added, count(*) FILTER (WHERE cur AND status = 'M') AS modified, count(*) FILTER (WHERE cur AND status = 'D') AS deleted, count(*) FILTER (WHERE NOT cur) AS prior_changes FROM va GROUP BY 1),
ve AS (SELECT *, {half_up('added / CAST(greatest(changes, 1) AS DOUBLE)', 4)} AS growth, {half_up('modified / CAST(greatest(changes, 1) AS DOUBLE)', 4)} AS churn, {half_up('changes / CAST(greatest(prior_changes, 1) AS DOUBLE)', 2)} AS acceleration, prior_changes = 0 AND changes > 0 AS is_emerging FROM vb)
"""


_tables: dict[tuple[str, str, str], DataFrame] = {}


class Graph:
    """The tables of a snapshot. Edges are made when a query first needs them and stored once an application, so each later query reads them."""

    #: The snapshot that tables are stored for; those of a graph without one are not stored.
    at: tuple[str, str] | None = None

    def __init__(self, spark, sf) -> None:
        self.spark, self.sf, self.at = spark, sf, (spark.sparkContext.applicationId, sf)
        self.commits, self.clusters = src.commits(spark, sf), src.clusters(spark, sf)

    def _stored(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        if self.at is None:
            return make()
        if (*self.at, name) not in _tables:
            _tables[(*self.at, name)] = cut(make(), name)
        return _tables[(*self.at, name)]

    @cached_property
    def sem(self):
        return self._stored("semantic", lambda: g.semantic_edges(src.vectors(self.spark, self.sf)))

    @cached_property
    def dep(self):
        return self._stored("dependency", lambda: g.dependency_edges(src.imports(self.spark, self.sf)))

    @cached_property
    def co(self):
        return self._stored("cochange", lambda: g.cochange_edges(self.commits))

    @cached_property
    def edges(self):
        return self._stored("fused", lambda: g.fused_edges(self.sem, self.co, self.dep))

    @cached_property
    def between(self):
        return self._stored("betweenness", lambda: g.betweenness(self.edges))

    @property
    def given(self):
        """A betweenness that SQL can have too."""
        return self.clusters.select("path", ((F.col("path") % 7) / 70.0).alias("betweenness"))

    def files(self, between=None):
        return g.file_metrics(self.clusters, self.edges, self.sem, self.commits, between)

    def whole_files(self):
        """Files with their betweenness, for queries without SQL; the SQL of the others fixes it at zero or by a rule."""
        return self.files(self.between)

    def metrics(self, between=None):
        return g.cluster_metrics(self.clusters, self.edges, self.files(between))


@query("cochange_edges", BASE + co_sql() + "SELECT * FROM co")
def cochange_edges(spark, sf):
    return g.cochange_edges(src.commits(spark, sf))


@query("cochange_edges_cap8", BASE + co_sql(8) + "SELECT * FROM co")
def cochange_edges_cap8(spark, sf):
    return g.cochange_edges(src.commits(spark, sf), cap=8)


@query("ignored_commits", BASE + "SELECT count(*) AS ignored_commits FROM (SELECT commit_sha FROM cm GROUP BY 1 HAVING count(DISTINCT path) > 8)")
def ignored_commits(spark, sf):
    return g.ignored_commits(src.commits(spark, sf), cap=8)


@query("dependency_edges", BASE + DEP + "SELECT * FROM dp")
def dependency_edges(spark, sf):
    return g.dependency_edges(src.imports(spark, sf))


@query("semantic_edges", BASE + SEM + "SELECT * FROM se")
def semantic_edges(spark, sf):
    return g.semantic_edges(src.vectors(spark, sf))


@query("hashed_vectors", f"""WITH tk AS (SELECT doc_id AS path, unnest(regexp_split_to_array(lower(text), '\\s+')) AS token FROM documents), tn AS (SELECT path, token, count(*) AS n, sha1(token) AS h FROM tk WHERE token <> '' GROUP BY 1, 2),
ix AS (SELECT path, CAST(CAST('0x' || substr(h, 1, 8) AS BIGINT) % 256 AS INTEGER) AS index, sum(n * CASE WHEN CAST('0x' || substr(h, 9, 2) AS BIGINT) % 2 = 0 THEN 1 ELSE -1 END) AS w FROM tn GROUP BY 1, 2)
SELECT path, index, {half_up('CAST(w AS DOUBLE) / sqrt(CAST(sum(w * w) OVER (PARTITION BY path) AS DOUBLE))', 6)} AS weight FROM ix WHERE w <> 0""")
def hashed_vectors(spark, sf):
    return g.hashed_vectors(src.table(spark, sf, "documents").select(F.col("doc_id").alias("path"), "text"))


def _graph(name: str, sql: str | None, f):
    query(name, sql and FUSED + sql)(lambda spark, sf: f(Graph(spark, sf)))


_graph("fused_edges", "SELECT * FROM fu", lambda x: x.edges)
_graph("node_degrees", "SELECT * FROM dg", lambda x: g.degrees(x.edges))
_graph("xnbr", "SELECT * FROM xn", lambda x: g.xnbr(x.sem, x.clusters))
_graph("volatility", "SELECT * FROM vl", lambda x: g.volatility(x.commits))
_graph("file_risk", "SELECT * FROM fm", lambda x: x.files())
_graph("cluster_metrics", "SELECT * FROM km", lambda x: x.metrics())
_graph("modularity", f", md AS (SELECT c, sum(CASE WHEN c = oc THEN weight ELSE 0 END) AS i, sum(weight) AS d FROM ec GROUP BY 1) SELECT {half_up('sum(i / (SELECT sum(d) FROM md) - pow(d / (SELECT sum(d) FROM md), 2))', 6)} AS modularity FROM md", lambda x: g.modularity(x.edges, x.clusters))
_graph("graph_summary", f"SELECT count(*) AS nodes, (SELECT count(*) FROM fu) AS edges, (SELECT count(DISTINCT cluster_id) FROM cl) AS clusters, {half_up('max(degree) / avg(degree)', 6)} AS hub_dominance FROM dg", lambda x: g.graph_summary(x.edges, x.clusters))
_graph("author_stats", "SELECT * FROM ap", lambda x: r.author_stats(x.commits, x.clusters))
_graph("bus_factor", "SELECT * FROM bf", lambda x: r.bus_factor(r.author_stats(x.commits, x.clusters)))
_graph("concentration", "SELECT * FROM hh", lambda x: r.concentration(r.author_stats(x.commits, x.clusters)))
_graph("team", "SELECT cluster_id, bus_factor, hhi, author_count, size FROM bf FULL JOIN hh USING (cluster_id) LEFT JOIN (SELECT cluster_id, count(*) AS size FROM cl GROUP BY 1) USING (cluster_id) WHERE size >= 2", lambda x: r.team(r.bus_factor(s := r.author_stats(x.commits, x.clusters)), r.concentration(s), x.clusters.groupBy("cluster_id").agg(F.count("*").alias("size"))))
_graph("velocity_compare", "SELECT * FROM ve", lambda x: r.velocity(x.commits, x.clusters))
_graph("recent_changes", "SELECT cluster_id, count(*) FILTER (WHERE last - commit_ts <= 2592000) AS recent_file_changes_30d, count(*) FILTER (WHERE last - commit_ts <= 7776000) AS recent_file_changes_90d FROM cm JOIN cl USING (path), lst GROUP BY 1", lambda x: r.recent_changes(x.commits, x.clusters))
_graph("list_commits", "SELECT commit_sha, path, max(commit_ts) AS commit_ts, min(status) AS status, coalesce(min(cluster_id), -1) AS cluster_id FROM cm LEFT JOIN cl USING (path), lst WHERE commit_ts >= last - 30 * 86400 GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 50", lambda x: r.list_commits(x.commits, x.clusters))
_graph("hot_files", "SELECT path, count(DISTINCT commit_sha) AS commits, any_value(cluster_id) AS cluster_id, any_value(risk) AS risk FROM cm LEFT JOIN fm USING (path), lst WHERE commit_ts >= last - 90 * 86400 GROUP BY path ORDER BY commits DESC, path LIMIT 20", lambda x: r.hot_files(x.commits, x.files()))
_graph("risks", "SELECT * FROM fm WHERE risk >= 0.1 ORDER BY risk DESC, path LIMIT 20", lambda x: r.risks(x.files(), 0.1))
CLUSTER_EDGES = f""", eb AS (SELECT c AS cluster_id, oc AS neighbour, {half_up('sum(weight)', 6)} AS weight, count(*) AS edges FROM ec WHERE c <> oc GROUP BY 1, 2),
et AS (SELECT c AS cluster_id, oc AS neighbour, string_agg(node || '-' || other, ',' ORDER BY rn) AS top_pairs FROM (SELECT *, row_number() OVER (PARTITION BY c, oc ORDER BY weight DESC, node, other) AS rn FROM ec WHERE c <> oc) WHERE rn <= 3 GROUP BY 1, 2)
SELECT cluster_id, neighbour, weight, edges, {half_up('weight / external_weight', 4)} AS leakage_share, top_pairs FROM eb JOIN et USING (cluster_id, neighbour) JOIN km USING (cluster_id)"""
_graph("cluster_edges", CLUSTER_EDGES, lambda x: r.cluster_edges(x.edges, x.clusters, x.metrics()))
_graph("fitness_violations", """, big AS (SELECT * FROM km WHERE size >= 2)
SELECT 'file_risk' AS category, CAST(path AS VARCHAR) AS entity, 'risk' AS metric, risk AS value, 0.3::DOUBLE AS threshold FROM fm WHERE risk > 0.3 UNION ALL SELECT 'boundary_leakage', CAST(cluster_id AS VARCHAR), 'leakage', leakage, 0.6 FROM big WHERE leakage > 0.6
UNION ALL SELECT 'cohesion', CAST(cluster_id AS VARCHAR), 'cohesion', cohesion, 0.4 FROM big WHERE cohesion < 0.4 UNION ALL SELECT 'cluster_risk', CAST(cluster_id AS VARCHAR), 'risk_mean', risk_mean, 0.1 FROM big WHERE risk_mean > 0.1
UNION ALL SELECT 'bus_factor', CAST(cluster_id AS VARCHAR), 'bus_factor', CAST(bus_factor AS DOUBLE), 15 FROM bf SEMI JOIN big USING (cluster_id) WHERE bus_factor < 15""", lambda x: r.fitness((f := x.files()), g.cluster_metrics(x.clusters, x.edges, f), r.bus_factor(r.author_stats(x.commits, x.clusters)), max_file_risk=0.3, max_risk_mean=0.1, min_bus=15))
_graph("file_status", None, lambda x: r.file_status(x.whole_files()))
_graph("focus_graph", None, lambda x: g.focus_graph(x.edges, x.whole_files()))
_graph("suggestions", None, lambda x: r.suggestions((f := x.whole_files()), (m := g.cluster_metrics(x.clusters, x.edges, f)), r.cluster_edges(x.edges, x.clusters, m), r.velocity(x.commits, x.clusters)))
_graph("communities", None, lambda x: g.communities(x.edges))
_graph("betweenness", None, lambda x: g.betweenness(x.edges))
_graph("drift", None, lambda x: g.drift(x.commits, x.sem, x.dep))
_graph("drift_trend", None, lambda x: g.drift_trend(g.drift(x.commits, x.sem, x.dep)))
query("adjusted_rand", f"""WITH b AS (SELECT vec_id % 7 AS l, label AS r FROM embeddings), c AS (SELECT l, r, count(*) AS n FROM b GROUP BY 1, 2), s AS (SELECT sum(n * (n - 1) / 2.0) AS c, sum(n) AS n FROM c),
a AS (SELECT sum(n * (n - 1) / 2.0) AS a FROM (SELECT sum(n) AS n FROM c GROUP BY l)), d AS (SELECT sum(n * (n - 1) / 2.0) AS b FROM (SELECT sum(n) AS n FROM c GROUP BY r))
SELECT {half_up('(c - a * b / (n * (n - 1) / 2.0)) / ((a + b) / 2 - a * b / (n * (n - 1) / 2.0))', 6)} AS ari FROM s, a, d""")(
    lambda spark, sf: g.adjusted_rand((v := src.vectors(spark, sf)).select("path", (F.col("path") % 7).alias("cluster_id")), v.select("path", F.col("label").alias("cluster_id"))))


RECENT = "SELECT cluster_id, count(*) FILTER (WHERE last - commit_ts <= 2592000) AS recent_file_changes_30d, count(*) FILTER (WHERE last - commit_ts <= 7776000) AS recent_file_changes_90d FROM cm JOIN cl USING (path), lst GROUP BY 1"
_graph("show_clusters", f""", rc AS ({RECENT}) SELECT cluster_id, size, cohesion, leakage, conductance, internal_weight, external_weight, external_inbound_weight, risk_mean, risk_max,
 coalesce(recent_file_changes_30d, 0) AS recent_file_changes_30d, coalesce(recent_file_changes_90d, 0) AS recent_file_changes_90d FROM km LEFT JOIN rc USING (cluster_id) WHERE size >= 2""", lambda x: pf.show_clusters(x.metrics(), r.recent_changes(x.commits, x.clusters)))
ACTIVE = """, mx AS (SELECT max(commit_ts) AS m FROM cm JOIN cl USING (path)), ta AS (SELECT cluster_id, count(*) AS file_change_count FROM cm JOIN cl USING (path), mx WHERE commit_ts >= m - 30 * 86400 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3)"""
_graph("top_active_clusters", ACTIVE + " SELECT * FROM ta", lambda x: pf.top_active(x.commits, x.clusters))
_graph("cluster_edges_top_active", ACTIVE + CLUSTER_EDGES + " SEMI JOIN ta USING (cluster_id)", lambda x: r.cluster_edges(x.edges, x.clusters, x.metrics()).join(F.broadcast(pf.top_active(x.commits, x.clusters)), "cluster_id", "left_semi"))  # three rows
_graph("boundary_profiles", f""", lk AS (SELECT cluster_id, leakage FROM km ORDER BY leakage DESC, cluster_id LIMIT 5), bx AS (SELECT c AS cluster_id, leakage, oc AS neighbour, node, other, weight FROM ec JOIN lk ON c = cluster_id WHERE c <> oc),
bw AS (SELECT cluster_id, leakage, neighbour, {half_up('sum(weight)', 3)} AS weight FROM bx GROUP BY 1, 2, 3), bp AS (SELECT *, CAST(row_number() OVER (PARTITION BY cluster_id ORDER BY weight DESC, neighbour) AS INTEGER) AS place FROM bw),
be AS (SELECT cluster_id, neighbour, string_agg(node || '-' || other, ',' ORDER BY rn) AS examples FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id, neighbour ORDER BY least(node, other), greatest(node, other)) AS rn FROM bx) WHERE rn <= 3 GROUP BY 1, 2)
SELECT cluster_id, leakage, neighbour, weight, place, examples FROM bp JOIN be USING (cluster_id, neighbour) WHERE place <= 3""", lambda x: pf.boundary_profiles(x.edges, x.clusters, x.metrics()))
_graph("file_risk_with_betweenness", None, lambda x: x.whole_files())

#: The same with a betweenness by a rule in place of zero.
GIVEN = FUSED.replace("0.0::DOUBLE AS betweenness", "(path % 7) / 70.0 AS betweenness")
GIVEN = GIVEN.replace(half_up("0.5 * (weighted_degree / max(weighted_degree) OVER ())", 6), half_up("0.5 * (weighted_degree / max(weighted_degree) OVER ()) + 0.5 * (betweenness / max(betweenness) OVER ())", 6))
SPLIT = """, lb AS (SELECT * FROM km WHERE leakage >= 0.2), nb AS (SELECT c AS cluster_id, oc AS neighbour, floor(sum(weight) * 1000000.0 + 0.5) / 1000000.0 AS weight FROM ec WHERE c <> oc GROUP BY 1, 2),
tp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY weight DESC, neighbour) AS rn FROM nb SEMI JOIN lb USING (cluster_id)) WHERE rn = 1), hb AS (SELECT neighbour, count(*) AS n FROM tp GROUP BY 1 HAVING count(*) >= 2),
sg AS (SELECT 'High' AS priority, 'Separate the hub cluster ' || neighbour AS title, n || ' leaky clusters lean on it most' AS reason FROM hb
UNION ALL SELECT CASE WHEN leakage >= 0.4 THEN 'High' ELSE 'Medium' END, 'Tighten the boundary of cluster ' || cluster_id, 'leakage ' || leakage FROM lb
UNION ALL SELECT CASE WHEN xnbr >= 0.5 THEN 'Medium' ELSE 'Low' END, 'Review the place of path ' || path, 'neighbours elsewhere ' || xnbr FROM fm WHERE xnbr >= 0.35
UNION ALL SELECT 'Medium', 'Split the hub path ' || path, 'hubness ' || hubness FROM fm WHERE hubness >= 0.45
UNION ALL SELECT 'Medium', 'Watch the growth of cluster ' || cluster_id, 'acceleration ' || acceleration FROM ve WHERE acceleration >= 1.5 AND growth >= 0.3
UNION ALL SELECT 'Low', 'Review what cluster ' || cluster_id || ' has added', added || ' additions' FROM ve WHERE added >= 20
UNION ALL SELECT 'Low', 'Check whether cluster ' || cluster_id || ' is finished', 'acceleration ' || acceleration FROM ve WHERE acceleration <= 0.5 AND growth < 0.1),
so AS (SELECT *, CASE priority WHEN 'High' THEN 0 WHEN 'Medium' THEN 1 ELSE 2 END AS k FROM sg)
SELECT priority, title, reason FROM (SELECT *, row_number() OVER (PARTITION BY title ORDER BY k, reason) AS rn FROM so) WHERE rn = 1 ORDER BY k, title LIMIT 20"""


def _given(name: str, sql: str, f):
    query(name, GIVEN + sql)(lambda spark, sf: f(Graph(spark, sf)))


_given("file_risk_given_betweenness", "SELECT * FROM fm", lambda x: x.files(x.given))
_given("cluster_metrics_given_betweenness", "SELECT * FROM km", lambda x: x.metrics(x.given))
_given("risks_given_betweenness", "SELECT * FROM fm WHERE risk >= 0.1 ORDER BY risk DESC, path LIMIT 20", lambda x: r.risks(x.files(x.given), 0.1))
_given("file_status_given_betweenness", """SELECT path, risk, CASE WHEN risk > 0.8 THEN 'critical' WHEN risk > 0.5 THEN 'attention' ELSE 'ok' END AS status,
 CASE WHEN 0.2 * volatility >= 0.5 * xnbr AND 0.2 * volatility >= 0.3 * hubness THEN 'volatile' WHEN 0.3 * hubness >= 0.5 * xnbr AND 0.3 * hubness >= 0.2 * volatility THEN 'hub' ELSE 'cross-cluster neighbours' END AS reason FROM fm""", lambda x: r.file_status(x.files(x.given)))
_given("suggestions_given_betweenness", SPLIT, lambda x: r.suggestions((f := x.files(x.given)), (m := g.cluster_metrics(x.clusters, x.edges, f)), r.cluster_edges(x.edges, x.clusters, m), r.velocity(x.commits, x.clusters)))

LABELS = f"""WITH pt AS (SELECT CAST(regexp_extract(p_brand, '(\\d+)', 1) AS INTEGER) AS cluster_id, lower(p_type) || '/' || split_part(p_name, ' ', 1) || '/v' || (p_size % 3) AS prefix, lower(split_part(p_name, ' ', 2)) AS stem, CAST({{w}} AS DOUBLE) AS w, p_partkey FROM part),
tt AS (SELECT cluster_id, count(*) AS n, sum(w) AS total FROM pt GROUP BY 1),
px AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY w DESC, prefix) AS rn FROM (SELECT cluster_id, prefix, sum(w) AS w FROM pt GROUP BY 1, 2)), pr AS (SELECT cluster_id, string_agg(prefix, ' + ' ORDER BY rn) AS structural FROM px WHERE rn <= 2 GROUP BY 1),
sx AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY w DESC, stem) AS rn FROM (SELECT cluster_id, stem, sum(w) AS w FROM pt WHERE length(stem) > 1 AND stem NOT IN ('core', 'app', 'main', 'index') GROUP BY 1, 2)),
lb AS (SELECT cluster_id, n, structural, a.stem AS s1, b.stem AS s2, a.w / total AS share, (a.w + b.w) / total AS both_, CASE WHEN n > 100 THEN .15 WHEN n > 30 THEN .25 ELSE .4 END AS least_ FROM tt JOIN pr USING (cluster_id) LEFT JOIN sx a USING (cluster_id) LEFT JOIN sx b USING (cluster_id) WHERE a.rn = 1 AND b.rn = 2),
lc AS (SELECT cluster_id, CASE WHEN n > 100 THEN 70 ELSE 50 END AS longest, CASE WHEN share > least_ AND NOT (n > 100 AND share < .25) THEN s1 || ' (' || structural || ')' WHEN both_ > least_ THEN s1 || '/' || s2 || ' (' || structural || ')' ELSE structural END AS label FROM lb)
SELECT cluster_id, CASE WHEN length(label) > longest THEN substr(label, 1, longest - 3) || '...' ELSE label END AS label FROM lc"""


def _labels(weight: str | None):
    def run(spark, sf):
        p = src.table(spark, sf, "part")
        folder = F.concat_ws("/", F.lit("src"), F.lower("p_type"), F.split_part("p_name", F.lit(" "), F.lit(1)), F.concat(F.lit("v"), F.col("p_size") % 3))
        name = F.concat(F.split_part("p_name", F.lit(" "), F.lit(2)), F.lit("-"), F.col("p_partkey"), F.lit(".service.ts"))
        return pf.cluster_labels(p.select(F.regexp_extract("p_brand", r"(\d+)", 1).cast("int").alias("cluster_id"), F.concat_ws("/", folder, name).alias("path"), "p_size"), weight)

    return run


query("cluster_labels", LABELS.format(w="1"))(_labels(None))
query("cluster_labels_weighted", LABELS.format(w="p_size"))(_labels("p_size"))
