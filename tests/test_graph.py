import random

import pytest
from pyspark.sql import functions as F

from tidewell.operators import communities
from tidewell.operators import graph as g
from tidewell.operators import relational
from tidewell.operators import repo as r
from tidewell.operators.communities import leiden
from tidewell.sources import feeds, repository

EDGES = [(1, 2, 1.0), (3, 4, 1.0), (2, 3, 0.5)]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame([(a, b, 0.0, 0.0, 0.0, w) for a, b, w in EDGES], "path_a long, path_b long, w_sem double, w_co double, w_dep double, weight double")


@pytest.fixture(scope="module")
def clusters(spark):
    return spark.createDataFrame([(1, 0), (2, 0), (3, 1), (4, 1)], "path long, cluster_id int")


def test_degrees_and_cluster_metrics(spark, edges, clusters):
    d = {x["path"]: x["weighted_degree"] for x in g.degrees(edges).collect()}
    assert d == {1: 1.0, 2: 1.5, 3: 1.5, 4: 1.0}
    files = clusters.withColumn("risk", F.lit(0.5))
    m = {x["cluster_id"]: x for x in g.cluster_metrics(clusters, edges, files).collect()}
    assert (m[0]["cohesion"], m[0]["leakage"], m[0]["conductance"], m[0]["internal_weight"], m[0]["external_weight"]) == (round(2 / 3, 6), round(1 / 3, 6), 0.2, 1.0, 0.5)
    assert m[0]["external_inbound_rank"] == 0.75 and m[0]["paths"] == "1\n2"


def test_modularity_and_ari(spark, edges, clusters):
    q = g.modularity(edges, clusters).first()[0]
    assert abs(q - 2 * (2 / 5 - (2.5 / 5) ** 2)) < 1e-6
    assert g.adjusted_rand(clusters, clusters).first()[0] == 1.0
    other = clusters.withColumn("cluster_id", F.col("path") % 2)
    assert g.adjusted_rand(clusters, other).first()[0] < 0.5
    assert g.adjusted_rand(clusters.where("false"), clusters).first()[0] == 1.0


def test_communities_and_betweenness(spark, edges, clusters):
    found = g.communities(edges)
    assert g.adjusted_rand(found, clusters).first()[0] == 1.0
    assert [x["cluster_id"] for x in found.orderBy("path").collect()] == [0, 0, 1, 1]
    b = {x["path"]: x["betweenness"] for x in g.betweenness(edges).collect()}
    assert b[1] == b[4] == 0 and abs(b[2] - 2 / 3) < 1e-9 and b[2] == b[3]


def cliques(count=6, size=4, bridge=0.1):
    ring = [(c * size + i, c * size + j, 1.0) for c in range(count) for i in range(size) for j in range(i)] + [(c * size, (c * size + size) % (count * size), bridge) for c in range(count)]
    return [(min(a, b), max(a, b), w) for a, b, w in ring]


def quality(edges, label, resolution=1.0):
    m2, degree, inside = 2 * sum(w for *_, w in edges), {}, 0.0
    for a, b, w in edges:
        inside += 2 * w * (label[a] == label[b])
        for v in (a, b):
            degree[label[v]] = degree.get(label[v], 0.0) + w
    return inside / m2 - resolution * sum(d * d for d in degree.values()) / m2**2


def is_connected(edges, members):
    seen, open_ = set(), [min(members)]
    while open_:
        v = open_.pop()
        if v not in seen:
            seen.add(v)
            open_ += [b if a == v else a for a, b, _ in edges if v in (a, b) and {a, b} <= members]
    return seen == members


@pytest.mark.parametrize("parts", [1, 5])
def test_leiden_finds_cliques_whatever_the_partitions(spark, parts):
    rows = cliques()
    edges = spark.createDataFrame(rows, "path_a long, path_b long, weight double").repartition(parts)
    found = {x["path"]: x["cluster_id"] for x in g.communities(edges).collect()}
    assert found == {v: v // 4 for v in range(24)}
    bridged = g.communities(edges, start=spark.createDataFrame([(v, 0) for v in range(24)], "path long, cluster_id int"))
    assert {x["path"]: x["cluster_id"] for x in bridged.collect()}.keys() == found.keys()


def test_leiden_communities_are_connected_and_good(spark):
    rng = random.Random(5)
    group = {v: rng.randrange(5) for v in range(60)}
    rows = [(a, b, rng.choice([0.5, 1.0])) for a in range(60) for b in range(a + 1, 60) if rng.random() < (0.4 if group[a] == group[b] else 0.03)]
    edges = spark.createDataFrame(rows, "path_a long, path_b long, weight double")
    found = {x["path"]: x["cluster_id"] for x in g.communities(edges).collect()}
    again = {x["path"]: x["cluster_id"] for x in g.communities(edges.repartition(6)).collect()}
    assert found == again and quality(rows, found) >= quality(rows, group) - 0.01
    for c in set(found.values()):
        assert is_connected(rows, {v for v, x in found.items() if x == c})


@pytest.mark.parametrize("bound", [0, 6])
def test_steps_and_arrays_give_the_same_communities(spark, monkeypatch, bound):
    """No level on arrays, and all but the first."""
    rng = random.Random(2)
    rows = cliques(3, 3, 0.4) + [(a, b, 0.25) for a, b in ((0, 4), (1, 7), (10, 11), (2, 10))] + [(5, 5, 0.5)]
    edges = spark.createDataFrame(rng.sample(rows, len(rows)), "path_a long, path_b long, weight double")
    want = {tuple(r) for r in leiden(edges).collect()}
    monkeypatch.setattr(communities, "ARRAY_EDGES", bound)
    assert {tuple(r) for r in leiden(edges).collect()} == want and len({c for _, c in want}) == 4


def test_communities_that_hang_together_only_through_others_are_split(spark):
    """A start that joins two far cliques: no move gains, and no community may stay in pieces."""
    rows = cliques(2, 4, 0.0001)[:12]
    edges = spark.createDataFrame(rows, "path_a long, path_b long, weight double")
    start = spark.createDataFrame([(v, 0) for v in range(8)], "path long, cluster_id int")
    found = {x["path"]: x["cluster_id"] for x in g.communities(edges, start=start).collect()}
    assert found == {v: v // 4 for v in range(8)}
    assert g.communities(edges.where("false")).count() == 0


def test_percentile_by_counting(spark, monkeypatch):
    monkeypatch.setattr(relational, "FEW", 5)
    monkeypatch.setattr(relational, "RANGES", 7)
    rng = random.Random(3)
    for values in ([rng.random() ** 9 for _ in range(400)], [rng.choice([0.0, 1.0, 1e-300, 2.5]) for _ in range(200)], [7.0] * 50, [1.0], [1e300, -1e300, 0.0, 3.0] * 9, [None, 2.0, 4.0]):
        t = spark.createDataFrame([(v,) for v in values], "raw double")
        for share in (0.0, 0.5, 0.95, 1.0):
            assert relational.exact_percentile(t, "raw", share) == t.agg(F.percentile("raw", share)).first()[0]
    assert relational.exact_percentile(t.where("false"), "raw", 0.5) is None


def test_windows_from_one_pass_equal_each_computed_anew(spark):
    rng = random.Random(8)
    commits = spark.createDataFrame([(c, 1_700_000_000 + c * 5 * g.DAY, p) for c in range(40) for p in rng.sample(range(12), rng.randrange(1, 6))], "commit_sha long, commit_ts long, path long")
    first, last = 1_700_000_000, 1_700_000_000 + 39 * 5 * g.DAY
    ends = g.drift_windows(first, last)
    for end, one in zip(ends, g.cochange_windows(commits, ends, k=2), strict=True):
        want = {tuple(r) for r in g.cochange_edges(commits.where(F.col("commit_ts") <= end), k=2).collect()}
        assert {tuple(r) for r in one.collect()} == want and want
    rows = g.drift(commits, *[spark.createDataFrame([], f"path_a long, path_b long, {w} double") for w in ("w_sem", "w_dep")]).collect()
    assert [r.window_end_ts for r in rows] == ends and rows[0].ari_prev == 1.0


def test_volatility_of_even_changes_is_zero(spark):
    commits = spark.createDataFrame([(k, k * 30 * g.DAY + 1, "p") for k in range(6)] + [(9, 6 * 30 * g.DAY, "q")], "commit_sha long, commit_ts long, path string")
    got = {x["path"]: x["variance"] for x in g.volatility(commits).collect()}
    assert got["p"] == 0.0 and got["q"] == round(1 / 6 - 1 / 36, 6)


def test_mutual_neighbours_and_blocks(spark, monkeypatch):
    v = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.9, 0.1, 0.0]), (3, [0.0, 1.0, 0.0]), (4, [0.0, 0.0, 0.0])], "path long, vector array<float>")
    assert [(x["path_a"], x["path_b"]) for x in g.semantic_edges(v, k=1, tau=0.5).collect()] == [(1, 2)]
    whole = sorted(map(tuple, g.neighbours(v, 2, 0.05).collect()))
    monkeypatch.setattr(g, "BROADCAST_BYTES", 0)
    assert sorted(map(tuple, g.neighbours(v, 2, 0.05, block=2).collect())) == whole


def test_cochange_cap(spark):
    commits = spark.createDataFrame([("a", 0, p) for p in range(4)] + [("b", 0, p) for p in range(2)], "commit_sha string, commit_ts long, path long")
    assert g.cochange_edges(commits).count() == 6 and g.cochange_edges(commits, cap=3).count() == 1
    assert g.ignored_commits(commits, cap=3).first()[0] == 1


def test_ignored_commits_holds_paths_of_large_commits_alone(spark):
    """every task held all pairs of a commit and a path."""
    rows = [("a", p) for p in range(4)] + [("b", p % 3) for p in range(9)] + [(None, p) for p in range(5)] + [("c", None)] * 6 + [(f"d{n}", n) for n in range(500)]
    got = g.ignored_commits(spark.createDataFrame(rows, "commit_sha string, path long"), cap=3)
    assert got.first()[0] == 2  # a and the one without a name
    seen = [got._jdf.queryExecution().executedPlan()]
    metrics = {}
    while seen:
        node = seen.pop()
        kind = node.nodeName()
        seen += [node.finalPhysicalPlan()] if kind == "AdaptiveSparkPlan" else [node.plan()] if kind.endswith("QueryStage") else []
        children = node.children()
        seen += [children.apply(i) for i in range(children.size())]
        if kind == "HashAggregate":
            metrics.setdefault(kind, []).append(node.metrics().apply("numOutputRows").value())
    assert max(metrics["HashAggregate"]) < 100


def test_drift_windows():
    assert g.drift_windows(0, 200 * g.DAY) == [k * g.DAY for k in (50, 80, 110, 140, 170, 200)]
    assert len(g.drift_windows(0, 60 * g.DAY)) == 6 and g.drift_windows(5, 5) == [5]


def test_drift_trend(spark):
    trend = lambda xs: g.drift_trend(spark.createDataFrame(list(enumerate(xs)), "window_end_ts long, ari_prev double")).first()[0]
    assert trend([1.0, 0.5, 0.9, 0.4]) == "volatile" and trend([0.5, 0.7]) == "stabilizing" and trend([0.9, 0.7]) == "degrading" and trend([0.7, 0.7]) == "stable"


def test_single_author_team(spark, clusters):
    commits = spark.createDataFrame([("x", 0, "ann", "A", 1), ("y", 1, "ann", "M", 2)], "commit_sha string, commit_ts long, author string, status string, path long")
    stats = r.author_stats(commits, clusters)
    assert r.bus_factor(stats).first()["bus_factor"] == 1 and r.concentration(stats).first()["hhi"] == 1.0
    speed = r.velocity(commits, clusters).first()
    assert (speed["changes"], speed["added"], speed["growth"], speed["is_emerging"]) == (2, 1, 0.5, True)


def test_fitness_categories(spark):
    files = spark.createDataFrame([(1, 0.9), (2, 0.8)], "path long, risk double")
    metrics = spark.createDataFrame([(0, 3, 0.7, 0.3, 0.6), (1, 1, 0.9, 0.1, 0.9)], "cluster_id int, size int, leakage double, cohesion double, risk_mean double")
    bus = spark.createDataFrame([(0, 1), (1, 1)], "cluster_id int, bus_factor long")
    got = sorted((x["category"], x["entity"]) for x in r.fitness(files, metrics, bus).collect())
    assert got == [("boundary_leakage", "0"), ("bus_factor", "0"), ("cluster_risk", "0"), ("cohesion", "0"), ("file_risk", "1")]


def test_commit_log_and_imports(spark):
    log = spark.createDataFrame([("--COMMIT--\nabc\n100\nAnn\n" + "m" * 100 + "\nM\ta.py\nA\tgone.py\n--COMMIT--\ndef\n200\nBob\nfix\nM\tpkg/b.py\n",)], "value string")
    files = spark.createDataFrame([("a.py", b"import pkg.b\nfrom pkg import b\n"), ("pkg/__init__.py", b""), ("pkg/b.py", b"from . import c\nfrom .c import x, y\n"), ("pkg/c.py", b"syntax error("), ("w/m.ts", b"import x from './n'\nconst y = require(\"../q\")\n"), ("w/n/index.ts", b""), ("q.js", b""), ("bin.dat", b"a\x00b")], "path string, content binary")
    inv = repository.inventory(files)
    assert {x["path"] for x in inv.collect()} == {"a.py", "pkg/__init__.py", "pkg/b.py", "pkg/c.py", "w/m.ts", "w/n/index.ts", "q.js"}
    assert {x["path"]: x["loc"] for x in inv.collect()}["a.py"] == 3
    rows = repository.commit_log(log, inv).orderBy("commit_ts").collect()
    assert [(x["commit_sha"], x["status"], x["path"], len(x["message"])) for x in rows] == [("abc", "M", "a.py", 80), ("def", "M", "pkg/b.py", 3)]
    py = {(x["source_path"], x["raw_specifier"]): (x["resolved_path"], x["count"]) for x in repository.python_imports(inv).collect()}
    assert py == {("a.py", "pkg.b"): ("pkg/b.py", 1), ("a.py", "pkg"): ("pkg/__init__.py", 1), ("pkg/b.py", ".c"): ("pkg/c.py", 3)}
    js = lambda **k: {x["raw_specifier"]: x["resolved_path"] for x in repository.script_imports(inv, **k).collect()}
    assert js() == {"./n": "w/n/index.ts", "../q": None} and js(collapse_parents=True)["../q"] == "q.js"


def test_inventory_excludes_and_names_unknown_languages(spark):
    paths = ["a.py", "stub.pyi", "node_modules/x.js", "lib/y.min.js", "m.mjs", "notes.md", "Makefile"]
    files = spark.createDataFrame([(p, b"x") for p in paths], "path string, content binary")
    got = {x["path"]: x["language"] for x in repository.inventory(files, exclude_prefixes=["node_modules/"], exclude_suffixes=[".min.js"]).collect()}
    assert got == {"a.py": "python", "stub.pyi": "python", "m.mjs": "javascript", "notes.md": "unknown", "Makefile": "unknown"}
    assert {x["path"] for x in repository.inventory(files, extensions=[".py", ".mjs"]).collect()} == {"a.py", "m.mjs"}


def test_import_forms(spark):
    text = """import a from "./a"
import { b,
  c } from './b'
export * from './e'
import './bare'
const r = require("./r"), d = await import('./d')
const s = "from nowhere"; importer('./no')
"""
    got = spark.createDataFrame([(text,)], "t string").select(repository.script_specifiers(F.col("t")).alias("s")).first()["s"]
    assert sorted(got) == ["./a", "./b", "./bare", "./d", "./e", "./r"]
    assert repository._python_imports("p/q.py", "from .... import x\nfrom ...y import z") == [("x", "....x", 1), ("y", "...y", 1)]


def test_focus_graph_takes_risk_into_account(spark):
    edges = spark.createDataFrame([(0, k, 0.1 * k) for k in range(1, 8)] + [(8, 9, 0.01)], "path_a long, path_b long, weight double")
    files = spark.createDataFrame([(k, 1.0 if k == 9 else 0.0) for k in range(10)], "path long, risk double")
    pairs = lambda **k: sorted((x["path_a"], x["path_b"]) for x in g.focus_graph(edges, files, **k).collect())
    assert pairs() == [(0, k) for k in range(1, 8)] + [(8, 9)]
    assert pairs(most=1) == [(0, 7)] and pairs(nodes=3) == [(0, 7)]  # 9 stays by risk, but 8 doesn't, and so their edge goes
    assert pairs(nodes=1) == [(0, 7)]  # no edge would be left


def test_feeds(spark):
    from datetime import datetime

    body = "<rss><item><title><![CDATA[One]]></title><link>http://x/1</link><guid>g1</guid><pubDate>Mon, 01 Jan 2024 10:00:00 GMT</pubDate></item><item><title>Two</title></item></rss>"
    got = feeds.rss(spark.createDataFrame([("f", body)], "feed string, body string")).collect()
    assert [(x["event_id"], x["title"], x["published_at"].year) for x in got] == [("rss:f:g1", "One", 2024)]
    atom = "<feed><entry><title>8-K - Acme Corp (0001234567) (Filer)</title><id>urn:0001234567-24-000001</id><updated>2024-01-02T00:00:00Z</updated></entry></feed>"
    f = feeds.filings(spark.createDataFrame([("f", atom)], "feed string, body string")).first()
    assert (f["event_id"], f["form"], f["cik"], f["company"]) == ("edgar:0001234567-24-000001", "8-K", "0001234567", "Acme Corp")
    sub = spark.createDataFrame([("1", ["a", "b", "c"], ["2024-01-01", "2020-01-01", "2024-02-01"], ["", "", ""], ["8-K", "8-K", "4"], ["", "", ""])], "cik string, accessionNumber array<string>, filingDate array<string>, reportDate array<string>, form array<string>, primaryDocument array<string>")
    assert [x["event_id"] for x in feeds.earnings(sub, datetime(2024, 3, 1)).collect()] == ["earnings:a"]
    assert feeds.earnings(sub, datetime(2024, 3, 1), cursor="2024-01-01").count() == 0
    items = spark.createDataFrame([(1, "t", None, "b", 0, 5, 2, None, None), (2, "u", "http://y", "b", 0, 5, None, True, None)], "id long, title string, url string, by string, time long, score int, descendants int, deleted boolean, dead boolean")
    assert [(x["event_id"], x["comments"]) for x in feeds.hacker_news(items).collect()] == [("hn:1", 2)]


def test_betweenness_is_the_same_beyond_the_bound(spark, monkeypatch, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    rows = [(1, 2, 1.0), (1, 3, 1.0), (2, 4, 1.0), (3, 4, 1.0), (4, 5, 0.1), (5, 6, 0.5), (4, 6, 0.05), (7, 8, 1.0)]
    t = spark.createDataFrame(rows, "path_a long, path_b long, weight double")
    want = {x["path"]: x["betweenness"] for x in g.betweenness(t).collect()}
    monkeypatch.setattr(g, "DRIVER_EDGES", 3)
    got = {x["path"]: x["betweenness"] for x in g.betweenness(t).collect()}
    assert got == pytest.approx(want, abs=2e-9) and want[4] > want[2] > 0


def test_betweenness_query_takes_weak_edges(monkeypatch):
    from tidewell.plans import catalog
    from tidewell.plans import graph as plans

    class Fake:
        edges = "all fused edges"

        def __init__(self, spark, sf):
            pass

    monkeypatch.setattr(plans, "Graph", Fake)
    monkeypatch.setattr(g, "betweenness", lambda edges: edges)
    assert catalog.QUERIES["betweenness"](None, "") == "all fused edges"


@pytest.mark.parametrize("name", ["file_status", "focus_graph", "suggestions"])
def test_queries_without_sql_take_betweenness(spark, edges, clusters, monkeypatch, name):
    from tidewell.plans import catalog
    from tidewell.plans import graph as plans

    commits = spark.createDataFrame([("x", 0, 1), ("y", 1, 2)], "commit_sha string, commit_ts long, path long")
    made = plans.Graph.__new__(plans.Graph)
    made.clusters, made.edges, made.sem, made.commits = clusters, edges, edges, commits
    risk = {x["path"]: (x["betweenness"], x["hubness"]) for x in made.whole_files().collect()}
    assert risk[1] == (0.0, round(0.5 / 1.5, 6)) and risk[2] == (pytest.approx(2 / 3), 1.0)

    def files(self, between=None):
        raise LookupError if between is not None else AssertionError("files without betweenness")

    monkeypatch.setattr(plans.Graph, "files", files)
    monkeypatch.setattr(plans, "Graph", lambda spark, sf: made)
    with pytest.raises(LookupError):
        catalog.QUERIES[name](spark, "")


def test_sql_of_file_risk_holds_the_same_law(spark, edges, clusters):
    duckdb = pytest.importorskip("duckdb")
    between = g.betweenness(edges)
    commits = spark.createDataFrame([("x", 0, 1)], "commit_sha string, commit_ts long, path long")
    got = {x["path"]: x["hubness"] for x in g.file_metrics(clusters, edges, edges, commits, between).collect()}
    db = duckdb.connect()
    db.execute("CREATE TABLE f (path BIGINT, weighted_degree DOUBLE, betweenness DOUBLE)")
    degree = {x["path"]: x["weighted_degree"] for x in g.degrees(edges).collect()}
    db.executemany("INSERT INTO f VALUES (?, ?, ?)", [(x["path"], degree[x["path"]], x["betweenness"]) for x in between.collect()])
    want = dict(db.execute("SELECT path, round(0.5 * (weighted_degree / max(weighted_degree) OVER ()) + 0.5 * (betweenness / max(betweenness) OVER ()), 6) FROM f").fetchall())
    assert got == want
