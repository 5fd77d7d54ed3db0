from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewell.functions import text as tx
from tidewell.functions.html import main_text
from tidewell.functions.scalar import half_up
from tidewell.operators import classify as cf
from tidewell.operators import forecast as fc
from tidewell.operators import intel
from tidewell.operators.relational import average_rank, band_join, keyset_page
from tidewell.operators.search import Query, build_index, search, snippet

NOW = datetime(2024, 3, 1, 12)
FIELDS = "event_id string, topic string, source string, fetched_at timestamp_ntz, published_at timestamp_ntz, canonical_url string, score long, title string"


def row(i, topic, at, url=None, score=0, source="rss"):
    return (i, topic, source, at, at, url, score, f"title {i}")


@pytest.fixture(scope="module")
def seed(spark):
    rows = [row(f"recent-{i}", "ai.models", NOW - timedelta(minutes=i), f"u{i}", i) for i in range(10)]
    rows += [row(f"old-{i}", "ai.models", NOW - timedelta(minutes=90 + i), f"o{i}") for i in range(3)]
    rows += [row("hn:123", "ai.agents", NOW - timedelta(minutes=5), "same", 50), row("rss:shared", "ai.agents", NOW - timedelta(minutes=5), "same")]
    return spark.createDataFrame(rows, FIELDS)


def test_trends_golden(seed):
    got = {r["topic"]: r for r in intel.trends(seed, NOW, timedelta(hours=1)).collect()}
    assert (got["ai.models"]["volume"], got["ai.models"]["prev_volume"], got["ai.models"]["acceleration"], got["ai.models"]["score"]) == (10, 3, 2.33, 10.0)
    assert (got["ai.agents"]["volume"], got["ai.agents"]["acceleration"], got["ai.agents"]["score"]) == (1, 1.0, 0.0)
    assert {r["topic"]: r["volume"] for r in intel.trends(seed, NOW, timedelta(hours=1), dedup=False).collect()}["ai.agents"] == 2


def test_trend_events_and_empty(seed, spark):
    found = intel.trends(seed, NOW, timedelta(hours=1))
    best = intel.trend_events(seed, found, NOW, timedelta(hours=1), 3).where("topic = 'ai.models'").orderBy("rn").collect()
    assert [r["score"] for r in best] == [9, 8, 7]
    assert intel.trends(spark.createDataFrame([], FIELDS), NOW, timedelta(hours=1)).count() == 0


def test_keyset_pages_cover_everything(seed):
    df = seed.select("fetched_at", "event_id")
    seen, after = [], None
    while True:
        page = keyset_page(df, "fetched_at", "event_id", after, 4).collect()
        if not page:
            break
        seen += [r["event_id"] for r in page]
        after = tuple(page[-1])
    assert sorted(seen) == sorted(r["event_id"] for r in df.collect()) and len(seen) == len(set(seen))


def test_source_status(spark):
    ev = spark.createDataFrame([row("1", "a.b", NOW, source="s0"), row("2", "a.b", NOW - timedelta(days=3), source="s1")], FIELDS)
    health = spark.createDataFrame([("s0", NOW, None), ("s1", NOW - timedelta(hours=1), None), ("s2", None, None), ("s3", NOW, "boom")], "source string, last_success_at timestamp_ntz, last_error string")
    got = {r["source"]: (r["status"], r["events_24h"], r["events_total"]) for r in intel.sources(ev, health, NOW).collect()}
    assert got == {"s0": ("healthy", 1, 1), "s1": ("stale", 0, 1), "s2": ("stale", 0, 0), "s3": ("error", 0, 0)}


def test_review_warning(spark):
    old = spark.createDataFrame([("last_topic_review", "2023-01-01")], "key string, value string")
    assert intel.review_warning(old, NOW).first()["overdue"]
    assert intel.review_warning(old.where("false"), NOW).first()["overdue"]
    fresh = spark.createDataFrame([("last_topic_review", "2024-02-20")], "key string, value string")
    assert intel.review_warning(fresh, NOW).first()["overdue"] is False


@pytest.fixture(scope="module")
def chained(spark):
    rows, n = [], 0
    for d in (20, 15, 10):
        for k in range(4):
            rows.append(row(f"a{(n := n + 1)}", "ai.models", NOW - timedelta(days=d, hours=k)))
        for k in range(3):
            rows.append(row(f"b{(n := n + 1)}", "ai.agents", NOW - timedelta(days=d - 2, hours=k)))
    for d in (25, 20, 15, 10):
        for k in range(3):
            rows.append(row(f"c{(n := n + 1)}", "compute.serverless", NOW - timedelta(days=d, hours=k), source=("rss", "hackernews")[k % 2]))
            rows.append(row(f"d{(n := n + 1)}", "compute.containers", NOW - timedelta(days=d - 1, hours=k), source=("rss", "hackernews")[k % 2]))
    rows += [row(f"e{k}", "ai.models", NOW - timedelta(hours=k), score=10 + k) for k in range(5)]
    return spark.createDataFrame(rows, FIELDS)


def test_chain_invariants(chained):
    daily, vols = fc.daily_volume(chained, NOW).cache(), fc.lifecycle_volumes(chained, NOW).cache()
    found = fc.chains(daily, chained, vols, NOW).cache()
    got = {(r["from_topic"], r["to_topic"]): r for r in found.collect()}
    one = got["ai.models", "ai.agents"]
    assert one["support"] >= 3 and one["active"]
    for (a, b), r in got.items():
        assert r["decay_weighted_support"] <= r["support"] and 0 <= r["confidence"] <= 1
        if (b, a) in got:
            assert abs(r["directionality"] + got[b, a]["directionality"] - 1) <= 0.011
        else:
            assert r["directionality"] == 1.0
    assert all(r["a"] != r["c"] for r in fc.transitive_chains(found).collect())
    ranked = fc.ranked_chains(found, vols)
    assert ranked.count() <= 50 and ranked.groupBy("from_topic").count().agg(F.max("count")).first()[0] <= 3
    assert all(0 <= r["normalized_entropy"] <= 1 for r in fc.entropy(daily).collect())
    post = fc.phase_posterior(vols)
    assert all(abs(sum(r[f"p_{p}"] for p in fc.EMISSIONS) - 1) < 0.01 for r in post.collect())
    counts = chained.groupBy("topic").agg((F.count("*") * 100).alias("events"))
    scen = fc.scenarios(fc.tiers(found, counts), fc.base_rates(daily), fc.cusum(daily, NOW), fc.entropy(daily)).collect()
    assert all(0 <= r["score"] <= 1 and r["from_days"] <= r["to_days"] for r in scen)


def test_forecast_of_nothing(spark):
    none = spark.createDataFrame([], FIELDS)
    daily, vols = fc.daily_volume(none, NOW), fc.lifecycle_volumes(none, NOW)
    assert fc.chains(daily, none, vols, NOW).count() == 0 and fc.cusum(daily, NOW).count() == 0 and fc.lifecycles(vols).count() == 0


def test_cusum_fold_matches_loop(spark):
    values = [3, 3, 4, 3, 3, 3, 20, 22, 21, 3, 3, 4]
    days = [datetime(2024, 1, 1) + timedelta(days=k) for k in range(len(values))]
    daily = spark.createDataFrame([("a.b", d.date(), v, 1) for d, v in zip(days, values, strict=True)], "topic string, day date, volume long, sources long")
    mu = sum(values) / len(values)
    sd = (sum((v - mu) ** 2 for v in values) / len(values)) ** 0.5
    up = dn = 0.0
    want = []
    for d, v in zip(days, values, strict=True):
        up, dn = max(0, up + v - mu - sd / 2), max(0, dn - (v - mu) - sd / 2)
        if up > 4 * sd or dn > 4 * sd:
            want.append(d.date())
            up = dn = 0.0
    assert [r["day"] for r in fc.cusum(daily, NOW).orderBy("day").collect()] == want


def test_brier_and_weights(spark):
    fields = "snapshot_id long, created_at timestamp_ntz, topic string, predicted_probability double, from_days double, to_days double, base_rate double"
    then = NOW - timedelta(days=20)
    saved = spark.createDataFrame([(k, then, t, 0.9, 1.0, 3.0, 0.3) for k in range(5) for t in ("a.hit", "a.miss")], fields)
    te = spark.createDataFrame([row(f"x{k}", "a.hit", then + timedelta(days=2, minutes=k)) for k in range(3)], FIELDS)
    got = fc.evaluate(saved, te, NOW)
    by = {r["topic"]: r for r in got.collect()}
    assert (by["a.hit"]["outcome"], by["a.hit"]["brier_score"], by["a.miss"]["brier_score"], by["a.hit"]["brier_ref"]) == (1, 0.01, 0.81, 0.21)
    w = {r["topic"]: r["weight"] for r in fc.learned_weights(got).collect()}
    assert w["a.miss"] == 0.5 and w["a.hit"] == round(0.5 + 0.5 * (1 - 0.01 / 0.21), 3)
    assert fc.learned_weights(got.where("snapshot_id < 4")).count() == 0


def test_scalars(spark):
    got = spark.createDataFrame([(-2.5,), (2.5,), (0.125,)], "x double").select(half_up(F.col("x"), 0).alias("a"), half_up(F.col("x"), 2).alias("b")).collect()
    assert [tuple(r) for r in got] == [(-2.0, -2.5), (3.0, 2.5), (0.0, 0.13)]
    ranks = average_rank(spark.createDataFrame([(1,), (2,), (2,), (4,)], "v int"), "v", "r").orderBy("v").collect()
    assert [r["r"] for r in ranks] == [0.25, 0.625, 0.625, 1.0]


def test_band_join_equals_nested_loop(spark):
    from datetime import date

    days = spark.createDataFrame([(t, date(2024, 1, d)) for t, d in [("a", 1), ("b", 2), ("b", 9), ("a", 8), ("c", 20)]], "topic string, day date")
    got = band_join(days, days, "day", 7, F.col("a.topic") != F.col("b.topic")).count()
    plain = days.alias("a").crossJoin(days.alias("b")).where("a.topic <> b.topic and b.day > a.day and datediff(b.day, a.day) <= 7").count()
    assert got == plain
    assert "CartesianProduct" not in band_join(days, days, "day", 7, F.col("a.topic") != F.col("b.topic"))._jdf.queryExecution().executedPlan().toString()


def test_sanitized(spark):
    rows = [("a\x00b​c", None), ("a\r\nb", None), ("<b>", None), ("x" * 600, None), ("[inst] hi", None), ("human: x", None), ("Human: x", None), (None, None)]
    text, flags = tx.sanitized(F.col("t"))
    got = spark.createDataFrame(rows, "t string, u string").select(text.alias("s"), flags.alias("f")).collect()
    assert [r["s"] for r in got[:3]] == ["abc", "a b", "&lt;b&gt;"]
    assert len(got[3]["s"]) == 500 and got[3]["s"].endswith("...") and got[3]["f"] == ["truncated"]
    assert [r["f"] for r in got[4:]] == [["injection_markers"], [], ["injection_markers"], []] and got[7]["s"] == ""


def test_canonical_urls(spark):
    cases = {
        "HTTPS://Ex.COM/a/?b=2&utm_source=x&a=1#top": "https://ex.com/a/?a=1&b=2", "http://ex.com": "http://ex.com/", "http://ex.com/a/": "http://ex.com/a", "https://ex.com:443/?REF=1": "https://ex.com/", "no address": None, None: None,
    }
    got = spark.createDataFrame([(u,) for u in cases], "u string").select("u", tx.canonical_url(F.col("u")).alias("c")).collect()
    assert {r["u"]: r["c"] for r in got} == cases


def test_search(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Building RAG Applications with Amazon Bedrock", "Vectors and retrieval."), (2, "AWS Lambda Cold Start Optimization", "Faster starts."), (3, "CVE-2026-12345 Critical Vulnerability Found", "Patch now, critical.")], "doc_id long, title string, content string")
    index = build_index(docs, ["title", "content"], f"file://{tmp_path}/ix").cache()
    find = lambda q, **k: [r["doc_id"] for r in search(index, q, **k).collect()]
    assert find("cve-2026-12345") == [3] and find("cold start") == [2] and find("start cold") == [2] and find('"cold start"') == [2] and find('"start cold"') == []
    assert find("bedrock OR lambda") and set(find("bedrock OR lambda")) == {1, 2} and find("critical NOT patch") == [] and find("optim*") == [2] and find("(rag OR aws) cold") == [2]
    for bad in ("", "NOT", "(a", "OR a"):
        with pytest.raises(ValueError):
            Query(bad)
    marked = docs.where("doc_id = 2").select(snippet(F.col("title"), ["cold"], 3).alias("s")).first()["s"]
    assert "[Cold]" in marked and marked.endswith("...")


def test_classify_stops_at_first_failure(spark):
    scores = spark.createDataFrame([(1, "a", 30.0, 0.9), (1, "b", 13.0, 0.5), (1, "c", 12.0, 0.4), (2, "a", 9.9, 0.2)], "doc long, topic string, score double, confidence double")
    assert [(r["doc"], r["topic"]) for r in cf.classify(scores).collect()] == [(1, "a")]


def test_evaluation(spark):
    rows = [(["a"], ["a"])] * 20 + [(["a"], ["b"])] * 10
    reviewed = spark.createDataFrame(rows, "machine array<string>, human array<string>")
    got = {r["topic"]: r for r in cf.evaluate(reviewed, least=10).collect()}
    assert (got["a"]["precision"], got["a"]["recall"], got["b"]["recall"]) == (0.667, 1.0, 0.0)
    assert cf.label_losses(reviewed, 4).first()["hamming_loss"] == round(20 / (30 * 4), 6)


def test_training_sample_is_stable(spark):
    ev = spark.range(1000).select(F.col("id").cast("string").alias("event_id"))
    a, b = (cf.training_sample(ev.repartition(n), 100).orderBy("event_id").collect() for n in (2, 5))
    assert a == b and len(a) == 100


def test_main_text():
    body = "<nav><a href='x'>menu menu</a></nav><script>var x = '<p>';</script><p>" + "Words &amp; more. " * 20 + "</p><div><a href='y'>" + "link " * 30 + "</a></div>"
    text, flags = main_text(f"<html><head><title>t</title></head><body>{body}</body></html>")
    assert text.startswith("Words & more.") and "menu" not in text and "link" not in text and flags == ["extracted"]
    assert main_text("<p>short</p>") == (None, []) and main_text(None) == (None, ["fetch_failed"])


def test_upsert_folds_arrivals_and_merge_keeps_creation(spark):
    import random
    from datetime import datetime, timedelta

    from tidewell.streaming import ingest

    schema = "event_id string, content string, canonical_url string, content_flags string, score long, comments long, fetched_at timestamp"
    rng, t0 = random.Random(1), datetime(2024, 1, 1)
    rows = [(f"e{rng.randrange(12)}", rng.choice([None, "c"]) and f"c{k}", rng.choice([None, "u"]) and f"u{k}", rng.choice([None, None, "f"]) and f"f{k}", rng.randrange(5), rng.randrange(3), t0 + timedelta(minutes=k)) for k in range(90)]
    want = {}
    for e, c, u, f, s, n, at in rows:
        x = want.setdefault(e, dict(content=c, canonical_url=u, content_flags=f, score=s, comments=n, created_at=at, fetched_at=at))
        if (x["content"] is None and c) or (x["canonical_url"] is None and u) or (x["content_flags"] is None and f) or s > x["score"] or n > x["comments"]:
            x.update(content=x["content"] or c, canonical_url=x["canonical_url"] or u, content_flags=x["content_flags"] or f, score=max(s, x["score"]), comments=max(n, x["comments"]), fetched_at=at)
    plain = lambda df: {r["event_id"]: {k: v for k, v in r.asDict().items() if k != "event_id"} for r in df.collect()}
    assert plain(ingest.upsert(spark.createDataFrame(rows, schema))) == want
    state = ingest.upsert(spark.createDataFrame(rows[:40], schema))
    assert plain(ingest.merge(state, spark.createDataFrame(rows[40:], schema))) == want


def test_cursors_round_trip_and_refuse_others(spark):
    from tidewell.functions import cursor
    from tidewell.operators.relational import with_next

    keys = {"fts_rank": -1.5, "event_id": "é/1"}
    text = cursor.encode("search", keys)
    assert cursor.decode(text, "search") == keys and not set(text) & set("+/=")
    for bad, command in ((text, "events"), ("%%%", "search"), ("W10", "search"), (cursor.encode("search", {})[:-4], "search")):
        with pytest.raises(cursor.InvalidCursor):
            cursor.decode(bad, command)
    df = spark.range(5)
    rows, after = with_next(df, [F.col("id")], 2, "list", ["id"])
    assert [r["id"] for r in rows] == [0, 1] and cursor.decode(after, "list") == {"id": 1}
    assert with_next(df, [F.col("id")], 5, "list", ["id"])[1] is None


def test_search_within_a_column(spark, tmp_path):
    from tidewell.operators.search import build_index, search

    docs = spark.createDataFrame([(1, "foo story", "plain"), (2, "a", "title foo said so"), (3, "bar", "foo")], "doc_id long, title string, content string")
    index = build_index(docs, ["title", "content"], f"file://{tmp_path}/ix")
    ids = lambda q, **k: sorted(r["doc_id"] for r in search(index, q, columns=["title", "content"], **k).collect())
    assert ids("title:foo") == [1] and ids("content : foo") == [2, 3] and ids('content:"title foo"') == [2] and ids("foo NOT title:bar") == [1, 2]
    assert ids("foo", among=docs.where("doc_id > 1")) == [2, 3]
    with pytest.raises(ValueError):
        search(index, "body:foo", columns=["title"])


def test_audit_flags_of_made_up_topics(spark):
    volume = spark.createDataFrame([("a.x", 1, 1, 1), ("a.y", 50, 50, 50), ("b.z", 9, 9, 9)], "topic string, recent long, mid long, old long")
    overlaps = spark.createDataFrame([("a.x", "a.y", 0.6), ("b.z", "a.y", 0.2)], "topic string, other string, overlap double")
    weights, chains = spark.createDataFrame([("a.y", 0.5)], "topic string, weight double"), spark.createDataFrame([("a.x", 2)], "topic string, cross_domain long")
    got = {(r["topic"], r["flag"]) for r in intel.audit_flags(volume, overlaps, weights, chains).collect()}
    assert got == {
        ("a.x", "below_minimum_volume"), ("a.x", "domain_imbalance"), ("a.x", "high_overlap:a.y"), ("a.y", "low_learning_weight"), ("a.y", "no_cross_domain_chains"), ("a.y", "domain_imbalance"),
        ("b.z", "no_cross_domain_chains"), ("b.z", "domain_imbalance"),
    }
    small = intel.health_warnings(spark.createDataFrame([(0.6, 0.1, 0.2)], "unclassified_share double, top_source_share double, multi_topic_share double"), spark.createDataFrame([(20,)], "days long"))
    assert {(r["type"], r["severity"], r["value"]) for r in small.collect()} == {("unclassified", "critical", 0.6), ("over_classification", "warning", 0.2), ("data_age", "critical", 20.0)}
