"""Clusters' names, the assembled forecast, the classifier's life, manifests and small readers."""

import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewell.functions import jsons, spans
from tidewell.operators import briefing, outlook, profiles, training
from tidewell.operators import forecast as fc
from tidewell.sources import manifest

AT = datetime(2024, 3, 1, 12)


def labels_of(spark, paths, weight=None):
    rows = spark.createDataFrame([(1, p, float(w)) for p, w in paths], "cluster_id int, path string, risk double")
    return profiles.cluster_labels(rows, weight).first()["label"]


def test_labels_small_cluster(spark):
    assert labels_of(spark, [("src/orders/api/orders.service.ts", 1), ("src/orders/api/orders-events.ts", 1), ("src/orders/api/index.ts", 1)]) == "orders (orders/api/index.ts + orders/api/orders-events.ts)"[:47] + "..."
    assert labels_of(spark, [("a/b/pay.py", 1), ("a/b/bill.py", 1), ("a/b/ship.py", 1), ("a/b/index.py", 1)]) == "bill/pay (a/b)"
    assert labels_of(spark, [("a/b/index.py", 1), ("a/b/main.py", 1)]) == "a/b"
    assert labels_of(spark, [("src", 1)]) == ""


def test_labels_large_cluster_takes_its_riskiest_file(spark):
    paths = [(f"a/b/f{i}.py", 0.02) for i in range(120)] + [("a/b/ledger.py", 0.95)]
    assert labels_of(spark, paths, "risk") == "ledger (a/b)"
    assert labels_of(spark, paths) == "a/b"  # every stem is one of 121


def test_path_domain(spark):
    given = {"src/a/b/c/d/e.ts": "src/a/b/c", "lib/a/b/c/e.ts": "lib/a/b", "bare.ts": "bare.ts", "x/y.ts": "x"}
    rows = spark.createDataFrame([(k,) for k in given], "p string").select("p", profiles.path_domain(F.col("p")).alias("d")).collect()
    assert {r["p"]: r["d"] for r in rows} == given


def test_top_active_counts_the_last_window_only(spark):
    day = 86400
    commits = spark.createDataFrame([("s1", "a", 100 * day), ("s2", "a", 99 * day), ("s3", "b", 100 * day), ("s4", "b", 10 * day), ("s5", "c", 80 * day)], "commit_sha string, path string, commit_ts long")
    clusters = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "path string, cluster_id int")
    assert [tuple(r) for r in profiles.top_active(commits, clusters, n=2).collect()] == [(1, 2), (2, 1)]


def sections(spark, scenarios):
    table = lambda rows, schema: spark.createDataFrame(rows, schema)
    up = F.asc
    return {
        "lifecycles": outlook.Section(table([(f"t{i:02}",) for i in range(30)], "topic string"), (up("topic"),), ("topic",)),
        "ranked_chains": outlook.Section(table([(f"t{i:02}", "t00") for i in range(1, 20)], "from_topic string, to_topic string"), (up("from_topic"),), ("from_topic", "to_topic")),
        "scenarios": outlook.Section(table([(f"t{i:02}",) for i in range(scenarios)], "topic string"), (up("topic"),), ("topic",)),
        "dynamics": outlook.Section(table([(k, f"t{i:02}", None) for k in ("delay", "dampening") for i in range(7)], "type string, topic string, other string"), (up("topic"),), ("topic", "other"), "type"),
        "change_points_summary": outlook.Section(table([(f"t{i:02}",) for i in range(25)], "topic string"), (up("topic"),), ("topic",)),
    }


def counts(chosen):
    return {k: s.rows.count() for k, s in chosen.items()}


def test_outlook_modes(spark):
    many = sections(spark, 6)
    assert counts(outlook.outlook(many)) == {"lifecycles": 30, "ranked_chains": 19, "scenarios": 6, "dynamics": 14, "change_points_summary": 25}
    assert counts(outlook.outlook(many, "compact")) == {"lifecycles": 15, "ranked_chains": 10, "scenarios": 6, "dynamics": 10, "change_points_summary": 25}
    assert counts(outlook.outlook(many, "summary")) == {"ranked_chains": 5, "scenarios": 3, "dynamics": 2, "change_points_summary": 25}
    assert counts(outlook.outlook(sections(spark, 2), "summary")) == {"lifecycles": 15, "ranked_chains": 10, "scenarios": 2, "dynamics": 10, "change_points_summary": 25}


def test_outlook_keeps_the_quality_of_the_data_and_warns(spark):
    row = lambda n: outlook.Section(spark.createDataFrame([(n, 12.5)], "events_analyzed long, unclassified_pct double"), (), ())
    every = sections(spark, 6) | {"data_quality": row(9)}
    for chosen in (outlook.outlook(every, "summary"), outlook.outlook(every, topics=["t00"], only=["scenarios"])):
        assert [tuple(r) for r in chosen["data_quality"].rows.collect()] == [(9, 12.5)] and "scenarios" in chosen
    assert "data_quality" not in {r["section"] for r in outlook.listed({k: s for k, s in every.items() if k in ("scenarios", "data_quality")}).collect()}
    assert outlook.warnings(every, 30, 90) == [] and len(outlook.warnings({"data_quality": row(0)}, 30, 9)) == 2 and outlook.warnings({}, 30, 30) == []


def test_outlook_topics_and_sections(spark):
    every = sections(spark, 6)
    assert counts(outlook.outlook(every, topics=["t00", "t03"])) == {"lifecycles": 2, "ranked_chains": 19, "scenarios": 2, "dynamics": 4, "change_points_summary": 2}
    assert list(outlook.outlook(every, only=["scenarios"])) == ["scenarios"]
    with pytest.raises(ValueError, match="nothing"):
        outlook.outlook(every, only=["nothing"])


def test_evidence_relevance_falls_with_topics(spark):
    rows = [("a", "e1", 9)] + [(t, "e2", 5) for t in "abc"] + [(t, "e3", 1) for t in "abcde"]
    te = spark.createDataFrame([(t, e, AT, AT, s, f"title {e}") for t, e, s in rows], "topic string, event_id string, published_at timestamp_ntz, fetched_at timestamp_ntz, score long, title string")
    got = outlook.evidence(te, spark.createDataFrame([("a",)], "topic string"), F.lit(AT - timedelta(days=1)).cast("timestamp_ntz"), 3).orderBy("rn").collect()
    assert [(r["title"], r["topic_count"], r["relevance"]) for r in got] == [("title e1", 1, "high"), ("title e2", 3, "high"), ("title e3", 5, "medium")]


def test_dampening_has_fading_topics_with_a_recent_break(spark):
    life = spark.createDataFrame([("a", "decaying"), ("b", "decaying"), ("c", "stable")], "topic string, phase string")
    changes = spark.createDataFrame([("a", 9), ("a", 3), ("b", 20), ("c", 1)], "topic string, days_ago long")
    assert [tuple(r) for r in fc.dampening(life, changes).collect()] == [("a", 3)]


def training_events(spark):
    rows = [(1, "e1", "x", ["a"], None, None, AT), (2, "e2", "y", None, None, None, None), (3, "e3", "z", None, None, None, None)]
    return spark.createDataFrame(rows, "id long, event_id string, title string, human_topics array<string>, labeler string, notes string, reviewed_at timestamp_ntz")


def test_review(spark):
    events = training_events(spark)
    assert [r["event_id"] for r in training.next_unreviewed(events, 5).collect()] == ["e2", "e3"]
    later = AT + timedelta(days=1)
    labels = spark.createDataFrame([("e2", ["b", "a"], "me", None, AT), ("e2", ["b"], None, "n", later), ("e9", ["a"], "me", None, AT)], "event_id string, human_topics array<string>, labeler string, notes string, at timestamp_ntz")
    after = training.labelled(events, labels)
    row = after.where("event_id = 'e2'").first()
    assert (row["human_topics"], row["labeler"], row["notes"], row["reviewed_at"]) == (["b"], "unspecified", "n", later)
    assert after.count() == 3 and after.where("event_id = 'e1'").first()["human_topics"] == ["a"]
    assert tuple(training.progress(after).first()) == (3, 2, 1, 0.667)
    assert {r["topic"]: r["count"] for r in training.coverage(after).collect()} == {"a": 1, "b": 1}
    assert training.exported(after, later).count() == 1
    with pytest.raises(training.Refused):
        training.labelled(events, labels.withColumn("human_topics", F.array(*[F.lit(c) for c in "abcdef"])))
    assert tuple(training.progress(events.limit(0)).first()) == (0, 0, 0, 0.0)


def test_rare_first_split(spark):
    rows = [(i, "common") for i in range(300)] + [(i, "rare") for i in range(0, 300, 20)]
    split = training.rare_first_split(spark.createDataFrame(rows, "doc long, label string")).collect()
    assert len(split) == 300
    held = {r["doc"] for r in split if r["held_out"]}
    assert len([i for i in held if i % 20 == 0]) == 3 and len(held) == 3 + 57  # a fifth of 15 and of 285


def test_platt_is_the_best_sigmoid(spark):
    r = random.Random(5)
    pairs = [(s, int(r.random() < 1 / (1 + math.exp(-1.7 * s + 0.4)))) for s in (r.uniform(-3, 3) for _ in range(400))]
    a, b = training.platt(spark.createDataFrame(pairs, "score double, label int"))
    pos = sum(y for _, y in pairs)
    hi, lo = (pos + 1) / (pos + 2), 1 / (len(pairs) - pos + 2)

    def loss(a, b):
        return sum((t * x if x >= 0 else (t - 1) * x) + math.log1p(math.exp(-abs(x))) for s, y in pairs for t, x in [(hi if y else lo, a * s + b)])

    assert a < 0 and all(loss(a, b) <= loss(a + da, b + db) for da in (-1e-3, 0, 1e-3) for db in (-1e-3, 0, 1e-3))
    assert training.platt(spark.createDataFrame([], "score double, label int")) == (0.0, 0.0)
    one = spark.range(1).select(training.calibrated(F.lit(2.0), -1.0, 0.5).alias("p")).first()["p"]
    assert abs(one - 1 / (1 + math.exp(-1.5))) < 1e-12


def test_plan_training(spark):
    labels = spark.createDataFrame([(i, "a") for i in range(30)] + [(i, "b") for i in range(5)], "doc long, label string")
    got = {r["topic"]: r["method"] for r in training.plan_training(labels, least_labelled=30).collect()}
    assert got == {"a": "model", "b": "bm25_fallback"}
    with pytest.raises(training.Refused):
        training.plan_training(labels)
    alpha = spark.createDataFrame([(0.9, 0.1), (0.0, 0.9), (0.4, 0.6)], "f double, k double").select(training.blend_alpha(F.col("f"), F.col("k")).alias("x")).collect()
    assert [r["x"] for r in alpha] == [0.5, 0.05, 0.396]


def test_with_model_prefers_models_and_guards(spark):
    scores = spark.createDataFrame([(1, "a", 2.0, 0.5), (1, "b", 0.1, 0.5)], "doc long, topic string, logit double, threshold double")
    words = spark.createDataFrame([(1, "a", 30.0, 0.98), (1, "c", 12.0, 0.4), (1, "d", 9.0, 0.2)], "doc long, topic string, score double, confidence double")
    modelled = spark.createDataFrame([("a",), ("b",)], "topic string")
    assert [(r["topic"], r["path"]) for r in training.with_model(scores, words, modelled).orderBy("rn").collect()] == [("a", "model"), ("c", "keywords")]
    docs = spark.createDataFrame([(1, "good spam")], "doc_id long, text string")
    guard = spark.createDataFrame([("a", ["spam"], []), ("b", ["none"], ["good"])], "topic string, negative array<string>, context array<string>")
    assert [r["topic"] for r in training.guarded(scores, docs, F.col("text"), guard).collect()] == ["b"]


def test_reclassified_replaces_the_scope_only(spark):
    old = spark.createDataFrame([("e1", "a"), ("e1", "b"), ("e2", "a")], "event_id string, topic string")
    new = spark.createDataFrame([("e1", "c"), ("e3", "z")], "event_id string, topic string")
    got = training.reclassified(old, new, spark.createDataFrame([("e1",)], "event_id string")).collect()
    assert sorted(tuple(r) for r in got) == [("e1", "c"), ("e2", "a")]


def test_durations():
    assert [spans.parse_duration(x) for x in ("100ms", "30s", "1.5 h", " 7D ", "1w")] == [timedelta(milliseconds=100), timedelta(seconds=30), timedelta(hours=1.5), timedelta(days=7), timedelta(weeks=1)]
    for bad in ("", "h", "5", "5y", "-1h", "1h30m", "1.h"):
        with pytest.raises(ValueError):
            spans.parse_duration(bad)
    assert spans.iso(AT) == "2024-03-01T12:00:00.000Z" and spans.since(AT, "6h") == AT - timedelta(hours=6)


def test_json_readers(spark):
    rows = spark.createDataFrame([('["a","b"]',), ("{",), (None,), ('{"k":"v"}',)], "t string")
    got = rows.select(jsons.is_json(F.col("t")).alias("ok"), jsons.strings(F.col("t")).alias("xs"), jsons.object_or_null(F.col("t")).alias("m")).collect()
    assert [r["ok"] for r in got] == [True, False, False, True]
    assert got[0]["xs"] == ["a", "b"] and got[1]["xs"] == [] and got[2]["xs"] == [] and got[3]["xs"] == []
    assert got[3]["m"] == {"k": "v"} and got[2]["m"] is None


def test_manifest_fails_closed(spark, tmp_path):
    folder = str(tmp_path)
    assert manifest.issue(spark, folder) is None
    manifest.write(spark, folder, "complete", ["edges"], AT)
    assert manifest.issue(spark, folder) is None and manifest.read(spark, folder)["completed_stages"] == ["edges"]
    manifest.invalidate(spark, folder, "rebuild", AT)
    assert "rebuild" in manifest.issue(spark, folder) and "edges" in manifest.issue(spark, folder)
    with pytest.raises(manifest.Stale):
        manifest.require(spark, folder)
    for text in ("{", "[1]"):
        (tmp_path / manifest.NAME).write_text(text)
        for crc in tmp_path.glob(".*.crc"):
            crc.unlink()
        assert manifest.issue(spark, folder) is not None


def test_event_detail(spark):
    ev = spark.createDataFrame([("e1", "t", "x")], "event_id string, topic string, title string")
    et = spark.createDataFrame([("e1", "b"), ("e1", "a")], "event_id string, topic string")
    assert briefing.event(ev, et, "e1").first()["topics"] == ["a", "b"]
    assert briefing.event(ev, et, "e2").count() == 0
