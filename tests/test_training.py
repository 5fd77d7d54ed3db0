"""Training of all topics, their model table, and how models are used."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewell.functions import text as tx
from tidewell.operators import classify as cf
from tidewell.operators import training

TOPICS = [
    {"id": "t.fruit", "keywords": ["apple pear", "plum"], "negative_keywords": ["car"]},
    {"id": "t.metal", "keywords": ["iron", "zinc"], "context_required": True, "context_terms": ["ore"]},
    {"id": "t.rare", "keywords": ["quark"], "priority": 500},
]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for k in range(120):
        kind = rng.choice(["t.fruit", "t.metal", None])
        words = {"t.fruit": ["apple", "pear", "plum", "ripe"], "t.metal": ["iron", "zinc", "ore", "smelt"], None: ["sky", "sea", "stone"]}[kind]
        rows.append((k, rng.choice(words), " ".join(rng.choice(words + ["common", "word"]) for _ in range(12))))
        labels.append((k, kind))
    return spark.createDataFrame(rows, "doc_id long, title string, content string"), spark.createDataFrame([*labels, (5, "t.rare")], "doc long, label string")


def plain_descent(rows, labels, terms):
    """The same rule of updates, written out."""
    w, bias, rate, n, pos = [0.0] * terms, 0.0, 0.5, len(rows), sum(labels)
    draw = np.random.Generator(np.random.PCG64(123))
    for _ in range(30):
        for k in draw.permutation(n):
            z = bias + sum(w[i] * v for i, v in rows[k])
            step = (1 / (1 + np.exp(-z)) - labels[k]) * (n / (2 * pos) if labels[k] else n / (2 * (n - pos)))
            for i, v in rows[k]:
                w[i] -= rate * (step * v + 0.001 * w[i])
            bias -= rate * step
        rate *= 0.95
    return w, bias


def test_topics_are_trained_alike_on_any_partitioning(spark):
    rng = random.Random(1)
    docs = {d: sorted(rng.sample(range(6), rng.randrange(0, 4))) for d in range(25)}
    rows = [(d, f"w{i}", round(rng.random(), 3)) for d, at in docs.items() for i in at]
    labels = [(d, "a" if 0 in at else None) for d, at in docs.items()] + [(3, "b"), (4, "b")]
    vectors, given = spark.createDataFrame(rows, "doc long, term string, weight double"), spark.createDataFrame(labels, "doc long, label string")
    terms = spark.createDataFrame([(f"w{i}",) for i in range(6)], "term string")
    run = lambda n: tuple(sorted(tuple(r) for r in x.collect()) for x in training.train_topics(vectors.repartition(n), given.repartition(n), ["a", "b", "none"], terms))
    once = run(1)
    assert once == run(7)
    by_doc = {d: [(int(t[1:]), v) for e, t, v in rows if e == d] for d in docs}
    for topic, have in (("a", {d for d, at in docs.items() if 0 in at}), ("b", {3, 4})):
        w, bias = plain_descent([by_doc[d] for d in sorted(docs)], [int(d in have) for d in sorted(docs)], 6)
        assert {t: x for p, t, x in once[0] if p == topic} == pytest.approx({f"w{i}": x for i, x in enumerate(w) if x}, abs=1e-9)
        assert dict(once[1])[topic] == pytest.approx(bias, abs=1e-9)
    assert dict(once[1])["none"] == 0.0 and not [r for r in once[0] if r[0] == "none"]  # no example of it


def test_a_classifier_of_all_topics(spark, corpus):
    docs, labels = corpus
    keywords = cf.keyword_table(spark, TOPICS)
    model = training.train_classifier(docs, labels, keywords, least_labelled=100, least_positive=10)
    table = {r["topic"]: r for r in model.table.collect()}
    assert {t: r["method"] for t, r in table.items()} == {"t.fruit": "logistic", "t.metal": "logistic", "t.rare": "bm25_fallback"}
    assert table["t.rare"]["bias"] is None and all(table[t]["val_f1"] >= 0.95 and 0.05 <= table[t]["blend_alpha"] <= 0.5 for t in ("t.fruit", "t.metal"))
    (whole,) = training.overall(model.table).collect()
    assert whole["precision"] == pytest.approx((table["t.fruit"]["val_precision"] + table["t.metal"]["val_precision"]) / 2, abs=6e-4)
    new = spark.createDataFrame([(1, "ripe apple", "pear plum"), (2, "ripe apple", "pear plum car"), (3, "zinc", "iron smelt"), (4, "zinc", "iron ore"), (5, "", ""), (6, "quark", "quark quark")], "doc_id long, title string, content string")
    found = {(r["doc"], r["topic"]): r["path"] for r in training.classify_by(model, new, keywords, 96).collect()}
    assert found[(1, "t.fruit")] == "model" and found[(4, "t.metal")] == "model" and found[(6, "t.rare")] == "keywords"
    assert (2, "t.fruit") not in found and (3, "t.metal") not in found  # guards hold on the model's path too
    with pytest.raises(training.Refused):
        training.train_classifier(docs, labels, keywords)


def test_documents_without_known_terms_have_the_bias(spark):
    docs = spark.createDataFrame([(1,), (2,)], "doc long")
    vectors, weights = spark.createDataFrame([(1, "w", 1.0)], "doc long, term string, weight double"), spark.createDataFrame([("t", "w", -2.0)], "topic string, term string, w double")
    got = training.logits(docs, vectors, weights, spark.createDataFrame([("t", 0.9, 0.5)], "topic string, bias double, threshold double")).collect()
    assert sorted((r["doc"], r["logit"]) for r in got) == [(1, -1.1), (2, 0.9)]


def test_figures_on_held_out_documents(spark):
    scores = spark.createDataFrame([(d, "t", s) for d, s in enumerate([3.0, 2.0, 1.0, 0.5, -1.0])] + [(d, "u", -1.0) for d in range(5)], "doc long, topic string, logit double")
    labels = spark.createDataFrame([(0, "t"), (1, "t"), (3, "t"), (4, None)], "doc long, label string")
    words = spark.createDataFrame([(0, "t", 11.0), (2, "t", 12.0), (1, "t", 9.0)], "doc long, topic string, score double")
    got = {r["topic"]: tuple(r)[1:] for r in training.validated(scores, labels, words).collect()}
    assert got["t"] == (0.5, 0.75, 1.0, 0.857, 0.4, 0.5) and got["u"] == (0.0, 0.0, 0.0, 0.0, 0.0, 0.05)


def test_topic_weights_move_scores_but_not_matches(spark):
    scores = spark.createDataFrame([(1, "a", 12.0, 0.5, True), (1, "b", 11.0, 0.4, True), (1, "c", 9.0, 0.3, False)], "doc long, topic string, score double, confidence double, matched boolean")
    weights = spark.createDataFrame([("b", 2.0), ("c", 5.0), ("x", 3.0)], "topic string, weight double")
    got = cf.classify(scores, weights=weights).orderBy("rn").collect()
    assert [(r["topic"], r["score"], r["confidence"]) for r in got] == [("b", 22.0, 0.8)]  # the second needs 14
    assert [r["topic"] for r in cf.classify(scores).orderBy("rn").collect()] == ["a"]


def test_stopwords_are_looked_up_in_a_set(spark):
    """every token was compared with all stopwords, one after another."""
    rows = spark.createDataFrame([("The cat, and THE dog's 2 its",), ("",), (None,), ("of",)], "t string").select(tx.tokens(F.col("t")).alias("ts"))
    assert [r["ts"] for r in rows.collect()] == [["cat", "dog", "s", "2"], [], None, []]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "INSET" in plan and "array_contains" not in plan


def test_every_labelled_document_is_trained_on(spark):
    """of more than 50,000 documents those with the smallest hashes of their ids were taken."""
    labels = spark.range(50_020).select(F.col("id").alias("doc"), F.lit(None).cast("string").alias("label"))
    last = [r["doc"] for r in labels.orderBy(F.desc(F.xxhash64(F.lit(training.SEED), "doc"))).limit(20).collect()]
    labels = labels.withColumn("label", F.when(F.col("doc").isin(last), "t"))
    vectors = labels.select("doc", F.when(F.col("label") == "t", "yes").otherwise("no").alias("term"), F.lit(1.0).alias("weight"))
    weights, biases = training.train_topics(vectors, labels, ["t"], spark.createDataFrame([("yes",), ("no",)], "term string"), epochs=1)
    found = {r["term"]: r["w"] for r in weights.collect()}
    assert found["yes"] > 0.1 > found["no"] and [r["bias"] != 0 for r in biases.collect()] == [True], found


def test_rows_of_training_lie_in_a_file():
    """a task held all of its rows, as Python's lists."""
    held = training.Spooled()
    for k in range(3):
        held.add(pa.record_batch({"i": [[], [k, 5], [7]], "v": [[], [0.5, 1.5], [k + 0.25]], "label": [0, 1, 0]}).slice(k % 2))
    row, label = held.rows()
    assert [(row(k)[0].tolist(), row(k)[1].tolist()) for k in range(len(label))] == [([], []), ([0, 5], [0.5, 1.5]), ([7], [0.25]), ([1, 5], [0.5, 1.5]), ([7], [1.25]), ([], []), ([2, 5], [0.5, 1.5]), ([7], [2.25])]
    assert label.tolist() == [0, 1, 0, 1, 0, 0, 1, 0]
