"""The life of a topic classifier: review of labels, training per topic, calibration, use beside keyword scores."""

from __future__ import annotations

import math
import os
import tempfile
from array import array
from collections.abc import Callable, Iterator
from datetime import datetime
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewell.functions.scalar import half_up, moment, ratio
from tidewell.functions.text import tokens
from tidewell.operators import classify as cf
from tidewell.operators.relational import cut, top_n_per_group

#: Fixed values of training and review.
LEAST_LABELLED, LEAST_POSITIVE, SUFFICIENT, MOST_TOPICS, KEYWORD_MINIMUM = 500, 20, 30, 5, 10.0
RATE, DECAY, SHRINK, EPOCHS, SEED = 0.5, 0.95, 0.001, 30, 123


class Refused(ValueError):
    """A label or a training run that the rules don't allow."""


def next_unreviewed(events: DataFrame, limit: int = 1, key: str = "id", machine: bool = False) -> DataFrame:
    """The first events without a review, 1 to 100 of them; what the machine thought only on request."""
    rows = events.where("reviewed_at is null").orderBy(key).limit(max(1, min(limit, 100)))
    return rows if machine else rows.drop("machine_topics", "machine_confidences", "machine_scores")


def progress(events: DataFrame) -> DataFrame:
    """One row: how many events there are, how many were reviewed, and the share."""
    done = F.count("reviewed_at")
    return events.agg(F.count("*").alias("total"), done.alias("reviewed"), (F.count("*") - done).alias("remaining"), half_up(ratio(done, F.count("*")), 3).alias("pct_complete"))


def coverage(events: DataFrame) -> DataFrame:
    """(topic, count, sufficient) over the topics that people gave."""
    by = events.where("reviewed_at is not null").select(F.explode("human_topics").alias("topic")).groupBy("topic").agg(F.count("*").alias("count"))
    return by.withColumn("sufficient", F.col("count") >= SUFFICIENT)


def listed(events: DataFrame, reviewed: bool | None = None, topic: str | None = None, limit: int = 20, key: str = "id") -> DataFrame:
    """Events of a training set, with a review or without one, of a topic that people gave: 1 to 200 of them by key."""
    rows = events
    if reviewed is not None:
        rows = rows.where(F.col("reviewed_at").isNotNull() == reviewed)
    if topic is not None:
        rows = rows.where(F.coalesce(F.array_contains("human_topics", topic), F.lit(False)))
    return rows.orderBy(key).limit(max(1, min(limit, 200)))


def shown(events: DataFrame, labels: DataFrame, event_id: str) -> DataFrame:
    """One event with the history of its labels, newest first; no row if there is none of that id."""
    mine = labels.where(F.col("event_id") == event_id).groupBy("event_id").agg(F.sort_array(F.collect_list(F.struct("at", "human_topics", "labeler", "notes")), asc=False).alias("history"))
    return events.where(F.col("event_id") == event_id).join(mine, "event_id", "left")


def labelled(events: DataFrame, labels: DataFrame) -> DataFrame:
    """Events after ``labels`` (event_id, human_topics, labeler, notes, at). Of several labels of an event the newest counts.

    The labels themselves are the history: append them to it. Events without a new label stay as they are; labels
    of unknown events change nothing. A label of more than five topics is refused.
    """
    if labels.where(F.size("human_topics") > MOST_TOPICS).limit(1).count():
        raise Refused(f"at most {MOST_TOPICS} topics a label")
    new = labels.groupBy("event_id").agg(F.max_by(F.struct(F.col("human_topics").alias("topics"), F.coalesce("labeler", F.lit("unspecified")).alias("labeler"), "notes", "at"), F.struct("at", "human_topics")).alias("_new"))
    rows = events.join(new, "event_id", "left")
    given = F.col("_new").isNotNull()
    taken = {"human_topics": "topics", "labeler": "labeler", "notes": "notes", "reviewed_at": "at"}
    return rows.withColumns({c: F.when(given, F.col(f"_new.{f}")).otherwise(F.col(c)) for c, f in taken.items()}).drop("_new")


def rare_first_split(labels: DataFrame, share: float = 0.2, seed: int = 42) -> DataFrame:
    """(doc, held_out): each document belongs to its rarest label, and of each label's documents the share with the smallest hashes is held out.

    So a rare label has its share in both parts, and the whole has ``share`` within one document a label. Ties: label by
    name, document by id. Ranks are taken per label and hash bucket first, so no task sorts all documents of a label.
    """
    sizes = labels.groupBy("label").agg(F.count_distinct("doc").alias("size"))
    own = labels.join(F.broadcast(sizes), "label").groupBy("doc").agg(F.min_by("label", F.struct("size", "label")).alias("label"))  # labels are configured
    h = F.xxhash64(F.lit(seed), "doc")
    rows = own.withColumn("h", h).withColumn("bucket", F.shiftrightunsigned("h", 52).cast("int"))
    counts = rows.groupBy("label", "bucket").agg(F.count("*").alias("k"))
    w = Window.partitionBy("label").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # at most 4096 buckets a label
    below = counts.select("label", "bucket", F.coalesce(F.sum("k").over(w), F.lit(0)).alias("before"))
    target = counts.groupBy("label").agg(F.ceil(F.sum("k") * share).alias("target"))
    ranked = top_n_per_group(rows.select("doc", "label", "bucket", "h"), ["label", "bucket"], [F.asc("h"), F.asc("doc")], 2**31 - 1)
    return ranked.join(below, ["label", "bucket"]).join(target, "label").select("doc", (F.col("before") + F.col("rn") <= F.col("target")).alias("held_out"))


def logits(docs: DataFrame, vectors: DataFrame, weights: DataFrame, bias: DataFrame) -> DataFrame:
    """(doc, topic, logit, threshold) of every document (doc) and topic that has a model: ``vectors`` (doc, term, weight), ``weights`` (topic, term, w), ``bias`` (topic, bias, threshold).

    Both model tables are bounded by the vocabulary times the taxonomy. A document without any known term has the bias.
    """
    hits = vectors.join(F.broadcast(weights), "term").groupBy("doc", "topic").agg(F.sum(F.col("weight") * F.col("w")).alias("dot"))
    every = docs.select("doc").distinct().crossJoin(F.broadcast(bias))  # a row a topic of the taxonomy
    rows = every.join(hits, ["doc", "topic"], "left")
    return rows.select("doc", "topic", half_up(F.coalesce("dot", F.lit(0.0)) + F.col("bias"), 6).alias("logit"), "threshold")


def guarded(scores: DataFrame, docs: DataFrame, text: Column, words: DataFrame, key: str = "doc_id") -> DataFrame:
    """``scores`` without topics whose negative words occur or whose required context doesn't. ``words`` is (topic, negative, context)."""
    off = docs.select(F.col(key).alias("doc"), cf.suppressed(tokens(text), words).alias("_off"))
    return scores.join(off, "doc").where(~F.array_contains("_off", F.col("topic"))).select(*scores.columns)


def with_model(model_scores: DataFrame, keyword_scores: DataFrame, modelled: DataFrame, most: int = 5) -> DataFrame:
    """(doc, rn, topic, confidence, score, path): topics whose logit reaches their threshold, and of topics without a model those
    whose keyword score reaches ten, by confidence; ties by name. ``modelled`` is (topic) of all models."""
    sure = half_up(1 / (1 + F.exp(-F.col("logit"))), 3)
    a = model_scores.where(F.col("logit") >= F.col("threshold")).select("doc", "topic", sure.alias("confidence"), F.col("logit").alias("score"), F.lit("model").alias("path"))
    b = keyword_scores.where(F.col("score") >= KEYWORD_MINIMUM).join(F.broadcast(modelled.select("topic")), "topic", "left_anti")
    both = a.unionByName(b.select("doc", "topic", "confidence", "score", F.lit("keywords").alias("path")))
    return top_n_per_group(both, ["doc"], [F.desc("confidence"), F.asc("topic")], most)


def platt(scored: DataFrame, rounds: int = 100) -> tuple[float, float]:
    """(a, b) such that 1 / (1 + exp(a * score + b)) is the chance of label 1, for ``scored`` (score, label 0 or 1).

    Newton steps with a halving line search. A step is one aggregate over all rows, which tries every step length at
    once, so nothing but sums reaches the driver. Targets are smoothed; scores without any label of a kind are
    allowed, an empty table gives (0.0, 0.0).
    """
    rows = scored.where("score is not null and label is not null").groupBy("score", "label").agg(F.count("*").alias("n"))
    pos, neg = (float(x or 0) for x in rows.agg(F.sum(F.when(F.col("label") == 1, F.col("n"))), F.sum(F.when(F.col("label") != 1, F.col("n")))).first())
    if pos + neg == 0:
        return 0.0, 0.0
    hi, lo = (pos + 1) / (pos + 2), 1 / (neg + 2)
    rows = rows.select(F.col("score").cast("double").alias("s"), F.when(F.col("label") == 1, hi).otherwise(lo).alias("t"), "n").cache()

    def loss(x: Column) -> Column:
        return F.sum(F.col("n") * (F.when(x >= 0, F.col("t") * x).otherwise((F.col("t") - 1) * x) + F.log1p(F.exp(-F.abs(x)))))

    a, b = 0.0, math.log((neg + 1) / (pos + 1))
    now = rows.agg(loss(F.lit(a) * F.col("s") + b)).first()[0]
    steps = [0.5**k for k in range(34)]
    for _ in range(rounds):
        x = F.lit(a) * F.col("s") + b
        p = 1 / (1 + F.exp(x))
        d = F.col("t") - p
        h = rows.agg(*[F.sum(F.col("n") * y) for y in (F.col("s") * F.col("s") * p * (1 - p), p * (1 - p), F.col("s") * p * (1 - p), F.col("s") * d, d)]).first()
        h11, h22, h21, g1, g2 = h[0] + 1e-12, h[1] + 1e-12, h[2], h[3], h[4]
        det = h11 * h22 - h21 * h21
        if abs(det) < 1e-15 or (abs(g1) < 1e-5 and abs(g2) < 1e-5):
            break
        da, db = -(h22 * g1 - h21 * g2) / det, -(h11 * g2 - h21 * g1) / det
        slope = g1 * da + g2 * db
        tried = rows.agg(*[loss(F.lit(a + k * da) * F.col("s") + (b + k * db)) for k in steps]).first()
        good = next(((k, f) for k, f in zip(steps, tried, strict=True) if f < now + 1e-4 * k * slope), None)
        if good is None:
            break
        a, b, now = a + good[0] * da, b + good[0] * db, good[1]
    rows.unpersist()
    return a, b


def calibrated(score: Column, a: float, b: float) -> Column:
    return 1 / (1 + F.exp(F.lit(a) * score + b))


def blend_alpha(f1: Column, keyword_f1: Column) -> Column:
    """Share of the model in a blend with keywords, by their scores on held-out documents."""
    return half_up(F.least(F.lit(0.5), F.greatest(F.lit(0.05), f1 / (keyword_f1 + f1 + 0.01))), 3)


def plan_training(labels: DataFrame, least_labelled: int = LEAST_LABELLED, least_positive: int = LEAST_POSITIVE) -> DataFrame:
    """(topic, positives, method): topics with enough positives get a model, the others fall back to keywords.

    ``labels`` is (doc, label), with a row without label for a document that has none. Too few documents are refused."""
    n = labels.select("doc").distinct().limit(least_labelled).count()
    if n < least_labelled:
        raise Refused(f"{n} labelled documents, at least {least_labelled} are needed")
    by = labels.where("label is not null").groupBy(F.col("label").alias("topic")).agg(F.count_distinct("doc").alias("positives"))
    return by.withColumn("method", F.when(F.col("positives") >= least_positive, "model").otherwise("bm25_fallback"))


def train_topic(features: DataFrame, topic: str) -> tuple[DataFrame, object]:
    """A model of one topic over hashed terms and the scores of held-out documents, which it has not seen: (doc, label, score).

    ``features`` is (doc, tokens, topics, held_out). ``train_topics`` trains all topics over a vocabulary.
    """
    from pyspark.ml.functions import vector_to_array

    rows = features.select("doc", "tokens", "held_out", F.array_contains("topics", topic).cast("int").alias("label"))
    model, _ = cf.logistic_regression(rows.where("not held_out"), "label")
    from pyspark.ml.feature import HashingTF

    unseen = HashingTF(numFeatures=model.numFeatures, inputCol="tokens", outputCol="features").transform(rows.where("held_out"))
    return model.transform(unseen).select("doc", "label", vector_to_array("rawPrediction")[1].alias("score")), model


class Spooled:
    """Rows of places and values in a file of the task's temp folder, which are read one by one: a task holds where each begins, and its label."""

    def __init__(self) -> None:
        self.file, self.sizes, self.labels = tempfile.TemporaryFile(), [], []

    def add(self, batch: pa.RecordBatch) -> None:
        """The rows (i, v, label) of ``batch``, behind those before."""
        i, v = batch["i"], batch["v"]
        places, values = i.flatten().to_numpy().astype(np.int32), v.flatten().to_numpy().astype(float)
        sizes = np.diff(i.offsets.to_numpy())
        ends = np.cumsum(sizes)
        self.file.write(b"".join(part for k, n in zip(ends.tolist(), sizes.tolist(), strict=True) for part in (values[k - n : k].tobytes(), places[k - n : k].tobytes())))
        self.sizes.append(sizes)
        self.labels.append(batch["label"].to_numpy().astype(np.int8))

    def rows(self) -> tuple[Callable[[int], tuple[np.ndarray, np.ndarray]], np.ndarray]:
        """Places and values of a row by its number, and the labels of all."""
        self.file.flush()
        file, starts = self.file.fileno(), array("q", (np.concatenate([[0], np.cumsum(np.concatenate(self.sizes), dtype=np.int64)]) * 12).tobytes())

        def row(k: int) -> tuple[np.ndarray, np.ndarray]:
            at = starts[k]
            n = (starts[k + 1] - at) // 12
            held = os.pread(file, 12 * n, at)
            return np.frombuffer(held, np.int32, n, 8 * n), np.frombuffer(held, float, n)

        return row, np.concatenate(self.labels)


def descend(row: Callable[[int], tuple[np.ndarray, np.ndarray]], label: np.ndarray, terms: int, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights and bias of one topic by stochastic gradient descent over rows (``row(k)``: places and values of the k-th).

    The order of an epoch is drawn anew from the seed. Classes weigh alike; only the weights of a row's terms shrink with it. Without
    examples of both classes everything is zero.
    """
    n, positive = len(label), int(label.sum())
    weights, bias, rate = np.zeros(terms), 0.0, RATE
    if positive in (0, n):
        return weights, bias
    share, labels = (n / (2 * (n - positive)), n / (2 * positive)), label.tobytes()  # of 0 and 1
    draw = np.random.Generator(np.random.PCG64(SEED))
    for _ in range(epochs):
        for k in draw.permutation(n):
            at, x = row(k)
            w, y = weights.take(at), labels[k]
            z = min(max(bias + float(w.dot(x)), -500.0), 500.0)
            step = (1 / (1 + math.exp(-z)) - y) * share[y]
            w = w - rate * (step * x + SHRINK * w)
            w[np.abs(w) <= 1e-10] = 0.0
            weights[at] = w
            bias -= rate * step
        rate *= DECAY
    return weights, bias


def train_topics(vectors: DataFrame, labels: DataFrame, topics: list[str], terms: DataFrame, epochs: int = EPOCHS) -> tuple[DataFrame, DataFrame]:
    """``weights`` (topic, term, w) and ``biases`` (topic, bias) of all ``topics``, each trained in a task of its own in one job.

    ``vectors`` (doc, term, weight) and ``labels`` (doc, label; null where a document has none) are those of the training
    documents, all of which are used; ``terms`` (term) is the vocabulary. A topic's task writes its rows to a local file as they
    come and holds some 25 bytes of each. Rows stand in the order of their ids before any order is drawn, so the result depends on neither partitions nor runs.
    """
    spark = vectors.sparkSession
    names = sorted(r["term"] for r in terms.select("term").distinct().collect())  # a vocabulary has a size limit
    place = spark.createDataFrame(list(enumerate(names)), "i int, term string")
    docs = labels.select("doc").distinct()
    mine = labels.where("label is not null").groupBy("doc").agg(F.collect_set("label").alias("own"))
    rows = docs.join(vectors.join(F.broadcast(place), "term").groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("i", "weight"))).alias("x")), "doc", "left").join(mine, "doc", "left")
    rows = rows.select("doc", F.coalesce(F.col("x.i"), F.expr("cast(array() as array<int>)")).alias("i"), F.coalesce(F.col("x.weight"), F.expr("cast(array() as array<double>)")).alias("v"), F.coalesce("own", F.expr("cast(array() as array<string>)")).alias("own"))
    each = rows.select("doc", "i", "v", "own", F.posexplode(F.array(*[F.lit(t) for t in topics])).alias("at", "topic")).select("at", "topic", "doc", "i", "v", F.array_contains("own", F.col("topic")).cast("int").alias("label"))

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, topic = Spooled(), None
        for x in batches:
            if x.num_rows:
                held.add(x)
                topic = x["topic"][0]
        if topic is not None:
            w, bias = descend(*held.rows(), len(names), epochs)
            used = np.nonzero(w)[0]
            yield pa.record_batch([pa.array([topic]), pa.array([used.astype(np.int32)]), pa.array([w[used]]), pa.array([float(bias)])], names=["topic", "i", "w", "bias"])

    by_topic = each.repartitionById(len(topics), F.col("at")).sortWithinPartitions("doc").drop("at")
    found = cut(by_topic.mapInArrow(fit, "topic string, i array<int>, w array<double>, bias double"), "models")
    weights = found.select("topic", F.inline(F.arrays_zip("i", "w"))).join(F.broadcast(place), "i").select("topic", "term", "w")
    return weights, found.select("topic", "bias")


def validated(scores: DataFrame, labels: DataFrame, keyword_scores: DataFrame) -> DataFrame:
    """(topic, threshold, val_precision, val_recall, val_f1, bm25_val_f1, blend_alpha) on held-out documents.

    ``scores`` (doc, topic, logit) has every held-out document and topic, ``labels`` (doc, label) what people said,
    ``keyword_scores`` (doc, topic, score) those of keywords, which predict from ten on. A topic without a usable threshold has zero, at which it is measured.
    """
    truth = labels.where("label is not null").select("doc", F.col("label").alias("topic")).distinct().withColumn("label", F.lit(1))
    said = keyword_scores.where(F.col("score") >= KEYWORD_MINIMUM).select("doc", "topic").distinct().withColumn("said", F.lit(True))
    rows = scores.select("doc", "topic", F.col("logit").alias("score")).join(truth, ["doc", "topic"], "left").join(said, ["doc", "topic"], "left")
    rows = rows.withColumns({"label": F.coalesce("label", F.lit(0)), "said": F.coalesce("said", F.lit(False))})
    best = cf.best_threshold(rows.select("topic", "score", "label")).select("topic", F.col("threshold").alias("_t"))
    rows = rows.join(F.broadcast(best), "topic", "left").withColumn("threshold", F.coalesce("_t", F.lit(0.0)))  # a row a topic
    yes, positive = F.col("score") >= F.col("threshold"), F.col("label") == 1
    counts = {"tp": yes & positive, "fp": yes & ~positive, "fn": ~yes & positive, "btp": F.col("said") & positive, "bfp": F.col("said") & ~positive, "bfn": ~F.col("said") & positive}
    by = rows.groupBy("topic").agg(F.max("threshold").alias("threshold"), *[F.count_if(c).alias(k) for k, c in counts.items()])
    f1 = lambda tp, fp, fn: ratio(2 * F.col(tp), 2 * F.col(tp) + F.col(fp) + F.col(fn))
    return by.select(
        "topic", "threshold", half_up(ratio(F.col("tp"), F.col("tp") + F.col("fp")), 3).alias("val_precision"), half_up(ratio(F.col("tp"), F.col("tp") + F.col("fn")), 3).alias("val_recall"),
        half_up(f1("tp", "fp", "fn"), 3).alias("val_f1"), half_up(f1("btp", "bfp", "bfn"), 3).alias("bm25_val_f1"), blend_alpha(f1("tp", "fp", "fn"), f1("btp", "bfp", "bfn")).alias("blend_alpha"),
    )


def overall(models: DataFrame) -> DataFrame:
    """One row: precision and recall averaged over topics that have a model, and the F1 of these two averages."""
    rows = models.where("method = 'logistic'").agg(F.avg("val_precision").alias("p"), F.avg("val_recall").alias("r")).select(F.coalesce("p", F.lit(0.0)).alias("p"), F.coalesce("r", F.lit(0.0)).alias("r"))
    return rows.select(half_up(F.col("p"), 3).alias("precision"), half_up(F.col("r"), 3).alias("recall"), half_up(ratio(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")), 3).alias("f1"))


class Model(NamedTuple):
    """``table``: a row a topic. ``weights`` (topic, term, w) and ``terms`` (term, df) are those of topics with a model."""

    table: DataFrame
    weights: DataFrame
    terms: DataFrame


def train_classifier(
    docs: DataFrame, labels: DataFrame, keywords: DataFrame, key: str = "doc_id", title: str = "title", content: str = "content", most_terms: int = 5000, least_labelled: int = LEAST_LABELLED, least_positive: int = LEAST_POSITIVE
) -> Model:
    """Train, choose thresholds and measure all topics of ``keywords`` on labelled documents.

    ``labels`` is (doc, label), with a row without label for a document that has none. A fifth of the documents, rare topics first, is held out; vocabulary,
    rarity and weights come from the others, thresholds and figures from the held-out. Topics of too few examples keep to keywords.
    """
    labels = cut(labels.join(docs.select(F.col(key).alias("doc")), "doc", "left_semi").select("doc", "label").distinct(), "labels")
    n = labels.select("doc").distinct().count()
    if n < least_labelled:
        raise Refused(f"{n} labelled documents, at least {least_labelled} are needed")
    split = cut(rare_first_split(labels.select("doc", F.coalesce("label", F.lit("")).alias("label"))), "split")
    text = F.substring(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(content, F.lit(""))), 1, 3000)
    own = docs.select(F.col(key).alias("doc_id"), F.col(title).alias("title"), F.col(content).alias("content"), text.alias("text")).join(split.withColumnRenamed("doc", "doc_id"), "doc_id")
    seen, held = own.where("not held_out"), own.where("held_out")
    trained = labels.join(split.where("not held_out").select("doc"), "doc", "left_semi")
    chosen = cf.chi_squared(seen, trained, F.col("text"), most_terms)
    terms = cut(cf.document_frequency(seen, F.col("text")).join(chosen, "term", "left_semi"), "terms")
    total = seen.count()
    topics = keywords.select("topic").distinct()
    counts = trained.where("label is not null").groupBy(F.col("label").alias("topic")).agg(F.count_distinct("doc").alias("examples"))
    plan = topics.join(counts, "topic", "left").select("topic", F.coalesce("examples", F.lit(0).cast("long")).alias("examples"))
    enough = [r["topic"] for r in plan.where(F.col("examples") >= least_positive).orderBy("topic").collect()]  # topics of the taxonomy
    spark = docs.sparkSession
    figures = "topic string, bias double, threshold double, val_precision double, val_recall double, val_f1 double, bm25_val_f1 double, blend_alpha double"
    weights, measured = spark.createDataFrame([], "topic string, term string, w double"), spark.createDataFrame([], figures)
    if enough:
        weights, biases = train_topics(cf.tfidf(seen, terms, F.col("text"), total=total), trained, enough, terms)
        zero = biases.withColumn("threshold", F.lit(0.0))
        scores = logits(held.select(F.col("doc_id").alias("doc")), cf.tfidf(held, terms, F.col("text"), total=total), weights, zero)
        unseen = labels.join(split.where("held_out").select("doc"), "doc", "left_semi")
        measured = biases.join(validated(scores, unseen, cf.bm25_topics(held, keywords)), "topic")
    table = plan.join(measured, "topic", "left").withColumn("method", F.when(F.col("bias").isNotNull(), "logistic").otherwise("bm25_fallback"))
    return Model(cut(table, "models"), cut(weights, "weights"), terms)


def classify_by(model: Model, docs: DataFrame, keywords: DataFrame, total: int, weights: DataFrame | None = None, most: int = 5) -> DataFrame:
    """Topics of ``docs`` (doc_id, title, content) by the models and, where a topic has none, by keywords; guards hold on both paths. ``total``: documents the rarities were counted over."""
    text = F.substring(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("content", F.lit(""))), 1, 3000)
    bias = model.table.where("method = 'logistic'").select("topic", "bias", "threshold")
    scores = logits(docs.select(F.col("doc_id").alias("doc")), cf.tfidf(docs, model.terms, text, total=total), model.weights, bias)
    keyword = cf.bm25_topics(docs, keywords)
    keyword = keyword.where("matched") if weights is None else cf.weighted(keyword.where("matched"), weights)
    return with_model(guarded(scores, docs, text, cf.guard_words(keywords)), keyword, bias, most)


def reclassified(event_topics: DataFrame, found: DataFrame, scope: DataFrame) -> DataFrame:
    """Topics of events after those of ``scope`` (event_id) were classified anew as ``found``: the old ones of the scope go, all others stay."""
    kept = event_topics.join(scope.select("event_id").distinct(), "event_id", "left_anti")
    return kept.unionByName(found.join(scope.select("event_id").distinct(), "event_id", "left_semi").select(*kept.columns))


def exported(events: DataFrame, since: datetime | None = None) -> DataFrame:
    """Reviewed events as JSON lines, one column ``value``."""
    rows = events.where("reviewed_at is not null")
    if since is not None:
        rows = rows.where(F.col("reviewed_at") >= moment(since))
    return rows.select(F.to_json(F.struct("event_id", "title", "human_topics", "labeler", "notes", "reviewed_at")).alias("value"))
