"""Topic classification: BM25 against a taxonomy, term statistics, logistic regression, thresholds and evaluation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewell.functions.scalar import half_up, ratio
from tidewell.functions.text import tokens

# BM25 constants, escalating thresholds, confidence curve.
K1, B, TITLE_BOOST, AVERAGE_LENGTH = 1.2, 0.75, 2.0, 150
THRESHOLDS = (10.0, 14.0, 18.0, 22.0, 26.0)
MIDPOINT, TEMPERATURE = 14.0, 4.0


def python_tokens(text: str) -> list[str]:
    import re

    from tidewell.functions.text import STOPWORDS

    return [t for t in re.split("[^a-z0-9]+", text.lower()) if t and t not in STOPWORDS]


def topic_idf(taxonomy: list[dict]) -> dict[str, float]:
    """How rare a keyword token is among topics. The taxonomy is a small configuration on the driver."""
    per = [{t for k in topic["keywords"] for t in python_tokens(k)} for topic in taxonomy]
    n = len(per)
    return {t: math.log((n - df + 0.5) / (df + 0.5) + 1) for t in set().union(*per) for df in [sum(t in p for p in per)]}


def keyword_table(spark: SparkSession, taxonomy: list[dict]) -> DataFrame:
    idf = topic_idf(taxonomy)
    rows = [(t["id"], w, idf[w], float(t.get("priority", 50)), sorted({x for k in t.get("negative_keywords", ()) for x in python_tokens(k)}), sorted({x for k in t.get("context_terms", ()) for x in python_tokens(k)}) if t.get("context_required") else [])
            for t in taxonomy for w in sorted({x for k in t["keywords"] for x in python_tokens(k)})]
    return spark.createDataFrame(rows, "topic string, term string, idf double, priority double, negative array<string>, context array<string>")


def _bm25(tf: Column, dl: Column, idf: Column) -> Column:
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / AVERAGE_LENGTH))


def guard_words(keywords: DataFrame) -> DataFrame:
    """(topic, negative, context) of a keyword table."""
    return keywords.groupBy("topic").agg(F.first("negative").alias("negative"), F.first("context").alias("context"))


def suppressed(ts: Column, words: DataFrame) -> Column:
    """The topics whose negative words are among ``ts``, or whose required context isn't. ``words`` is configuration: a row a topic, read by the driver."""
    out = []
    for r in words.where((F.size("negative") > 0) | (F.size("context") > 0)).orderBy("topic").collect():
        negative, context = (F.arrays_overlap(ts, F.array(*[F.lit(w) for w in r[c]])) if r[c] else None for c in ("negative", "context"))
        bad = negative if context is None else ~context if negative is None else negative | ~context
        out.append(F.when(F.coalesce(bad, F.lit(True)), r["topic"]))
    return F.array_compact(F.array(*out)) if out else F.expr("cast(array() as array<string>)")


def bm25_topics(docs: DataFrame, keywords: DataFrame, title: str = "title", content: str = "content", key: str = "doc_id") -> DataFrame:
    """(doc, topic, score, confidence, matched) of every topic a document has a keyword of; negative words and missing context suppress.

    Texts are cut into tokens once, and only tokens that are keywords are ever shuffled.
    """
    text = F.substring(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(content, F.lit(""))), 1, 3000)
    bags = docs.select(F.col(key).alias("doc"), tokens(text).alias("ts"), tokens(F.substring(F.coalesce(title, F.lit("")), 1, 200)).alias("hs"))

    def part(ts: str, boost: float) -> Column:
        return F.transform(ts, lambda t: F.struct(t.alias("term"), F.lit(boost).alias("boost")))

    # lengths and guards are settled below the explode; inside it they would be worked out again for every token
    off = suppressed(F.col("ts"), guard_words(keywords)).alias("off")
    rows = bags.select("doc", off, F.size("ts").alias("long"), F.size("hs").alias("short"), F.concat(part("ts", 1.0), part("hs", TITLE_BOOST)).alias("xs"))
    hits = rows.select("doc", "off", "long", "short", F.inline("xs")).join(F.broadcast(keywords), "term").where(~F.array_contains("off", F.col("topic")))  # the taxonomy's keywords: configuration
    hits = hits.withColumn("dl", F.when(F.col("boost") == TITLE_BOOST, F.col("short")).otherwise(F.col("long")))
    by = hits.groupBy("doc", "topic", "term", "boost", "dl", "idf", "priority").agg(F.count("*").alias("tf"))
    scores = by.groupBy("doc", "topic").agg(F.sum(F.col("boost") * _bm25(F.col("tf"), F.col("dl"), F.col("idf"))).alias("raw"), F.max("priority").alias("priority"))
    score = F.col("raw") * (F.col("priority") / 50)
    sure = 1 / (1 + F.exp(-(score - MIDPOINT) / TEMPERATURE))
    rows = scores.select("doc", "topic", half_up(score, 6).alias("score"), half_up(F.least(F.greatest(sure, F.lit(1e-6)), F.lit(1 - 1e-6)), 3).alias("confidence"))
    return rows.withColumn("matched", F.col("score") >= THRESHOLDS[0])


def weighted(scores: DataFrame, weights: DataFrame) -> DataFrame:
    """Scores and confidences times the topic's learned weight (topic, weight), one where it has none; ``matched`` is as before."""
    rows = scores.join(F.broadcast(weights.select("topic", "weight")), "topic", "left")  # a row a topic
    w = F.coalesce("weight", F.lit(1.0))
    return rows.withColumns({"score": half_up(F.col("score") * w, 6), "confidence": half_up(F.least(F.lit(1.0), F.col("confidence") * w), 3)}).select(*scores.columns)


def classify(scores: DataFrame, most: int = 5, weights: DataFrame | None = None) -> DataFrame:
    """Topics of each document among those that match: each next one has a higher threshold, and the first failure ends the list."""
    scores = scores.where(F.col("matched") if "matched" in scores.columns else F.col("score") >= THRESHOLDS[0])
    scores = scores if weights is None else weighted(scores, weights)
    rn = F.row_number().over(Window.partitionBy("doc").orderBy(F.desc("score"), "topic"))
    need = F.element_at(F.array(*[F.lit(t) for t in THRESHOLDS]), F.col("rn"))
    rows = scores.withColumn("rn", rn).where(F.col("rn") <= min(most, len(THRESHOLDS))).withColumn("fails", F.col("score") < need)
    first = F.min(F.when(F.col("fails"), F.col("rn"))).over(Window.partitionBy("doc"))
    return rows.withColumn("stop", first).where(F.col("stop").isNull() | (F.col("rn") < F.col("stop"))).select("doc", "topic", "rn", "score", "confidence")


def document_frequency(docs: DataFrame, text: Column) -> DataFrame:
    return docs.select(F.explode(F.array_distinct(tokens(text))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def corpus_idf(docs: DataFrame, text: Column, bootstrap: DataFrame | None = None) -> DataFrame:
    """Rarity of a term among documents (their first 3000 characters); terms only in ``bootstrap`` keep its value."""
    total = docs.agg(F.count("*").alias("N"))
    df = document_frequency(docs, F.substring(text, 1, 3000)).crossJoin(F.broadcast(total))
    rows = df.select("term", half_up(F.log((F.col("N") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1), 6).alias("idf"))
    if bootstrap is None:
        return rows
    return rows.join(bootstrap.select("term", F.col("idf").alias("_b")), "term", "full").select("term", F.coalesce("idf", "_b").alias("idf"))


def vocabulary(docs: DataFrame, text: Column, most: int) -> DataFrame:
    return document_frequency(docs, text).orderBy(F.desc("df"), "term").limit(most)


def chi_squared(docs: DataFrame, labels: DataFrame, text: Column, most: int = 5000, key: str = "doc_id") -> DataFrame:
    """Terms that tell some label best. ``labels`` is (doc, label); the score is the best over labels, also where a term never meets one."""
    own = docs.join(labels.select(F.col("doc").alias(key)).distinct(), key, "left_semi")
    pairs = own.select(F.col(key).alias("doc"), F.explode(F.array_distinct(tokens(text))).alias("term"))
    df = pairs.groupBy("term").agg(F.count("*").alias("df"))
    sizes = labels.where("label is not null").groupBy("label").agg(F.count_distinct("doc").alias("size"))
    joint = pairs.join(labels.where("label is not null").select("doc", "label").distinct(), "doc").groupBy("term", "label").agg(F.count("*").alias("a"))
    every = df.crossJoin(F.broadcast(sizes)).join(joint, ["term", "label"], "left").crossJoin(F.broadcast(own.agg(F.count("*").alias("N"))))  # labels are few
    a, b = F.coalesce("a", F.lit(0)).cast("double"), F.col("df") - F.coalesce("a", F.lit(0))
    c = F.col("size") - F.coalesce("a", F.lit(0))
    d = F.col("N") - a - b - c
    low = (a + b) * (c + d) * (a + c) * (b + d)
    chi = F.when(low != 0, F.col("N") * F.pow(a * d - b * c, F.lit(2.0)) / low)
    best = every.groupBy("term").agg(F.max(chi).alias("chi2")).where("chi2 is not null")
    return best.select("term", half_up(F.col("chi2"), 6).alias("chi2")).orderBy(F.desc("chi2"), "term").limit(most)


def tfidf(docs: DataFrame, terms: DataFrame, text: Column, key: str = "doc_id", total: int | None = None) -> DataFrame:
    """(doc, term, weight): dampened frequency times rarity, rows scaled to length one. ``terms`` has (term, df); ``total``, if given, is the number of documents that df was counted over, else these here.

    Only tokens of the vocabulary are shuffled.
    """
    n = docs.agg(F.count("*").alias("N"))
    known = docs.select(F.col(key).alias("doc"), F.explode(tokens(text)).alias("term")).join(F.broadcast(terms), "term")  # a vocabulary has a size limit
    rows = known.groupBy("doc", "term", "df").agg(F.count("*").alias("tf"))
    rows = rows.crossJoin(F.broadcast(n)) if total is None else rows.withColumn("N", F.lit(total))
    w = (1 + F.log("tf")) * (F.log((F.col("N") + 1) / (F.col("df") + 1)) + 1)
    rows = rows.select("doc", "term", w.alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("doc")))
    return rows.select("doc", "term", half_up(F.col("w") / norm, 6).alias("weight"))


def logistic_regression(features: DataFrame, label: str, dims: int = 4096, rounds: int = 30):
    """A class-weighted linear model over hashed terms, trained by Spark ML. ``features`` has doc, tokens and the label column (0 or 1)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF

    hashed = HashingTF(numFeatures=dims, inputCol="tokens", outputCol="features").transform(features)
    counts = {r[0]: r[1] for r in hashed.groupBy(label).count().collect()}
    n = sum(counts.values())
    weight = F.when(F.col(label) == 1, n / (2.0 * max(counts.get(1, 0), 1))).otherwise(n / (2.0 * max(counts.get(0, 0), 1)))
    model = LogisticRegression(featuresCol="features", labelCol=label, weightCol="w", maxIter=rounds, regParam=0.001)
    return model.fit(hashed.withColumn("w", weight).withColumn(label, F.col(label).cast("double"))), hashed


def best_threshold(scored: DataFrame, least_precision: float = 0.10) -> DataFrame:
    """Per topic, the score at which F1 is best along a walk down the scores. ``scored`` is (topic, score, label). Equal scores are one step."""
    by = scored.groupBy("topic", "score").agg(F.sum("label").alias("p"), F.count("*").alias("n"))
    down = Window.partitionBy("topic").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    rows = by.withColumn("tp", F.sum("p").over(down)).withColumn("seen", F.sum("n").over(down)).withColumn("pos", F.sum("p").over(Window.partitionBy("topic")))
    precision, recall = ratio(F.col("tp"), F.col("seen")), ratio(F.col("tp"), F.col("pos"))
    f1 = ratio(2 * precision * recall, precision + recall)
    rows = rows.select("topic", "score", precision.alias("precision"), recall.alias("recall"), half_up(f1, 9).alias("f1")).where((F.col("precision") >= least_precision) & (F.col("f1") > 0))
    best = rows.groupBy("topic").agg(F.max_by(F.struct("score", "precision", "recall", "f1"), F.struct("f1", "score")).alias("s"))
    return best.select("topic", F.col("s.score").alias("threshold"), *[half_up(F.col(f"s.{c}"), 6).alias(c) for c in ("precision", "recall", "f1")])


def evaluate(reviewed: DataFrame, least: int = 30) -> DataFrame:
    """Per label: counts of hits and misses, precision, recall, F1. ``reviewed`` has arrays machine and human."""
    every = F.array_union("machine", "human")
    rows = reviewed.select(F.explode(every).alias("topic"), "machine", "human")
    m, h = F.array_contains("machine", F.col("topic")), F.array_contains("human", F.col("topic"))
    by = rows.groupBy("topic").agg(F.count_if(m & h).alias("tp"), F.count_if(m & ~h).alias("false_positives"), F.count_if(~m & h).alias("false_negatives"), F.count("*").alias("samples")).where(F.col("samples") >= least)
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("false_positives")), ratio(F.col("tp"), F.col("tp") + F.col("false_negatives"))
    return by.select("topic", "samples", half_up(p, 3).alias("precision"), half_up(r, 3).alias("recall"), half_up(ratio(2 * p * r, p + r), 3).alias("f1"), "false_positives", "false_negatives")


def macro_average(evaluated: DataFrame) -> DataFrame:
    """One row: the averages of ``evaluate`` over its topics, and how many there are."""
    return evaluated.agg(*[half_up(F.coalesce(F.avg(c), F.lit(0.0)), 3).alias(c) for c in ("precision", "recall", "f1")], F.count("*").alias("topics"))


def label_losses(reviewed: DataFrame, topics: int, many: int = 4) -> DataFrame:
    """One row: Hamming loss and how often ``many`` labels or more are given, rightly or not."""
    differ = F.size(F.array_except("machine", "human")) + F.size(F.array_except("human", "machine"))
    over = F.size("machine") >= many
    return reviewed.agg(half_up(F.sum(differ) / (F.count("*") * F.lit(float(topics))), 6).alias("hamming_loss"), F.count_if(over).alias("over_classified"), F.count_if(over & (F.size("human") < many)).alias("falsely_over_classified"))


def confusion_pairs(reviewed: DataFrame, most: int = 20) -> DataFrame:
    fp = reviewed.select(F.explode(F.array_except("machine", "human")).alias("predicted"), F.coalesce(F.try_element_at("human", F.lit(1)), F.lit("none")).alias("actual")).withColumn("direction", F.lit("fp"))
    fn = reviewed.select(F.coalesce(F.try_element_at("machine", F.lit(1)), F.lit("none")).alias("predicted"), F.explode(F.array_except("human", "machine")).alias("actual")).withColumn("direction", F.lit("fn"))
    return fp.unionByName(fn).groupBy("predicted", "actual", "direction").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "predicted", "actual", "direction").limit(most)


def training_sample(events: DataFrame, k: int, seed: int = 42, key: str = "event_id") -> DataFrame:
    """A uniform sample of ``k`` rows that depends on ids and seed only."""
    return events.orderBy(F.xxhash64(F.lit(seed), key), key).limit(k)
