"""Operator 4, hierarchical language identification.

Texts become hashed counts of letter n-grams (bytes, A-Z folded, other ASCII taken as a gap),
dampened and scaled to length one. A first level of linear support vector machines, one for each language
family against all others, tells the family; inside the chosen family one-versus-one machines separate the
related languages, and most votes win, margins breaking ties. The score is the product of both levels'
logistic margins.

The machines are trained on the driver over at most ``PER_LANGUAGE`` documents of each language and about
``TRAINING_ROWS`` in all, those whose seeded hash is smallest; both bounds are parameters, and every language
that occurs is learned. What the driver gets of them is their features (16 KB each), computed on the executors
from whole texts. Rows are cut by a quantile of their hash before any exchange, repeated ones count once.
Prediction is one pass without an exchange.

Cases. Null text, or text without any letter: ``und``, score 0. Rows without a language, or without an id, are not
learned from, but predicted. With no rows to learn from, all are ``und``; with a single language, all texts
with letters get it with score 1. Repeated rows get equal predictions. Long texts are counted whole.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewell.llm.common import documents, text_hash

# Families of languages by their ISO 639-1 codes. A code not listed is a family of its own.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "is", "lb", "nl", "no", "sv"),
    "romance": ("ca", "es", "fr", "gl", "it", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "indo-aryan": ("bn", "gu", "hi", "mr", "ne", "pa", "ur"),
    "turkic": ("az", "kk", "ky", "tr", "uz"),
    "uralic": ("et", "fi", "hu"),
    "semitic": ("am", "ar", "he", "mt"),
    "dravidian": ("kn", "ml", "ta", "te"),
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}

UND = "und"
FEATURES = 4096
PER_LANGUAGE, TRAINING_ROWS = 400, 20_000
#: How many times the rows wanted pass the quantile; and the most languages whose quantiles are broadcast.
SPARE, BROADCAST_LANGUAGES = 2.0, 100_000
FOLD = bytes(b | 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Letters counted at once; bounds memory on long texts.
BLOCK = 1 << 20


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def has_letter(text: bytes) -> bool:
    return bool(re.search(rb"[A-Za-z]", text)) or (not text.isascii() and any(c.isalpha() for c in text.decode("utf-8", "ignore")))


def features(text: bytes) -> np.ndarray:
    """Unit vector of hashed 1-, 2- and 3-gram counts, square roots taken."""
    counts = np.zeros(FEATURES, np.int64)
    folded = b" " + text.translate(FOLD) + b" "
    for k in range(0, len(folded), BLOCK):
        b = np.frombuffer(folded, np.uint8, min(len(folded) - k, BLOCK + 2), k).astype(np.uint32)
        two = b[:-1] * np.uint32(257) + b[1:] + np.uint32(99_991)
        three = two[:-1] * np.uint32(263) + b[2:] if len(b) > 2 else b[:0]
        for grams in (b[:BLOCK], two[:BLOCK], three[:BLOCK]):
            counts += np.bincount((grams * np.uint32(2654435761)) >> np.uint32(20), minlength=FEATURES)
    x = np.sqrt(counts)
    return (x / np.linalg.norm(x)).astype(np.float32)


def linear_svm(x: np.ndarray, y: np.ndarray, penalty: float = 1e-4, rounds: int = 200) -> np.ndarray:
    """Weights and bias of a linear support vector machine (squared hinge loss), by accelerated gradient descent. ``y`` is +1 or -1."""
    x, y = np.hstack([x, np.ones((len(x), 1), x.dtype)]), y.astype(x.dtype)
    weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)).astype(x.dtype)
    step, penalty = x.dtype.type(1 / (2 * 2 + penalty)), x.dtype.type(penalty)  # rows have length sqrt(2) at most, weights add up to one
    w = ahead = np.zeros(x.shape[1], x.dtype)
    for k in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ ahead))
        new = ahead - step * (penalty * ahead - 2 * (x.T @ (weight * slack * y)))
        ahead, w = new + x.dtype.type(k / (k + 3)) * (new - w), new
    return w


@dataclass
class Duels:
    """One-versus-one machines among ``names``."""

    names: list[str]
    pairs: list[tuple[int, int]]
    weights: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, labels: np.ndarray, names: list[str]) -> Duels:
        pairs = list(itertools.combinations(range(len(names)), 2))
        rows = []
        for a, b in pairs:
            own = (labels == names[a]) | (labels == names[b])
            rows.append(linear_svm(x[own], np.where(labels[own] == names[a], 1.0, -1.0)))
        return cls(names, pairs, np.array(rows).reshape(len(pairs), x.shape[1] + 1))

    def choose(self, x: np.ndarray) -> tuple[str, float]:
        if not self.pairs:
            return self.names[0], 1.0
        margins = self.weights[:, :-1] @ x + self.weights[:, -1]
        votes, total, least = np.zeros(len(self.names)), np.zeros(len(self.names)), np.full(len(self.names), np.inf)
        for (a, b), m in zip(self.pairs, margins.tolist(), strict=True):
            votes[a if m >= 0 else b] += 1
            for k, own in ((a, m), (b, -m)):
                total[k] += np.tanh(own)
                least[k] = min(least[k], own)
        best = max(range(len(self.names)), key=lambda k: (votes[k], total[k]))
        return self.names[best], float(1 / (1 + np.exp(-4 * np.clip(least[best], -20, 20))))


@dataclass
class Rivals:
    """One machine for each of ``names`` against all others."""

    names: list[str]
    weights: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, labels: np.ndarray, names: list[str]) -> Rivals:
        rows = [linear_svm(x, np.where(labels == n, 1.0, -1.0)) for n in names] if len(names) > 1 else []
        return cls(names, np.array(rows).reshape(len(rows), x.shape[1] + 1))

    def choose(self, x: np.ndarray) -> tuple[str, float]:
        if len(self.names) == 1:
            return self.names[0], 1.0
        margins = self.weights[:, :-1] @ x + self.weights[:, -1]
        best = int(np.argmax(margins))
        return self.names[best], float(1 / (1 + np.exp(-4 * np.clip(margins[best], -20, 20))))


@dataclass
class Identifier:
    families: Rivals | None
    languages: dict[str, Duels]

    @classmethod
    def fit(cls, x: np.ndarray, labels: np.ndarray) -> Identifier:
        if not len(labels):
            return cls(None, {})
        family = np.array([FAMILY_OF.get(c, c) for c in labels])
        names = sorted(set(family.tolist()))
        inside = {f: Duels.fit(x[family == f], labels[family == f], sorted(set(labels[family == f].tolist()))) for f in names}
        return cls(Rivals.fit(x, family, names), inside)

    def predict(self, text: bytes | None) -> tuple[str, float]:
        if text is None or self.families is None or not has_letter(text):
            return UND, 0.0
        x = features(text)
        family, p = self.families.choose(x)
        language, q = self.languages[family].choose(x)
        return language, p * q


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, most: int = TRAINING_ROWS, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Identifier:
    """Fit on a bounded sample of the rows that are not held out."""
    own = docs.where(docs[lang_col].isNotNull() & docs[text_col].isNotNull() & docs[id_col].isNotNull() & ~held_out(docs[id_col]))
    own = own.select(own[lang_col].alias("l"), own[id_col].alias("id"), text_hash(own[text_col]).alias("h"), own[text_col].cast("binary").alias("text"))
    own = own.withColumn("even", F.shiftrightunsigned(F.xxhash64(F.lit(seed), "id", "h"), 11) / 2.0**53)
    sizes = own.groupBy("l").agg(F.count("*").alias("n"))
    languages = sizes.count()
    each = max(1, min(per_language, most // max(languages, 1)))
    # the hash is even, so this many times the share leaves enough rows of each language, and few go into the exchange
    share = sizes.select("l", (SPARE * (each + 50) / F.col("n")).alias("share"))
    keyed = own.select("l", "id", "h", "even").join(F.broadcast(share) if languages <= BROADCAST_LANGUAGES else share, "l").where(F.col("even") < F.col("share")).select("l", "id", "h", "even").distinct()
    first = keyed.withColumn("n", F.row_number().over(Window.partitionBy("l").orderBy("even", "id", "h"))).where(F.col("n") <= each).select("l", "id", "h").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            got = [features(t).tobytes() for t in x["text"].to_pylist()]
            yield pa.record_batch([x["l"], pa.array(got, pa.binary())], names=["l", "x"])

    # at most ``most`` keys, or one a language; repeated rows are told apart from none by id and hash of the text, and go before the exchange
    sample = own.join(F.broadcast(first), ["l", "id", "h"], "left_semi").dropDuplicates(["l", "id", "h"])
    rows = sample.select("l", "text").mapInArrow(run, "l string, x binary").collect()
    rows.sort(key=lambda r: (r["l"], bytes(r["x"])))
    x = np.array([np.frombuffer(r["x"], np.float32) for r in rows], np.float32).reshape(len(rows), FEATURES)
    return Identifier.fit(x, np.array([r["l"] for r in rows]))


def identify(docs: DataFrame, model: Identifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every row, from the text alone."""
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: FEATURES floats for each pair of languages of a family

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            got = [shared.value.predict(t) for t in x["text"].to_pylist()]
            yield pa.record_batch([x["id"], pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=["id", "lang_pred", "score"])

    return docs.select(docs[id_col].alias("id"), docs[text_col].cast("binary").alias("text")).mapInArrow(run, f"id {kind}, lang_pred string, score double")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = identify(docs, train(docs))
    return out.select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "lang_pred", "score")


def reject_unidentified(docs: DataFrame, model: Identifier, least: float = 0.0, text_col: str = "text") -> DataFrame:
    """Rows whose text has a language with a score of ``least`` or more; all columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            got = [shared.value.predict(None if t is None else t.encode("utf-8")) for t in x.column(at).to_pylist()]
            yield x.filter(pa.array([p != UND and s >= least for p, s in got], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
