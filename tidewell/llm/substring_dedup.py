"""Operator 7, substring dedup: repeated-phrase automata.

A window is ``window`` consecutive words. A word goes if a window over it has a word sequence that
also starts earlier (smaller doc_id, or the same document further up).

1. Confirm. Each window names an anchor: the smallest hash among its phrases of ``PHRASE`` words
   (winnowing). Equal windows name equal anchors, so a window can only recur if its anchor does.
   Anchors of all documents are counted; those seen at two places or more recur. Around them the passages are cut
   out of every document: the words of all windows that name the anchor. Passages are sharded by anchor, and a shard
   confirms which windows recur by their rolling hashes.
2. Compile. Every shard compiles the words of its recurring windows into an Aho-Corasick automaton over word numbers.
3. Stream. The passages of all documents stream through the automaton of their shard, in the order of documents,
   and it locates every occurrence, word for word. The first of a window stays; words of the others are cut.
   Passages that repeat an earlier one byte by byte are later copies throughout and need no second pass.

What a shard holds at once is bounded by ``CHUNK`` passages, cut between anchors, since an anchor of
more than ``FREQUENT`` places is not sharded: its passages, then the windows of those that differ, go under 128 bits of
their own hash, meet in partial aggregates for their first place, and are joined to it by shuffle, which splits
skewed partitions.
Broadcast are two Bloom filters of at most ``MAX_FILTER_BITS`` bits each, over recurring and over frequent anchors.
The first spares the shuffle most passages that can't recur; what it lets through in error is alone with its anchor.
What the second takes for frequent in error goes by its own hash, which is as right.

Cases. Null text: no words. Fewer words than a window: nothing to remove. Words are compared byte by byte.
Rows with the same ``doc_id`` and the same text are one document; with other text they are ordered by a hash of the text.
A null ``doc_id`` sorts first. Long texts are processed whole, their passages in blocks.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.llm.common import documents, drop_written, written

#: Words of the phrases among which a window's anchor is chosen.
PHRASE = 6
#: Passages that a shard compiles at once.
CHUNK = 20_000
#: An anchor with as many places is not sharded.
FREQUENT = 2_000
#: Size of the broadcast filter: 16 bits an anchor, never more than 32 MB.
MAX_FILTER_BITS = 1 << 28
#: Words whose hashes a worker remembers.
MEMORY = 400_000
BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_word_hashes: dict[bytes, int] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def _word_array(words: list[bytes]) -> np.ndarray:
    known = _word_hashes
    if len(known) > MEMORY:
        known.clear()
    try:
        return np.array([known[w] for w in words], np.uint64)
    except KeyError:
        for w in set(words).difference(known):
            known[w] = xxhash.xxh64_intdigest(w)
        return np.array([known[w] for w in words], np.uint64)


def _rolling(h: np.ndarray, size: int) -> np.ndarray:
    """Polynomial hash of every ``size`` consecutive words, by doubling."""
    out, have, power, pieces = None, 0, BASE, []
    block, length = h, 1
    while length <= size:
        if size & length:
            pieces.append((block, length, power))
        if length * 2 <= size:
            block = block[:-length] * power + block[length:]
            power = power * power
        length *= 2
    n = len(h) - size + 1
    for block, length, power in pieces:  # shortest first, each further right ones appended
        out = block[:n] if out is None else out * power + block[have : have + n]
        have += length
    return out


def _extreme(x: np.ndarray, size: int, pick) -> np.ndarray:
    """Running minimum or maximum over ``size`` entries."""
    block, length = x, 1
    while length * 2 <= size:
        block = pick(block[:-length], block[length:])
        length *= 2
    return pick(block[: len(x) - size + 1], block[size - length :][: len(x) - size + 1]) if size > length else block


def anchors(words: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The anchor each window names, and value and place of all phrases that are named."""
    phrases = mixed(_rolling(_word_array(words), PHRASE))
    span = window - PHRASE + 1
    named = _extreme(phrases, span, np.minimum)
    padded = np.concatenate([np.zeros(span - 1, np.uint64), named, np.zeros(span - 1, np.uint64)])
    places = np.nonzero(_extreme(padded, span, np.maximum) == phrases)[0]
    return named, phrases[places], places


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").split()


def _text(docs: DataFrame, text_col: str) -> Column:
    return F.coalesce(docs[text_col].cast("binary"), F.lit(b""))


def anchor_counts(docs: DataFrame, window: int, text_col: str = "text") -> DataFrame:
    """(anchor, n) of the phrases named at two places or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            found = [anchors(w, window)[1] for t in x["text"].to_pylist() if len(w := t.split()) >= window]
            value, n = np.unique(np.concatenate(found) if found else np.empty(0, np.uint64), return_counts=True)
            yield pa.record_batch({"anchor": value.view(np.int64), "n": n.astype(np.int64)})

    counted = docs.select(_text(docs, text_col).alias("text")).mapInArrow(run, "anchor long, n long")
    return counted.groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1")


def bloom(values: DataFrame) -> tuple[np.ndarray, int]:
    """A bit array over ``values`` (anchor), put together from slices that tasks fill."""
    n = values.count()
    bits = 1 << max(16, min(MAX_FILTER_BITS.bit_length() - 1, (16 * max(n, 1)).bit_length()))
    slices = min(64, bits >> 13)
    per = bits // slices

    def where(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            at = np.unique(np.concatenate(_bits(x["anchor"].to_numpy().view(np.uint64), bits)))
            yield pa.record_batch({"slice": (at // per).astype(np.int32), "bit": (at % per).astype(np.int32)})

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}
        for x in batches:
            which, bit = x["slice"].to_numpy(), x["bit"].to_numpy()
            for k in np.unique(which).tolist():
                own.setdefault(k, np.zeros(per, np.uint8))[bit[which == k]] = 1
        for k, v in own.items():
            yield pa.record_batch({"slice": np.array([k], np.int32), "bits": pa.array([np.packbits(v, bitorder="little").tobytes()], pa.binary())})

    spread = values.select("anchor").mapInArrow(where, "slice int, bit int").repartition(slices, "slice")
    out = np.zeros(bits // 8, np.uint8)
    for row in spread.mapInArrow(fill, "slice int, bits binary").collect():
        out[row["slice"] * per // 8 : (row["slice"] + 1) * per // 8] = np.frombuffer(row["bits"], np.uint8)
    return out, bits


def _bits(values: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64(bits - 1)
    return (values & mask).astype(np.int64), (mixed(values) & mask).astype(np.int64)


def in_filter(values: np.ndarray, held: np.ndarray, bits: int) -> np.ndarray:
    yes = np.ones(len(values), bool)
    for at in _bits(values, bits):
        yes &= (held[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
    return yes


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(docs[id_col].alias("d"), F.xxhash64(docs[text_col]).alias("h"), _text(docs, text_col).alias("text"))


def passages(docs: DataFrame, window: int, recurring: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(anchor, d, h, start, n, words, check, windows): the words of each run of ``n`` windows that name one anchor which may recur.

    Of a frequent anchor ``words`` is null: ``anchor`` and ``check`` are a hash of the passage, ``windows`` holds the hashes of its windows.
    """
    filters = bloom(recurring), bloom(recurring.where(F.col("n") >= FREQUENT))
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast([(held.tobytes(), bits) for held, bits in filters])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (mine, bits), (hot, hot_bits) = ((np.frombuffer(held, np.uint8), bits) for held, bits in shared.value)
        for x in batches:
            out: list[list] = [[] for _ in range(7)]
            for row, t in enumerate(x["text"].to_pylist()):
                words = t.split()
                if len(words) < window:
                    continue
                named = anchors(words, window)[0]
                starts = np.nonzero(np.concatenate([[True], named[1:] != named[:-1]]))[0]
                keys, ends = named[starts].view(np.int64), np.append(starts[1:], len(named))
                chosen = np.nonzero(in_filter(named[starts], mine, bits))[0]
                frequent = in_filter(named[starts[chosen]], hot, hot_bits)
                if frequent.any():
                    hashes = _word_array(words)
                    own = np.stack([mixed(_rolling(hashes, window)), mixed(_rolling(mixed(hashes), window))], axis=1)
                for a, s, e, often in zip(keys[chosen].tolist(), starts[chosen].tolist(), ends[chosen].tolist(), frequent.tolist(), strict=True):
                    for part in range(s, e, 64):  # a periodic text names one anchor throughout
                        end = min(e, part + 64)
                        text = b" ".join(words[part : end + window - 1])
                        if often:
                            low, high = np.frombuffer(xxhash.xxh3_128_digest(text), np.int64).tolist()
                            values = low, row, part, end - part, None, high, own[part:end].tobytes()
                        else:
                            values = a, row, part, end - part, text, 0, None
                        for column, value in zip(out, values, strict=True):
                            column.append(value)
            of = pa.array(out[1], pa.int64())
            columns = [pa.array(out[0], pa.int64()), x["d"].take(of), x["h"].take(of), pa.array(out[2], pa.int32()), pa.array(out[3], pa.int32()), pa.array(out[4], pa.binary()), pa.array(out[5], pa.int64()), pa.array(out[6], pa.binary())]
            yield pa.record_batch(columns, names=["anchor", "d", "h", "start", "n", "words", "check", "windows"])

    return _keyed(docs, id_col, text_col).mapInArrow(run, f"anchor long, d {kind}, h long, start int, n int, words binary, check long, windows binary")


def _place(d, h: int, start: int) -> tuple:
    return (0, 0, h, start) if d is None else (1, d, h, start)


def _located(rows: list[tuple], window: int) -> list[tuple]:
    """(row, s, n): runs of windows of passages (anchor, d, h, start, words) that also start earlier. ``s`` counts from the document's start."""
    several: list[tuple[int, list[bytes]]] = []
    out: list[tuple] = []
    for _, group in itertools.groupby(sorted(range(len(rows)), key=lambda k: (rows[k][0], *_place(*rows[k][1:4]))), key=lambda k: rows[k][0]):
        # where the very same words stood before, all windows of the passage did
        found: dict[bytes, int] = {}
        for k in group:
            earlier = found.setdefault(rows[k][4], k)
            if rows[earlier][1:4] != rows[k][1:4]:
                out.append((k, rows[k][3], rows[k][4].count(b" ") + 2 - window))
        parts = [(k, w.split()) for w, k in found.items()]
        # a passage alone with its anchor matters only if a window comes twice in it, which repeats that many words
        if len(parts) > 1 or len(set(parts[0][1])) <= len(parts[0][1]) - window:
            several += parts
    if not several:
        return out
    # confirm: windows whose hash comes twice
    hashes = [_rolling(_word_array(words), window) for _, words in several]
    values, counts = np.unique(np.concatenate(hashes), return_counts=True)
    twice = values[counts > 1]
    if not len(twice):
        return out
    # compile: the words of each such window
    numbers: dict[bytes, int] = {}
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    compiled: set[int] = set()
    streams = []
    for (k, words), own in zip(several, hashes, strict=True):
        at = np.minimum(np.searchsorted(twice, own), len(twice) - 1)
        marked = np.nonzero(twice[at] == own)[0]
        if len(marked):
            streams.append((k, words))
        for j in marked.tolist():
            key = tuple([numbers.setdefault(w, len(numbers) + 1) for w in words[j : j + window]])
            if int(own[j]) not in compiled or not automaton.exists(key):
                compiled.add(int(own[j]))
                automaton.add_word(key, len(automaton))
    automaton.make_automaton()
    # stream: every occurrence, in the order of documents
    number, first = numbers.get, {}
    for k, words in sorted(streams, key=lambda r: _place(*rows[r[0]][1:4])):
        (d, h, start), n, last = rows[k][1:4], 0, -1
        for end, pattern in automaton.iter(tuple([number(w, 0) for w in words])):
            at = end - window + 1
            if first.setdefault(pattern, (d, h, start + at)) == (d, h, start + at):
                continue
            if n and last + 1 == at:
                n += 1
            else:
                if n:
                    out.append((k, start + last - n + 1, n))
                n = 1
            last = at
        if n:
            out.append((k, start + last - n + 1, n))
    return out


def located(found: DataFrame, window: int) -> DataFrame:
    """(d, h, s, n): runs of windows in the sharded passages that also start earlier."""
    kind = found.schema["d"].dataType.simpleString()
    rows = found.where("words is not null").select("anchor", "d", "h", "start", "words").repartition("anchor").sortWithinPartitions("anchor")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def emit() -> pa.RecordBatch:
            got = _located(held, window)
            d = pa.array([held[k][1] for k, _, _ in got], ids)
            return pa.record_batch([d, pa.array([held[k][2] for k, _, _ in got], pa.int64()), pa.array([s for _, s, _ in got], pa.int32()), pa.array([n for _, _, n in got], pa.int32())], names=["d", "h", "s", "n"])

        for x in batches:
            ids = x["d"].type
            for row in zip(*(x[c].to_pylist() for c in ("anchor", "d", "h", "start", "words")), strict=True):
                if len(held) >= CHUNK and row[0] != held[-1][0]:
                    yield emit()
                    held = []
                held.append(row)
        if held:
            yield emit()

    return rows.mapInArrow(run, f"d {kind}, h long, s int, n int")


def frequent_runs(found: DataFrame, window: int) -> DataFrame:
    """(d, h, s, n): runs of windows that also start earlier, of frequent anchors.

    Equal passages meet in partial aggregates for their first place, and the others are joined to it, one row a
    passage. The windows of the first ones then meet in the same way, for passages that differ but share windows.
    """
    rows = found.where("words is null").select("anchor", "check", "d", "h", "start", "n", "windows")
    first = rows.groupBy("anchor", "check").agg(F.min(F.struct("d", "h", "start", "windows")).alias("first"), F.count("*").alias("times"))
    first = written(first, "frequent")
    known = first.where("times > 1").select("anchor", "check", F.struct("first.d", "first.h", "first.start").alias("place"))
    copies = rows.drop("windows").join(known, ["anchor", "check"]).where(F.struct("d", "h", "start") > F.col("place")).select("d", "h", F.col("start").alias("s"), "n")
    cut = F.posexplode(F.transform(F.sequence(F.lit(0), (F.octet_length("first.windows") / 16 - 1).cast("int")), lambda i: F.substring(F.col("first.windows"), i * 16 + 1, F.lit(16))))
    each = first.select("first.d", "first.h", "first.start", cut.alias("at", "key")).select("key", "d", "h", (F.col("start") + F.col("at")).alias("s"))
    least = each.groupBy("key").agg(F.min(F.struct("d", "h", "s")).alias("place"), F.count("*").alias("times")).where("times > 1")
    later = each.join(least, "key").where(F.struct("d", "h", "s") > F.col("place")).select("d", "h", "s", F.lit(1).alias("n"))
    return copies.union(later)


def removed_words(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(d, h, runs): per document, runs (s, n) of windows whose words also start earlier."""
    if window < PHRASE:
        raise ValueError(f"windows need {PHRASE} words or more")
    recurring = written(anchor_counts(docs, window, text_col), "anchors")
    found = written(passages(docs, window, recurring, id_col, text_col), "passages")
    drop_written(recurring)
    runs = written(located(found, window).union(frequent_runs(found, window)), "runs")
    drop_written(found)
    return runs.distinct().groupBy("d", "h").agg(F.collect_list(F.struct("s", "n")).alias("runs"))


def kept_words(words: list[bytes], starts: np.ndarray, counts: np.ndarray, window: int) -> list[bytes]:
    """Words outside the runs of ``counts`` windows that begin at ``starts``."""
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + (counts + (window - 1)), -1)
    return [w for w, c in zip(words, np.cumsum(edge).tolist(), strict=False) if not c]


def substring_dedup(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs``, the text reduced to the words that stay, joined by one space; null stays null.

    Adds ``_n_words`` and ``_n_removed``, in place of columns of these names.
    """
    gone = removed_words(docs, window, id_col, text_col)
    rest = F.struct(*[docs[c].alias(f"c{k}") for k, c in enumerate(docs.columns) if c != text_col])
    rows = docs.select(docs[id_col].alias("id"), F.xxhash64(docs[text_col]).alias("k"), docs[text_col].cast("binary").alias("text"), rest.alias("rest"))
    rows = rows.join(gone, rows["id"].eqNullSafe(gone["d"]) & (rows["k"] == gone["h"]), "left").select("rest", "text", "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            out: tuple[list, list, list] = ([], [], [])
            for t, runs in zip(x["text"].to_pylist(), x["runs"], strict=True):
                kept = words = (t or b"").split()
                if runs.is_valid:
                    kept = kept_words(words, *(runs.values.field(c).to_numpy() for c in "sn"), window)
                text = None if t is None else b" ".join(kept).decode("utf-8")
                for column, value in zip(out, (len(words), len(words) - len(kept), text), strict=True):
                    column.append(value)
            counts = [pa.array(c, pa.int64()) for c in out[:2]]
            yield pa.record_batch([x["rest"], *counts, pa.array(out[2], pa.string())], names=["rest", "n_words", "n_removed", "kept"])

    schema = T.StructType([rows.schema["rest"], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])
    done = rows.mapInArrow(run, schema)
    columns = [(F.col("kept") if c == text_col else F.col("rest").getField(f"c{k}")).alias(c) for k, c in enumerate(docs.columns) if c not in ("_n_words", "_n_removed")]
    return done.select(*columns, F.col("n_words").alias("_n_words"), F.col("n_removed").alias("_n_removed"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", F.col("_n_words").alias("n_words"), F.col("_n_removed").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def brute_force(rows: list[tuple[int, str | None]], window: int = 20) -> dict[int, tuple[int, int, str]]:
    """The same by definition, for tests."""
    first: dict[tuple, tuple] = {}
    texts = {d: (t or "").encode().split() for d, t in rows}
    for d in sorted(texts):
        for i in range(len(texts[d]) - window + 1):
            first.setdefault(tuple(texts[d][i : i + window]), (d, i))
    out = {}
    for d, words in texts.items():
        starts = [i for i in range(len(words) - window + 1) if first[tuple(words[i : i + window])] < (d, i)]
        kept = kept_words(words, np.array(starts, np.int64), np.ones(len(starts), np.int64), window)
        out[d] = len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()
    return out
