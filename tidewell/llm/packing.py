"""Operator 3, best-fit packing in bulk-synchronous rounds.

Documents are tokenized, closed with id 0, and cut into pieces only where longer than a sequence. A
piece of over half a sequence opens one. The others go in bands of lengths, longest first, each in
rounds of DataFrame steps over rows:

1. Range-sort. Pieces of the band and places in the gaps of open sequences stand in one order of size.
2. Sweep. Each place finds the longest piece that fits it and that no narrower place has found (``matched``).
   Every range pairs its own rows; what ranges leave over meets by depth, a prefix sum over ranges (``_across``).
3. Conflicts among equal sizes are resolved by rank in the order.
4. Gaps are updated, and the round repeats with what is left; once less than ``WORTH`` of the pieces find a
   place, the rest opens new sequences, as many to each as fit.

The driver sees counts a length and a gap, by which it knows empty bands and the end of a band. Ranges split a
length however often it comes. Bands and rounds number about fifteen, whatever the corpus.

Tokenizing remembers words: in this vocabulary a text's ids are those of its units, one after
another, and white space always ends a unit. Each new unit goes through the tokenizer itself.

Cases. Null text: empty; an empty text is the one id 0. Repeated rows are packed each. Null ids are
kept. Texts are tokenized whole. An empty table gives no rows.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewell.llm.common import buckets_for, documents, written

#: Words that a worker remembers before it starts anew; what it knew before serves once more.
MEMORY = 300_000
#: Characters whose words are looked up together.
AT_ONCE = 1 << 20
ID_BYTES = 4
#: A round that places a smaller share of its pieces is the last before new sequences are opened.
WORTH = 1 / 2
PIECE, PLACE = 0, 1


class WordTokenizer:
    """Ids of whole texts as little-endian unsigned 32-bit bytes.

    Texts of plain characters (below U+0250, no control characters, no special token's beginning) are cut into
    the tokenizer's own units by its own pattern; new units are encoded many at once and told apart
    by the mark of a word's end. Other texts are cut at spaces. Every unit's ids come from the
    tokenizer and are remembered.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {"": b""}
        self.before: dict[str, bytes] = {}
        parts = json.loads(self.tokenizer.to_str())["pre_tokenizer"]["pretokenizers"]
        pattern = next(p["pattern"]["Regex"] for p in parts if p["type"] == "Split")
        for kind in "LN":  # the classes of plain characters, spelt out for the quicker matcher
            plain = {x for c in range(0x250) for x in (chr(c), *chr(c).lower())}  # some of them have small letters further up
            members = sorted(x for x in plain if unicodedata.category(x)[0] == kind)
            pattern = pattern.replace(f"\\p{{{kind}}}", "".join(members))
        self.units = re.compile(pattern).findall
        self.unusual = re.compile("[^\t\n\r -~\u00a1-\u012f\u0131-\u024f]|<\\|").search
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def _learn(self, words: list[str]) -> None:
        got = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        self.known.update((w, np.array(e.ids, "<u4").tobytes()) for w, e in zip(words, got, strict=True))

    def _learn_units(self, units: list[str]) -> None:
        ids = np.array(self.tokenizer.encode(" ".join(units), add_special_tokens=False).ids, "<u4")
        data, cuts = ids.tobytes(), ((np.nonzero(self.ends[ids])[0] + 1) * ID_BYTES).tolist()
        if len(cuts) != len(units):  # some unit came apart
            self._learn(units)
        else:
            self.known.update((u, data[s:e]) for u, s, e in zip(units, [0, *cuts], cuts, strict=False))

    def ids_of(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > MEMORY:
            self.known, self.before = {"": b""}, self.known
        odd = [bool(self.unusual(t)) for t in texts]
        words = [t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") if o else self.units(t.lower()) for t, o in zip(texts, odd, strict=True)]
        for which, learn in ((False, self._learn_units), (True, self._learn)):
            fresh = set().union(*[w for w, o in zip(words, odd, strict=True) if o == which]).difference(self.known)
            again = fresh & self.before.keys()
            self.known.update((w, self.before[w]) for w in again)
            fresh -= again
            if fresh:
                learn(list(fresh))
        known = self.known.__getitem__
        return [b"".join(map(known, w)) for w in words]

    def ids(self, text: str) -> bytes:
        return self.ids_of([text])[0]


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def pieces(docs: DataFrame, vocabulary: str, size: int = 2048, closing: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32) of every document's pieces."""
    kind = docs.schema[id_col].dataType.simpleString()
    end, width = closing.to_bytes(ID_BYTES, "little"), size * ID_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def encode(texts: pa.StringArray) -> Iterator[bytes]:
            some: list[str] = []
            for t in texts:
                some.append(t.as_py() or "")
                if sum(map(len, some)) >= AT_ONCE or len(some) >= 256:
                    yield from tokenizer(vocabulary).ids_of(some)
                    some = []
            if some:
                yield from tokenizer(vocabulary).ids_of(some)

        for x in batches:
            of, piece, length, crc = [], [], [], []
            for k, ids in enumerate(encode(x["text"])):
                ids += end
                for p, s in enumerate(range(0, len(ids), width)):
                    part = ids[s : s + width]
                    of.append(k), piece.append(p), length.append(len(part) // ID_BYTES), crc.append(zlib.crc32(part))
            columns = [x["id"].take(pa.array(of, pa.int64())), pa.array(piece, pa.int32()), pa.array([p * size for p in piece], pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            yield pa.record_batch(columns, names=["id", "piece", "start", "length", "ids_crc32"])

    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long")


def bands(size: int) -> list[tuple[int, int]]:
    """(low, high] ranges of lengths, longest first: 1/2, 1/3, 1/4 of a sequence, then each two thirds of the last, below 64 a third."""
    edges = [size, size // 2, size // 3, size // 4]
    while edges[-1] > 0:
        edges.append(edges[-1] * 2 // 3 if edges[-1] >= 64 else edges[-1] // 3)
    return [(low, high) for high, low in itertools.pairwise(edges) if high > low]


def _ranged(rows: DataFrame, number: int, *order: Column) -> DataFrame:
    """``rows`` in one range order: partitions hold ranges of it, each sorted."""
    n = buckets_for(number, least=1)
    return (rows.repartition(1) if n == 1 else rows.repartitionByRange(n, *order)).sortWithinPartitions(*order)


def offered(gaps: DataFrame, least: int, most: int, number: int, wide: int) -> DataFrame:
    """(sequence_id, gap, part, width): places for pieces of ``least`` to ``most`` tokens in the gaps that have some.

    A gap narrower than ``most`` is one place of its own width. Each of the ``wide`` others offers as many of
    width ``most`` as fit, but together not many more than there are pieces.
    """
    share = -(-2 * number // max(wide, 1))
    fit = F.when(F.col("gap") < most, 1).otherwise(F.least(F.floor(F.col("gap") / most), F.lit(share)))
    part = F.explode(F.sequence(F.lit(1).cast("long"), fit.cast("long")))
    return gaps.where(F.col("gap") >= least).select("sequence_id", "gap", part.alias("part")).withColumn("width", F.least(F.col("gap"), F.lit(most)))


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pair the places and pieces of one range. What is left over are places that only smaller ranges can serve, then pieces for wider ones."""
    stack: list[tuple] = []
    out: list[tuple] = []
    places = 0
    here = TaskContext.get().partitionId()
    for x in batches:
        for length, kind, key in zip(*(x[c].to_pylist() for c in ("length", "kind", "key")), strict=True):
            if kind == PIECE:
                stack.append((key, length))
            elif stack:
                out.append((*stack.pop(), key, None, None))
            else:
                out.append((None, None, key, here, places))
                places += 1
    out += [(*piece, None, here, n) for n, piece in enumerate(stack)]
    kinds = pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()
    columns = zip(*out, strict=True) if out else [[]] * len(kinds)
    yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["k", "length", "sequence_id", "range", "nth"])


def _across(left: DataFrame) -> DataFrame:
    """Pair what the ranges have left over: a place goes with the piece that raised the depth to where the place stands.

    The depth before a range is a sum over smaller ranges; at one depth every range has one place and one
    piece at most, so what meets there is bounded by the number of ranges.
    """
    piece = F.col("k").isNotNull()
    per = left.groupBy("range").agg(F.count_if(~piece).alias("places"), F.count_if(piece).alias("pieces"))
    w = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("depth", F.coalesce(F.sum(F.col("pieces") - F.col("places")).over(w), F.lit(0)))
    rows = left.join(F.broadcast(per), "range")  # a row a range
    level = F.when(piece, F.col("depth") - F.col("places") + F.col("nth") + 1).otherwise(F.col("depth") - F.col("nth"))
    w = Window.partitionBy("level").orderBy("range", piece)
    rows = rows.withColumn("level", level).withColumn("taken", F.when(F.lead("k").over(w).isNull(), F.lead("sequence_id").over(w)))
    return rows.where(piece).select("k", "length", F.col("taken").alias("sequence_id"))


def matched(items: DataFrame, places: DataFrame, number: int) -> DataFrame:
    """``items`` (k, length) with the sequence that each has found, or null.

    The sweep goes over pieces and places in one range order by size. A place takes the longest piece that fits and
    that no narrower place has taken; equal sizes are told apart by their rank in that order.
    """
    events = items.select("length", F.lit(PIECE).alias("kind"), F.lit(0).cast("long").alias("gap"), F.col("k").alias("key"), F.lit(0).cast("long").alias("part"))
    events = events.union(places.select("width", F.lit(PLACE), "gap", "sequence_id", "part"))
    order = [F.col(c) for c in ("length", "kind", "gap", "key", "part")]
    swept = _ranged(events, number, *order).mapInArrow(_sweep, "k long, length long, sequence_id long, range int, nth long")
    if buckets_for(number, least=1) == 1:
        return swept.where("k is not null").select("k", "length", "sequence_id")
    swept = written(swept, "swept")
    return swept.where("range is null").select("k", "length", "sequence_id").union(_across(swept.where("range is not null")))


def opened(items: DataFrame, each: int, number: int, turn: int) -> DataFrame:
    """``items`` in new sequences of ``each``, neighbours by length together; the last of a range may hold fewer.

    Their ids are negative, those that ``pack`` gives to long pieces are not: the two can't meet, however many partitions there are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, seen = (turn << 44) + (TaskContext.get().partitionId() << 28), 0
        for x in batches:
            ids = -1 - (base + (seen + np.arange(x.num_rows)) // each)
            seen += x.num_rows
            yield pa.record_batch([x["k"], x["length"], pa.array(ids, pa.int64())], names=["k", "length", "sequence_id"])

    return _ranged(items.select("k", "length"), number, F.desc("length"), F.col("k")).mapInArrow(run, "k long, length long, sequence_id long")


def pack(cut: DataFrame, size: int = 2048) -> DataFrame:
    """``cut`` (id, piece, length, ...) with sequence_id and offset."""
    fields = cut.columns
    rows = written(cut.withColumn("k", F.monotonically_increasing_id()), "pieces")
    items = rows.select("k", "length")
    counts = {r["length"]: r["n"] for r in items.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``size`` rows; says which bands are empty
    # a piece over half a sequence shares it with no other such piece, so each opens its own
    done = [items.where(F.col("length") > size // 2).select("k", "length", F.col("k").alias("sequence_id"))]
    gaps, turn = done[0].select("sequence_id", (size - F.col("length")).alias("gap")).where("gap > 0"), 0
    widths = {size - n: c for n, c in counts.items() if size // 2 < n < size}
    for low, high in bands(size)[1:]:
        left = items.where((F.col("length") > low) & (F.col("length") <= high))
        inside = {n: c for n, c in counts.items() if low < n <= high}
        number, least, most = sum(inside.values()), min(inside, default=0), max(inside, default=0)
        while number:
            turn += 1
            wide = sum(c for g, c in widths.items() if g >= most)
            found = written(matched(left, offered(gaps, least, most, number, wide), number), f"matched-{turn}")
            put, left = found.where("sequence_id is not null"), found.where("sequence_id is null").select("k", "length")
            rest = {r["length"]: r["n"] for r in left.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``size`` rows
            done.append(put)
            changed = [gaps, put.groupBy("sequence_id").agg((-F.sum("length")).alias("gap"))]
            last = sum(rest.values()) > number * (1 - WORTH)
            if rest and last:  # gaps give out: the rest opens sequences
                new = written(opened(left, size // max(rest), sum(rest.values()), turn), f"opened-{turn}")
                done.append(new)
                changed += [new.select("sequence_id", (size - F.col("length")).alias("gap")) if size // max(rest) == 1 else new.groupBy("sequence_id").agg((size - F.sum("length")).alias("gap"))]
                rest = {}
            after = functools.reduce(DataFrame.union, changed).groupBy("sequence_id").agg(F.sum("gap").alias("gap")).where("gap > 0")
            gaps = written(after, f"gaps-{turn}")
            widths = {r["gap"]: r["n"] for r in gaps.groupBy("gap").agg(F.count("*").alias("n")).collect()}  # at most ``size`` rows
            number, least, most = sum(rest.values()), min(rest, default=0), max(rest, default=0)
    placed = functools.reduce(DataFrame.unionByName, done)
    both = rows.join(placed.select("k", "sequence_id"), "k")
    offset = F.sum("length").over(Window.partitionBy("sequence_id").orderBy(F.desc("length"), "k").rowsBetween(Window.unboundedPreceding, -1))
    return both.select(*fields, "sequence_id", F.coalesce(offset, F.lit(0)).cast("long").alias("offset"))


def pack_documents(docs: DataFrame, vocabulary: str, size: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return pack(pieces(docs, vocabulary, size, id_col=id_col, text_col=text_col), size)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_packing(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    out = pack_documents(documents(spark, sf_dir), vocabulary or default_vocabulary())
    return out.select(F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
