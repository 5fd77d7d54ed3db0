"""Operator 12, benchmark decontamination by Wu-Manber multi-pattern search.

Texts are brought to words between single spaces, with one before and after; a window of benchmark words is such
a string too, so that a window occurs among a document's words exactly where its bytes occur in the
document's. Windows are searched by their first ``m`` bytes, ``m`` being the length of the shortest:

- The shift table says, for a block of ``b`` bytes, how far the search may move on when the block stands at the end of its
  place: as far as the block is from the end of the first ``m`` bytes of any window, ``m - b + 1`` where no window has it.
- Where it may not move, the block is the suffix of the first ``m`` bytes of some windows; these are in its bucket.
- Strings of the lengths in the bucket are compared with its windows byte by byte.

Windows go in classes by length, so that one short item doesn't shorten everyone's shifts.

Documents are streamed once and never shuffled. The windows, each once with its items, are dealt into blocks of
bounded size by a hash; each block is broadcast in turn, and only documents it hits send on what it found. With
one block, the usual case, one pass gives the whole result.

Cases. A null text has no words, and so do texts of separators alone; items without words have no windows and
are in no list. Windows that several items share count for each. Equal items with equal ids count once. A null
``item_id`` is left out of the lists, though its windows hit. Documents that repeat each other each have their row; ids
may be of any type, null among them. Very long texts are searched whole. Empty tables give no
hits or no rows. Columns of other names pass by.
"""

from __future__ import annotations

import functools
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewell.llm.common import documents, table, written

WINDOW = 10
#: Bytes of windows and item ids that are broadcast at once.
BLOCK_BYTES = 16 << 20
#: Windows of at least so many bytes are searched together, those below by the next bound.
CLASSES = (32, 16, 8, 4, 0)

#: A-Z to a-z, and the separators, all of them below 0x80, to spaces.
NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(NORMAL).split()


class WuManber:
    """Where any of ``windows`` stands in a normalised text."""

    def __init__(self, windows: Iterable[bytes]) -> None:
        self.windows = set(windows)
        self.m = m = min(map(len, self.windows))
        self.b = b = max(1, m // 3)
        shift: dict[bytes, int] = {}
        bucket: dict[bytes, set[int]] = defaultdict(set)
        for w in self.windows:
            for end in range(b, m + 1):
                block = w[end - b : end]
                if m - end < shift.get(block, m):
                    shift[block] = m - end
            bucket[w[m - b : m]].add(len(w))
        self.shift = shift
        self.bucket = {k: sorted(v) for k, v in bucket.items()}

    def search(self, text: bytes) -> Iterator[tuple[int, bytes]]:
        """(start, window) in order of starts."""
        b, before, most, shift, windows, n = self.b, self.m - self.b, self.m - self.b + 1, self.shift.get, self.windows, len(text)
        at, last = before, n - b  # where the block stands
        while at <= last:
            block = text[at : at + b]
            move = shift(block, most)
            if not move:
                start = at - before
                for length in self.bucket[block]:
                    found = text[start : start + length]
                    if len(found) == length and found in windows:
                        yield start, found
                move = 1
            at += move


class Searcher:
    """The windows of one block and their items."""

    def __init__(self, rows: list[tuple[bytes, list[str]]]) -> None:
        self.items = {b" " + w + b" ": (w.count(b" ") + 1, items) for w, items in rows}
        classes: dict[int, list[bytes]] = defaultdict(list)
        for w in self.items:
            classes[next(c for c in CLASSES if len(w) >= c)].append(w)
        self.tables = [WuManber(c) for c in classes.values()]

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Disjoint ranges of hit words and the items that have windows among them."""
        text = b" " + b" ".join(words) + b" "
        places: list[tuple[int, int]] = []
        items: set[str] = set()
        for t in self.tables:
            at = word = 0
            for start, found in t.search(text):
                word += text.count(b" ", at, start)
                at = start
                length, of = self.items[found]
                places.append((word, word + length))
                items.update(of)
        return merged(places), items


def merged(places: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(places):
        if out and start <= out[-1][1]:
            out[-1] = out[-1][0], max(end, out[-1][1])
        else:
            out.append((start, end))
    return out


def _lowered_words(text: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.regexp_extract_all(F.translate(text, upper, upper.lower()), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), 0)


def windows(items: DataFrame, size: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(window, item): every ``size`` consecutive words of an item, or all of fewer, once an item."""
    words = items.select(items[id_col].cast("string").alias("item"), _lowered_words(items[text_col]).alias("words")).where(F.size("words") > 0)
    starts = F.explode(F.sequence(F.lit(1), F.greatest(F.size("words") - (size - 1), F.lit(1))))
    return words.select("item", starts.alias("i"), "words").select(F.array_join(F.slice("words", F.col("i"), size), " ").alias("window"), "item").distinct()


def _blocks(found: DataFrame, most: int) -> Iterator[list[tuple[bytes, list[str]]]]:
    """The windows in blocks of about ``most`` bytes, each with its items; one block at a time is on the driver."""
    total = found.agg(F.sum(F.octet_length("window") + F.coalesce(F.octet_length("item"), F.lit(0)) + 32)).first()[0] or 0
    n = max(1, -(-total // most))
    dealt = found.withColumn("block", F.pmod(F.xxhash64("window", "item"), F.lit(n)))
    for k in range(n):
        rows = dealt.where(F.col("block") == k).groupBy(F.col("window").cast("binary").alias("window")).agg(F.collect_list("item").alias("items"))
        yield [(bytes(r["window"]), r["items"]) for r in rows.collect()]


@functools.lru_cache(maxsize=2)
def _searcher(broadcast) -> Searcher | None:
    return Searcher(broadcast.value) if broadcast.value else None


def _pass(docs: DataFrame, broadcast, all_rows: bool) -> DataFrame:
    """(..., n_words, ranges, items) of the documents a block hits, or of all."""
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.drop("text").schema)
    ranges = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = _searcher(broadcast)
        for x in batches:
            at, n_words, places, items = [], [], [], []
            for k, text in enumerate(x["text"]):
                words = words_of(text.as_py())
                hit, of = searcher.hits(words) if searcher and words else ([], set())
                if hit or all_rows:
                    at.append(k), n_words.append(len(words)), places.append([{"start": s, "end": e} for s, e in hit]), items.append(sorted(of))
            rest = [x[c].take(pa.array(at, pa.int64())) for c in x.schema.names if c != "text"]
            names = [c for c in x.schema.names if c != "text"]
            yield pa.record_batch([*rest, pa.array(n_words, pa.int64()), pa.array(places, ranges), pa.array(items, pa.list_(pa.string()))], names=[*names, "n_words", "ranges", "items"])

    return docs.mapInArrow(run, f"{kinds}, n_words long, ranges array<struct<start:long,end:long>>, items array<string>")


def decontaminate(docs: DataFrame, items: DataFrame, size: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, n_words, n_hit, ranges, items): per document its words, those inside benchmark windows, where they stand, and the items' ids in order."""
    sc = docs.sparkSession.sparkContext
    found = written(windows(items, size, item_col, item_text), "windows")
    each = docs.select(docs[id_col].alias("id"), docs[text_col].cast("binary").alias("text"))
    blocks = _blocks(found, block_bytes)
    rows, following = next(blocks), next(blocks, None)
    if following is None:
        out = _pass(each, sc.broadcast(rows), all_rows=True)
    else:
        # rows of equal id and text have equal results, so this key is enough to bring them together
        keyed = each.select("id", F.xxhash64("text").alias("h"), "text")
        parts = []
        while rows is not None:
            sent = sc.broadcast(rows)
            parts.append(written(_pass(keyed, sent, all_rows=False), "hits"))
            sent.destroy()
            rows, following = following, next(blocks, None)
        hits = functools.reduce(DataFrame.union, parts).distinct()
        w = Window.partitionBy("id", "h").orderBy("start", "end")
        ranges = hits.select("id", "h", F.inline("ranges"))
        fresh = F.coalesce(F.col("start") > F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
        ranges = ranges.withColumn("island", F.sum(fresh.cast("long")).over(w)).groupBy("id", "h", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
        ranges = ranges.groupBy("id", "h").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("r"), F.lit(None).cast("array<string>").alias("i"))
        found = hits.groupBy("id", "h").agg(F.lit(None).cast(ranges.schema["r"].dataType).alias("r"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("i"))
        hits = ranges.union(found).groupBy(F.col("id").alias("hid"), F.col("h").alias("hh")).agg(F.first("r", True).alias("r"), F.first("i", True).alias("i"))
        whole = keyed.select("id", "h", F.greatest(F.size(_lowered_words(F.col("text").cast("string"))), F.lit(0)).cast("long").alias("n_words"))
        both = whole.join(hits, whole["id"].eqNullSafe(hits["hid"]) & (whole["h"] == hits["hh"]), "left")
        empty = "array<struct<start:bigint,end:bigint>>", "array<string>"
        out = both.select("id", "n_words", *[F.coalesce(c, F.expr(f"cast(array() as {e})")).alias(name) for c, name, e in zip("ri", ("ranges", "items"), empty, strict=True)])
    n_hit = F.aggregate("ranges", F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["start"])
    return out.select("id", "n_words", n_hit.alias("n_hit"), "ranges", "items")


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    return out.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


ORACLE = """
WITH docs AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words
  FROM documents
), items AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words
  FROM benchmark WHERE text IS NOT NULL
), starts AS (
  SELECT item, words, least(len(words), 10) AS k, unnest(range(1, greatest(len(words) - 8, 2))) AS i FROM items WHERE len(words) > 0
), windows AS (
  SELECT DISTINCT item, k, array_to_string(list_slice(words, i, i + k - 1), ' ') AS w FROM starts
), places AS (
  SELECT r, words, k, unnest(range(1, len(words) - k + 2)) AS i FROM docs, (SELECT DISTINCT k FROM windows) WHERE len(words) >= k
), hits AS (
  SELECT r, item, p.k, i FROM (SELECT r, k, i, array_to_string(list_slice(words, i, i + k - 1), ' ') AS w FROM places) p JOIN windows USING (k, w)
), hit_words AS (
  SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest(range(i, i + k)) AS j FROM hits) GROUP BY r
), hit_items AS (
  SELECT r, count(item) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(h.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(x.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(x.ids, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit_words h USING (r) LEFT JOIN hit_items x USING (r)
"""
