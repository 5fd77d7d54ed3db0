"""Operator 6, SimHash near-dedup over an inverted index of byte positions.

The fingerprint of a text has a bit set where over half its word shingles' XXH64 values have it.
Fingerprints at ``max_bits`` or fewer differing bits differ in at most that many of their eight
bytes, so a linked pair shares at least ``8 - max_bits`` bytes at their positions: the guaranteed
minimum. The inverted index leads from bytes at their positions to fingerprints. Posting lists of single
bytes hold 1/256 of all fingerprints, and pairs tallied over those would grow with the square of the corpus, so
the index holds intersections of posting lists that no linked pair can miss: the positions are dealt into
``max_bits + 2`` blocks, of which a linked pair shares two at least, and every two blocks make a list
(six lists of four bytes at two bits). In a list the shared positional bytes of its members are tallied, those
that reach the minimum are retained and verified by their differing bits. A list of over ``LONG_LIST`` members is
split by the bytes it has not yet looked at: a linked pair shares so many of them that it meets again in
the list of some choice of that size, which leaves ``8 * max_bits`` free bits and hence a bounded list (65,536 at
two bits). A list is walked from member to member instead of forming pairs and emits a spanning forest of
the links, which keeps all connections.

Copies share a fingerprint and are collapsed before the index, so a group of any size is one entry.
Components of linked fingerprints come from star contraction.

Cases. Null and empty texts and texts without words have fingerprint zero, linked like any other. Fewer words
than a shingle: the whole sequence is the one shingle. Repeated rows are returned as often as they
come. A null ``doc_id`` never names a component unless no other member has an id.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import documents, first_rows, text_hash, written
from tidewell.llm.components import components

UPPER, LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
FOLD = bytes.maketrans(UPPER, LOWER)
#: Shingles whose bits are counted at once; bounds memory on long texts.
BLOCK = 1 << 15
#: A longer list is split by further bytes; in one that is still longer, neighbours may be looked up instead of compared.
LONG_LIST = 1 << 12


def words_of(text: bytes) -> list[bytes]:
    """Runs free of space and control characters 9 to 13, A-Z in lower case. ``bytes.split`` has just these separators."""
    return text.translate(FOLD).split()


def shingle_hashes(words: list[bytes], size: int, seed: int) -> np.ndarray:
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed)], np.uint64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    return np.array([digest(join(words[i : i + size]), seed) for i in range(len(words) - size + 1)], np.uint64)


def fingerprint(text: bytes, size: int = 3, seed: int = 42) -> int:
    return fingerprint_of(shingle_hashes(words_of(text), size, seed))


def fingerprint_of(hashes: np.ndarray) -> int:
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), BLOCK):
        part = hashes[k : k + BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, h) of every row; ``fp`` as a signed long, ``h`` the hash of the text."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            fps = np.array([fingerprint(t, size, seed) for t in x["text"].to_pylist()], np.uint64).view(np.int64)
            yield pa.record_batch([x["id"], pa.array(fps), x["h"]], names=["id", "fp", "h"])

    text = F.coalesce(docs[text_col].cast("binary"), F.lit(b""))
    return docs.select(docs[id_col].alias("id"), text.alias("text"), text_hash(docs[text_col]).alias("h")).mapInArrow(run, f"id {kind}, fp long, h long")


def forest(values: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among ``values`` (distinct, unsigned): never more edges than values.

    A search from value to value tallies the bytes that each reached one shares with those not yet reached, and
    verifies the bits of those with ``8 - max_bits`` or more. Where that is dearer, long lists look up
    each value with every choice of up to ``max_bits`` bits flipped.
    """
    n = len(values)
    free = int(np.bitwise_or.reduce(values ^ values[0]))
    bits = [k for k in range(64) if free >> k & 1]
    if n > LONG_LIST and sum(math.comb(len(bits), r) for r in range(1, max_bits + 1)) * 16 < n:
        return _looked_up(np.sort(values), bits, max_bits)
    edges, left = [], values
    while len(left):
        reached, left = [left[0]], left[1:]
        while reached and len(left):
            v = reached.pop()
            differing = left ^ v
            near = (differing.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1) >= 8 - max_bits
            near[near] = np.bitwise_count(differing[near]) <= max_bits
            if near.any():
                found = left[near]
                left = left[~near]
                edges += [(int(v), w) for w in found.tolist()]
                reached += list(found)
    return edges


def _looked_up(values: np.ndarray, bits: list[int], max_bits: int) -> list[tuple[int, int]]:
    n, parent, edges = len(values), np.arange(len(values)), []

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for r in range(1, max_bits + 1):
        for chosen in itertools.combinations(bits, r):
            other = values ^ np.uint64(sum(1 << k for k in chosen))
            at = np.minimum(np.searchsorted(values, other), n - 1)
            for i in np.nonzero((values[at] == other) & (values < other))[0]:
                x, y = find(i), find(at[i])
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    edges.append((int(values[i]), int(values[at[i]])))
    return edges


def pairs_of_blocks(max_bits: int) -> list[tuple[int, ...]]:
    """Sets of byte positions: every two of ``max_bits + 2`` blocks, or single positions where there are more blocks than bytes."""
    if max_bits + 2 > 8:
        return [(k,) for k in range(8)]
    blocks = [tuple(b.tolist()) for b in np.array_split(np.arange(8), max_bits + 2)]
    return [a + b for a, b in itertools.combinations(blocks, 2)]


def _posted(fps: DataFrame, positions: list[tuple[int, ...]], first: int = 0) -> DataFrame:
    """(positions, shared, fp): each fingerprint in the lists of its bytes at every one of ``positions``."""
    masks = [sum(0xFF << (8 * p) for p in c) for c in positions]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    entries = fps.select("fp", F.posexplode(F.array(*[F.lit(m).cast("long") for m in signed])).alias("positions", "mask"))
    return entries.select((F.col("positions") + first).alias("positions"), F.col("fp").bitwiseAND(F.col("mask")).alias("shared"), "fp")


def links(fps: DataFrame, max_bits: int) -> DataFrame:
    """(a, b): links between distinct fingerprints (column ``fp``) that connect all that lie within ``max_bits``."""
    if not 0 < max_bits < 8:
        raise ValueError("max_bits must be from 1 to 7 for an index of eight bytes")
    entries = written(_posted(fps, pairs_of_blocks(max_bits)), "postings")
    long = entries.groupBy("positions", "shared").agg(F.count("*").alias("n")).where(F.col("n") > LONG_LIST).drop("n")
    long = written(long, "long-postings")
    if not long.isEmpty():
        split = [_posted(entries.where(F.col("positions") == k).join(long, ["positions", "shared"], "left_semi").select("fp"), [tuple(sorted((*p, *c))) for c in itertools.combinations(sorted(set(range(8)) - set(p)), 8 - max_bits - len(p))], (k + 1) * 1000)
                 for k, p in enumerate(pairs_of_blocks(max_bits)) if len(p) < 8 - max_bits]
        whole = [k for k, p in enumerate(pairs_of_blocks(max_bits)) if len(p) >= 8 - max_bits]
        kept = entries.join(long.where(~F.col("positions").isin(whole)) if whole else long, ["positions", "shared"], "left_anti")
        entries = functools.reduce(DataFrame.union, split, kept)
    lists = entries.groupBy("positions", "shared").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1).select("fps")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            found = [e for v in x["fps"] for e in forest(v.values.to_numpy().view(np.uint64), max_bits)]
            both = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.record_batch({"a": np.ascontiguousarray(both[:, 0]), "b": np.ascontiguousarray(both[:, 1])})

    return lists.mapInArrow(run, "a long, b long").distinct()


def _named(docs: DataFrame, size: int, max_bits: int, seed: int, id_col: str, text_col: str) -> DataFrame:
    """(id, fp, h, group, component_id) of every row: ``group`` is a fingerprint of the component."""
    prints = written(fingerprints(docs, size, seed, id_col, text_col), "fingerprints")
    distinct = written(prints.groupBy("fp").agg(F.min("id").alias("least")), "distinct-fingerprints")
    roots = components(links(distinct.select("fp"), max_bits))
    named = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(names, "root").select("fp", F.col("root").alias("group"), "component_id")
    return prints.join(named, "fp").select("id", "fp", "h", "group", "component_id")


def simhash_groups(docs: DataFrame, size: int = 3, max_bits: int = 2, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component_id) of every row; the component is named by its smallest id."""
    return _named(docs, size, max_bits, seed, id_col, text_col).select("id", "fp", "component_id")


def near_dedup(docs: DataFrame, size: int = 5, max_bits: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` that stay: of each component the one with the smallest id, then text hash, rows repeating it once; all columns kept."""
    return first_rows(docs, _named(docs, size, max_bits, 42, id_col, text_col), id_col, text_col)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_groups(documents(spark, sf_dir))
    return out.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
