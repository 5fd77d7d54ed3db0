"""Full-text search over an inverted index, with BM25 ranks as SQLite's FTS5 documents them."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.text import ACCENTED, PLAIN, folded, search_tokens

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
#: Tasks that a term's postings may lie in, and bytes of a row group of them.
SHARES, ROW_GROUP = 16, 1 << 20
#: Documents whose tokens are sorted together.
AT_ONCE = 200


def postings(docs: DataFrame, columns: list[str], key: str = "doc_id") -> DataFrame:
    """(term, doc_id, tf, positions, dl): one row a term and document, sorted by term in each task. Columns lie far apart, so phrases don't cross them.

    The tokens of a document are brought together where it is read. Its postings meet once, by term and a share of the documents,
    so that a frequent term lies in as many tasks. ``key`` is one document: rows that share one have postings of their own.
    """
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("doc_id"), *[search_tokens(F.coalesce(c, F.lit(""))).alias(f"t{n}") for n, c in enumerate(columns)])
    each = rows.mapInArrow(_by_document, f"doc_id {kind}, term string, tf long, positions array<int>, dl int")
    each = each.repartition("term", F.pmod(F.xxhash64("doc_id"), F.lit(SHARES)))
    return each.sortWithinPartitions("term", "doc_id")


def _by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of documents, given as their id and a list of tokens a column; no token becomes an object."""
    for x in batches:
        for k in range(0, x.num_rows, AT_ONCE):
            ids, *lists = x.slice(k, AT_ONCE).columns
            counts = [pc.list_value_length(t).to_numpy().astype(np.int64) for t in lists]
            doc = np.concatenate([np.repeat(np.arange(len(ids)), c) for c in counts])
            at = np.concatenate([np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c) + (n << 26) for n, c in enumerate(counts)])
            terms = pa.concat_arrays([t.flatten() for t in lists]).dictionary_encode()
            code = terms.indices.to_numpy()
            entry = doc * len(terms.dictionary) + code
            order = np.argsort(entry, kind="stable")  # positions ascend already
            starts = np.flatnonzero(np.diff(entry[order], prepend=-1))
            first, ends = order[starts], np.append(starts, len(order))
            yield pa.record_batch({
                "doc_id": ids.take(pa.array(doc[first])), "term": terms.dictionary.take(pa.array(code[first])), "tf": np.diff(ends),
                "positions": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(at[order], pa.int32())), "dl": pa.array(np.bincount(doc, minlength=len(ids))[doc[first]], pa.int32()),
            })


def build_index(docs: DataFrame, columns: list[str], path: str, key: str = "doc_id") -> DataFrame:
    """Write the postings, sorted by term so that a search reads few row groups, and return them."""
    rows = postings(docs, columns, key)
    rows.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    return docs.sparkSession.read.schema(rows.schema).parquet(path)


@dataclass(frozen=True)
class Atom:
    words: tuple[str, ...]
    prefix: bool = False
    column: int | None = None


class Query:
    """Words are ANDed; OR, NOT, parentheses, "phrases", prefixes* and ``column:word`` as in FTS5."""

    def __init__(self, text: str, columns: list[str] | None = None) -> None:
        self.atoms: list[Atom] = []
        self._columns = columns or []
        self._left = re.findall(r'\w+\s*:\s*(?=["\w])|"[^"]*"\*?|\(|\)|[^\s()":]+(?:-[^\s()":]+)*', text)
        if not self._left:
            raise ValueError("empty query")
        self.tree = self._either()
        if self._left:
            raise ValueError(f"unexpected {self._left[0]!r}")

    def _either(self):
        parts = [self._both()]
        while self._left[:1] == ["OR"]:
            self._left.pop(0)
            parts.append(self._both())
        return ("or", parts)

    def _both(self):
        parts = [self._one()]
        while self._left and self._left[0] not in ("OR", ")"):
            word = self._left[0]
            if word in ("AND", "NOT"):
                self._left.pop(0)
            parts.append(("not", self._one()) if word == "NOT" else self._one())
        return ("and", parts)

    def _one(self):
        if not self._left or self._left[0] in ("OR", "AND", "NOT", ")"):
            raise ValueError("a word is missing")
        word = self._left.pop(0)
        if word == "(":
            inner = self._either()
            if self._left[:1] != [")"]:
                raise ValueError("no closing parenthesis")
            self._left.pop(0)
            return inner
        column = None
        if word.rstrip().endswith(":"):
            name = word.rstrip().rstrip(":").rstrip()
            if name not in self._columns or not self._left:
                raise ValueError(f"no such column: {name}")
            column, word = self._columns.index(name), self._left.pop(0)
        words = tuple(w for w in re.split(r"[^\w-]+", folded(word)) if w)
        if not words:
            raise ValueError(f"nothing to look for in {word!r}")
        self.atoms.append(Atom(words, word.endswith("*"), column))
        return ("atom", len(self.atoms) - 1)

    def holds(self, node=None) -> Column:
        kind, value = node or self.tree
        if kind == "atom":
            return F.col(f"a{value}").isNotNull()
        if kind == "not":
            return ~self.holds(value)
        out = self.holds(value[0])
        for v in value[1:]:
            out = out | self.holds(v) if kind == "or" else out & self.holds(v)
        return out


def _hits(index: DataFrame, atom: Atom) -> DataFrame:
    """(doc_id, dl, tf) of documents with the atom."""
    if atom.column is not None:  # columns lie 2^26 positions apart
        inside = F.filter("positions", lambda p: F.shiftright(p, 26) == atom.column)
        index = index.withColumn("positions", inside).withColumn("tf", F.size("positions").cast("long")).where("tf > 0")
    match = lambda w, last: F.col("term").startswith(w) if atom.prefix and last else F.col("term") == w
    if len(atom.words) == 1:
        return index.where(match(atom.words[0], True)).groupBy("doc_id", "dl").agg(F.sum("tf").alias("tf"))
    ends = []
    for k, w in enumerate(atom.words):
        ends.append(index.where(match(w, k == len(atom.words) - 1)).select("doc_id", "dl", F.lit(k).alias("k"), F.explode("positions").alias("p")).select("doc_id", "dl", (F.col("p") - k).alias("start"), "k"))
    rows = ends[0]
    for e in ends[1:]:
        rows = rows.unionByName(e)
    whole = rows.groupBy("doc_id", "dl", "start").agg(F.count_distinct("k").alias("n")).where(F.col("n") == len(atom.words))
    return whole.groupBy("doc_id", "dl").agg(F.count("*").alias("tf"))


def search(index: DataFrame, text: str, limit: int | None = 20, after: tuple | None = None, columns: list[str] | None = None, among: DataFrame | None = None, stats: tuple[int, float] | None = None) -> DataFrame:
    """(doc_id, rank) by rank, smaller first, then newer document.

    ``columns`` names the indexed columns for ``column:word``; ``among`` (doc_id) holds the documents that may be
    found, as filters by source, topic or time leave them. Ranks are those of the whole index. ``stats``, the number of its
    documents and their mean length, spare the reading of all postings (``textindex.TextIndex`` knows them).
    """
    query = Query(text, columns)
    known = None if stats is None else index.sparkSession.createDataFrame([stats], "total long, avgdl double")
    stats = index.groupBy("doc_id").agg(F.max("dl").alias("dl")).agg(F.count("*").alias("total"), F.avg("dl").alias("avgdl")) if known is None else known
    rows = None
    for k, atom in enumerate(query.atoms):
        one = _hits(index, atom).withColumn("atom", F.lit(k))
        rows = one if rows is None else rows.unionByName(one)
    df = rows.groupBy("atom").agg(F.count("*").alias("n"))
    idf = F.greatest(F.lit(LEAST_IDF), F.log((F.col("total") - F.col("n") + 0.5) / (F.col("n") + 0.5)))
    tf = F.col("tf")
    score = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    rows = rows.join(F.broadcast(df), "atom").crossJoin(F.broadcast(stats)).withColumn("s", score)  # a row an atom; one row
    by = rows.groupBy("doc_id").agg(F.sum("s").alias("s"), *[F.max(F.when(F.col("atom") == k, tf)).alias(f"a{k}") for k in range(len(query.atoms))])
    found = by.where(query.holds()).select("doc_id", (-F.floor(F.col("s") * 1e6 + 0.5) / 1e6).alias("rank"))
    if among is not None:
        found = found.join(among.select("doc_id").distinct(), "doc_id", "left_semi")
    if after is not None:
        found = found.where((F.col("rank") > after[0]) | ((F.col("rank") == after[0]) & (F.col("doc_id") < after[1])))
    found = found.orderBy("rank", F.desc("doc_id"))
    return found.limit(limit) if limit else found


def snippet(text: Column, words: list[str], size: int = 32, left: str = "[", right: str = "]") -> Column:
    """The window of ``size`` words with most hits, hits marked, dots where text is left out."""
    look = F.array(*[F.lit(w) for w in words])
    parts = F.split(text, r"\s+")
    hit = lambda w: F.array_contains(look, F.regexp_replace(F.translate(F.lower(w), ACCENTED, PLAIN), r"[^\p{L}\p{N}_-]+", ""))
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(parts) - size))
    scored = F.transform(starts, lambda s: F.struct(F.size(F.filter(F.slice(parts, s + 1, size), hit)).alias("n"), (-s).alias("s")))
    best = -F.array_max(scored)["s"]
    shown = F.array_join(F.transform(F.slice(parts, best + 1, size), lambda w: F.when(hit(w), F.concat(F.lit(left), w, F.lit(right))).otherwise(w)), " ")
    return F.concat(F.when(best > 0, "...").otherwise(""), shown, F.when(best + size < F.size(parts), "...").otherwise(""))
