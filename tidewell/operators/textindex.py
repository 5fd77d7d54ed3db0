"""A full-text index that is kept up: segments of postings, deletions beside them, and merges.

Adding documents writes one more segment and touches nothing else. A document that is deleted, or added anew,
gets a tombstone: it is gone from all segments older than that. Each part's record says how many documents and words
it adds or takes away, so a search knows the statistics without reading postings, and reads of those only the row groups of its
terms. ``merge`` makes one segment of several and leaves out what is gone. All of it is committed by ``Versions``: a
search sees whole segments or none, and one that began before a merge still has its files until they are vacuumed.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.operators import search as fts
from tidewell.sources.versions import Part, Versions

#: Tombstones are broadcast up to so many, and joined beyond.
BROADCAST_GONE = 200_000


class TextIndex:
    def __init__(self, spark: SparkSession, root: str, columns: list[str], key: str = "doc_id") -> None:
        self.spark, self.columns, self.key = spark, columns, key
        self.versions = Versions(spark, root)

    def _tables(self, record: dict) -> dict[str, tuple[T.StructType, list[Part]]]:
        return {name: (T.StructType.fromJson(t["schema"]), [Part(**p) for p in t["parts"]]) for name, t in record["tables"].items()}

    def _stage(self, docs: DataFrame, segment: int) -> tuple[tuple[T.StructType, Part], tuple[T.StructType, Part]]:
        """A segment's postings and its documents with their lengths. A key is one document, so rows that share one are refused."""
        twice = docs.groupBy(self.key).count().where("count > 1").first()
        if twice:
            raise ValueError(f"{self.key} {twice[0]!r} stands for several documents")
        rows = fts.postings(docs, self.columns, self.key).withColumn("segment", F.lit(segment))
        path = self._write("postings", rows)
        written = self.spark.read.schema(rows.schema).parquet(f"{self.versions.root}/data/{path}")
        lengths = written.groupBy("doc_id").agg(F.max("dl").alias("dl"), F.lit(segment).alias("segment"))
        listed = self.versions.stage("documents", lengths)  # small, so the totals come from it
        words = self.spark.read.schema(lengths.schema).parquet(f"{self.versions.root}/data/{listed.path}").agg(F.sum("dl")).first()[0]
        facts = {"segment": segment, "documents": listed.rows, "words": words or 0}
        return (rows.schema, Part(path, written.count(), facts)), (lengths.schema, Part(listed.path, listed.rows, facts))

    def _write(self, name: str, rows: DataFrame) -> str:
        path = f"{name}-{uuid.uuid4().hex}"
        rows.write.option("parquet.block.size", fts.ROW_GROUP).parquet(f"{self.versions.root}/data/{path}")
        return path

    def _tombstones(self, keys: DataFrame, before: int, base: dict) -> list[Part]:
        """Marks those of ``keys`` that are in the index as gone from segments before ``before``; the record has what the statistics lose."""
        alive = self._alive("documents", base)
        if alive is None:
            return []
        part = self.versions.stage("gone", alive.join(keys.select(F.col(keys.columns[0]).alias("doc_id")), "doc_id", "left_semi").select("doc_id", "dl", F.lit(before).alias("before")))
        words = self.spark.read.parquet(f"{self.versions.root}/data/{part.path}").agg(F.sum("dl")).first()[0]
        return [Part(part.path, part.rows, {"before": before, "documents": -part.rows, "words": -(words or 0)})] if part.rows else []

    def _alive(self, name: str, record: dict) -> DataFrame | None:
        table = self.versions.read(name, record=record)
        parts = self.versions.parts("gone", record)
        if table is None or not parts:
            return table
        gone = self.versions.read("gone", record=record).groupBy("doc_id").agg(F.max("before").alias("before")).select(F.col("doc_id").alias("gone_id"), "before")
        if sum(p.rows for p in parts) <= BROADCAST_GONE:
            gone = F.broadcast(gone)
        return table.join(gone, (F.col("doc_id") == F.col("gone_id")) & (F.col("segment") < F.col("before")), "left_anti")

    def add(self, docs: DataFrame, batch: tuple[str, int] | None = None) -> int:
        """Documents in a new segment; those with known keys replace the old ones."""
        base = self.versions.record()
        if batch and base["streams"].get(batch[0], -1) >= batch[1]:
            return base["version"]
        tables = self._tables(base)
        segment = base["version"] + 1
        found = dict(zip(("postings", "documents"), self._stage(docs, segment), strict=True))
        parts = {name: (schema, [*tables.get(name, (None, []))[1], part]) for name, (schema, part) in found.items()}
        parts |= self._with_gone(docs.select(self.key), segment, base)
        return self.versions.commit(parts=parts, batch=batch, base=base)

    def _with_gone(self, keys: DataFrame, before: int, base: dict) -> dict:
        kind = T.StructType([T.StructField("doc_id", keys.schema[0].dataType), T.StructField("dl", T.IntegerType()), T.StructField("before", T.IntegerType())])
        return {"gone": (kind, [*self.versions.parts("gone", base), *self._tombstones(keys, before, base)])}

    def delete(self, keys: DataFrame, batch: tuple[str, int] | None = None) -> int:
        base = self.versions.record()
        if batch and base["streams"].get(batch[0], -1) >= batch[1]:
            return base["version"]
        return self.versions.commit(parts=self._with_gone(keys, base["version"] + 1, base), batch=batch, base=base)

    def _totals(self, record: dict, names: tuple[str, ...] = ("documents", "gone")) -> tuple[int, int]:
        facts = [p.facts for name in names for p in self.versions.parts(name, record)]
        return sum(f["documents"] for f in facts), sum(f["words"] for f in facts)

    def stats(self, record: dict | None = None) -> tuple[int, float]:
        """Documents and their mean length, from the records of parts alone."""
        total, words = self._totals(record or self.versions.record())
        return total, words / total if total else 0.0

    def postings(self, record: dict | None = None) -> DataFrame:
        found = self._alive("postings", record or self.versions.record())
        if found is None:
            raise ValueError("nothing was ever added to this index")
        return found

    def search(self, text: str, limit: int | None = 20, after: tuple | None = None, among: DataFrame | None = None, version: int | None = None) -> DataFrame:
        record = self.versions.record(version)
        return fts.search(self.postings(record), text, limit, after, self.columns, among, self.stats(record))

    def merge(self, at_most: int | None = None) -> int:
        """Make one segment of all, or of those with up to ``at_most`` postings, without what is gone.

        The new segment has the number of its latest one, so tombstones mean to it what they meant. Those that no segment is old enough for are dropped.
        """
        base = self.versions.record()
        tables = self._tables(base)
        schema, parts = tables["postings"]
        small = [p for p in parts if at_most is None or p.rows <= at_most]
        if len(small) < 2 and (at_most is not None or not tables["gone"][1]):
            return base["version"]
        numbers = {p.facts["segment"] for p in small}
        segment = max(numbers)
        out = {}
        kept = {name: [p for p in tables[name][1] if p.facts["segment"] not in numbers] for name in ("postings", "documents")}
        rows = self._alive("postings", base).where(F.col("segment").isin(*numbers)).select("doc_id", "term", "tf", "positions", "dl")
        rows = rows.repartition("term", F.pmod(F.xxhash64("doc_id"), F.lit(fts.SHARES))).sortWithinPartitions("term", "doc_id").withColumn("segment", F.lit(segment)).select(*schema.names)
        path = self._write("postings", rows)
        written = self.spark.read.schema(schema).parquet(f"{self.versions.root}/data/{path}")
        lengths = self._alive("documents", base).where(F.col("segment").isin(*numbers)).select("doc_id", "dl", F.lit(segment).alias("segment"))
        total, words = lengths.agg(F.count("*"), F.sum("dl")).first()
        facts = {"segment": segment, "documents": total, "words": words or 0}
        out["postings"] = schema, [*kept["postings"], Part(path, written.count(), facts)]
        out["documents"] = tables["documents"][0], [*kept["documents"], self.versions.stage("documents", lengths, facts)]
        if tables["gone"][1]:
            # to what was merged no tombstone applies any more
            oldest = min((p.facts["segment"] for p in kept["postings"]), default=segment + base["version"])
            rest = self.versions.stage("gone", self.versions.read("gone", record=base).where(F.col("before") > oldest))
            # the new segment counts what is left, so tombstones take away what the others still count
            had, has = self._totals(base), [sum(p.facts[k] for p in out["documents"][1]) for k in ("documents", "words")]
            out["gone"] = tables["gone"][0], [Part(rest.path, rest.rows, {"before": segment, "documents": had[0] - has[0], "words": had[1] - has[1]})]
        return self.versions.commit(parts=out, base=base)
