"""Operator 1, line dedup: repeated runs of lines found with a suffix array over line ids.

A document is the sequence of its lines (``\\n`` splits). Every line position starts a suffix.
Ranks of suffixes grow by prefix doubling: the rank by the first ``2d`` lines follows from the
pair (rank by ``d`` lines here, rank by ``d`` lines at ``d`` further on). A rank is the place where
the class of suffixes with that prefix begins in the suffix array, so classes are exactly the
intervals of the array whose longest common prefix has that many lines. Suffixes whose prefix
occurs once leave the array at once: no longer prefix of theirs can repeat. Doubling goes on until no
interval has two members. The deepest interval of a suffix tells how far it repeats: inside an interval of
``min_lines`` lines or more the earliest suffix (smallest document key, then line) is the first copy, all
others are later copies of as many lines, and later copies that adjoin in step with one original make up a
maximal repeated run. The runs are deleted.

With ``min_words``, runs of fewer than ``min_lines`` lines count too if they hold that many words (parts
between spaces with a letter or digit): every depth is then looked at, and the shorter windows with enough words join in.

Everything is DataFrame code. No task depends on one line's frequency: classes are counted with
partial aggregation, and ranks are prefix sums over a bounded number of buckets, split by the second rank
where one first rank is frequent.

Cases. Null text: kept null, no lines. Empty text: one empty line. Rows with the same ``doc_id``
and text are one document, none a copy of another; the same ``doc_id`` with other text is another
document, ordered by a hash of the text. A null ``doc_id`` sorts first. Other columns pass through
under any name, but for those of the counts, which are replaced. Rows that repeat each other are looked at once,
however many there are. A text of n lines makes n rows in each doubling, also if all its lines are equal, and its
rows meet in one task, which sorts them on disk where they outgrow memory; what is removed of it is an array of
at most n numbers.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewell.llm.common import documents, prefix_totals, written

#: Suffixes in a bucket of the rank computation, and the most buckets.
RANK_BUCKET, MOST_BUCKETS = 1 << 16, 1 << 12
#: So many keys of rows that repeat each other are broadcast; more are joined.
BROADCAST_KEYS = 100_000


def _needed(lines: Column, min_lines: int, min_words: int) -> Column:
    """For every line, how many lines from it on make a run that counts."""
    # one word is soon seen; more are counted by the first letter or digit of each
    one, each = r"[\p{L}\p{N}]", r"(?<!\S)[^\s\p{L}\p{N}]*+[\p{L}\p{N}]"
    counts = F.transform(lines, lambda x: x.rlike(one).cast("int") if min_words == 1 else F.regexp_count(x, F.lit(each)))

    def need(counts: Column, i: Column) -> Column:
        total, out = F.lit(0), F.when(F.lit(False), 0)
        for m in range(1, min_lines):
            total = total + F.coalesce(F.get(counts, i + (m - 1)), F.lit(0))
            out = out.when(total >= min_words, m)
        return out.otherwise(min_lines)

    # the counts stand in an array of one element so that they are worked out once
    return F.flatten(F.transform(F.array(counts), lambda c: F.transform(c, lambda _, i: need(c, i))))


def _once(docs: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """(d, h, text): each pair of id and text once. Only rows of keys that occur more than once are shuffled, and those after a partial aggregate."""
    text = docs[text_col]
    rows = docs.where(text.isNotNull()).select(docs[id_col].alias("d"), F.xxhash64(text).alias("h"), text.alias("text"))
    often = written(rows.groupBy("d", "h").agg(F.count("*").alias("n")).where("n > 1").select(F.col("d").alias("od"), F.col("h").alias("oh")), "repeated")
    n = often.count()
    if not n:
        return rows
    keys = F.broadcast(often) if n <= BROADCAST_KEYS else often
    on = rows["d"].eqNullSafe(keys["od"]) & (rows["h"] == keys["oh"])
    return rows.join(keys, on, "left_anti").union(rows.join(keys, on, "left_semi").dropDuplicates(["d", "h"]))


def _lines(docs: DataFrame, text_col: str, id_col: str, min_lines: int = 0, min_words: int | None = None) -> DataFrame:
    once = _once(docs, text_col, id_col)
    if min_words is not None:
        whole = once.select("d", "h", F.split("text", "\n", -1).alias("lines"))
        whole = whole.select("d", "h", F.arrays_zip("lines", _needed(F.col("lines"), min_lines, min_words).alias("need")).alias("both"))
        each = whole.select("d", "h", F.posexplode("both").alias("i", "x")).select("d", "h", "i", "x.lines", "x.need")
        return each.select("d", "h", "i", F.xxhash64("lines").alias("l1"), F.xxhash64(F.lit(7), "lines").alias("l2"), "need")
    # hashed below the explode; beside it, the text would be hashed again for every line
    whole = once.select("d", "h", F.split("text", "\n", -1).alias("lines"))
    return whole.select("d", "h", F.posexplode("lines").alias("i", "line")).select("d", "h", "i", F.xxhash64("line").alias("l1"), F.xxhash64(F.lit(7), "line").alias("l2"))


def _classes(pairs: DataFrame, a: str, b: str, bucket: list) -> DataFrame:
    """Classes of equal (a, b) with two members or more: their size, rank in the suffix array and first member.

    Without ``bucket`` one task ranks all, which is for few.
    """
    found = pairs.groupBy(a, b).agg(F.count("*").alias("n"), F.min(F.struct("d", "h", "i")).alias("first"), F.max("sz").alias("sz")).where("n > 1")
    found = found.select("*", *[x.alias(f"b{k}") for k, x in enumerate(bucket)])
    names = [f"b{k}" for k in range(len(bucket))]
    if not bucket:
        inside = F.sum("n").over(Window.orderBy(a, b).rowsBetween(Window.unboundedPreceding, -1))
        return found.select(F.col(a).alias("ca"), F.col(b).alias("cb"), F.coalesce(inside, F.lit(0)).alias("rank"), "n", "first")
    inside = F.sum("n").over(Window.partitionBy(*names).orderBy(a, b).rowsBetween(Window.unboundedPreceding, -1))
    ranked = found.withColumn("inside", F.coalesce(inside, F.lit(0)))
    return ranked.join(prefix_totals(found, names, F.col("n"), "before"), names).select(
        F.col(a).alias("ca"), F.col(b).alias("cb"), (F.col("inside") + F.col("before")).alias("rank"), "n", "first"
    )


def _shifted(active: DataFrame, by: int) -> DataFrame:
    """Rank of the suffix ``by`` lines further on in the same document; suffixes without one drop out."""
    w = Window.partitionBy("d", "h").orderBy("i").rangeBetween(by, by)
    return active.withColumn("r2", F.max("r").over(w)).where("r2 is not null")


def _intervals(docs: DataFrame, min_lines: int, text_col: str, id_col: str, min_words: int | None) -> Iterator[tuple[int, DataFrame]]:
    """(depth, suffixes in intervals of that depth), until there are none."""
    if min_lines < 1:
        raise ValueError("min_lines must be positive")
    lines = written(_lines(docs, text_col, id_col, min_lines, min_words).withColumn("sz", F.lit(0).cast("long")), "lines")
    top = F.shiftright("l1", 48)
    classes = _classes(lines, "l1", "l2", [top])
    on = (F.col("l1") == F.col("ca")) & (F.col("l2") == F.col("cb"))
    kept = ["d", "h", "i", F.col("rank").alias("r"), F.col("n").alias("sz"), "first", *(["need"] if min_words is not None else [])]
    active, depth = written(lines.drop("sz").join(classes, on).select(*kept), "lines-1"), 1
    while True:
        members, most = active.agg(F.count("*"), F.max("r")).first()
        if not members:
            return
        yield depth, active
        step = depth if depth >= min_lines else min(depth, min_lines - depth) if min_words is None else 1
        pairs = _shifted(active.drop("first"), step)
        # the class after a frequent one starts in a later bucket, so splitting the frequent by r2 keeps the order
        width = max(1, (most + 1) // max(16, min(MOST_BUCKETS, members // RANK_BUCKET)))
        bucket = [] if members <= RANK_BUCKET // 4 else [F.floor(F.col("r") / width), F.when(F.col("sz") > width, F.floor(F.col("r2") / width)).otherwise(0)]
        classes = _classes(pairs, "r", "r2", bucket)
        on = (F.col("r") == F.col("ca")) & (F.col("r2") == F.col("cb"))
        active, depth = written(pairs.drop("sz").join(classes, on).select(*kept), f"lines-{depth + step}"), depth + step


def _later(active: DataFrame) -> DataFrame:
    return active.where(F.struct("d", "h", "i") > F.col("first"))


def repeated_runs(docs: DataFrame, min_lines: int = 3, text_col: str = "text", id_col: str = "doc_id", min_words: int | None = None) -> DataFrame:
    """Maximal runs of later copies: (d, h, start, n_lines, of): ``d`` the doc_id, ``h`` the hash of its text, ``of`` where the original starts.

    Runs with different originals may overlap. Where a passage repeats with a period shorter than itself (blank
    lines, tables), each line's original is the period before, so that the passage is one run and not one for every
    line of it; shorter intervals at its end add a run for each line of the period and doubling.
    """
    found = []
    for depth, active in _intervals(docs, min_lines, text_col, id_col, min_words):
        if depth < min_lines and min_words is None:
            continue
        counts = _later(active) if depth >= min_lines else _later(active).where(F.col("need") <= depth)
        found.append(counts.select("d", "h", "i", F.lit(depth).alias("m"), "first"))
    if not found:
        fields = docs.select(docs[id_col].alias("d"), F.lit(0).cast("long").alias("h"), F.lit(0).alias("start"), F.lit(0).alias("n_lines"))
        return fields.withColumn("of", F.struct("d", "h", F.lit(0).alias("i"))).where("false")
    later = functools.reduce(DataFrame.union, found)
    # of a suffix in several intervals the deepest counts, with its original; in step are those as far from their originals
    deepest = later.groupBy("d", "h", "i").agg(F.max_by(F.struct("m", "first"), "m").alias("x")).select("d", "h", "i", "x.m", "x.first")
    # a document's rows come together once for both windows
    before = F.lag("i").over(Window.partitionBy("d", "h", "m", "first").orderBy("i"))
    deepest = deepest.repartition("d", "h").withColumn("back", F.col("i") - before)
    periodic = F.coalesce(F.col("back") <= F.col("m"), F.lit(False))
    own = {"end": F.col("i") + F.col("m"), "lag": F.when(periodic, F.col("back")).otherwise(F.col("i") - F.col("first.i"))}
    deepest = deepest.withColumns(own | {f"f{k}": F.when(periodic, F.col(k)).otherwise(F.col(f"first.{k}")) for k in "dh"})
    w = Window.partitionBy("d", "h", "fd", "fh", "lag").orderBy("i")
    fresh = F.coalesce(F.col("i") > F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    runs = deepest.withColumn("run", F.sum(fresh.cast("long")).over(w)).groupBy("d", "h", "fd", "fh", "lag", "run")
    runs = runs.agg(F.min("i").alias("start"), (F.max("end") - F.min("i")).alias("n_lines"))
    return runs.select("d", "h", "start", "n_lines", F.struct(F.col("fd").alias("d"), F.col("fh").alias("h"), (F.col("start") - F.col("lag")).alias("i")).alias("of"))


def _disjoint(runs: DataFrame) -> DataFrame:
    """(d, h, start, end) of the lines that some run covers: no line in two of them, so all together are as many as the lines of the text."""
    w = Window.partitionBy("d", "h").orderBy("start", "end")
    ends = runs.select("d", "h", "start", (F.col("start") + F.col("n_lines")).alias("end"))
    fresh = F.coalesce(F.col("start") > F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    return ends.withColumn("island", F.sum(fresh.cast("long")).over(w)).groupBy("d", "h", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))


def line_dedup(docs: DataFrame, min_lines: int = 3, text_col: str = "text", id_col: str = "doc_id", min_words: int | None = None) -> DataFrame:
    """All rows and columns of ``docs``, the text without later copies of runs of ``min_lines`` lines or ``min_words`` words or more.

    Adds ``_n_lines`` and ``_n_removed``, in place of columns of these names.
    """
    runs = _disjoint(repeated_runs(docs, min_lines, text_col, id_col, min_words))
    removed = runs.groupBy("d", "h").agg(F.flatten(F.collect_list(F.expr("sequence(start, end - 1)"))).alias("removed"))
    rest = [c for c in docs.columns if c != text_col]
    whole = docs.select(
        docs[id_col].alias("_k"), F.xxhash64(docs[text_col]).alias("_h"), F.struct(*[docs[c] for c in rest]).alias("_row"), F.split(docs[text_col], "\n", -1).alias("_lines")
    )
    both = whole.join(removed, whole["_k"].eqNullSafe(removed["d"]) & (whole["_h"] == removed["h"]), "left")
    count = F.coalesce(F.size("_lines"), F.lit(0))
    count = F.when(F.col("_lines").isNull(), 0).otherwise(count)
    left = F.array_except(F.expr("sequence(0, size(_lines) - 1)"), F.col("removed"))
    text = F.when(F.col("removed").isNull(), F.array_join("_lines", "\n")).otherwise(F.array_join(F.transform(left, lambda i: F.get(F.col("_lines"), i)), "\n"))
    gone = F.when(F.col("removed").isNull(), 0).otherwise(F.size("removed"))
    columns = [(text if c == text_col else F.col("_row").getField(c)).alias(c) for c in docs.columns if c not in ("_n_lines", "_n_removed")]
    return both.select(*columns, count.alias("_n_lines"), gone.alias("_n_removed"))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of any length that hold a word, and runs of three lines without one."""
    out = line_dedup(documents(spark, sf_dir).select("doc_id", "text"), min_words=1)
    return out.select("doc_id", F.col("_n_lines").cast("long").alias("n_lines"), F.col("_n_removed").cast("long").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


ORACLE = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i
  FROM documents WHERE text IS NOT NULL
), windows AS (
  SELECT doc_id, i, line, lead(line, 1) OVER w AS l1, lead(line, 2) OVER w AS l2, regexp_matches(line, '[\\p{L}\\p{N}]') AS word
  FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), places AS (
  SELECT *, lead(word, 1) OVER (PARTITION BY doc_id ORDER BY i) AS word1, row_number() OVER (PARTITION BY line ORDER BY doc_id, i) AS n1,
    row_number() OVER (PARTITION BY line, l1 ORDER BY doc_id, i) AS n2, row_number() OVER (PARTITION BY line, l1, l2 ORDER BY doc_id, i) AS n3
  FROM windows
), spans AS (
  SELECT doc_id, i, line, CASE WHEN n3 > 1 AND l2 IS NOT NULL THEN 3 WHEN n2 > 1 AND l1 IS NOT NULL AND (word OR word1) THEN 2 WHEN n1 > 1 AND word THEN 1 ELSE 0 END AS span
  FROM places
), marked AS (
  SELECT doc_id, i, line, CASE WHEN max(i + span) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) > i THEN 1 ELSE 0 END AS gone
  FROM spans
)
SELECT d.doc_id, count(m.i) AS n_lines, CAST(coalesce(sum(gone), 0) AS BIGINT) AS n_removed,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE gone = 0), '')) AS kept_sha256
FROM documents d LEFT JOIN marked m ON d.doc_id = m.doc_id
GROUP BY d.doc_id
"""
