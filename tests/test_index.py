"""The full-text index that is kept up, and the folding of letters."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from tidewell.functions import text as tx
from tidewell.operators import search as fts
from tidewell.operators.textindex import TextIndex

QUERIES = ["a", "b c", "a OR d", "(a OR b) NOT c", '"a b"', "de*", "title:a"]


def some(spark, docs):
    return spark.createDataFrame([(k, *v) for k, v in docs.items()], "doc_id long, title string, content string")


def same_as_rebuilt(spark, index, docs, path, queries=QUERIES):
    fresh = fts.build_index(some(spark, docs), ["title", "content"], path)
    for q in queries:
        found, want = index.search(q, limit=None).collect(), fts.search(fresh, q, None, columns=["title", "content"]).collect()
        assert [tuple(r) for r in found] == [tuple(r) for r in want], q


@pytest.mark.parametrize("limit", [200_000, 0])
def test_segments_answer_as_an_index_built_anew(spark, tmp_path, monkeypatch, limit):
    monkeypatch.setattr("tidewell.operators.textindex.BROADCAST_GONE", limit)
    rng = random.Random(limit)
    text = lambda: " ".join(rng.choice(["a", "b", "c", "d", "de", "def", "é"]) for _ in range(rng.randrange(0, 9)))
    index, docs = TextIndex(spark, f"file://{tmp_path}/ix", ["title", "content"]), {}
    for step in range(3):
        new = {k: (text(), text()) for k in rng.sample(range(40), 15)}  # some are known already
        index.add(some(spark, new), batch=("docs", step))
        docs |= new
        if step:
            gone = rng.sample(sorted(docs), 4) + [999]
            index.delete(spark.createDataFrame([(k,) for k in gone], "doc_id long"))
            docs = {k: v for k, v in docs.items() if k not in gone}
    version = index.versions.latest()
    assert index.add(some(spark, {1: ("x", "x")}), batch=("docs", 2)) == version  # replayed
    same_as_rebuilt(spark, index, docs, f"file://{tmp_path}/a")
    total, mean = index.stats()
    sizes = [len(f"{t} {c}".split()) for t, c in docs.values() if f"{t}{c}".strip()]
    assert total == len(sizes) and mean == pytest.approx(sum(sizes) / len(sizes))
    smallest = sorted(p.rows for p in index.versions.parts("postings"))[1]
    index.merge(at_most=smallest)
    assert len(index.versions.parts("postings")) == 2 and index.stats() == (total, pytest.approx(mean))
    same_as_rebuilt(spark, index, docs, f"file://{tmp_path}/b", QUERIES[:3])
    index.merge()
    assert len(index.versions.parts("postings")) == 1 and index.versions.read("gone").count() == 0
    same_as_rebuilt(spark, index, docs, f"file://{tmp_path}/c", QUERIES[2:5])
    before = [tuple(r) for r in index.search("a OR b").collect()]
    index.add(some(spark, {k: ("new", "a") for k in list(docs)[:3]}))
    docs |= {k: ("new", "a") for k in list(docs)[:3]}
    same_as_rebuilt(spark, index, docs, f"file://{tmp_path}/d", QUERIES[:2])
    assert [tuple(r) for r in index.search("a OR b", version=index.versions.latest() - 1).collect()] == before


def test_a_search_reads_its_terms_only(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(fts, "ROW_GROUP", 4096)
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *[F.concat(F.lit(f"w{k}x"), F.col("id").cast("string")) for k in range(8)]).alias("title"), F.lit("").alias("content"))
    index = TextIndex(spark, f"file://{tmp_path}/ix", ["title", "content"])
    index.add(docs)
    found = index.postings().where("term = 'w3x77'")
    plan = found._jdf.queryExecution().executedPlan()
    assert found.count() == 1 and "EqualTo(term,w3x77)" in plan.toString()
    rows = found._jdf.queryExecution().toRdd().count()
    scans = plan.collectLeaves()
    read = sum(scans.apply(k).metrics().apply("numOutputRows").value() for k in range(scans.size()))
    assert rows == 1 and read < 0.2 * index.versions.parts("postings")[0].rows


def test_keys_are_documents(spark, tmp_path):
    index = TextIndex(spark, f"file://{tmp_path}/ix", ["title", "content"])
    with pytest.raises(ValueError, match="ever added"):
        index.search("a")
    with pytest.raises(ValueError, match="several"):
        index.add(some(spark, {1: ("a", "b")}).union(some(spark, {1: ("c", "d")})))
    index.add(some(spark, {1: (None, None), 2: ("a", None)}))
    assert [r.doc_id for r in index.search("a").collect()] == [2] and index.stats() == (1, 1.0)


def test_letters_fold_as_their_decomposition(spark):
    """Equal to canonical decomposition without marks, for every letter that isn't a Hangul syllable."""
    letters = [c for c in map(chr, range(0x80, 0x110000)) if unicodedata.category(c)[0] == "L" and not 0xAC00 <= ord(c) <= 0xD7A3]
    assert len(tx.PLAIN) > 1000
    for c in letters:
        want = "".join(x for x in unicodedata.normalize("NFD", c.lower()) if unicodedata.category(x) != "Mn")
        assert tx.folded(c) == want, hex(ord(c))
    rows = spark.createDataFrame([("Ünïcödé été Ἀθῆναι Ёлка ṩ 한글 naïve-co_op",)], "t string")
    assert rows.select(tx.search_tokens(F.col("t")).alias("x")).first().x == ["unicode", "ete", "αθηναι", "елка", "s", "한글", "naive-co_op"]


def test_tokens_of_a_document_meet_before_the_shuffle(spark):
    """every token was shuffled and sorted; now the postings are, as one row a term and document."""
    texts = [(1, "b a b", "a c-d"), (2, None, ""), (3, "", "e e  e_1"), (None, "a", None), (5, "x " * 3000, "Ä x")]
    docs = spark.createDataFrame(texts, "doc_id long, title string, content string").coalesce(1)
    rows = fts.postings(docs, ["title", "content"])
    want = {}
    for d, *columns in texts:
        at = [(w, k + (n << 26)) for n, c in enumerate(columns) for k, w in enumerate(tx.folded(c or "").split())]
        for w, k in at:
            want.setdefault((d, w, len(at)), []).append(k)
    assert {(r["doc_id"], r["term"], r["dl"]): r["positions"] for r in rows.collect()} == want
    assert all(r["tf"] == len(r["positions"]) for r in rows.collect())
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "Aggregate" not in plan
