"""The stages of the pipeline against brute-force versions of their own laws."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidewell.llm import line_dedup, shingle_join, simhash, substring_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    return spark.createDataFrame([(d, t, "en", "s", None if t is None else len(t)) for d, t in rows], SCHEMA)


def shingles(text, size=5):
    words = (text or "").lower().split()
    return {tuple(words[i : i + size]) for i in range(max(len(words) - size + 1, min(len(words), 1)))}


def brute_near(rows):
    """Smallest (id, text) of each component of the pairs with a similarity of 0.8 or more."""
    root, sets = list(range(len(rows))), [shingles(t) for _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            union = len(sets[i] | sets[j])
            if not union or 5 * len(sets[i] & sets[j]) >= 4 * union:
                a, b = root[i], root[j]
                root = [b if r == a else r for r in root]
    groups = {}
    for r, row in zip(root, rows, strict=True):
        groups.setdefault(r, set()).add(row)
    return groups.values()


def near_texts(seed):
    rng, out = random.Random(seed), []
    for _ in range(25):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(60, 130))]
        out.append(" ".join(words))
        for _ in range(rng.randrange(4)):
            copy = list(words)
            for _ in range(rng.randrange(1, 5)):
                copy[rng.randrange(len(copy))] = "X"
            out.append(" ".join(copy[rng.randrange(6) :]))
    rng.shuffle(out)
    return [*out, None, "", "one two", "One  two", "three four"]


@pytest.mark.parametrize(("seed", "sample"), [(1, 20_000), (2, 10)])
def test_near_equals_brute_force(spark, monkeypatch, seed, sample):
    monkeypatch.setattr(shingle_join, "SAMPLE", sample)
    rows = list(enumerate(near_texts(seed)))
    got = sorted(r["doc_id"] for r in corpus_pipeline.near(spark, documents(spark, rows), "").collect())
    groups = brute_near(rows)
    assert got == sorted(min(d for d, _ in g) for g in groups) and max(map(len, groups)) > 2


def brute_lines(texts, min_words, most=3):
    """Lines inside a window that stood before, of ``most`` lines or with ``min_words`` words."""
    words = lambda lines: sum(any(c.isalnum() for c in w) for x in lines for w in x.split())
    seen, out = set(), {}
    for d in sorted(texts):
        lines, gone = texts[d].split("\n"), set()
        for i in range(len(lines)):
            for m in range(1, min(most, len(lines) - i) + 1):
                window = tuple(lines[i : i + m])
                if window not in seen:
                    seen.add(window)
                elif m == most or words(window) >= min_words:
                    gone |= set(range(i, i + m))
        out[d] = "\n".join(x for i, x in enumerate(lines) if i not in gone), len(gone)
    return out


@pytest.mark.parametrize("min_words", [1, 3])
def test_short_runs_count_by_their_words(spark, min_words):
    rng = random.Random(min_words)
    texts = {d: "\n".join(rng.choice(["", "}", "one", "two words", "é ü x", f"own {d}", "-- --", f"u{rng.random()}"]) for _ in range(rng.randrange(1, 9))) for d in range(60)}
    got = line_dedup.line_dedup(documents(spark, texts.items()), 3, min_words=min_words).collect()
    assert {r["doc_id"]: (r["text"], r["_n_removed"]) for r in got} == brute_lines(texts, min_words)


def test_lines_stage_cuts_short_runs_and_whole_short_copies(spark):
    rows = [(0, "a passage of one line\nown"), (1, "first\na passage of one line\nlast"), (2, "short\ncopy"), (3, "short\ncopy"), (4, "}\nx1\n\nx2"), (5, "}\nx3\n\nx4")]
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.lines(spark, documents(spark, rows), "").collect()}
    assert got == {0: rows[0][1], 1: "first\nlast", 2: "short\ncopy", 4: rows[4][1], 5: rows[5][1]}


@pytest.mark.parametrize("dedup", [simhash.near_dedup, shingle_join.jaccard_dedup])
def test_rows_without_id_or_with_one_id_keep_unrelated_texts(spark, dedup):
    texts = [" ".join(f"{c}{k}" for k in range(40)) for c in "abcde"]
    rows = [(None, texts[0]), (None, texts[0]), (None, texts[1]), (5, texts[1]), (None, texts[2]), (7, texts[3]), (7, texts[4])]
    got = sorted((str(r["doc_id"]), r["text"]) for r in dedup(documents(spark, rows)).collect())
    assert got == sorted([("None", texts[0]), ("5", texts[1]), ("None", texts[2]), ("7", texts[3]), ("7", texts[4])])


def test_substrings_and_packed_stages(spark):
    passage = " ".join(f"p{k}" for k in range(30))
    rows = [(0, f"a0 a1 {passage} a2"), (1, f"b0 {passage} b1"), (2, "alone")]
    kept = corpus_pipeline.substrings(spark, documents(spark, rows), "")
    want = substring_dedup.brute_force(rows)
    got = {r["doc_id"]: hashlib.sha256(r["text"].encode()).hexdigest() for r in kept.collect()}
    assert got == {d: w[2] for d, w in want.items()} and want[1][1] == 30
    assert {r["doc_id"] for r in corpus_pipeline.packed(spark, kept, "").collect()} == {0, 1, 2}


def test_texts_that_a_stage_empties_go_whatever_white_space_is_left(spark):
    rows = [(0, "same line", 0), (1, "\n\t ", 1), (2, "\n", 0), (3, "x\n", 2)]
    docs = spark.createDataFrame([(i, t, "en", "s", 9, n) for i, t, n in rows], "doc_id long, text string, lang string, source string, n_chars long, _n_removed int")
    got = {r["doc_id"]: r["n_chars"] for r in corpus_pipeline._shortened(docs, "_n_removed").collect()}
    assert got == {0: 9, 2: 1, 3: 2}


def test_language_stage_and_the_whole_run(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(9001, None, None, None, None), (9002, "", "en", "s", 0), (9003, "123 456", None, "s", 7), (None, "12", "en", None, 2)], docs.schema)
    given = docs.union(odd).withColumns({c: F.lit("own") for c in ("id", "h", "row", "_row", "score", "n_words")})
    kept = corpus_pipeline.language(spark, given, "")
    assert kept.columns == corpus_pipeline.COLUMNS
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    left = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert not left.keys() & {9001, 9002, 9003, None} and all(texts[d] == t for d, t in left.items()) and len(left) > 0.9 * len(texts)
    given.write.parquet(f"{tmp_path}/some/documents.parquet")
    packed = corpus_pipeline.run(spark, f"{tmp_path}/some").collect()
    assert {r["doc_id"] for r in packed} <= left.keys() and len({r["doc_id"] for r in packed}) > 0.5 * len(left)
    full = {}
    for r in packed:
        full[r["sequence_id"]] = full.get(r["sequence_id"], 0) + r["length"]
    assert max(full.values()) <= 2048
    given.where("false").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
