"""Operators 11 to 13: whitening, benchmark decontamination, Merkle manifest."""

import hashlib
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.llm import decontamination, merkle, whitening

DOCS = "doc_id long, text string, lang string, source string, n_chars long, grp string, id string, leaf string, rank int, n int, words string, x int"


def docs_of(spark, rows):
    """Rows (doc_id, text, source) with extra columns named like those the operators work with."""
    return spark.createDataFrame([(i, t, None if k % 4 == 0 else "en", s, None if t is None else len(t), "g", "i", "l", 1, 2, "w", 3) for k, (i, t, s) in enumerate(rows)], DOCS)


# 11 whitening


def plain_whitening(vectors):
    """n, sums and the exact covariance of the distinct vectors, then numpy in extended precision."""
    fit = sorted(set(vectors))
    n, width = len(fit), len(fit[0])
    sums = [sum(v[k] for v in fit) for k in range(width)]
    y = [[Fraction(v[k] * n - sums[k], n) for k in range(width)] for v in fit]
    cov = [[sum(a[i] * a[j] for a in y) / n for j in range(width)] for i in range(width)]
    return n, sums, cov


def embeddings(spark, vectors, parts=3):
    return spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>").repartition(parts)


@pytest.mark.parametrize("parts", [1, 7])
def test_whitening_equals_exact_covariance(spark, parts):
    rng = random.Random(parts)
    base = [[rng.gauss(3, 1 + 3 * k) for k in range(6)] for _ in range(60)]
    vectors = base + base[:20] + [base[0]] * 15
    x = [tuple(math.floor(256 * c) for c in v) for v in vectors]
    n, sums, cov = plain_whitening(x)
    values, q = np.linalg.eigh(np.array([[float(c) for c in r] for r in cov]))
    trace = float(sum(cov[k][k] for k in range(6)))
    rows = whitening.whiten(embeddings(spark, vectors, parts)).collect()
    assert len(rows) == 4 * len(vectors) and {r["n"] for r in rows} == {n}
    signs = {}
    for r in rows:
        k, v = r["component"], x[r["id"]]
        want = sum(float(v[i] - Fraction(sums[i], n)) * q[i, -k] for i in range(6)) / math.sqrt(values[-k])
        sign = signs.setdefault(k, 1 if want * r["whitened"] > 0 else -1)
        assert r["whitened"] == pytest.approx(sign * want, rel=1e-9, abs=1e-9)
        assert r["deviation"] == sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True))
        assert r["explained"] == pytest.approx(values[-k] / trace, rel=1e-12) and r["identity_error"] < 1e-12


def test_outer_sums_keep_what_doubles_lose():
    rng = np.random.default_rng(0)
    y = rng.normal(size=(77, 3)) * np.array([1e9, 1.0, 1e-6])
    high, low = whitening.outer_sum((y, y * 1e-17))
    exact = [[Fraction(v) + Fraction(v * 1e-17) for v in row] for row in y.tolist()]
    for t, (i, j) in enumerate(zip(*np.triu_indices(3), strict=True)):
        want, size = sum(r[i] * r[j] for r in exact), sum(abs(r[i] * r[j]) for r in exact)
        assert abs(Fraction(high[t]) + Fraction(low[t]) - want) <= size * Fraction(1, 2**98)


def test_eigen_of_graded_and_degenerate_matrices():
    rng = np.random.default_rng(1)
    y = rng.integers(-50, 50, size=(40, 5)).astype(float) * np.array([1e8, 1e4, 1.0, 1e-3, 0.0])
    high, low = whitening.outer_sum((y, np.zeros_like(y)))
    a = np.zeros((5, 5)), np.zeros((5, 5))
    for full, part in zip(a, (high, low), strict=True):
        i, j = np.triu_indices(5)
        full[i, j] = full[j, i] = part
    values, q = whitening.eigen(a)
    for k in range(4):
        v = [Fraction(c) for c in q[:, k].tolist()]
        exact = [[sum(Fraction(r[i]) * Fraction(r[j]) for r in y.tolist()) for j in range(5)] for i in range(5)]
        rayleigh = sum(v[i] * exact[i][j] * v[j] for i in range(5) for j in range(5)) / sum(c * c for c in v)
        assert values[k] == pytest.approx(float(rayleigh), rel=1e-9)
    assert abs(values[4]) < 1e-26 * values[0] and np.abs(q.T @ q - np.eye(5)).max() < 1e-15
    values, q = whitening.eigen((np.eye(3) * 7, np.zeros((3, 3))))
    assert np.allclose(values, 7) and np.abs(q.T @ q - np.eye(3)).max() < 1e-15


def test_whitening_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [[1.0, 2.0], [2.0, -1.0], [0.5, 0.25], [1.0, 2.0], [-0.0, -0.001]]
    rows = [(k, v) for k, v in enumerate(good)] + [(10, None), (11, [nan, 1.0]), (12, [1.0, -inf]), (13, [None, 1.0]), (14, []), (15, [1.0, 2.0, 3.0]), (None, [1.0, 2.0]), (None, [1.0, 2.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"id": F.lit("own"), "x": F.lit("own"), "n": F.lit(0)})
    got = whitening.whiten(table).collect()
    assert sorted((r["id"] if r["id"] is not None else -1, r["component"]) for r in got) == sorted([(k, c) for k in (*range(5), -1, -1) for c in (1, 2)])
    assert {r["n"] for r in got} == {4} and all(r["identity_error"] < 1e-12 for r in got)
    same = {r["component"]: r["whitened"] for r in got if r["id"] == 0}
    assert all(r["whitened"] == same[r["component"]] for r in got if r["id"] in (3, None))
    assert whitening.whiten(table.where("false")).count() == 0 and whitening.whiten(table.where("vec_id in (0, 3)")).count() == 0
    line = whitening.whiten(table.where("vec_id in (0, 1)")).collect()
    assert [(r["component"], r["explained"]) for r in line] == [(1, pytest.approx(1.0))] * 2 and line[0]["whitened"] == pytest.approx(-line[1]["whitened"])


def test_whitening_of_large_entries(spark):
    vectors = [[1e12 + k, -1e12 + k * k, float(k % 3)] for k in range(12)] + [[3e38, 0.0, 0.0]]
    got = whitening.whiten(embeddings(spark, vectors[:-1])).collect()
    x = [[256 * int(c) for c in v] for v in vectors[:-1]]
    n, sums, _ = plain_whitening([tuple(v) for v in x])
    assert all(r["deviation"] == sum((n * a - s) ** 2 for a, s in zip(x[r["id"]], sums, strict=True)) for r in got) and got[0]["identity_error"] < 1e-9
    far = whitening.whiten(embeddings(spark, vectors)).collect()
    assert {r["id"] for r in far if r["deviation"] is None} and len(far) >= 13


# 12 decontamination


def plain_hits(docs, items, size):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    windows = {}
    for item, text in items:
        w = words(text)
        for k in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + size]), set()).add(str(item))
    out = []
    for d, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in windows:
                    hit.update(range(k, k + n))
                    found |= windows[x]
        out.append((d, len(w), len(hit), ",".join(sorted(found))))
    return sorted(out, key=str)


def contaminated_corpus(seed):
    rng = random.Random(seed)
    vocabulary = ["ab", "a", "b", "ba", "É", "é", "x1", "1", "abab", "ß", "日本"]
    sep = lambda: rng.choice([" ", ". ", "\n", " - ", "\x00", "'", "_"])
    text = lambda n: "".join(rng.choice(vocabulary) + sep() for _ in range(n))
    items = [(k, text(rng.choice([1, 2, 4, 5, 9]))) for k in range(25)] + [(30, None), (31, " .-"), (32, "a"), (33, "A!"), (34, "only here and now")]
    docs = [(k, text(rng.randrange(0, 40))) for k in range(60)]
    docs += [(100 + k, text(5) + (items[k][1] or "").upper() + text(5)) for k in range(25)] + [(200, None), (201, ""), (202, "..."), (203, "only here and"), (204, "ONLY, here; and_now"), (204, "ONLY, here; and_now")]
    return docs, items


@pytest.mark.parametrize(("size", "block"), [(4, 1 << 20), (4, 300), (10, 1 << 20), (2, 500)])
def test_decontamination_equals_brute_force(spark, size, block):
    docs, items = contaminated_corpus(size)
    table = docs_of(spark, [(d, t, "s") for d, t in docs]).withColumn("h", F.lit("own"))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("window", F.lit("own"))
    got = decontamination.decontaminate(table, bench, size=size, block_bytes=block).collect()
    assert sorted(((r["id"], r["n_words"], r["n_hit"], ",".join(r["items"])) for r in got), key=str) == plain_hits(docs, items, size)
    for r in got:
        assert sum(x["end"] - x["start"] for x in r["ranges"]) == r["n_hit"] and all(a["end"] < b["start"] for a, b in zip(r["ranges"], r["ranges"][1:], strict=False))


def test_search_finds_overlapping_windows_and_skips():
    windows = [b" one two three ", b" two three four ", b" three four five six ", b" one two three four "]
    table = decontamination.WuManber(windows)
    text = b" zero one two three four five six one two three "
    assert sorted(table.search(text)) == sorted((k, w) for w in windows for k in range(len(text)) if text.startswith(w, k))
    looks = 0
    table.shift = type("Counted", (dict,), {"get": lambda self, k, d: (count(), dict.get(self, k, d))[1]})(table.shift)

    def count():
        nonlocal looks
        looks += 1

    assert not list(table.search(b" qq" * 5000)) and looks <= 15_000 / (table.m - table.b + 1) + 1


def test_decontamination_of_no_items_and_no_documents(spark):
    docs = docs_of(spark, [(1, "one two", None), (None, "three", "s")])
    bench = spark.createDataFrame([(1, "one"), (None, "three")], "item_id long, text string")
    none = decontamination.decontaminate(docs, bench.where("false")).collect()
    assert sorted((r["n_words"], r["n_hit"], r["items"]) for r in none) == [(1, 0, []), (2, 0, [])]
    assert decontamination.decontaminate(docs.where("false"), bench).count() == 0
    assert sorted((r["n_hit"], r["items"]) for r in decontamination.decontaminate(docs, bench).collect()) == [(1, []), (1, ["1"])]


# 13 Merkle manifest


def plain_manifest(rows, fanout, tampered):
    """Rows (doc_id, source, lang, n_chars, text) as in the contract."""
    h = lambda *x: hashlib.sha256("".join(x).encode()).hexdigest()
    leaf = lambda r: h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in r])

    def tree(nodes):
        paths, level, at = [[] for _ in nodes], list(nodes), list(range(len(nodes)))
        while len(level) > 1:
            for k, a in enumerate(at):
                run = level[a // fanout * fanout : a // fanout * fanout + fanout]
                paths[k].append((a % fanout, run))
            level = [h(*level[i : i + fanout]) for i in range(0, len(level), fanout)]
            at = [a // fanout for a in at]
        return level[0], paths

    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = tree([leaf(r) for r in groups[s]])
    root, above = tree([trees[s][0] for s in order])
    out = []
    for s, up in zip(order, above, strict=True):
        for r, own in zip(groups[s], trees[s][1], strict=True):
            path = own + up
            folded = leaf(tampered(r))
            for k, run in path:
                folded = h(*run[:k], folded, *run[k + 1 :])
            out.append((r[0], leaf(r), trees[s][0], root, h(*[x for k, run in path for j, x in enumerate(run) if j != k]), folded, folded == root))
    return sorted(out, key=str)


def lower_some(r):
    return (*r[:4], r[4].translate({c: c + 32 for c in range(65, 91)})) if r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 else r


@pytest.mark.parametrize(("fanout", "per_task"), [(2, 10), (16, 20_000), (3, 7)])
def test_manifest_equals_brute_force(spark, monkeypatch, fanout, per_task):
    monkeypatch.setattr(merkle, "PER_TASK", per_task)
    rng = random.Random(fanout)
    rows = [(k, rng.choice(["Bé ", "a:1", "-", ""]) * rng.randrange(4), "big" if k % 3 == 0 else rng.choice(["é", "a", None, "Z", "", "lone" if k == 50 else "a"])) for k in range(150)]
    rows += [(7, "tie", "big"), (7, "Tie", "big"), (7, "tie", "big"), (None, "NULL id", "big"), (None, None, None), (400, None, "z"), (401, "L" * 100_000, "z")]
    docs = docs_of(spark, rows).repartition(5)
    dealt = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    found = merkle.manifest(docs, fanout=fanout, where=dealt, tampered={"text": merkle.ascii_lower(docs["text"])})
    got = sorted((tuple(r) for r in found.leaves.collect()), key=str)
    plain = [(r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"]) for r in docs.collect()]
    want = plain_manifest(plain, fanout, lower_some)
    assert got == want and {r[6] for r in got} == {True, False}
    nodes = found.nodes.collect()
    assert [r["digest"] for r in nodes if r["top"]][-1:] and {r["digest"] for r in nodes} >= {got[0][3]}


def test_manifest_of_one_row_and_none(spark):
    docs = docs_of(spark, [(1, "Text", "s")])
    (r,) = merkle.manifest(docs).leaves.collect()
    assert r["leaf"] == r["subroot"] == r["root"] == r["folded_root"] and r["verified"] and r["proof_sha256"] == hashlib.sha256(b"").hexdigest()
    assert merkle.manifest(docs.where("false")).leaves.count() == 0
    assert merkle.manifest(docs.select(F.array("doc_id").alias("doc_id"), "source"), fields=["source"]).leaves.first()["id"] == [1]


@pytest.mark.parametrize("name", ["op11_whitening", "op12_decontamination", "op13_merkle"])
def test_queries_cover_their_tables(spark, sf, name):
    from tidewell.llm import registry

    got = registry.QUERIES[name](spark, sf)
    table = spark.read.parquet(f"{sf}/{'embeddings' if 'op11' in name else 'documents'}.parquet")
    assert got.count() == table.count() * (4 if "op11" in name else 1)
