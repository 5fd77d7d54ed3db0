import hashlib
import io
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.llm import components, exact_dedup, language_id, line_dedup, media, packing, quality, sentencepiece_codec, sharding, simhash, substring_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, d string, h string, id string, fp string, rn int, key double, _b int, words string"


def table(spark, texts, ids=None, langs=None, sources=None):
    """Documents with extra columns named like those the operators work with."""
    n = len(texts)
    ids, langs, sources = ids or list(range(n)), langs or ["en"] * n, sources or ["s"] * n
    rows = [(i, t, la, s, None if t is None else len(t), "x", "y", "z", "f", 1, 0.5, 2, "w") for i, t, la, s in zip(ids, texts, langs, sources, strict=True)]
    return spark.createDataFrame(rows, SCHEMA)


LONG = " ".join(f"w{k}" for k in range(30_000))
ODD = [None, "", " ", "one two", "one two", LONG, LONG, "\n\n", "é ü ß", "12 34", "One TWO"]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows."""
    t = table(spark, ODD, sources=[None, "a"] * 5 + ["a"])
    extra = table(spark, ["no id", "no id"], ids=[None, None], langs=[None, None])
    return t.union(t.where("doc_id in (1, 3)")).union(extra).cache()


@pytest.fixture(scope="module")
def empty(odd):
    return odd.where("false")


# 1 line dedup


def brute_lines(texts: dict[int, str], m: int) -> dict[int, str]:
    first, out = {}, {}
    for d in sorted(texts):
        lines = texts[d].split("\n")
        for i in range(len(lines) - m + 1):
            first.setdefault(tuple(lines[i : i + m]), (d, i))
    for d, text in texts.items():
        lines = text.split("\n")
        gone = {i + k for i in range(len(lines) - m + 1) if first[tuple(lines[i : i + m])] < (d, i) for k in range(m)}
        out[d] = "\n".join(x for i, x in enumerate(lines) if i not in gone)
    return out


@pytest.mark.parametrize("m", [1, 3, 5])
def test_line_dedup_equals_brute_force(spark, m):
    rng = random.Random(m)
    texts = {d: "\n".join(rng.choice("abc") for _ in range(rng.randrange(1, 14))) for d in range(60)}
    got = line_dedup.line_dedup(table(spark, list(texts.values()), list(texts)), m)
    assert {r["doc_id"]: r["text"] for r in got.collect()} == brute_lines(texts, m)


def test_line_dedup_of_frequent_lines_over_split_buckets(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "RANK_BUCKET", 1)
    monkeypatch.setattr(line_dedup, "MOST_BUCKETS", 100)
    rng = random.Random(0)
    texts = {d: "\n".join(["head"] + [rng.choice("ab") for _ in range(6)]) for d in range(40)}
    got = line_dedup.line_dedup(table(spark, list(texts.values()), list(texts)), 3)
    assert {r["doc_id"]: r["text"] for r in got.collect()} == brute_lines(texts, 3)


def test_repeated_runs_are_maximal_and_name_their_original(spark):
    long = [f"l{k}" for k in range(40)]
    texts = {0: [*long, "x"], 1: ["a", "b", "c", "d"], 2: ["y", *long[5:30], "a", "b", "c", "z"], 3: [*long, "x"], 4: ["u", "v"]}
    docs = table(spark, ["\n".join(t) for t in texts.values()], list(texts)).withColumns({"_n_lines": F.lit("own"), "_lines": F.lit("own")})
    got = sorted((r["d"], r["start"], r["n_lines"], r["of"]["d"], r["of"]["i"]) for r in line_dedup.repeated_runs(docs, 3).collect())
    assert got == [(2, 1, 25, 0, 5), (2, 26, 3, 1, 0), (3, 0, 41, 0, 0)]
    out = line_dedup.line_dedup(docs, 3)
    assert out.columns.count("_n_lines") == 1 and {r["doc_id"]: (r["_n_lines"], r["_n_removed"], r["_lines"]) for r in out.collect()}[2] == (30, 28, "own")


def test_line_dedup_of_equal_lines_and_equal_rows_stays_linear(spark):
    """A text of equal lines is one run, not one for every lag; rows that repeat each other are looked at once."""
    for texts in ({0: ["x"] * 200 + ["end"]}, {0: ["a", "b", "c"] * 60, 1: ["a", "b", "c"] * 90}, {0: ["x"] * 90, 1: ["y"] + ["x"] * 70 + ["z"]}):
        docs = table(spark, ["\n".join(t) for t in texts.values()], list(texts))
        runs = line_dedup.repeated_runs(docs, 3).collect()
        assert len(runs) <= 9 * 3 * len(texts)  # doublings times the longest period
        assert {r["doc_id"]: r["text"] for r in line_dedup.line_dedup(docs, 3).collect()} == brute_lines({d: "\n".join(t) for d, t in texts.items()}, 3)
    docs = table(spark, ["\n".join(["same"] * 30_000)])
    assert [(r["_n_lines"], r["_n_removed"], r["text"]) for r in line_dedup.line_dedup(docs, 3, min_words=1).collect()] == [(30_000, 29_999, "same")]
    one = table(spark, ["\n".join(f"l{k}" for k in range(40))], [None])
    rows = one.crossJoin(spark.range(3000)).drop("id").unionByName(table(spark, ["l3\nl4\nl5"], [7]).drop("id"))
    lines = line_dedup._lines(rows, "text", "doc_id")
    assert lines.count() == 43
    out = line_dedup.line_dedup(rows, 3).groupBy("doc_id", "text", "_n_removed").count().collect()
    assert sorted((r["doc_id"] or 0, r["_n_removed"], r["count"]) for r in out) == [(0, 0, 3000), (7, 3, 1)]


def test_line_dedup_joins_many_repeated_keys(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "BROADCAST_KEYS", 0)
    docs = table(spark, ["a\nb", "a\nb", "c", None], [1, 1, 2, 3])
    assert sorted((r["d"], r["i"]) for r in line_dedup._lines(docs, "text", "doc_id").collect()) == [(1, 0), (1, 1), (2, 0)]


def test_line_dedup_keeps_columns_and_odd_rows(odd, empty):
    got = line_dedup.line_dedup(odd, 1)
    assert got.columns == [*odd.columns, "_n_lines", "_n_removed"] and got.count() == odd.count()
    by = [(r["doc_id"], r["text"]) for r in got.orderBy("doc_id").collect()]
    assert by.count((None, "no id")) == 2 and by.count((3, "one two")) == 2 and by.count((1, "")) == 2 and (0, None) in by and (4, "") in by
    assert line_dedup.line_dedup(empty).count() == 0


# 2 media


def test_media_round_trip_and_digests(odd, empty, spark):
    stored = media.stored_media(odd)
    got = {(r["id"], r["n_bytes"]): r for r in media.media_features(stored).collect()}
    pngs = {(r["id"], r["n_bytes"]): bytes(r["media"]) for r in stored.collect()}
    for d, t in enumerate(ODD):
        data = (t or "").encode()
        payload = data + b"\xff" * (max(576, -(-len(data) // 576) * 576) - len(data))
        r = got[d, len(data)]
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(pngs[d, len(data)]), hashlib.sha256(pngs[d, len(data)]).hexdigest())
        assert media.decode_png(pngs[d, len(data)]).tobytes() == payload
    assert got[3, 7]["feature"] == got[4, 7]["feature"] and media.media_features(media.stored_media(empty)).count() == 0


def test_png_filters_and_damage():
    rng = np.random.default_rng(1)
    samples = rng.integers(0, 256, (10, 7), np.uint8)
    rows, above = [], np.zeros(7, int)
    for y, row in enumerate(samples.astype(int)):
        kind, left, corner = y % 5, np.concatenate([[0], row[:-1]]), np.concatenate([[0], above[:-1]])
        paeth = []
        for a, b, c in zip(left, above, corner, strict=True):
            p = a + b - c
            paeth.append(a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c)
        guess = [0 * row, left, above, (left + above) // 2, np.array(paeth)][kind]
        rows.append(np.concatenate([[kind], (row - guess) % 256]))
        above = row
    assert (media.unfilter(np.array(rows, np.uint8)) == samples).all()
    png = bytearray(media.encode_png(samples))
    png[45] ^= 1
    with pytest.raises(ValueError):
        media.decode_png(bytes(png))
    with pytest.raises(ValueError):
        media.decode_png(b"GIF89a")


def test_png_rows_take_filters_and_come_back():
    rng = np.random.default_rng(4)
    ramp = (np.arange(24)[None, :] * 9 + np.arange(40)[:, None] * 7).astype(np.uint8)
    for samples in (ramp, np.repeat(ramp[:1], 40, axis=0), rng.integers(0, 256, (40, 24), np.uint8), rng.integers(97, 123, (1, 24), np.uint8)):
        rows = media.filtered(samples)
        assert (media.unfilter(rows) == samples).all() and (media.decode_png(media.encode_png(samples)) == samples).all()
    assert set(media.filtered(ramp)[1:, 0].tolist()) <= {media.FILTER_SUB, media.FILTER_UP} and set(media.filtered(np.repeat(ramp[:1], 40, axis=0))[1:, 0].tolist()) == {media.FILTER_UP}


def test_cosine_hash_equals_plain_transform():
    """Averages and cosine sums by their definitions."""
    rng = np.random.default_rng(5)
    for height in (24, 31, 60):
        x = rng.integers(0, 256, (height, 24)).astype(float)
        small = np.zeros((24, 24))
        for i in range(24):
            low, high = i * height / 24, (i + 1) * height / 24
            for y in range(height):
                small[i] += x[y] * max(0.0, min(high, y + 1) - max(low, y)) / (high - low)
        plain = [[sum(small[y, z] * np.cos(np.pi * (2 * y + 1) * u / 48) * np.cos(np.pi * (2 * z + 1) * v / 48) for y in range(24) for z in range(24)) for v in range(8)] for u in range(8)]
        bits = [c > np.median(plain) for row in plain for c in row]
        assert int(media.cosine_hash(x.astype(np.uint8)), 16) == int("".join("01"[int(b)] for b in bits), 2)


def test_cosine_hash_moves_little():
    rng = np.random.default_rng(2)
    x = np.kron(rng.integers(0, 200, (6, 6)), np.ones((8, 8))).astype(np.uint8)
    y = np.clip(x.astype(int) + rng.integers(0, 3, x.shape), 0, 255).astype(np.uint8)
    bits = lambda s: int(media.cosine_hash(s), 16)
    assert (bits(x) ^ bits(y)).bit_count() <= 4 and media.cosine_hash(x) == media.cosine_hash(x.copy())


# 3 packing


def plain_best_fit(lengths, size):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fits = [k for k, g in enumerate(gaps) if g >= n]
        if fits:
            gaps[min(fits, key=lambda k: gaps[k])] -= n
        else:
            gaps.append(size - n)
    return len(gaps)


@pytest.mark.parametrize(("seed", "ranges"), [(0, 1), (0, 5), (1, 1), (2, 1), (3, 5)])
def test_packing_is_as_good_as_plain_best_fit(spark, monkeypatch, seed, ranges):
    monkeypatch.setattr(packing, "buckets_for", lambda n, least: ranges)
    rng = random.Random(seed)
    size = 50
    lengths = [[rng.randrange(1, size + 1) for _ in range(300)], [rng.choice([1, 7, 26, 50]) for _ in range(200)], [1] * 120, [17] * 50 + [16] * 50 + [1]][seed]
    cut = spark.createDataFrame([(k, 0, n) for k, n in enumerate(lengths)], "id long, piece int, length long")
    got = packing.pack(cut, size).toPandas().sort_values(["sequence_id", "offset"])
    assert sorted(got.length) == sorted(lengths) and sorted(got.id) == list(range(len(lengths)))
    assert (got.groupby("sequence_id").length.cumsum() - got.length == got.offset).all() and got.groupby("sequence_id").length.sum().max() <= size
    assert got.sequence_id.nunique() <= plain_best_fit(lengths, size) * 1.02 + 1


def test_no_sequence_is_overfull_beyond_2048_partitions(spark):
    """Ids of long pieces hold their partition's number, ids of opened sequences their round's: they must not meet."""
    cut = spark.range(4120, numPartitions=2060).select("id", F.lit(0).alias("piece"), F.when(F.col("id") % 2 == 0, 11).otherwise(6).cast("long").alias("length"))
    sums = packing.pack(cut, 16).groupBy("sequence_id").agg(F.sum("length").alias("n")).toPandas()
    assert sums.n.max() <= 16 and sums.n.sum() == 2060 * 17 and len(sums) == 2060 + 1030


@pytest.mark.parametrize("ranges", [1, 6])
def test_sweep_equals_a_stack(spark, monkeypatch, ranges):
    """Places from narrow to wide, each taking the longest piece that fits and is left."""
    monkeypatch.setattr(packing, "buckets_for", lambda n, least: ranges)
    rng = random.Random(11)
    for _ in range(2):
        items, gaps = [rng.randrange(10, 20) for _ in range(60)], [rng.randrange(5, 40) for _ in range(35)]
        rows = spark.createDataFrame([(k, n) for k, n in enumerate(items)], "k long, length long")
        open_ = spark.createDataFrame([(1000 + k, g) for k, g in enumerate(gaps)], "sequence_id long, gap long")
        places = packing.offered(open_, min(items), max(items), 10**9, 1)
        assert sorted((r["gap"], r["width"]) for r in places.collect()) == sorted((g, min(g, max(items))) for g in gaps if g >= min(items) for _ in range(max(1, g // max(items))))
        left, want = sorted(items), []
        for g, w in sorted((r["gap"], r["width"]) for r in places.collect()):
            fits = [n for n in left if n <= w]
            if fits:
                left.remove(fits[-1])
                want.append((fits[-1], g))
        got = [(r["length"], gaps[r["sequence_id"] - 1000]) for r in packing.matched(rows, places, 1).collect() if r["sequence_id"] is not None]
        assert sorted(got) == sorted(want)


def test_few_places_are_offered_for_few_pieces(spark):
    gaps = spark.range(20_000).select(F.col("id").alias("sequence_id"), F.lit(2000).cast("long").alias("gap"))
    assert 1000 <= packing.offered(gaps, 2, 4, 1000, 20_000).count() <= 22_000


def test_packing_matches_tokenizer(odd, empty):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(packing.default_vocabulary())
    got = packing.pack_documents(odd, packing.default_vocabulary(), 2048).toPandas()
    for d, t in enumerate(ODD):
        ids = own.encode(t or "", add_special_tokens=False).ids + [0]
        mine = got[got.id == d].sort_values("piece")
        reps = 2 if d in (1, 3) else 1
        assert mine.length.sum() == reps * len(ids)
        for r in mine.itertuples():
            part = ids[r.start : r.start + r.length]
            assert r.start == r.piece * 2048 and r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
    q = got.sort_values(["sequence_id", "offset"])
    assert (q.groupby("sequence_id").length.cumsum() - q.length == q.offset).all() and got.groupby("sequence_id").length.sum().max() <= 2048
    assert packing.pack_documents(empty, packing.default_vocabulary()).count() == 0


def test_word_tokenizer_on_all_plain_letters():
    """Every character below U+0250, in capitals too, alone and among others; random strings of them."""
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(packing.default_vocabulary())
    mine = packing.WordTokenizer(packing.default_vocabulary())
    rng = random.Random(12)
    letters = [chr(c) for c in range(0x250)]
    texts = [t for c in letters for t in (c, f"a{c}b {c}", f"{c}1 {c}{c}")] + ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 40))) for _ in range(30_000)]
    want = own.encode_batch_fast(texts, add_special_tokens=False)
    assert [t for t, e, g in zip(texts, want, mine.ids_of(texts), strict=True) if np.array(e.ids, "<u4").tobytes() != g] == []


def test_word_tokenizer_on_hard_texts():
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(packing.default_vocabulary())
    mine = packing.WordTokenizer(packing.default_vocabulary())
    for t in ["It's  a test\x1c of lines\tİstanbul ΣΑΣ", "é a\ńb", "don't'll <|endoftext|> x<|endoftext|>y", "日本語 テスト", "​zero", "a" * 5000]:
        assert mine.ids(t) == np.array(own.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), t


# 4 language ID


def test_language_id(spark, odd, empty):
    rng = random.Random(3)
    words = {"en": "the and of to in is that it".split(), "de": "der die und das ist nicht ein zu".split(), "fr": "le la et les des est une que".split(), "es": "el los y las del es una que".split()}
    langs = [rng.choice(list(words)) for _ in range(400)]
    docs = table(spark, [" ".join(rng.choice(words[la]) for _ in range(40)) for la in langs], langs=langs)
    model = language_id.train(docs, per_language=60)
    got = language_id.identify(docs, model).join(docs.select(F.col("doc_id").alias("k"), "lang"), F.col("id") == F.col("k")).withColumn("held", language_id.held_out(F.col("id"))).toPandas()
    assert got.held.any() and (got.lang == got.lang_pred)[got.held].mean() > 0.97 and got.score.between(0, 1).all()
    res = {(r["id"], r["lang_pred"]) for r in language_id.identify(odd, model).collect()}
    assert {(0, "und"), (1, "und"), (2, "und"), (9, "und")} <= res and (8, "und") not in res
    kept = language_id.reject_unidentified(odd, model)
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} == {3, 4, 5, 6, 8, 10, None}
    none = language_id.train(empty)
    assert {r["lang_pred"] for r in language_id.identify(odd, none).collect()} == {"und"} and language_id.identify(empty, none).count() == 0


def test_training_bounds_and_many_languages(spark, monkeypatch):
    """Every language is learned, however many; repeated rows and frequent languages don't crowd the sample."""
    rng = random.Random(13)
    langs = [f"x{k:03d}" for k in range(60)]
    texts = [" ".join(la + rng.choice("abc") for _ in range(12)) for la in langs for _ in range(9)]
    docs = table(spark, texts + [texts[0]] * 500, ids=[*range(len(texts)), *[0] * 500], langs=[la for la in langs for _ in range(9)] + ["x000"] * 500)
    seen = {}
    monkeypatch.setattr(language_id.Identifier, "fit", classmethod(lambda cls, x, labels: seen.update(n=Counter(labels.tolist())) or cls(None, {})))
    language_id.train(docs, per_language=4, most=180)
    assert set(seen["n"]) == set(langs) and max(seen["n"].values()) <= 3
    language_id.train(docs, per_language=4)
    assert max(seen["n"].values()) == 4


def test_machines_decide_as_their_margins_say():
    """Families by the largest margin, languages by votes: recomputed plainly from the weights."""
    rng = np.random.default_rng(14)
    x = rng.random((120, language_id.FEATURES), np.float32)
    labels = np.array(["en", "de", "nl", "fr", "es", "pl"] * 20)
    for k, la in enumerate(["en", "de", "nl", "fr", "es", "pl"]):
        x[labels == la, k * 50 : k * 50 + 50] += 1
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    model = language_id.Identifier.fit(x, labels)
    for v, la in zip(x, labels, strict=True):
        family = max(model.families.names, key=lambda f: float(model.families.weights[model.families.names.index(f)] @ np.append(v, 1)))
        duels = model.languages[family]
        votes = Counter({n: 0 for n in duels.names})
        for (a, b), w in zip(duels.pairs, duels.weights, strict=True):
            votes[duels.names[a if w @ np.append(v, 1) >= 0 else b]] += 1
        f, p = model.families.choose(v)
        language, q = model.languages[f].choose(v)
        assert f == family == language_id.FAMILY_OF[la] and votes[language] == max(votes.values()) and language == la and 0 < p <= 1 and 0 < q <= 1


def test_prediction_ignores_lang_and_source(spark):
    docs = table(spark, ["the and of"] * 8 + ["der die und"] * 8, langs=["en"] * 8 + ["de"] * 8)
    model = language_id.train(docs)
    other = docs.withColumn("lang", F.lit("de")).withColumn("source", F.lit(None).cast("string"))
    assert sorted(map(tuple, language_id.identify(docs, model).collect())) == sorted(map(tuple, language_id.identify(other, model).collect()))


# 5 SentencePiece


@pytest.fixture(scope="module")
def unigram(tmp_path_factory):
    """The public model file declared unigram, for the library's own answer."""
    import sentencepiece

    data = open(sentencepiece_codec.default_model(), "rb").read()
    out, at = io.BytesIO(), 0
    while at < len(data):  # the top-level fields are all length-delimited
        start = at
        key, at = data[at], at + 1
        n = shift = 0
        while True:
            b = data[at]
            at += 1
            n |= (b & 127) << shift
            shift += 7
            if b < 128:
                break
        body = data[at : at + n]
        at += n
        if key >> 3 == 2:
            body = body.replace(b"\x18\x02", b"\x18\x01", 1)
            assert len(body) < 1 << 14
            out.write(bytes([key]) + (bytes([len(body) & 127 | 128, len(body) >> 7]) if len(body) > 127 else bytes([len(body)])) + body)
        else:
            out.write(data[start:at])
    return sentencepiece.SentencePieceProcessor(model_proto=out.getvalue())


def test_viterbi_equals_library_unigram(unigram):
    own = sentencepiece_codec.Codec(sentencepiece_codec.default_model())
    rng = random.Random(5)
    texts = ["Hello world", " leading  and   double ", "naïve Ωμέγα 日本語 🙂", "a\nb\n\nc", "x" * 200, "the\tcat", "1234567890"] + ["".join(rng.choice("abcdehnrst é") for _ in range(60)) for _ in range(60)]
    compared = 0
    for t in texts:
        ids = own.encode(t)
        assert own.decode(ids) == t
        if "  " not in f" {t}" and not any(own.pieces[i][2] == sentencepiece_codec.BYTE for i in ids):  # runs of gaps tie in its single precision, and its list of best segmentations has no byte pieces
            best = unigram.nbest_encode(t, nbest_size=2)[0]
            assert ids == best or sum(own.pieces[i][1] for i in ids) == sum(own.pieces[i][1] for i in best), t  # equal scores may differ in order
            compared += 1
    assert compared > 20


def test_viterbi_equals_plain_search():
    own = sentencepiece_codec.Codec(sentencepiece_codec.default_model())
    scores = {p: s for p, s, kind in own.pieces if kind == sentencepiece_codec.NORMAL}
    rng = random.Random(6)
    for _ in range(40):
        text = "▁" + "".join(rng.choice("thereandoü") for _ in range(rng.randrange(1, 15)))
        best = [0.0] + [float("-inf")] * len(text)
        for e in range(1, len(text) + 1):
            for s in range(e):
                part = text[s:e]
                x = scores.get(part, own.unknown_score if len(part) == 1 else None)
                if x is not None:
                    best[e] = max(best[e], best[s] + x)
        assert own.viterbi(text)[1] == best[-1]


def test_sentencepiece_query_restores(odd, empty):
    got = {r["id"]: r for r in sentencepiece_codec.encoded(odd, sentencepiece_codec.default_model()).collect()}
    assert all(r["restored"] for r in got.values()) and got[0]["n_ids"] == got[1]["n_ids"] == 0 and len(got[5]["ids"]) == got[5]["n_ids"] > 30_000
    assert sentencepiece_codec.encoded(empty, sentencepiece_codec.default_model()).count() == 0


# 6 SimHash


def brute_fingerprint(text: str) -> int:
    import xxhash

    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hs = [xxhash.xxh64_intdigest(x.encode(), 42) for x in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs)) if hs else 0


def test_simhash_equals_brute_force(spark, odd, empty):
    rng = random.Random(7)
    base = [[f"w{rng.randrange(40)}" for _ in range(60)] for _ in range(12)]
    texts = []
    for words in base:
        for _ in range(5):
            w = list(words)
            w[rng.randrange(60)] = rng.choice(["X", "y", w[0]])
            texts.append(" ".join(w))
    rows = simhash.simhash_groups(table(spark, texts)).collect()
    fps = {r["id"]: r["fp"] & (1 << 64) - 1 for r in rows}
    assert fps == {d: brute_fingerprint(t) for d, t in enumerate(texts)}
    root = {d: d for d in fps}
    for _ in fps:
        for a in fps:
            for b in fps:
                if (fps[a] ^ fps[b]).bit_count() <= 2:
                    root[a] = root[b] = min(root[a], root[b])
    assert {r["id"]: r["component_id"] for r in rows} == root
    got = {}
    for r in simhash.simhash_groups(odd).collect():
        got.setdefault(r["id"], set()).add((r["fp"], r["component_id"]))
    assert got[0] == got[1] == got[2] == {(0, 0)} and got[3] == got[4] and got[5] == got[6] and {c for _, c in got[10]} == {3}
    assert simhash.simhash_groups(empty).count() == 0 and simhash.near_dedup(empty).count() == 0
    kept = simhash.near_dedup(odd)
    assert kept.columns == odd.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["0", "3", "5", "8", "9", "None"]


@pytest.mark.parametrize(("bits", "long"), [(1, 0), (1, 1 << 30), (2, 1 << 30), (5, 1 << 30)])
def test_forest_connects_all_links(bits, long, monkeypatch):
    monkeypatch.setattr(simhash, "LONG_LIST", long)
    rng = np.random.default_rng(bits)
    near = np.uint64(1) << rng.integers(0, 12, (700, 3)).astype(np.uint64)
    values = np.unique(np.bitwise_or.reduce(near, axis=1) ^ np.uint64(0xABCDEF0000000000))
    values = np.unique(np.concatenate([values, rng.integers(0, 1 << 16, 300).astype(np.uint64)]))
    edges = simhash.forest(values, bits)

    def parts(links):
        root = {int(v): int(v) for v in values}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in links:
            root[find(a)] = find(b)
        groups = {}
        for v in root:
            groups.setdefault(find(v), set()).add(v)
        return sorted(map(sorted, groups.values()))

    all_links = [(int(a), int(b)) for i, a in enumerate(values) for b in values[i + 1 :] if (int(a) ^ int(b)).bit_count() <= bits]
    assert len(edges) < len(values) and all((a ^ b).bit_count() <= bits for a, b in edges) and parts(edges) == parts(all_links)


@pytest.mark.parametrize(("bits", "long"), [(1, 1 << 30), (2, 1 << 30), (2, 3), (3, 3), (5, 1 << 30), (7, 1 << 30)])
def test_links_connect_what_brute_force_does(spark, monkeypatch, bits, long):
    monkeypatch.setattr(simhash, "LONG_LIST", long)  # with 3, most lists are split
    rng = random.Random(bits)
    values = {rng.getrandbits(64) for _ in range(30)}
    for v in list(values):
        for _ in range(6):
            values.add(v ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 9))))
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    got = [(r["a"] & (1 << 64) - 1, r["b"] & (1 << 64) - 1) for r in simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), bits).collect()]
    assert all((a ^ b).bit_count() <= bits for a, b in got)

    def parts(pairs):
        root = {v: v for v in values}
        for a, b in pairs:
            x, y = root[a], root[b]
            if x != y:
                root = {v: y if r == x else r for v, r in root.items()}
        return {frozenset(v for v in values if root[v] == r) for r in root.values()}

    assert parts(got) == parts([(a, b) for i, a in enumerate(values) for b in values[i + 1 :] if (a ^ b).bit_count() <= bits])


def test_components(spark):
    rng = random.Random(8)
    pairs = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(k, k + 1) for k in range(100, 140)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    root = {x: x for p in pairs for x in p}
    for _ in root:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {k: v for k, v in root.items() if any(k in p and p[0] != p[1] for p in pairs)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# 7 substring dedup


def check_substrings(spark, texts):
    rows = list(enumerate(texts))
    want = substring_dedup.brute_force(rows)
    got = substring_dedup.substring_dedup(table(spark, texts)).collect()
    assert {r["doc_id"]: (r["_n_words"], r["_n_removed"], hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in got} == want
    assert sum(w[1] for w in want.values()) > 0


def make_texts(seed):
    rng = random.Random(seed)
    passage = [f"p{k}" for k in range(55)]
    out = [None, "", "a " * 23, "a b c " * 9, "x " * 150]
    for _ in range(40):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(5, 90))]
        cut = rng.randrange(0, 30)
        out.append(" ".join(words[:20] + passage[cut : cut + rng.randrange(18, 55)] + words[20:]))
    return out + out[5:9]


def test_substring_dedup_equals_brute_force(spark):
    check_substrings(spark, make_texts(1))


def test_substring_dedup_splits_frequent_anchors(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "FREQUENT", 2)
    monkeypatch.setattr(substring_dedup, "CHUNK", 10)
    check_substrings(spark, make_texts(2))


def test_substring_dedup_takes_ids_of_any_type_and_clashing_names(spark):
    passage = " ".join(f"p{k}" for k in range(25))
    docs = spark.createDataFrame([("b", f"x {passage}", 1, 2), ("a", f"{passage} y", 3, 4), (None, "short", 5, 6)], "doc_id string, text string, _n_words int, runs int")
    got = substring_dedup.substring_dedup(docs)
    assert got.columns == ["doc_id", "text", "runs", "_n_words", "_n_removed"]
    twice = substring_dedup.substring_dedup(docs.unionAll(docs)).where("_n_removed > 0").collect()
    assert [r["doc_id"] for r in twice] == ["b", "b"]
    assert {r["doc_id"]: (r["text"], r["_n_removed"], r["runs"]) for r in got.collect()} == {"a": (f"{passage} y", 0, 4), "b": ("x", 25, 2), None: ("short", 0, 6)}


def test_substring_dedup_odd_rows(odd, empty):
    got = substring_dedup.substring_dedup(odd)
    assert got.columns == [*odd.columns, "_n_words", "_n_removed"] and got.count() == odd.count()
    by = {r["doc_id"]: r for r in got.collect()}
    assert by[0]["text"] is None and by[5]["_n_removed"] == 0 and by[6]["_n_removed"] == 30_000 and by[6]["text"] == ""
    assert substring_dedup.substring_dedup(empty).count() == 0


def test_rolling_hash_and_extremes():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 1 << 63, 70).astype(np.uint64)
    for size in (1, 2, 6, 13, 20):
        want = []
        for i in range(len(h) - size + 1):
            x = 0
            for v in h[i : i + size].tolist():
                x = (x * int(substring_dedup.BASE) + v) % (1 << 64)
            want.append(x)
        assert substring_dedup._rolling(h, size).tolist() == want
        assert substring_dedup._extreme(h, size, np.minimum).tolist() == [min(h[i : i + size].tolist()) for i in range(len(h) - size + 1)]


# 8 exact dedup


def test_exact_dedup(spark, odd, empty, tmp_path):
    path = f"file://{tmp_path}/docs.parquet"
    odd.repartition(3).write.parquet(path)
    got = exact_dedup.exact_dedup(spark, path, files_per_batch=1).collect()  # several batches, state carried over
    assert len(got) == odd.count()
    by = {}
    for r in sorted(got, key=lambda r: not r["kept"]):
        by.setdefault(r["id"], r)
    groups = Counter(r["text_sha256"] for r in got if r["kept"])
    assert set(groups.values()) == {1} and len(groups) == len({r["text_sha256"] for r in got})
    assert (by[3]["keep_id"], by[3]["group_size"], by[3]["kept"], by[10]["kept"]) == (10, 4, False, True)
    assert (by[0]["keep_id"], by[0]["group_size"]) == (1, 3) and by[1]["kept"] and by[8]["kept"] and by[6]["kept"] and not by[5]["kept"]
    assert by[None]["kept"] and by[None]["group_size"] == 2 and by[10]["text_sha256"] == hashlib.sha256(b"one two").hexdigest()
    none = f"file://{tmp_path}/none.parquet"
    empty.write.parquet(none)
    assert exact_dedup.exact_dedup(spark, none).count() == 0


def test_collisions_are_told_apart(spark, odd, tmp_path):
    path = f"file://{tmp_path}/c.parquet"
    table(spark, ["a", "b", "a"]).write.parquet(path)
    docs = spark.read.parquet(path)
    state = exact_dedup.stream_state(spark, path, docs.schema)
    assert exact_dedup.confirmed(docs, state).count() == 0
    digest = bytes.fromhex(hashlib.sha256(b"a").hexdigest())
    wrong = state.where(F.col("digest") == digest).withColumn("place", F.lit(1).cast("long"))  # as if the locator held other bytes
    assert exact_dedup.confirmed(docs, wrong).count() == 1


def kept_of(spark, tmp_path, rows, schema):
    path = f"file://{tmp_path}/ties.parquet"
    spark.createDataFrame(rows, schema).repartition(2).write.parquet(path)
    return exact_dedup.exact_dedup(spark, path).collect()


@pytest.mark.parametrize("often", [1_000, 1])
def test_exactly_one_row_of_a_group_stays(spark, tmp_path, monkeypatch, often):
    monkeypatch.setattr(exact_dedup, "OFTEN", often)  # with 1, groups of two are joined as frequent ones
    got = kept_of(spark, tmp_path, [(7, "X"), (7, "x"), (1, "x"), (None, "y"), (None, "y"), (3, "z"), (3, "z"), (4, "alone")], "doc_id long, text string")
    groups = {}
    for r in got:
        groups.setdefault(r["text_sha256"], []).append(r)
    assert sorted(len(g) for g in groups.values()) == [1, 2, 2, 3] and all(sum(r["kept"] for r in g) == 1 for g in groups.values())
    assert all({r["group_size"] for r in g} == {len(g)} and {r["keep_id"] for r in g} == {next(r["id"] for r in g if r["kept"])} for g in groups.values())


def test_exact_dedup_takes_ids_of_any_type(spark, tmp_path):
    got = {r["id"]: (r["keep_id"], r["kept"]) for r in kept_of(spark, tmp_path, [("a", "X"), ("b", "x"), ("c", "y")], "doc_id string, text string")}
    assert got == {"a": ("b", False), "b": ("b", True), "c": ("c", True)}


# 9 quality


def test_quality_prefers_target(spark, odd, empty):
    rng = random.Random(9)
    good = lambda: " ".join(rng.choice(["calm", "river", "stone", "light"]) for _ in range(30))
    bad = lambda: " ".join(rng.choice(["buy", "now", "river", "cheap"]) for _ in range(30))
    texts = [good() if k % 3 else bad() for k in range(300)]
    labels = spark.createDataFrame([(k, int(k % 3 > 0), 0) for k in range(0, 300, 2)], "doc_id long, quality int, toxic int")
    got = quality.resampled(table(spark, texts), labels).toPandas()
    assert abs(got.selected.sum() - 200) <= 1 and got[got.id % 3 > 0].selected.mean() > 0.98
    again = quality.resampled(table(spark, texts), labels).toPandas().set_index("id").sort_index()
    assert (again.key == got.set_index("id").sort_index().key).all()
    res = quality.resampled(odd, labels.where("false")).collect()
    assert len(res) == odd.count() and all(r["selected"] and r["log_weight"] == 0 for r in res) and quality.resampled(empty, labels).count() == 0


def test_log_weights_equal_brute_force(spark):
    rng = random.Random(12)
    texts = [" ".join(rng.choice("abcdefgh") * rng.randrange(1, 3) for _ in range(rng.randrange(0, 12))) for _ in range(80)] + [None]
    good = set(range(0, 80, 4))
    labels = spark.createDataFrame([(k, 1, 0) for k in good] + [(k, 1, 1) for k in range(1, 80, 4)] + [(999, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    grams = [[int(b) for part in quality.buckets((t or "").encode()) for b in part] for t in texts]
    assert all(len(g) == max(0, 2 * len((t or "").split()) - 1) for g, t in zip(grams, texts, strict=True))
    raw, target = Counter(b for g in grams for b in g), Counter(b for k in good for b in grams[k])
    chance = lambda c, b: (c[b] + 1) / (sum(c.values()) + quality.BUCKETS)
    want = [sum(np.log(chance(target, b) / chance(raw, b)) for b in g) for g in grams]
    got = {r["id"]: r["log_weight"] for r in quality.resampled(table(spark, texts), labels).collect()}
    assert got == pytest.approx(dict(enumerate(want)), abs=1e-9) and got[80] == 0


def test_threshold_is_exact(spark):
    rng = random.Random(10)
    values = [rng.gauss(0, 10) ** 3 for _ in range(5000)] + [1.5] * 3000
    df = spark.createDataFrame([(v,) for v in values], "key double").cache()
    for k in (1, 17, 2500, 4000, 7999):
        assert quality.threshold(df, k) == sorted(values, reverse=True)[k - 1]
    assert quality.threshold(df, 8000) == float("-inf") and quality.threshold(df, 0) == float("inf")


# 10 sharding


def test_shards_match_mixture(spark, odd, empty):
    sources = ["hot"] * 500 + [f"s{k % 7}" for k in range(503)]
    got = sharding.stratified_shards(table(spark, [f"t{k}" for k in range(1003)], sources=sources), shards=10).toPandas()
    sizes = got.groupby("shard").size()
    assert set(sizes) == {100, 101} and len(sizes) == 10
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))
    for s, n in Counter(sources).items():
        per = got[got.stratum == s].groupby("shard").size().reindex(range(10), fill_value=0)
        assert per.max() - per.min() <= 4 and per.sum() == n
    assert (got["size"] == got.id.map(lambda k: len(f"t{k}") + 16)).all()
    few = sharding.stratified_shards(odd, shards=40).collect()
    assert len(few) == odd.count() == len({r["shard"] for r in few}) and {(r["size"], r["text_crc32"]) for r in few if r["id"] == 0} == {(16, 0)}
    assert sharding.stratified_shards(empty).count() == 0


def test_shards_follow_the_whole_order(spark):
    """Ranks by hash in each source, fractions over all, equal cuts: sorted in one place."""
    sources = [None] * 9 + ["hot"] * 70 + [f"s{k % 4}" for k in range(44)]
    rows = table(spark, [f"t{k % 60}" for k in range(123)], sources=sources)
    hashes = rows.select("doc_id", "source", F.xxhash64(F.lit(42), "doc_id", F.xxhash64("text")).alias("h"), F.xxhash64(F.lit(42), "source").alias("of"), F.shiftrightunsigned(F.xxhash64(F.lit(42), F.lit("phase"), "source"), 11).alias("p")).collect()
    order = []
    for s in set(sources):
        own = sorted((r for r in hashes if r["source"] == s), key=lambda r: r["h"])
        order += [((k + 1 - (r["p"] + 0.5) / 2.0**53) / len(own), r["of"], r["doc_id"]) for k, r in enumerate(own)]
    ids, want, at = [i for *_, i in sorted(order)], {}, 0
    for shard in range(10):
        for slot in range(13 if shard < 3 else 12):
            want[ids[at]], at = (shard, slot), at + 1
    assert {r["id"]: (r["shard"], r["slot"]) for r in sharding.stratified_shards(rows, shards=10).collect()} == want
