"""Queries over texts: search, classification, term statistics, snippets, addresses, journal."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.functions import scalar
from tidewell.functions import text as tx
from tidewell.operators import classify as cf
from tidewell.operators import journal, training
from tidewell.operators.search import snippet
from tidewell.operators.textindex import TextIndex
from tidewell.plans.registry import half_up, query
from tidewell.sources import adapters as src
from tidewell.streaming.ingest import shared_folder

TAXONOMY = [
    {"id": "text.english", "keywords": ["the ing", "ed", "ea", "th"]},
    {"id": "text.german", "keywords": ["der", "die und", "ung", "sch"]},
    {"id": "text.french", "keywords": ["le", "les", "des", "eux", "eau"], "priority": 80},
    {"id": "text.spanish", "keywords": ["el", "los", "que", "ado", "mente"]},
    {"id": "text.romance", "keywords": ["de", "la", "en", "que"], "negative_keywords": ["und", "der"]},
    {"id": "junk.secret", "keywords": ["token", "password", "key"], "context_required": True, "context_terms": ["token"], "priority": 100},
]
STOP = "[" + ", ".join(f"'{w}'" for w in tx.STOPWORDS) + "]"


def toks(x: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({x}), '[^a-z0-9]+'), lambda t: t <> '' AND NOT list_contains({STOP}, t))"


def ftok(x: str) -> str:
    return "list_filter(regexp_split_to_array(translate(lower(" + x + "), '" + tx.ACCENTED + "', '" + tx.PLAIN + "'), '[^\\p{L}\\p{N}_-]+'), lambda t: t <> '')"


DOCS = "WITH d AS (SELECT doc_id, substr(text, 1, 60) AS title, text AS content FROM documents)"
INDEX = DOCS + f""", bag AS (SELECT doc_id, list_concat({ftok('title')}, {ftok('content')}) AS ts FROM d), st AS (SELECT count(*) AS n_docs, avg(len(ts)) AS avgdl FROM bag WHERE len(ts) > 0),
ix AS (SELECT doc_id, len(ts) AS dl, unnest(ts) AS term FROM bag), po AS (SELECT doc_id, dl, term, count(*) AS tf FROM ix GROUP BY ALL)"""


def _search_sql(atoms: list[str], condition: str, limit: int = 20) -> str:
    """``atoms``: conditions on term, one each; ``condition`` over a0, a1, ..."""
    parts = " UNION ALL ".join(f"SELECT {k} AS atom, doc_id, dl, sum(tf) AS tf FROM po WHERE {a} GROUP BY doc_id, dl" for k, a in enumerate(atoms))
    cols = ", ".join(f"max(CASE WHEN atom = {k} THEN tf END) AS a{k}" for k in range(len(atoms)))
    return INDEX + f""", h AS ({parts}), nn AS (SELECT atom, count(*) AS n FROM h GROUP BY atom),
s AS (SELECT h.*, greatest(1e-6, ln((n_docs - n + 0.5) / (n + 0.5))) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl)) AS s FROM h JOIN nn USING (atom), st),
b AS (SELECT doc_id, sum(s) AS s, {cols} FROM s GROUP BY doc_id)
SELECT doc_id, -floor(s * 1e6 + 0.5) / 1e6 AS rank FROM b WHERE {condition} ORDER BY rank, doc_id DESC LIMIT {limit}"""


def _docs(spark, sf):
    return src.table(spark, sf, "documents").select("doc_id", F.substring("text", 1, 60).alias("title"), F.col("text").alias("content"))


_indexes: dict[tuple[str, str], TextIndex] = {}


def _index(spark, sf) -> TextIndex:
    """The index of the documents, built once an application and searched by each query."""
    at = spark.sparkContext.applicationId, sf
    if at not in _indexes:
        index, docs = TextIndex(spark, shared_folder(spark, "text-index"), ["title", "content"]), _docs(spark, sf)
        index.add(docs)
        _indexes[at] = index
    return _indexes[at]


@query("fts_search", _search_sql(["term = 'thanea'", "term = 'eriner'"], "a0 IS NOT NULL AND a1 IS NOT NULL"))
def fts_search(spark, sf):
    return _index(spark, sf).search("thanea Eriner")


@query("fts_boolean", _search_sql(["term = 'token'", "starts_with(term, 'worth')", "term = 'und'"], "(a0 IS NOT NULL OR a1 IS NOT NULL) AND NOT a2 IS NOT NULL"))
def fts_boolean(spark, sf):
    return _index(spark, sf).search("(token OR worth*) NOT und")


TITLE = DOCS + f""", bag AS (SELECT doc_id, {ftok('title')} AS tt, list_concat({ftok('title')}, {ftok('content')}) AS ts FROM d), st AS (SELECT count(*) AS n_docs, avg(len(ts)) AS avgdl FROM bag WHERE len(ts) > 0),
h AS (SELECT doc_id, len(ts) AS dl, len(list_filter(tt, lambda t: t = 'the')) AS tf FROM bag), n AS (SELECT count(*) AS n FROM h WHERE tf > 0)
SELECT doc_id, -floor(greatest(1e-6, ln((n_docs - n + 0.5) / (n + 0.5))) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl)) * 1e6 + 0.5) / 1e6 AS rank FROM h JOIN documents USING (doc_id), st, n WHERE tf > 0 AND source = 'src1' ORDER BY rank, doc_id DESC LIMIT 20"""


@query("fts_column_filter", TITLE)
def fts_column_filter(spark, sf):
    """A word of one column, in documents of one source."""
    among = src.table(spark, sf, "documents").where("source = 'src1'")
    return _index(spark, sf).search("title:the", among=among)


PHRASE = DOCS + f""", bag AS (SELECT doc_id, {ftok('title')} AS tt, {ftok('content')} AS cc FROM d), st AS (SELECT count(*) AS n_docs, avg(len(tt) + len(cc)) AS avgdl FROM bag WHERE len(tt) + len(cc) > 0),
h AS (SELECT doc_id, len(tt) + len(cc) AS dl, len(list_filter(range(1, len(tt) - 1), lambda i: tt[i] = 'the' AND tt[i + 1] = 'and' AND tt[i + 2] = 'attion')) + len(list_filter(range(1, len(cc) - 1), lambda i: cc[i] = 'the' AND cc[i + 1] = 'and' AND cc[i + 2] = 'attion')) AS tf FROM bag), n AS (SELECT count(*) AS n FROM h WHERE tf > 0)
SELECT doc_id, -floor(greatest(1e-6, ln((n_docs - n + 0.5) / (n + 0.5))) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl)) * 1e6 + 0.5) / 1e6 AS rank FROM h, st, n WHERE tf > 0 ORDER BY rank, doc_id DESC LIMIT 20"""


@query("fts_phrase", PHRASE)
def fts_phrase(spark, sf):
    return _index(spark, sf).search('"the and attion"')


@query("fts_page_2", _search_sql(["term = 'of'"], "a0 IS NOT NULL", 20) + " OFFSET 20")
def fts_page_2(spark, sf):
    index = _index(spark, sf)
    last = index.search("of").collect()[-1]  # one page
    return index.search("of", after=(last["rank"], last["doc_id"]))


@query("fts_snippets")
def fts_snippets(spark, sf):
    found = _index(spark, sf).search("thanea Eriner")
    docs = _docs(spark, sf).join(F.broadcast(found), "doc_id")  # one page
    return docs.select("doc_id", "rank", snippet(F.col("content"), ["thanea", "eriner"]).alias("snippet"))


@query("tokenize", DOCS + f" SELECT doc_id, len({toks('content')}) AS n_tokens, list_aggregate({toks('content')}, 'string_agg', ' ') AS joined FROM d")
def tokenize(spark, sf):
    ts = tx.tokens(F.col("content"))
    return _docs(spark, sf).select("doc_id", F.size(ts).cast("long").alias("n_tokens"), F.when(F.size(ts) > 0, F.array_join(ts, " ")).alias("joined"))


IDF = DOCS + f""", tk AS (SELECT DISTINCT doc_id, unnest({toks("substr(content, 1, 3000)")}) AS term FROM d), dfx AS (SELECT term, count(*) AS df FROM tk GROUP BY term)"""


@query("corpus_idf", IDF + f" SELECT term, {half_up('ln(((SELECT count(*) FROM d) - df + 0.5) / (df + 0.5) + 1)', 6)} AS idf FROM dfx")
def corpus_idf(spark, sf):
    return cf.corpus_idf(_docs(spark, sf), F.col("content"))


def _keywords_sql() -> str:
    idf, rows = cf.topic_idf(TAXONOMY), []
    for t in TAXONOMY:
        for w in sorted({x for k in t["keywords"] for x in cf.python_tokens(k)}):
            neg = [x for k in t.get("negative_keywords", ()) for x in cf.python_tokens(k)]
            ctx = list(t.get("context_terms", ()))
            rows.append(f"('{t['id']}', '{w}', {idf[w]!r}::DOUBLE, {float(t.get('priority', 50))}::DOUBLE, {neg}::VARCHAR[], {ctx}::VARCHAR[])")
    return "kw(topic, term, idf, priority, neg, ctx) AS (VALUES " + ", ".join(rows) + ")"


BM25 = DOCS + f""", {_keywords_sql()}, tb AS (SELECT doc_id, {toks("substr(title || ' ' || content, 1, 3000)")} AS ts, {toks("substr(title, 1, 200)")} AS hs FROM d),
tf AS (SELECT doc_id, term, dl, count(*) AS tf, 1.0 AS boost FROM (SELECT doc_id, len(ts) AS dl, unnest(ts) AS term FROM tb) GROUP BY ALL UNION ALL SELECT doc_id, term, dl, count(*), 2.0 FROM (SELECT doc_id, len(hs) AS dl, unnest(hs) AS term FROM tb) GROUP BY ALL),
rw AS (SELECT doc_id, topic, sum(boost * (idf * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / 150)))) * (max(priority) / 50) AS raw, any_value(neg) AS neg, any_value(ctx) AS ctx FROM tf JOIN kw USING (term) GROUP BY 1, 2),
bs AS (SELECT doc_id AS doc, topic, {half_up('raw', 6)} AS score, {half_up('least(greatest(1 / (1 + exp(-(raw - 14.0) / 4.0)), 1e-6), 1 - 1e-6)', 3)} AS confidence FROM rw JOIN tb USING (doc_id) WHERE NOT list_has_any(ts, neg) AND (len(ctx) = 0 OR list_has_any(ts, ctx)))"""


def _scores(spark, sf):
    return cf.bm25_topics(_docs(spark, sf), cf.keyword_table(spark, TAXONOMY))


@query("bm25_topic_scores", BM25 + " SELECT *, score >= 10 AS matched FROM bs")
def bm25_topic_scores(spark, sf):
    return _scores(spark, sf)


@query("classify_bm25", BM25 + """, rk AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc ORDER BY score DESC, topic) AS INTEGER) AS rn FROM bs), fl AS (SELECT *, min(CASE WHEN score < [10.0, 14.0, 18.0, 22.0, 26.0][rn] THEN rn END) OVER (PARTITION BY doc) AS stop FROM rk WHERE rn <= 5)
SELECT doc, topic, rn, score, confidence FROM fl WHERE stop IS NULL OR rn < stop""")
def classify_bm25(spark, sf):
    return cf.classify(_scores(spark, sf))


@query("classify_weighted", BM25 + f""", lw AS (SELECT * FROM (VALUES ('text.french', 1.5::DOUBLE), ('text.english', 0.8::DOUBLE)) v(topic, weight)), ws AS (SELECT doc, topic, {half_up('score * coalesce(weight, 1.0)', 6)} AS score, {half_up('least(1.0, confidence * coalesce(weight, 1.0))', 3)} AS confidence FROM bs LEFT JOIN lw USING (topic) WHERE score >= 10),
rk AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc ORDER BY score DESC, topic) AS INTEGER) AS rn FROM ws), fl AS (SELECT *, min(CASE WHEN score < [10.0, 14.0, 18.0, 22.0, 26.0][rn] THEN rn END) OVER (PARTITION BY doc) AS stop FROM rk WHERE rn <= 5)
SELECT doc, topic, rn, score, confidence FROM fl WHERE stop IS NULL OR rn < stop""")
def classify_weighted(spark, sf):
    """With weights that were learned for two topics."""
    return cf.classify(_scores(spark, sf), weights=spark.createDataFrame([("text.french", 1.5), ("text.english", 0.8)], "topic string, weight double"))


VOCAB = DOCS + f""", tk AS (SELECT DISTINCT doc_id, unnest({toks('content')}) AS term FROM d), vo AS (SELECT term, count(*) AS df FROM tk GROUP BY term ORDER BY df DESC, term LIMIT 200)"""


@query("vocabulary", VOCAB + " SELECT * FROM vo")
def vocabulary(spark, sf):
    return cf.vocabulary(_docs(spark, sf), F.col("content"), 200)


@query("tfidf_vectors", VOCAB + f""", tf AS (SELECT doc_id AS doc, term, count(*) AS tf FROM (SELECT doc_id, unnest({toks('content')}) AS term FROM d) GROUP BY ALL), w AS (SELECT doc, term, (1 + ln(tf)) * (ln(((SELECT count(*) FROM d) + 1) / CAST(df + 1 AS DOUBLE)) + 1) AS w FROM tf JOIN vo USING (term))
SELECT doc, term, {half_up('w / sqrt(sum(w * w) OVER (PARTITION BY doc))', 6)} AS weight FROM w""")
def tfidf_vectors(spark, sf):
    docs = _docs(spark, sf)
    return cf.tfidf(docs, cf.vocabulary(docs, F.col("content"), 200), F.col("content"))


def _labels(spark, sf):
    """Labels as (doc, label), a row without label where a document has none."""
    lb = src.table(spark, sf, "labels")
    both = F.array_compact(F.array(F.when(F.col("quality") == 1, "quality"), F.when(F.col("toxic") == 1, "toxic")))
    return lb.select(F.col("doc_id").alias("doc"), F.explode_outer(both).alias("label"))


@query("chi2_vocabulary", DOCS + f""", lb AS (SELECT doc_id AS doc, 'quality' AS label FROM labels WHERE quality = 1 UNION ALL SELECT doc_id, 'toxic' FROM labels WHERE toxic = 1), own AS (SELECT d.* FROM d SEMI JOIN labels USING (doc_id)), n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM own),
pr AS (SELECT DISTINCT doc_id AS doc, unnest({toks('content')}) AS term FROM own), dfx AS (SELECT term, count(*) AS df FROM pr GROUP BY 1), sz AS (SELECT label, count(DISTINCT doc) AS size FROM lb JOIN own ON doc = doc_id GROUP BY 1), jt AS (SELECT term, label, count(*) AS a FROM pr JOIN lb USING (doc) GROUP BY 1, 2),
ct AS (SELECT term, CAST(coalesce(a, 0) AS DOUBLE) AS a, df - coalesce(a, 0) AS b, size - coalesce(a, 0) AS c, n FROM dfx CROSS JOIN sz LEFT JOIN jt USING (term, label), n), cd AS (SELECT *, n - a - b - c AS dd FROM ct)
SELECT term, {half_up('max(CASE WHEN (a + b) * (c + dd) * (a + c) * (b + dd) <> 0 THEN n * pow(a * dd - b * c, 2.0) / ((a + b) * (c + dd) * (a + c) * (b + dd)) END)', 6)} AS chi2 FROM cd GROUP BY term HAVING chi2 IS NOT NULL ORDER BY chi2 DESC, term LIMIT 500""")
def chi2_vocabulary(spark, sf):
    docs = _docs(spark, sf)
    labels = _labels(spark, sf).join(docs.select(F.col("doc_id").alias("doc")), "doc", "left_semi")
    return cf.chi_squared(docs, labels, F.col("content"), 500)


@query("threshold_sweep", f"""WITH s AS (SELECT 'quality' AS topic, CAST(n_chars // 50 AS DOUBLE) AS score, quality AS label FROM labels JOIN documents USING (doc_id) UNION ALL SELECT 'toxic', CAST(n_chars // 50 AS DOUBLE), toxic FROM labels JOIN documents USING (doc_id)),
g AS (SELECT topic, score, sum(label) AS p, count(*) AS n FROM s GROUP BY 1, 2), c AS (SELECT topic, score, sum(p) OVER w AS tp, sum(n) OVER w AS seen, sum(p) OVER (PARTITION BY topic) AS pos FROM g WINDOW w AS (PARTITION BY topic ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
f AS (SELECT topic, score, tp / CAST(seen AS DOUBLE) AS pr, tp / CAST(pos AS DOUBLE) AS re FROM c), q AS (SELECT *, {half_up('CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0.0 END', 9)} AS f1 FROM f)
SELECT topic, score AS threshold, {half_up('pr', 6)} AS precision, {half_up('re', 6)} AS recall, {half_up('f1', 6)} AS f1 FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY f1 DESC, score DESC) AS rn FROM q WHERE pr >= 0.1 AND f1 > 0) WHERE rn = 1""")
def threshold_sweep(spark, sf):
    rows = src.table(spark, sf, "labels").join(src.table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    pairs = F.explode(F.array(F.struct(F.lit("quality").alias("topic"), F.col("quality").alias("label")), F.struct(F.lit("toxic").alias("topic"), F.col("toxic").alias("label"))))
    return cf.best_threshold(rows.select(F.floor(F.col("n_chars") / 50).cast("double").alias("score"), pairs.alias("p")).select("p.topic", "score", "p.label"))


def _reviewed(spark, sf):
    """Labels of people beside a crude machine's: long texts are good, texts of source src3 toxic."""
    rows = src.table(spark, sf, "labels").join(src.table(spark, sf, "documents").select("doc_id", "n_chars", "source"), "doc_id")
    human = F.array_compact(F.array(F.when(F.col("quality") == 1, "quality"), F.when(F.col("toxic") == 1, "toxic")))
    machine = F.array_compact(F.array(F.when(F.col("n_chars") > 800, "quality"), F.when(F.col("source") == "src3", "toxic")))
    return rows.select(human.alias("human"), machine.alias("machine"))


REVIEWED = "WITH rv AS (SELECT list_filter([CASE WHEN quality = 1 THEN 'quality' END, CASE WHEN toxic = 1 THEN 'toxic' END], lambda x: x IS NOT NULL) AS human, list_filter([CASE WHEN n_chars > 800 THEN 'quality' END, CASE WHEN source = 'src3' THEN 'toxic' END], lambda x: x IS NOT NULL) AS machine FROM labels JOIN documents USING (doc_id))"


EVAL = REVIEWED + f""", x AS (SELECT topic, list_contains(machine, topic) AS m, list_contains(human, topic) AS h FROM rv CROSS JOIN (VALUES ('quality'), ('toxic')) v(topic)),
e AS (SELECT topic, count(*) FILTER (WHERE m AND h) AS tp, count(*) FILTER (WHERE m AND NOT h) AS fp, count(*) FILTER (WHERE h AND NOT m) AS fn FROM x GROUP BY 1), p AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / CAST(tp + fp AS DOUBLE) ELSE 0.0 END AS pr, CASE WHEN tp + fn > 0 THEN tp / CAST(tp + fn AS DOUBLE) ELSE 0.0 END AS re FROM e)
SELECT topic, tp + fp + fn AS samples, {half_up('pr', 3)} AS precision, {half_up('re', 3)} AS recall, {half_up('CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0.0 END', 3)} AS f1, fp AS false_positives, fn AS false_negatives FROM p WHERE tp + fp + fn >= 30"""


@query("label_eval", EVAL)
def label_eval(spark, sf):
    return cf.evaluate(_reviewed(spark, sf))


@query("label_macro", f"SELECT {half_up('avg(precision)', 3)} AS precision, {half_up('avg(recall)', 3)} AS recall, {half_up('avg(f1)', 3)} AS f1, count(*) AS topics FROM ({EVAL})")
def label_macro(spark, sf):
    return cf.macro_average(cf.evaluate(_reviewed(spark, sf)))


@query("label_losses", REVIEWED + f", l AS (SELECT len(list_filter(machine, lambda x: NOT list_contains(human, x))) + len(list_filter(human, lambda x: NOT list_contains(machine, x))) AS k, len(machine) AS nm, len(human) AS nh FROM rv) SELECT {half_up('sum(k) / (count(*) * 2.0)', 6)} AS hamming_loss, count(*) FILTER (WHERE nm >= 1) AS over_classified, count(*) FILTER (WHERE nm >= 1 AND nh < 1) AS falsely_over_classified FROM l")
def label_losses(spark, sf):
    return cf.label_losses(_reviewed(spark, sf), 2, many=1)


@query("confusion_pairs", REVIEWED + """, f AS (SELECT unnest(list_filter(machine, lambda x: NOT list_contains(human, x))) AS predicted, coalesce(human[1], 'none') AS actual, 'fp' AS direction FROM rv UNION ALL SELECT coalesce(machine[1], 'none'), unnest(list_filter(human, lambda x: NOT list_contains(machine, x))), 'fn' FROM rv)
SELECT predicted, actual, direction, count(*) AS count FROM f GROUP BY ALL ORDER BY 4 DESC, 1, 2, 3 LIMIT 20""")
def confusion_pairs(spark, sf):
    return cf.confusion_pairs(_reviewed(spark, sf))


def _held_out(spark, sf):
    """Scores of labelled documents that the model of their topic has not seen."""
    lb = _labels(spark, sf)
    split = training.rare_first_split(lb.select("doc", F.coalesce("label", F.lit("none")).alias("label")))
    rows = lb.groupBy("doc").agg(F.collect_set("label").alias("topics")).join(split, "doc").join(src.table(spark, sf, "documents").select(F.col("doc_id").alias("doc"), tx.tokens(F.col("text")).alias("tokens")), "doc")
    return training.train_topic(rows, "quality")[0]


@query("lr_predictions")
def lr_predictions(spark, sf):
    return _held_out(spark, sf).select("doc", "label", (F.col("score") >= 0).cast("int").alias("prediction"))


@query("lr_calibrated")
def lr_calibrated(spark, sf):
    """The calibration is fitted on one half of the held-out documents and applied to the other."""
    rows = _held_out(spark, sf).withColumn("half", F.pmod(F.xxhash64("doc"), F.lit(2))).cache()
    scored, fitted = rows.where("half = 0"), rows.where("half = 1")
    return scored.select("doc", "label", scalar.half_up(training.calibrated(F.col("score"), *training.platt(fitted)), 3).alias("probability"))


@query("training_plan", "WITH lb AS (SELECT 'quality' AS topic, doc_id FROM labels WHERE quality = 1 UNION ALL SELECT 'toxic', doc_id FROM labels WHERE toxic = 1) SELECT topic, count(DISTINCT doc_id) AS positives, CASE WHEN count(DISTINCT doc_id) >= 20 THEN 'model' ELSE 'bm25_fallback' END AS method FROM lb GROUP BY 1")
def training_plan(spark, sf):
    return training.plan_training(_labels(spark, sf), least_labelled=1)


def _training_events(spark, sf):
    """Labelled documents as events of a training set; those whose length is a multiple of four wait for review."""
    rows = src.table(spark, sf, "labels").join(src.table(spark, sf, "documents"), "doc_id")
    human = F.array_compact(F.array(F.when(F.col("quality") == 1, "quality"), F.when(F.col("toxic") == 1, "toxic")))
    waits = F.col("n_chars") % 4 == 0
    at = F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00"))
    return rows.select(F.col("doc_id").alias("id"), F.concat(F.lit("d"), "doc_id").alias("event_id"), F.substring("text", 1, 60).alias("title"), F.when(~waits, human).alias("human_topics"), F.when(~waits, at).alias("reviewed_at"))


TRAINING = "WITH tr AS (SELECT doc_id AS id, 'd' || doc_id AS event_id, substr(text, 1, 60) AS title, n_chars % 4 <> 0 AS done, quality, toxic FROM labels JOIN documents USING (doc_id)) "


@query("review_next", TRAINING + "SELECT id, event_id, title FROM tr WHERE NOT done ORDER BY id LIMIT 25")
def review_next(spark, sf):
    return training.next_unreviewed(_training_events(spark, sf), 25).select("id", "event_id", "title")


@query("review_list", TRAINING + "SELECT id, event_id, title FROM tr WHERE done AND toxic = 1 ORDER BY id LIMIT 50")
def review_list(spark, sf):
    return training.listed(_training_events(spark, sf), reviewed=True, topic="toxic", limit=50).select("id", "event_id", "title")


@query("review_progress", TRAINING + f"SELECT count(*) AS total, count(*) FILTER (WHERE done) AS reviewed, count(*) FILTER (WHERE NOT done) AS remaining, {half_up('count(*) FILTER (WHERE done) / CAST(count(*) AS DOUBLE)', 3)} AS pct_complete FROM tr")
def review_progress(spark, sf):
    return training.progress(_training_events(spark, sf))


@query("review_coverage", TRAINING + "SELECT topic, count(*) AS count, count(*) >= 30 AS sufficient FROM (SELECT 'quality' AS topic FROM tr WHERE done AND quality = 1 UNION ALL SELECT 'toxic' FROM tr WHERE done AND toxic = 1) GROUP BY 1")
def review_coverage(spark, sf):
    return training.coverage(_training_events(spark, sf))


#: A model of two topics over the vocabulary, its weights a rule of length and first letter. Documents without any of its terms have the bias.
MODEL = VOCAB + f""", mf AS (SELECT doc_id AS doc, term, count(*) AS tf FROM (SELECT doc_id, unnest({toks('content')}) AS term FROM d) GROUP BY ALL), w AS (SELECT doc, term, (1 + ln(tf)) * (ln(((SELECT count(*) FROM d) + 1) / CAST(df + 1 AS DOUBLE)) + 1) AS w FROM mf JOIN vo USING (term)),
tv AS (SELECT doc, term, {half_up('w / sqrt(sum(w * w) OVER (PARTITION BY doc))', 6)} AS weight FROM w), mw AS (SELECT 'text.romance' AS topic, term, (length(term) % 5 - 2) * 2.0::DOUBLE AS w FROM vo UNION ALL SELECT 'junk.secret', term, (ascii(term) % 3 - 1) * 3.0::DOUBLE FROM vo),
mb AS (SELECT * FROM (VALUES ('text.romance', 0.75::DOUBLE, 0.5::DOUBLE), ('junk.secret', -0.5::DOUBLE, 0.0::DOUBLE)) v(topic, bias, threshold)),
lh AS (SELECT doc, topic, sum(weight * w) AS dot FROM tv JOIN mw USING (term) GROUP BY 1, 2),
lg AS (SELECT doc_id AS doc, mb.topic, {half_up('coalesce(dot, 0.0) + bias', 6)} AS logit, threshold FROM d CROSS JOIN mb LEFT JOIN lh ON lh.doc = doc_id AND lh.topic = mb.topic)"""


@query("model_logits", MODEL + " SELECT doc, topic, logit FROM lg WHERE logit >= threshold")
def model_logits(spark, sf):
    return _logits(spark, sf).where("logit >= threshold").select("doc", "topic", "logit")


def _logits(spark, sf):
    docs = _docs(spark, sf)
    terms = cf.vocabulary(docs, F.col("content"), 200)
    rule = F.array(F.struct(F.lit("text.romance").alias("topic"), ((F.length("term") % 5 - 2) * 2.0).alias("w")), F.struct(F.lit("junk.secret").alias("topic"), ((F.ascii("term") % 3 - 1) * 3.0).alias("w")))
    weights = terms.select("term", F.explode(rule).alias("r")).select("r.topic", "term", "r.w")
    bias = spark.createDataFrame([("text.romance", 0.75, 0.5), ("junk.secret", -0.5, 0.0)], "topic string, bias double, threshold double")
    return training.logits(docs.select(F.col("doc_id").alias("doc")), cf.tfidf(docs, terms, F.col("content")), weights, bias)


GUARDS = ", gw AS (SELECT topic, any_value(neg) AS neg, any_value(ctx) AS ctx FROM kw GROUP BY 1)"


@query("classify_with_model", BM25 + MODEL.removeprefix(DOCS) + GUARDS + f""", al AS (SELECT doc, topic, {half_up('1 / (1 + exp(-logit))', 3)} AS confidence, 'model' AS path FROM lg JOIN gw USING (topic) JOIN tb ON doc_id = doc WHERE logit >= threshold AND NOT list_has_any(ts, neg) AND (len(ctx) = 0 OR list_has_any(ts, ctx)) UNION ALL SELECT doc, topic, confidence, 'keywords' FROM bs WHERE score >= 10 AND topic NOT IN ('text.romance', 'junk.secret'))
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY doc ORDER BY confidence DESC, topic) AS INTEGER) AS rn FROM al) WHERE rn <= 5""")
def classify_with_model(spark, sf):
    """Both topics with a model have guard words."""
    docs, keywords = _docs(spark, sf), cf.keyword_table(spark, TAXONOMY)
    text = F.substring(F.concat_ws(" ", "title", "content"), 1, 3000)
    found = training.guarded(_logits(spark, sf), docs, text, cf.guard_words(keywords))
    return training.with_model(found, cf.bm25_topics(docs, keywords), spark.createDataFrame([("text.romance",), ("junk.secret",)], "topic string")).select("doc", "topic", "confidence", "path", "rn")


METRICS = BM25 + MODEL.removeprefix(DOCS) + f""", tr AS (SELECT doc_id AS doc, 'text.romance' AS topic FROM documents WHERE lang IN ('fr', 'es') UNION ALL SELECT doc_id, 'junk.secret' FROM labels WHERE toxic = 1),
sc AS (SELECT lg.doc, lg.topic, logit AS score, CASE WHEN tr.doc IS NULL THEN 0 ELSE 1 END AS label, coalesce(bs.score >= 10, false) AS said FROM lg LEFT JOIN tr ON tr.doc = lg.doc AND tr.topic = lg.topic LEFT JOIN bs ON bs.doc = lg.doc AND bs.topic = lg.topic),
g AS (SELECT topic, score, sum(label) AS p, count(*) AS n FROM sc GROUP BY 1, 2), c AS (SELECT topic, score, sum(p) OVER v AS tp, sum(n) OVER v AS seen, sum(p) OVER (PARTITION BY topic) AS pos FROM g WINDOW v AS (PARTITION BY topic ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
f AS (SELECT topic, score, tp / CAST(seen AS DOUBLE) AS pr, tp / CAST(pos AS DOUBLE) AS re FROM c), q AS (SELECT *, {half_up('CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0.0 END', 9)} AS f1 FROM f),
th AS (SELECT topic, score AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY f1 DESC, score DESC) AS rn FROM q WHERE pr >= 0.1 AND f1 > 0) WHERE rn = 1),
ev AS (SELECT sc.topic, coalesce(threshold, 0.0) AS threshold, count(*) FILTER (WHERE score >= coalesce(threshold, 0.0) AND label = 1) AS tp, count(*) FILTER (WHERE score >= coalesce(threshold, 0.0) AND label = 0) AS fp, count(*) FILTER (WHERE score < coalesce(threshold, 0.0) AND label = 1) AS fn,
 count(*) FILTER (WHERE said AND label = 1) AS btp, count(*) FILTER (WHERE said AND label = 0) AS bfp, count(*) FILTER (WHERE NOT said AND label = 1) AS bfn FROM sc LEFT JOIN th USING (topic) GROUP BY 1, 2),
mm AS (SELECT topic, threshold, CASE WHEN tp + fp > 0 THEN tp / CAST(tp + fp AS DOUBLE) ELSE 0.0 END AS pr, CASE WHEN tp + fn > 0 THEN tp / CAST(tp + fn AS DOUBLE) ELSE 0.0 END AS re, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / CAST(2 * tp + fp + fn AS DOUBLE) ELSE 0.0 END AS f1, CASE WHEN 2 * btp + bfp + bfn > 0 THEN 2 * btp / CAST(2 * btp + bfp + bfn AS DOUBLE) ELSE 0.0 END AS bf FROM ev)
SELECT topic, threshold, {half_up('pr', 3)} AS val_precision, {half_up('re', 3)} AS val_recall, {half_up('f1', 3)} AS val_f1, {half_up('bf', 3)} AS bm25_val_f1, {half_up('least(0.5, greatest(0.05, f1 / (bf + f1 + 0.01)))', 3)} AS blend_alpha FROM mm"""


@query("model_metrics", METRICS)
def model_metrics(spark, sf):
    """Thresholds and figures of the model of two topics, against the languages and the toxic labels."""
    romance = src.table(spark, sf, "documents").where("lang in ('fr', 'es')").select(F.col("doc_id").alias("doc"), F.lit("text.romance").alias("label"))
    secret = src.table(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").alias("doc"), F.lit("junk.secret").alias("label"))
    return training.validated(_logits(spark, sf), romance.union(secret), _scores(spark, sf))


@query("trained_models")
def trained_models(spark, sf):
    """All topics trained on the languages of the documents: what each model reaches on documents it hasn't seen."""
    lang = F.create_map(*[F.lit(x) for pair in (("en", "text.english"), ("de", "text.german"), ("fr", "text.french"), ("es", "text.spanish")) for x in pair])
    labels = src.table(spark, sf, "documents").select(F.col("doc_id").alias("doc"), lang[F.col("lang")].alias("label"))
    return training.train_classifier(_docs(spark, sf), labels, cf.keyword_table(spark, TAXONOMY), least_labelled=1).table


@query("training_sample")
def training_sample(spark, sf):
    return cf.training_sample(src.events(spark, sf), 500).select("event_id", "title", "source")


@query("stratified_split")
def stratified_split(spark, sf):
    return training.rare_first_split(_labels(spark, sf).where("label is not null"))


@query("sanitize_text", """WITH c AS (SELECT doc_id, coalesce(text, '') AS g, regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '[\\x{00}-\\x{08}\\x{0b}\\x{0c}\\x{0e}-\\x{1f}\\x{7f}-\\x{9f}]', '', 'g'), '[\\x{200b}-\\x{200f}\\x{feff}\\x{2060}-\\x{2064}\\x{206a}-\\x{206f}]', '', 'g'), '[\\r\\n]+', ' ', 'g'), ' {2,}', ' ', 'g')), '<', '&lt;', 'g'), '>', '&gt;', 'g') AS t FROM documents)
SELECT doc_id, CASE WHEN length(t) > 500 THEN substr(t, 1, 497) || '...' ELSE t END AS snippet, length(t) > 500 AS truncated, regexp_matches(g, '(?i)\\[INST\\]|\\[/INST\\]|<\\|system\\|>|<<SYS>>|\\[SYSTEM\\]') AS injected FROM c""")
def sanitize_text(spark, sf):
    text, flags = tx.sanitized(F.col("text"))
    return src.table(spark, sf, "documents").select("doc_id", text.alias("snippet"), F.array_contains(flags, "truncated").alias("truncated"), F.array_contains(flags, "injection_markers").alias("injected"))


@query("canonical_urls", """WITH u AS (SELECT page_id, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]+)([^?#]*)(\\?([^#]*))?', ['s', 'h', 'p', 'x', 'q']) AS r FROM pages),
v AS (SELECT page_id, lower(r.s) || '://' || lower(r.h) || CASE WHEN r.p = '' THEN '/' ELSE r.p END AS base, r.p AS p, list_sort(list_filter(string_split(r.q, '&'), lambda x: x <> '' AND NOT list_contains(['utm_source', 'utm_medium', 'utm_campaign', 'utm_term', 'utm_content', 'ref', 'source', 'via'], lower(split_part(x, '=', 1))))) AS q FROM u),
w AS (SELECT page_id, p, base || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS c FROM v)
SELECT page_id, CASE WHEN c LIKE '%/' AND p NOT IN ('', '/') THEN rtrim(c, '/') ELSE c END AS canonical_url FROM w""")
def canonical_urls(spark, sf):
    return src.table(spark, sf, "pages").select("page_id", tx.canonical_url(F.col("url")).alias("canonical_url"))


@query("html_text")
def html_text(spark, sf):
    from tidewell.functions.html import extract

    rows = src.table(spark, sf, "pages").select("page_id", extract("html").alias("x"))
    return rows.select("page_id", "x.content", F.array_join("x.flags", ",").alias("flags"))


def _journal(spark, sf):
    rows = src.table(spark, sf, "conversations")
    at = F.make_dt_interval(F.lit(0), F.col("conv_id").cast("int"), F.col("turn").cast("int"))
    return rows.select(F.concat_ws("-", "conv_id", "turn").alias("entry_id"), F.col("text").alias("context"), F.col("role").alias("decision"), F.lit(None).cast("string").alias("rationale"), F.array("role").alias("tags"), (F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00")) + at).alias("created_at"))


JOURNAL = "WITH j AS (SELECT conv_id || '-' || turn AS entry_id, text AS context, role AS decision, TIMESTAMP '2024-01-01' + to_hours(CAST(conv_id AS INTEGER)) + to_minutes(CAST(turn AS INTEGER)) AS created_at FROM conversations) SELECT entry_id, context, decision, created_at FROM j"


@query("journal_page", JOURNAL + " ORDER BY created_at DESC, entry_id DESC LIMIT 20")
def journal_page(spark, sf):
    return journal.page(_journal(spark, sf)).select("entry_id", "context", "decision", "created_at")


@query("journal_by_tag", JOURNAL + " WHERE decision = 'assistant' ORDER BY created_at DESC, entry_id DESC LIMIT 20")
def journal_by_tag(spark, sf):
    return journal.page(_journal(spark, sf), tag="assistant").select("entry_id", "context", "decision", "created_at")


@query("journal_search", _search_sql(["term = 'assistant'", "term = 'the'"], "a0 IS NOT NULL AND a1 IS NOT NULL").replace(DOCS, "WITH d AS (SELECT conv_id || '-' || turn AS doc_id, text AS title, role AS content FROM conversations)").replace("SELECT doc_id, -floor(s", "SELECT doc_id AS entry_id, -floor(s").replace("ORDER BY rank, doc_id", "ORDER BY rank, entry_id"))
def journal_search(spark, sf):
    return journal.search_entries(_journal(spark, sf), shared_folder(spark, "journal"), "assistant the").withColumnRenamed("doc_id", "entry_id")
