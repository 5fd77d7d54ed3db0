"""Versions, the feed source with its cursors, and the event store."""

import http.server
import json
import threading
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tidewell.sources import files
from tidewell.sources.manifest import Stale
from tidewell.sources.versions import Versions
from tidewell.streaming import ingest, polling
from tidewell.streaming.store import EventStore

T0 = datetime(2024, 5, 1, 12, tzinfo=timezone.utc)


def numbers(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "v int")


def test_versions_append_replace_and_stay_readable(spark, tmp_path):
    v = Versions(spark, f"file://{tmp_path}/t")
    assert v.read("a") is None and v.latest() == 0
    assert v.commit(append={"a": numbers(spark, 1)}, replace={"b": numbers(spark, 9)}) == 1
    assert v.commit(append={"a": numbers(spark, 2)}) == 2
    assert v.commit(replace={"a": numbers(spark, 3)}) == 3
    found = {n: sorted(r.v for r in v.read("a", n).collect()) for n in (1, 2, 3)}
    assert found == {1: [1], 2: [1, 2], 3: [3]} and [r.v for r in v.read("b").collect()] == [9]
    assert [p.rows for p in v.parts("a", v.record(2))] == [1, 1]
    gone = v.vacuum(keep=2)
    assert not gone and v.read("a", 2).count() == 2  # version 2 still lists both parts
    assert len(v.vacuum(keep=1)) == 2 and [r.v for r in v.read("a").collect()] == [3]


def test_a_writer_that_dies_leaves_the_version_before(spark, tmp_path, monkeypatch):
    v = Versions(spark, f"file://{tmp_path}/t")
    v.commit(replace={"a": numbers(spark, 1), "b": numbers(spark, 1)})
    failing = numbers(spark, 2).select(F.raise_error(F.lit("broken")).cast("int").alias("v"))
    with pytest.raises(Exception, match="broken"):
        v.commit(replace={"a": numbers(spark, 2), "b": failing})
    with monkeypatch.context() as m:
        m.setattr(files, "write_new", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            v.commit(replace={"a": numbers(spark, 3), "b": numbers(spark, 3)})
    assert v.latest() == 1 and [v.read(t).first().v for t in "ab"] == [1, 1]
    assert len(v.vacuum()) >= 3 and [v.read(t).first().v for t in "ab"] == [1, 1]


def test_two_writers_from_one_version(spark, tmp_path):
    v = Versions(spark, f"file://{tmp_path}/t")
    base = v.record()
    v.commit(append={"a": numbers(spark, 1)}, base=base)
    with pytest.raises(files.Exists):
        v.commit(append={"a": numbers(spark, 2)}, base=base)
    assert [r.v for r in v.read("a").collect()] == [1]
    assert not [n for n in files.names(spark, f"file://{tmp_path}/t/commits") if n.startswith(".")]


def test_a_batch_counts_once_and_lost_parts_are_told(spark, tmp_path):
    v = Versions(spark, f"file://{tmp_path}/t")
    for number in (0, 1, 1, 0):
        v.commit(append={"a": numbers(spark, number)}, batch=("s", number))
    assert sorted(r.v for r in v.read("a").collect()) == [0, 1] and v.written("s") == 1 and v.written("other") == -1
    files.delete(spark, f"file://{tmp_path}/t/data/{v.parts('a')[0].path}")
    with pytest.raises(Stale, match="lacks"):
        v.read("a")


# feeds


def rss_of(*items):
    return "<rss><channel>" + "".join(f"<item><guid>{g}</guid><link>http://x/{g}</link><title>T {g}</title><pubDate>{at:%a, %d %b %Y %H:%M:%S} GMT</pubDate><category>c</category></item>" for g, at in items) + "</channel></rss>"


class Site(http.server.BaseHTTPRequestHandler):
    pages: dict = {}
    seen: list = []

    def do_GET(self):
        body, tag = self.pages.get(self.path, (None, None))
        Site.seen.append((self.path, self.headers.get("If-None-Match")))
        if body is None:
            self.send_error(500)
        elif tag and self.headers.get("If-None-Match") == tag:
            self.send_response(304)
            self.end_headers()
        else:
            self.send_response(200)
            if tag:
                self.send_header("ETag", tag)
            self.end_headers()
            self.wfile.write(body.encode())

    def log_message(self, *a):
        pass


@pytest.fixture
def site():
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Site)
    Site.pages, Site.seen = {}, []
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_feed_kinds_cut_at_their_cursors():
    day = timedelta(days=1)
    body = rss_of(("a", T0), ("b", T0 + day), ("c", T0 + 2 * day)).encode()
    rows, cursor = polling._rss({"feed": "f", "url": "u", "max_items": 2}, None, lambda u: body)
    assert [r["event_id"] for r in rows] == ["rss:f:c", "rss:f:b"] and cursor == (T0 + 2 * day).isoformat() and rows[0]["tags"] == ["c"]
    rows, same = polling._rss({"feed": "f", "url": "u"}, (T0 + day).isoformat(), lambda u: body)
    assert [r["event_id"] for r in rows] == ["rss:f:c"] and same == cursor
    atom = b'<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>8-K - ACME (0000000042) (Filer)</title><link href="http://x/0000000042-24-000007-index.htm"/><updated>2024-05-02T10:00:00-04:00</updated></entry><entry><title>no number</title></entry></feed>'
    rows, cursor = polling._edgar({"feed": "f", "url": "u", "forms": ["8-K"]}, None, lambda u: atom)
    assert [(r["event_id"], r["form"], r["cik"], r["published_at"]) for r in rows] == [("edgar:0000000042-24-000007", "8-K", "0000000042", "2024-05-02T14:00:00+00:00")]
    assert polling._edgar({"feed": "f", "url": "u"}, cursor, lambda u: atom) == ([], cursor)
    pages = {"u/topstories.json": [9, 5, 8, 3], "u/item/9.json": {"time": 0, "title": "n", "score": 4}, "u/item/8.json": {"deleted": True}, "u/item/5.json": None}
    rows, cursor = polling._hackernews({"feed": "top", "url": "u", "mode": "top"}, "4", lambda u: json.dumps(pages[u]).encode())
    assert [(r["event_id"], r["score"], r["comments"]) for r in rows] == [("hn:9", 4, 0)] and cursor == "9"
    assert [f["url"] for f in polling.edgar_feeds(["a", "b"], ["1"], "x?{form}&{cik}")] == ["x?a&1", "x?b&1"]
    assert polling.moment_of("nonsense") is None and polling.moment_of(None) is None


def test_polls_resume_from_their_offsets(spark, tmp_path, site):
    """New rows only, a feed that fails stops no other, a batch that wasn't committed is read again, and each row counts once."""
    Site.pages = {"/a": (rss_of(("1", T0), ("2", T0)), '"v1"'), "/b": (None, None)}
    feeds = [{"source": "rss", "feed": n, "url": f"{site}/{n}", "poll_interval": 600} for n in "ab"]
    spool, store = f"{tmp_path}/spool", EventStore(spark, f"file://{tmp_path}/events")
    topic = lambda events: events.select("event_id", F.concat(F.lit("t."), "feed").alias("topic"), F.lit(0.5).alias("confidence"))

    def run(minutes, put=None):
        stream = polling.feed_stream(spark, feeds, spool, T0 + timedelta(minutes=minutes))
        ingest.run_durably(stream, put or store.sink(classify=topic), f"{tmp_path}/offsets")

    run(0)
    assert {r.event_id for r in store.events().collect()} == {"rss:a:1", "rss:a:2"}
    log = {(r.feed, r.status) for r in polling.poll_log(spark, f"file://{spool}").collect()}
    assert log == {("a", "ok"), ("b", "error")}
    run(5)  # nothing is due
    assert len(Site.seen) == 2
    Site.pages["/b"] = (rss_of(("9", T0)), None)
    run(10)
    assert Site.seen[2:] and ("/a", '"v1"') in Site.seen and store.events().count() == 3
    Site.pages["/a"] = (rss_of(("1", T0), ("3", T0 + timedelta(hours=1))), '"v2"')

    def dies(batch, number):
        store.write(batch, number, classify=topic)
        raise RuntimeError("killed before the commit")

    with pytest.raises(Exception, match="killed"):
        run(30, dies)
    version = store.versions.latest()
    Site.pages["/a"] = (rss_of(("4", T0 + timedelta(hours=2))), '"v3"')
    run(31)  # the batch is replayed from the spool, and is in the store already
    assert store.versions.latest() == version
    run(50)
    events = {r.event_id: r for r in store.events().collect()}
    assert set(events) == {"rss:a:1", "rss:a:2", "rss:b:9", "rss:a:3", "rss:a:4"}
    assert store.versions.read("arrivals").count() == 5 and store.topics().count() == 5
    assert events["rss:a:3"].title == "T 3" and events["rss:a:3"].published_at is not None
    healthy = {r.feed: r for r in ingest.health(polling.poll_log(spark, f"file://{spool}")).collect()}
    assert healthy["b"].last_error is None and healthy["a"].http_etag == '"v3"'


# the store


def some(spark, *rows):
    return spark.createDataFrame([(i, at, s, c) for i, at, s, c in rows], "event_id string, fetched_at timestamp, score long, content string").withColumn("title", F.concat(F.lit("of "), "event_id"))


def test_store_agrees_with_itself_after_every_step(spark, tmp_path):
    s, day = EventStore(spark, f"file://{tmp_path}/e"), timedelta(days=1)
    topic = lambda k: lambda events: events.select("event_id", F.lit(f"t.{k}").alias("topic"), F.lit(k / 10).alias("confidence"))
    t = T0.replace(tzinfo=None)
    s.write(some(spark, ("a", t, 1, None), ("b", t, 1, "text")), 0, classify=topic(1))
    s.write(some(spark, ("a", t + 100 * day, 5, "later"), ("c", t + 100 * day, None, None)), 1, classify=topic(2))
    s.write(some(spark, ("z", t, 1, None)), 1, classify=topic(2))  # replayed with other rows
    s.add_snapshots(spark.createDataFrame([(t, "k", "t.1", 0.5), (t + 200 * day, "k", "t.1", 0.6)], "snapshot_at timestamp, kind string, topic string, value double"), 0)
    read = lambda: ({r.event_id: (r.score, r.content, r.fetched_at) for r in s.events().collect()}, {(r.event_id, r.topic) for r in s.topics().collect()})
    before = read()
    assert before == ({"a": (5, "later", t + 100 * day), "b": (1, "text", t), "c": (None, None, t + 100 * day)}, {("a", "t.1"), ("b", "t.1"), ("c", "t.2")})
    s.compact()
    assert read() == before and s.versions.read("arrivals").count() == 3
    assert s.retain(t, 120) == s.versions.latest() and s.versions.latest() == 4
    s.write(some(spark, ("d", t + 300 * day, 1, None)), 2, classify=topic(3))
    untouched = s.versions.parts("arrivals")[-1]
    version = s.retain(t + 210 * day, 120, 90)
    events, topics = read()
    assert set(events) == {"a", "c", "d"} and topics == {("a", "t.1"), ("c", "t.2"), ("d", "t.3")} and [r.value for r in s.snapshots().collect()] == [0.6]
    assert untouched in s.versions.parts("arrivals") and s.retain(t + 210 * day, 120, 90) == version
    s.reclassify(topic(7), "second")
    assert {(r.topic, r.classifier) for r in s.topics().collect()} == {("t.7", "second")} and s.topics(version).where("classifier = 'first'").count() == 3


def test_orders_are_not_broadcast(spark, sf):
    """each task counted the whole broadcast table of orders, which grows with the lines."""
    from tidewell.sources import adapters

    assert "Broadcast" not in adapters.commits(spark, sf)._jdf.queryExecution().executedPlan().toString()
