"""Feeds as a stream, with one cursor a feed in the offsets (a Python data source of the engine).

A poll asks the feeds that are due, each with the validators of its last answer, and keeps what lies beyond
the feed's cursor. What came is spooled before the offset is given out: a feed doesn't answer twice alike, the spool
does. An offset is the number of the poll and the state of every feed after it, so a query that starts anew from
its checkpoint reads on where it was, and a batch whose commit was lost reads the same rows again.

    spark.dataSource.register(FeedSource)
    spark.readStream.format("feeds").option("feeds", json.dumps([...])).option("spool", folder).load()

A feed is a dict: ``source`` (rss, edgar or hackernews), ``feed`` (its name), ``url``, and, where they differ from
the defaults, ``poll_interval`` (300 seconds), ``max_items`` (200), ``headers``, and for hackernews ``mode`` (new, top or best).
Option ``now`` sets the time of polls, for runs that must be repeatable; without it they take the clock's.
"""

from __future__ import annotations

import json
import re
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timezone
from email.utils import parsedate_to_datetime
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = (
    "event_id string, source string, feed string, url string, title string, author string, content string, tags array<string>, published_at timestamp, score long, comments long, form string, cik string, fetched_at timestamp"
)
COLUMNS = [c.split(" ")[0] for c in SCHEMA.split(", ")]
POLL_INTERVAL, MAX_ITEMS, TIMEOUT_S, AT_ONCE = 300, 200, 15, 8


class NotModified(Exception):
    """The feed has nothing new for these validators."""


def fetch(url: str, headers: dict[str, str]) -> tuple[bytes, dict[str, str]]:
    """Body and answer headers, by lower-case name."""
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=TIMEOUT_S) as r:
            return r.read(), {k.lower(): v for k, v in r.headers.items()}
    except urllib.error.HTTPError as e:
        if e.code == 304:
            raise NotModified from e
        raise


def _utc(at: datetime) -> datetime:
    return at.replace(tzinfo=timezone.utc) if at.tzinfo is None else at.astimezone(timezone.utc)


def moment_of(text: str | None) -> datetime | None:
    """A feed's time, of mail's form or ISO's; None where it is neither."""
    for read in (datetime.fromisoformat, parsedate_to_datetime):
        try:
            return _utc(read((text or "").strip()))
        except (ValueError, TypeError):
            continue
    return None


def _fields(node: ElementTree.Element) -> dict[str, list[ElementTree.Element]]:
    out: dict[str, list[ElementTree.Element]] = {}
    for child in node:
        out.setdefault(child.tag.rpartition("}")[2].lower(), []).append(child)
    return out


def _words(fields: dict, *names: str) -> str | None:
    for n in names:
        for e in fields.get(n, []):
            if text := "".join(e.itertext()).strip():
                return text
    return None


def entries(body: bytes) -> Iterator[dict]:
    """The items of an RSS or Atom document."""
    for node in ElementTree.fromstring(body).iter():
        if node.tag.rpartition("}")[2].lower() not in ("item", "entry"):
            continue
        f = _fields(node)
        link = _words(f, "link") or next((e.get("href") for e in f.get("link", []) if e.get("href")), None)
        yield {
            "guid": _words(f, "guid", "id") or link, "url": link, "title": _words(f, "title"), "author": _words(f, "creator", "author"), "content": _words(f, "encoded", "content", "description", "summary"),
            "tags": [t for e in f.get("category", []) if (t := (e.text or e.get("term") or "").strip())], "at": moment_of(_words(f, "pubdate", "published", "updated", "date")),
        }


def _rss(feed: dict, cursor: str | None, get: Callable[[str], bytes]) -> tuple[list[dict], str | None]:
    """Newest first, capped, then what isn't newer than the cursor left out; items without a time always count as new."""
    least = datetime.min.replace(tzinfo=timezone.utc)
    items = sorted(entries(get(feed["url"])), key=lambda x: x["url"] or "")
    items = sorted(items, key=lambda x: x["at"] or least, reverse=True)[: feed.get("max_items", MAX_ITEMS)]
    since = cursor and datetime.fromisoformat(cursor)
    fresh = [x for x in items if x["guid"] and not (since and x["at"] and x["at"] <= since)]
    newest = max((x["at"] for x in fresh if x["at"]), default=None)
    rows = [{"event_id": f"rss:{feed['feed']}:{x['guid']}", **{k: x[k] for k in ("url", "title", "author", "content", "tags")}, "published_at": x["at"] and x["at"].isoformat()} for x in fresh]
    return rows, newest.isoformat() if newest else cursor


def _edgar(feed: dict, cursor: str | None, get: Callable[[str], bytes]) -> tuple[list[dict], str | None]:
    """Filings by accession number; of one time, all or none have been seen, so only later ones are new."""
    since, rows, newest = cursor and datetime.fromisoformat(cursor), [], cursor
    for x in entries(get(feed["url"])):
        number = re.search(r"\d{10}-\d{2}-\d{6}", f"{x['guid']} {x['url']}")
        if not number or (since and x["at"] and x["at"] <= since):
            continue
        words = re.match(r"(\S+)(?: +- +(.*?) +\((\d{10})\))?", x["title"] or "")
        form, cik = (words[1], words[3]) if words else (None, None)
        if feed.get("forms") and form not in feed["forms"]:
            continue
        rows.append({"event_id": f"edgar:{number[0]}", "url": x["url"], "title": x["title"], "published_at": x["at"] and x["at"].isoformat(), "form": form, "cik": cik})
        newest = max(newest or "", x["at"].isoformat()) if x["at"] else newest
    return rows[: feed.get("max_items", MAX_ITEMS)], newest


def _hackernews(feed: dict, cursor: str | None, get: Callable[[str], bytes]) -> tuple[list[dict], str | None]:
    """Items with ids beyond the cursor, in the order of the mode's list."""
    base, least = feed["url"].rstrip("/"), int(cursor or 0)
    ids = [i for i in json.loads(get(f"{base}/{feed.get('mode', 'new')}stories.json")) if i > least][: feed.get("max_items", MAX_ITEMS)]
    rows = []
    for i in ids:
        x = json.loads(get(f"{base}/item/{i}.json"))
        if x and not x.get("deleted") and not x.get("dead"):
            at = datetime.fromtimestamp(x["time"], timezone.utc).isoformat() if "time" in x else None
            rows.append({"event_id": f"hn:{i}", "url": x.get("url") or f"https://news.ycombinator.com/item?id={i}", "title": x.get("title"), "author": x.get("by"), "content": x.get("text"), "published_at": at, "score": x.get("score", 0), "comments": x.get("descendants", 0)})
    return rows, str(max([least, *ids])) if ids else cursor


KINDS = {"rss": _rss, "edgar": _edgar, "hackernews": _hackernews}


def edgar_feeds(forms: list[str], ciks: list[str], pattern: str, **more) -> list[dict]:
    """A feed for each form and company; ``pattern`` is an address with ``{form}`` and ``{cik}``."""
    return [{"source": "edgar", "feed": f"{form}:{cik}", "url": pattern.format(form=form, cik=cik), "forms": [form], **more} for form in forms for cik in ciks]


def polled(feed: dict, state: dict, now: datetime, get: Callable = fetch) -> tuple[list[dict], dict, dict]:
    """Rows, the feed's next state, and a line for the log. An error leaves the cursor and the validators as they are."""
    line = {"source": feed["source"], "feed": feed["feed"], "polled_at": now.isoformat(), "error": None, "events": 0, "status": "ok", "etag": None, "last_modified": None}
    seen: dict[str, str] = {}

    def one(url: str) -> bytes:
        headers = dict(feed.get("headers", {}))
        if url == feed["url"]:
            headers |= {k: state[v] for k, v in (("If-None-Match", "etag"), ("If-Modified-Since", "last_modified")) if state.get(v)}
        body, answer = get(url, headers)
        if url == feed["url"]:
            seen.update({v: answer[k] for k, v in (("etag", "etag"), ("last-modified", "last_modified")) if k in answer})
        return body

    after = state | {"polled_at": now.isoformat()}
    try:
        rows, cursor = KINDS[feed["source"]](feed, state.get("cursor"), one)
    except NotModified:
        return [], after, line | {"status": "not modified"}
    except Exception as e:  # a feed that fails must not stop the others; the log says why
        return [], after, line | {"status": "error", "error": f"{type(e).__name__}: {e}"[:500]}
    same = {"source": feed["source"], "feed": feed["feed"], "fetched_at": now.isoformat()}
    return [r | same for r in rows], after | seen | ({"cursor": cursor} if cursor else {}), line | seen | {"events": len(rows)}


class Spool:
    """``polls``: a file a poll with the states after it and its log; ``rows``: a file for each poll and feed that brought something."""

    def __init__(self, uri: str) -> None:
        from pyarrow import fs

        self.fs, self.root = fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)
        self.root = self.root.rstrip("/")

    def names(self, folder: str) -> list[str]:
        from pyarrow import fs

        found = self.fs.get_file_info(fs.FileSelector(f"{self.root}/{folder}", allow_not_found=True))
        return sorted(x.base_name for x in found if x.base_name.endswith(".json"))

    def read(self, name: str) -> str:
        with self.fs.open_input_stream(f"{self.root}/{name}") as f:
            return f.read().decode()

    def write(self, name: str, text: str) -> None:
        """A reader sees the whole file or none."""
        path = f"{self.root}/{name}"
        self.fs.create_dir(path.rpartition("/")[0], recursive=True)
        with self.fs.open_output_stream(f"{path}.part") as f:
            f.write(text.encode())
        self.fs.move(f"{path}.part", path)

    def delete(self, name: str) -> None:
        self.fs.delete_file(f"{self.root}/{name}")


def _key(feed: dict) -> str:
    return f"{feed['source']}:{feed['feed']}"


class SpoolFile(InputPartition):
    def __init__(self, spool: str, name: str) -> None:
        self.spool, self.name = spool, name


class FeedReader(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.feeds, self.uri, self.now = json.loads(options["feeds"]), options["spool"], options.get("now")
        names = [_key(f) for f in self.feeds]
        if len(set(names)) < len(names) or any(f["source"] not in KINDS for f in self.feeds):
            raise ValueError("feeds need names of their own and a known source")

    def initialOffset(self) -> dict:
        return {"poll": 0, "feeds": {}}

    def latestOffset(self) -> dict:
        """Poll what is due. The newest poll in the spool counts, whether or not its offset was ever written down."""
        spool = Spool(self.uri)
        known = spool.names("polls")
        last = json.loads(spool.read(f"polls/{known[-1]}")) if known else self.initialOffset()
        now = _utc(datetime.fromisoformat(self.now)) if self.now else datetime.now(timezone.utc)
        states, due = dict(last["feeds"]), []
        for f in self.feeds:
            before = states.get(_key(f), {}).get("polled_at")
            if before is None or (now - datetime.fromisoformat(before)).total_seconds() >= f.get("poll_interval", POLL_INTERVAL):
                due.append(f)
        if not due:
            return {"poll": last["poll"], "feeds": last["feeds"]}
        poll, log = last["poll"] + 1, []
        for n in spool.names("rows"):
            if int(n.partition("-")[0]) >= poll:  # of a poll that didn't get to its end
                spool.delete(f"rows/{n}")
        with ThreadPoolExecutor(AT_ONCE) as pool:
            answers = pool.map(lambda f: polled(f, states.get(_key(f), {}), now), due)
            for k, (f, (rows, state, line)) in enumerate(zip(due, answers, strict=True)):
                states[_key(f)] = state
                log.append(line)
                if rows:
                    spool.write(f"rows/{poll:012d}-{k:06d}.json", json.dumps(rows))
        spool.write(f"polls/{poll:012d}.json", json.dumps({"poll": poll, "feeds": states, "log": log}))  # last: what has no poll is not read
        return {"poll": poll, "feeds": states}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [SpoolFile(self.uri, f"rows/{n}") for n in Spool(self.uri).names("rows") if start["poll"] < int(n.partition("-")[0]) <= end["poll"]]

    def read(self, partition: SpoolFile) -> Iterator[tuple]:
        for row in json.loads(Spool(partition.spool).read(partition.name)):
            yield tuple(datetime.fromisoformat(row[c]) if c in ("published_at", "fetched_at") and row.get(c) else row.get(c) for c in COLUMNS)

    def commit(self, end: dict) -> None:
        """Rows before the last poll are in the sink for good."""
        spool = Spool(self.uri)
        for n in spool.names("rows"):
            if int(n.partition("-")[0]) < end["poll"]:
                spool.delete(f"rows/{n}")


class FeedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "feeds"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> FeedReader:
        return FeedReader(self.options)


def feed_stream(spark: SparkSession, feeds: list[dict], spool: str, now: datetime | None = None) -> DataFrame:
    spark.dataSource.register(FeedSource)
    reader = spark.readStream.format("feeds").option("feeds", json.dumps(feeds)).option("spool", spool)
    return (reader.option("now", now.isoformat()) if now else reader).load()


def poll_log(spark: SparkSession, spool: str) -> DataFrame:
    """A row for each poll of a feed, as ``ingest.health`` takes them."""
    line = "source string, feed string, polled_at timestamp, error string, events long, status string, etag string, last_modified string"
    polls = spark.read.schema(f"poll long, log array<struct<{line.replace(' string', ':string').replace(' timestamp', ':timestamp').replace(' long', ':long')}>>").json(f"{spool}/polls")
    return polls.select("poll", F.inline("log"))
