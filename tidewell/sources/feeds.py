"""Feed and filing sources: raw dumps in, events out. All parsing is column expressions over files that were fetched before."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

def _tag(body: Column, name: str) -> Column:
    text = F.regexp_extract(body, rf"(?s)<{name}(?:\s[^>]*)?>\s*(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?\s*</{name}>", 1)
    return F.when(text != "", text)


def rss(dumps: DataFrame, cursor: datetime | None = None, max_items: int = 200) -> DataFrame:
    """Events of RSS and Atom dumps (feed, body): newest first, a cap a feed, items without guid and link dropped; ``cursor`` is the newest time seen before."""
    item = F.explode(F.regexp_extract_all("body", F.lit(r"(?s)<(?:item|entry)[\s>].*?</(?:item|entry)>"), 0))
    rows = dumps.select("feed", item.alias("x"))
    x = F.col("x")
    link = F.coalesce(_tag(x, "link"), F.when(F.regexp_extract(x, r'<link[^>]*href="([^"]+)"', 1) != "", F.regexp_extract(x, r'<link[^>]*href="([^"]+)"', 1)))
    guid = F.coalesce(_tag(x, "guid"), _tag(x, "id"))
    day = F.coalesce(_tag(x, "pubDate"), _tag(x, "published"), _tag(x, "updated"))
    at = F.coalesce(F.try_to_timestamp(day), F.try_to_timestamp(F.regexp_extract(day, r"(\d{1,2} \w{3} \d{4} \d{2}:\d{2}:\d{2})", 1), F.lit("d MMM yyyy HH:mm:ss")))
    rows = rows.select(F.concat(F.lit("rss:"), "feed", F.lit(":"), F.coalesce(guid, link)).alias("event_id"), F.lit("rss").alias("source"), "feed", link.alias("url"), _tag(x, "title").alias("title"), at.alias("published_at")).where("event_id is not null")
    if cursor is not None:
        rows = rows.where(F.col("published_at") > F.lit(cursor))
    w = Window.partitionBy("feed").orderBy(F.desc_nulls_last("published_at"), "url")
    return rows.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= max_items).drop("rn").dropDuplicates(["event_id"])


def hacker_news(items: DataFrame, cursor: int = 0, max_items: int = 200) -> DataFrame:
    """Events of item dumps (id, type, title, url, by, time, score, descendants, deleted, dead): ids beyond the cursor, the highest id seen."""
    alive = ~F.coalesce("deleted", F.lit(False)) & ~F.coalesce("dead", F.lit(False))
    rows = items.where((F.col("id") > cursor) & alive).dropDuplicates(["id"]).orderBy(F.desc("id")).limit(max_items)
    url = F.coalesce("url", F.concat(F.lit("https://news.ycombinator.com/item?id="), F.col("id").cast("string")))
    return rows.select(F.concat(F.lit("hn:"), F.col("id").cast("string")).alias("event_id"), F.lit("hackernews").alias("source"), F.lit("new").alias("feed"), url.alias("url"), "title", F.timestamp_seconds("time").alias("published_at"), F.coalesce("score", F.lit(0)).alias("score"), F.coalesce("descendants", F.lit(0)).alias("comments"))


def filings(dumps: DataFrame, forms: list[str] | None = None) -> DataFrame:
    """Filings of Atom dumps (feed, body): accession number, form, company and its number from titles and links."""
    x = F.col("x")
    rows = dumps.select("feed", F.explode(F.regexp_extract_all("body", F.lit(r"(?s)<entry[\s>].*?</entry>"), 0)).alias("x"))
    title = F.coalesce(_tag(x, "title"), F.lit(""))
    # the feed's titles are: form, dash, company, number of ten digits in brackets, role of the filer in brackets
    part = lambda k: F.regexp_extract(title, r"^(\S[^ ]*)(?: +- +(.*?) +\((\d{10})\))?", k)
    rows = rows.select(
        "feed", F.regexp_extract(x, r"(\d{10}-\d{2}-\d{6})", 1).alias("accession"), part(1).alias("form"), part(3).alias("cik"), part(2).alias("company"), F.try_to_timestamp(_tag(x, "updated")).alias("published_at"), title.alias("title"),
    ).where("accession <> ''")
    if forms:
        rows = rows.where(F.col("form").isin(forms))
    return rows.dropDuplicates(["accession"]).withColumn("event_id", F.concat(F.lit("edgar:"), "accession"))


def earnings(submissions: DataFrame, as_of: datetime, cursor: str | None = None, forms: tuple[str, ...] = ("8-K", "10-Q", "10-K"), history_days: int = 730) -> DataFrame:
    """Filings of submissions that hold parallel arrays (accessionNumber, filingDate, reportDate, form, primaryDocument)."""
    rows = submissions.select("cik", F.explode(F.arrays_zip("accessionNumber", "filingDate", "reportDate", "form", "primaryDocument")).alias("z")).select("cik", "z.*")
    oldest = (as_of - timedelta(days=history_days)).date().isoformat()
    rows = rows.where(F.col("form").isin(*forms) & (F.col("filingDate") >= oldest))
    if cursor:
        rows = rows.where(F.col("filingDate") > cursor)
    return rows.withColumn("event_id", F.concat(F.lit("earnings:"), "accessionNumber"))


def with_companies(rows: DataFrame, companies: DataFrame) -> DataFrame:
    """Tickers by company number; the map is a fixed table of some dozen rows."""
    return rows.join(F.broadcast(companies), "cik", "left")


def taxonomy(spark: SparkSession, path: str) -> list[dict]:
    """Topics of a YAML file, checked."""
    import yaml

    with open(path) as f:
        topics = yaml.safe_load(f)["topics"]
    for t in topics:
        if not isinstance(t.get("id"), str) or "." not in t["id"] or not t.get("keywords"):
            raise ValueError(f"bad topic {t!r}")
    return topics


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)
