"""Main text of web pages."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F

SKIPPED = {"script", "style", "noscript", "template", "svg", "head", "title"}
BOILERPLATE = {"nav", "header", "footer", "aside", "form"}
BLOCKS = {"p", "div", "section", "article", "main", "li", "ul", "ol", "td", "tr", "table", "h1", "h2", "h3", "h4", "h5", "h6", "br", "blockquote", "pre", "body"}
VOID = {"br", "img", "hr", "meta", "link", "input", "source", "wbr"}


class _Blocks(HTMLParser):
    """Text by block, with how many of its letters stand in links."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.skip = self.link = 0
        self.blocks: list[tuple[str, int]] = []
        self.parts: list[str] = []
        self.linked = 0

    def flush(self) -> None:
        text = re.sub(r"\s+", " ", "".join(self.parts)).strip()
        if text:
            self.blocks.append((text, self.linked))
        self.parts, self.linked = [], 0

    def handle_starttag(self, tag, attrs) -> None:
        if tag in SKIPPED | BOILERPLATE:
            self.skip += 1
        if tag in BLOCKS:
            self.flush()
        self.link += tag == "a"

    def handle_endtag(self, tag) -> None:
        if tag in SKIPPED | BOILERPLATE:
            self.skip = max(0, self.skip - 1)
        if tag in BLOCKS:
            self.flush()
        if tag == "a":
            self.link = max(0, self.link - 1)

    def handle_data(self, data) -> None:
        if not self.skip:
            self.parts.append(data)
            self.linked += len(data.strip()) if self.link else 0


def main_text(html: str | None, least: int = 100, most: int = 50_000) -> tuple[str | None, list[str]]:
    """Text of blocks that are not mostly links, and flags (extracted, truncated). Null below ``least`` characters."""
    if not html:
        return None, ["fetch_failed"]
    parser = _Blocks()
    parser.feed(html)
    parser.close()
    parser.flush()
    text = "\n".join(t for t, linked in parser.blocks if linked * 2 <= len(t))
    if len(text) < least:
        return None, []
    return text[:most], ["extracted", "truncated"] if len(text) > most else ["extracted"]


def extract(column):
    """Struct (content, flags) of a column of pages, in Arrow batches."""

    def run(pages: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for html in pages:
            yield pd.DataFrame([main_text(h) for h in html], columns=["content", "flags"])

    run.__annotations__ = {"pages": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(run, "content string, flags array<string>")(column)


def blocked(url, domains: list[str]):
    """Whether an address lies on a blocked domain or below one."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z]+://([^/?#:]+)", 1))
    return F.exists(F.array(*[F.lit(d) for d in domains]), lambda d: (host == d) | host.endswith(F.concat(F.lit("."), d)))
