"""Decision journal: add, list, search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.operators.relational import keyset_page
from tidewell.operators.search import build_index, search

SCHEMA = "entry_id string, context string, decision string, rationale string, signal_refs array<struct<type:string,id:string>>, tags array<string>, created_at timestamp_ntz"


def add(entries: DataFrame, rows: DataFrame) -> DataFrame:
    """Entries with valid new ones: context and decision are required, ids are kept once."""
    good = rows.where((F.trim(F.coalesce("context", F.lit(""))) != "") & (F.trim(F.coalesce("decision", F.lit(""))) != ""))
    return entries.unionByName(good.join(entries, "entry_id", "left_anti"))


def page(entries: DataFrame, tag: str | None = None, after: tuple | None = None, limit: int = 20) -> DataFrame:
    if tag:
        entries = entries.where(F.array_contains("tags", tag))
    return keyset_page(entries, "created_at", "entry_id", after, limit)


def search_entries(entries: DataFrame, path: str, text: str, limit: int = 20) -> DataFrame:
    """Search over an index that is written to ``path``."""
    return search(build_index(entries, ["context", "decision", "rationale"], path, "entry_id"), text, limit)
