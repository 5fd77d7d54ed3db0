"""JSON in text columns, read without failing on what isn't JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_json(text: Column) -> Column:
    """Whether the text parses as JSON; false for null."""
    return F.coalesce(F.try_parse_json(text).isNotNull(), F.lit(False))


def strings(text: Column) -> Column:
    """The members of a JSON array of strings; an empty array for null, other JSON and what isn't JSON."""
    return F.coalesce(F.from_json(text, "array<string>", {"mode": "PERMISSIVE"}), F.array().cast("array<string>"))


def object_or_null(text: Column) -> Column:
    """A JSON object as a map of texts; null for anything else."""
    return F.from_json(text, "map<string,string>", {"mode": "PERMISSIVE"})
