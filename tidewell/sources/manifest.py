"""A run's manifest beside its tables: consumers refuse tables of a run that did not end well.

The folder may lie on any filesystem that Spark reads; writes go through Spark's own client, so a manifest lies where the tables do.
"""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import SparkSession

NAME = "run_manifest.json"


class Stale(RuntimeError):
    """The tables of a folder may be incomplete or of different runs."""


def _file(spark: SparkSession, folder: str):
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder, NAME)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def read(spark: SparkSession, folder: str) -> dict | None:
    """The manifest; None where there is none. Text that isn't a JSON object raises ``Stale``."""
    fs, path = _file(spark, folder)
    if not fs.exists(path):
        return None
    stream = fs.open(path)
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    try:
        found = json.loads(text)
    except ValueError as e:
        raise Stale(f"{folder}: the manifest is not JSON") from e
    if not isinstance(found, dict):
        raise Stale(f"{folder}: the manifest is not an object")
    return found


def write(spark: SparkSession, folder: str, status: str, stages: list[str], at: datetime, reason: str | None = None) -> None:
    fs, path = _file(spark, folder)
    stream = fs.create(path, True)
    try:
        stream.write(bytearray(json.dumps({"status": status, "completed_stages": stages, "stale_reason": reason, "updated_at": at.isoformat()}, sort_keys=True, indent=2).encode()))
    finally:
        stream.close()


def invalidate(spark: SparkSession, folder: str, reason: str, at: datetime) -> None:
    """Marks the tables as stale before they are touched; stages known so far stay listed."""
    try:
        stages = (read(spark, folder) or {}).get("completed_stages") or []
    except Stale:
        stages = []
    write(spark, folder, "stale", list(stages), at, reason)


def issue(spark: SparkSession, folder: str) -> str | None:
    """Why the tables can't be trusted; None if the run is complete or no manifest was ever written."""
    try:
        found = read(spark, folder)
    except Stale as e:
        return str(e)
    if found is None or found.get("status") == "complete":
        return None
    stages = found.get("completed_stages")
    done = ", ".join(map(str, stages)) if isinstance(stages, list) else "unknown"
    return f"{folder}: the run is {found.get('status')!r}; {found.get('stale_reason') or 'no reason given'}; completed stages: {done}"


def require(spark: SparkSession, folder: str) -> None:
    why = issue(spark, folder)
    if why:
        raise Stale(why)
