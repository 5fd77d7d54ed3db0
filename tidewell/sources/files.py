"""Small files through Spark's own filesystem client, so they lie where the tables do, on whatever store that is."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Exists(RuntimeError):
    """A file that must be new is there already."""


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def names(spark: SparkSession, folder: str) -> list[str]:
    fs, p = _at(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def text(spark: SparkSession, path: str) -> str:
    fs, p = _at(spark, path)
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _at(spark, path)
    fs.delete(p, True)


def write_new(spark: SparkSession, path: str, content: str) -> None:
    """Write a whole file that isn't there yet, or raise ``Exists``. Readers never see part of it."""
    fs, p = _at(spark, path)
    part = spark._jvm.org.apache.hadoop.fs.Path(p.getParent(), f".{uuid.uuid4().hex}")
    stream = fs.create(part, False)
    try:
        stream.write(bytearray(content.encode()))
    finally:
        stream.close()
    rename = getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename")
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(part, fs.makeQualified(p), spark._sc._gateway.new_array(rename, 0))
    except Exception as e:
        fs.delete(part, False)
        if "FileAlreadyExists" in str(e):
            raise Exists(path) from e
        raise
