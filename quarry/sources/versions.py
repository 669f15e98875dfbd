"""Numbered versions of a stored thing: one small JSON file each, published by an atomic rename.

A reader sees the last version that was published whole; a writer that dies before the rename leaves no trace but files
that no version names. Two writers of the same number: the second fails."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession

from ..workspace import hadoop_path


def _context(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.getFileSystem(conf).getUri(), conf), p


def numbers(spark: SparkSession, root: str) -> list[int]:
    fs, p = hadoop_path(spark, f"{root}/versions")
    return sorted(int(f.getPath().getName()[:-5]) for f in fs.listStatus(p) if f.getPath().getName().endswith(".json")) if fs.exists(p) else []


def read(spark: SparkSession, root: str, number: int) -> dict:
    fs, p = hadoop_path(spark, f"{root}/versions/{number:010d}.json")
    stream = fs.open(p)
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def latest(spark: SparkSession, root: str) -> tuple[int, dict]:
    """(number, value) of the last version; 0 and an empty value if there is none."""
    have = numbers(spark, root)
    return (have[-1], read(spark, root, have[-1])) if have else (0, {})


def publish(spark: SparkSession, root: str, number: int, value: dict) -> None:
    """Make ``value`` version ``number``: written aside, then renamed; an existing version is an error."""
    part = f"{root}/versions/.{uuid.uuid4().hex}"
    fs, p = hadoop_path(spark, part)
    out = fs.create(p)
    out.write(bytearray(json.dumps(value), "utf-8"))
    out.close()
    context, target = _context(spark, f"{root}/versions/{number:010d}.json")
    kind = getattr(spark.sparkContext._jvm.org.apache.hadoop.fs, "Options$Rename")
    context.rename(p, target, spark.sparkContext._gateway.new_array(kind, 0))
