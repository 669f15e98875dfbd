"""Generations of a code index: built in parts that survive a lost driver, published whole, cleaned up later.

A generation is a folder of tables (files, chunks, symbols, references, relations) that a numbered version names; the
version is published last and by one rename, so a reader always has the tables of one generation. Files whose content the
served generation already holds are taken over from it; the others are indexed in parts, each with a marker that names
what it holds: a job that starts again skips the parts that are done.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources import versions
from ..workspace import discard, fresh_path, hadoop_path
from .corpus import extract, marked, relate

BY_FILE = ("files", "chunks", "symbols", "references")
TABLES = (*BY_FILE, "relations")


def served(spark: SparkSession, root: str, generation: int | None = None) -> dict[str, DataFrame]:
    """The tables of a generation, the last one published by default; none if there is no generation."""
    value = versions.latest(spark, root)[1] if generation is None else versions.read(spark, root, generation)
    return {t: spark.read.parquet(f"{value['path']}/{t}") for t in TABLES} if value else {}


def publish(spark: SparkSession, root: str, tables: dict[str, DataFrame]) -> int:
    """Write the tables aside, then name them by the next version; returns its number."""
    number = versions.latest(spark, root)[0] + 1
    path = f"{root}/generations/{number}-{uuid.uuid4().hex}"
    for t in TABLES:
        tables[t].write.parquet(f"{path}/{t}")
    versions.publish(spark, root, number, {"path": path})
    return number


def _dealt(files: DataFrame, parts: int) -> DataFrame:
    """``files`` with their states, hashes and parts, stored by part: contents are read once, and only those that are
    indexed go on."""
    spark = files.sparkSession
    each = marked(files.withColumn("hash", F.sha2("content", 256))).withColumn("part", F.pmod(F.xxhash64("file_path"), F.lit(parts)))
    path = fresh_path(spark, "generation-files")
    each.write.partitionBy("part").parquet(path)
    out = spark.read.schema(each.schema).parquet(path)
    out._quarry_path = path
    return out


def _parts(spark: SparkSession, base: str, dealt: DataFrame) -> dict[str, DataFrame]:
    """The tables of ``dealt(file_path, language, content, hash, state, part)``, part by part; done parts are not done again."""
    marks = dealt.groupBy("part").agg(F.count("*").alias("n"), F.sum(F.xxhash64("file_path", "hash").cast("decimal(20,0)")).alias("sum")).collect()  # a row a part
    out: dict[str, DataFrame] = {}
    for m in sorted(marks):
        path = f"{base}/{m['part']}-{m['n']}-{m['sum']}"
        fs, done = hadoop_path(spark, f"{path}/_DONE")
        if not fs.exists(done):
            got = extract(dealt.where(F.col("part") == m["part"]).drop("part"))
            for t in BY_FILE:
                got[t].write.mode("overwrite").parquet(f"{path}/{t}")
            fs.create(done).close()
        for t in BY_FILE:
            one = spark.read.parquet(f"{path}/{t}")
            out[t] = out[t].unionByName(one) if t in out else one
    return out


def build(spark: SparkSession, root: str, job: str, files: DataFrame, parts: int = 8) -> int:
    """Index ``files(file_path, language, content)``, all files of a project, as the next generation.

    ``job`` names the attempt: the same name resumes it. Unchanged files are taken over from the served generation;
    relations are drawn anew, as a symbol of one file may resolve a reference of another."""
    dealt = now = _dealt(files, parts)
    old = served(spark, root)
    tables: dict[str, DataFrame] = {}
    if old:
        known = old["files"].select("file_path", "hash")
        same = now.select("file_path", "hash").join(known, ["file_path", "hash"], "left_semi").select("file_path")
        tables = {t: old[t].join(same, "file_path", "left_semi") for t in BY_FILE}
        now = now.join(known, ["file_path", "hash"], "left_anti").select(*now.columns)
    fresh = _parts(spark, f"{root}/building/{job}", now)
    tables = {t: tables[t].unionByName(fresh[t]) if t in tables and t in fresh else tables.get(t, fresh.get(t)) for t in BY_FILE}
    if tables["files"] is None:
        raise ValueError("no files")
    number = publish(spark, root, tables | {"relations": relate(tables["symbols"], tables["references"])})
    discard(dealt)
    return number


def clean(spark: SparkSession, root: str, protected: Iterable[int] = (), orphans_before_ms: int = 0) -> list[int]:
    """Drop all generations but the last and the protected ones; returns their numbers. A version goes before its data.

    Folders that no version names (of publishers that died) go if they were last changed before ``orphans_before_ms``."""
    have = versions.numbers(spark, root)
    gone = [n for n in have[:-1] if n not in set(protected)]
    for n in gone:
        path = versions.read(spark, root, n)["path"]
        for p in (f"{root}/versions/{n:010d}.json", path):
            fs, at = hadoop_path(spark, p)
            fs.delete(at, True)
    fs, base = hadoop_path(spark, f"{root}/generations")
    named = {versions.read(spark, root, n)["path"].rsplit("/", 1)[-1] for n in versions.numbers(spark, root)}
    for f in fs.listStatus(base) if fs.exists(base) else []:
        if f.getPath().getName() not in named and f.getModificationTime() < orphans_before_ms:
            fs.delete(f.getPath(), True)
    return gone
