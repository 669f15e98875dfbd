"""Stored intermediate tables in the shared folder: they cut lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``. Where that is unset, a temporary one on a local master (tests); on
    a cluster executors would not see it, so that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        context = spark.sparkContext
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _OWN.setdefault(context.applicationId, "file://" + tempfile.mkdtemp(prefix="quarry-"))
    return base.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{folder(spark)}/quarry/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Delete every stored table of this application; results that were not written elsewhere can't be read afterwards."""
    fs, p = hadoop_path(spark, f"{folder(spark)}/quarry/{spark.sparkContext.applicationId}")
    fs.delete(p, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._quarry_path = path
    return out


def together(*makes):
    """What each of ``makes`` returns; none needs what another makes, so their jobs run side by side."""
    own = inheritable_thread_target(SparkSession.active())
    with ThreadPoolExecutor(len(makes)) as pool:
        return [made.result() for made in [pool.submit(own(m)) for m in makes]]


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) of the JVM."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), p


def discard(*tables: DataFrame | None) -> None:
    """Delete stored tables that no later plan reads."""
    for t in tables:
        path = getattr(t, "_quarry_path", None)
        if path:
            fs, p = hadoop_path(t.sparkSession, path)
            fs.delete(p, True)


def trimmed(run):
    """``run`` over Arrow batches, whose worker gives freed memory back to the system at the end of a task."""

    def whole(batches):
        import ctypes

        import pyarrow as pa

        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return whole
