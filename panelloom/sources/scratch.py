"""Scratch tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ROOTS: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` if the cluster names one, else a folder in the SQL warehouse; on a local master a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
            root = _ROOTS.get(spark.sparkContext.applicationId) or "file://" + tempfile.mkdtemp(prefix="panelloom-")
        else:
            root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_panelloom"
        root = _ROOTS.setdefault(spark.sparkContext.applicationId, root)
    return root.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_root(spark)}/{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` below the shared folder and read it back: cuts lineage, survives lost executors, has a known size."""
    path = new_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def at_once(*steps: Callable) -> list:
    """What each step returns, in their order; their jobs share the cluster, whose cores small ones leave idle. The first error in that order is raised."""
    with ThreadPoolExecutor(len(steps)) as pool:
        return [f.result() for f in [pool.submit(s) for s in steps]]


def _store(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    place, store = _store(spark, path)
    store.delete(place, True)


def move(spark: SparkSession, path: str, to: str) -> None:
    """Move a file or folder within a store; the folder it comes to is made."""
    place, store = _store(spark, path)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(to)
    store.mkdirs(target.getParent())
    if not store.rename(place, target):
        raise OSError(f"{path} can't be moved to {to}")


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    place, store = _store(spark, path)
    out = store.create(place, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def read_files(spark: SparkSession, path: str) -> dict[str, bytes]:
    """All files below a folder by their path in it: for folders that fit the driver."""
    place, store = _store(spark, path)
    root = store.makeQualified(place).toString().rstrip("/") + "/"
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("content")).collect()
    plain = lambda p: "/" + p.split(":", 1)[-1].lstrip("/")  # noqa: E731  file:/a and file:///a are one
    return {plain(r["path"])[len(plain(root)) :]: bytes(r["content"]) for r in rows}
