"""Lineage cuts in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local = threading.local()


def _scopes() -> list[list[str]]:
    """The paths of tables cut in the open blocks of this thread, innermost last."""
    if not hasattr(_local, "scopes"):
        _local.scopes = []
    return _local.scopes


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a local one only where that is unset (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = "file://" + tempfile.mkdtemp(prefix="smoothspan-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    The result no longer depends on shuffle files of lost executors and keeps column pruning.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if _scopes():
        _scopes()[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def consumed(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Tables that are cut inside the block go at its end, but for those cut by the function that it gives."""
    scopes, paths = _scopes(), []

    def keep(df: DataFrame, name: str) -> DataFrame:
        scopes.append([])
        try:
            return cut(df, name)
        finally:
            kept = scopes.pop()
            if len(scopes) > 1:  # an outer block has no more use for it at its own end
                scopes[-2].extend(kept)

    scopes.append(paths)
    try:
        yield keep
    finally:
        scopes.pop()
        for path in paths:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
