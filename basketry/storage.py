"""Shared scratch space for the few steps that must be pinned to disk.

The cluster names its shared folder in ``spark.checkpoint.dir``.  Only a local
session without that setting falls back to a temporary folder.
"""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A side is broadcast by hand only after its row count was read and is below this.
BROADCAST_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="basketry-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_dir(spark)}/basketry/{label}-{uuid.uuid4().hex}"


# Paths of the pinned copies that were not dropped yet.
_pinned: list[str] = []


def pin(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage, survives lost executors, and gives the optimizer real sizes.  The
    copy stays until :func:`drop_pinned` or the end of a :func:`pinned_scope`.
    """
    return pin_to(df, fresh_path(df.sparkSession, label))


def keep_track(path: str) -> None:
    """Count what is written to ``path`` among the pinned copies."""
    _pinned.append(path)


def pin_to(df: DataFrame, path: str) -> DataFrame:
    """:func:`pin` to a given new path, which :func:`unpin` takes back."""
    keep_track(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unpin(spark: SparkSession, path: str) -> None:
    """Delete one pinned copy; no plan on it may still be run."""
    if path in _pinned:
        _pinned.remove(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def drop_pinned(spark: SparkSession, keep: int = 0) -> None:
    """Delete the pinned copies but the ``keep`` oldest ones; no plan on them may still be run."""
    while len(_pinned) > keep:
        unpin(spark, _pinned[-1])


@contextmanager
def pinned_scope(spark: SparkSession):
    """Copies pinned inside are deleted at the end: write or collect the result inside as well."""
    before = len(_pinned)
    try:
        yield
    finally:
        drop_pinned(spark, before)


def broadcast_if_small(df: DataFrame, rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only when the counted rows are under ``limit``."""
    rows = df.count() if rows is None else rows
    return F.broadcast(df) if rows <= limit else df


def text(col: Column) -> Column:
    return col.cast("string")
