"""Tables in the folder that all executors share: how lineage is cut, and how intermediate files are freed."""

from __future__ import annotations

import gc
import tempfile
import uuid
import weakref
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a temporary folder in local mode, as in tests; an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="kgweave-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the application ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(at)
    fs.deleteOnExit(at)
    return path


#: Where the tables that cut() returned are, as long as something refers to them.
_WRITTEN: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


#: For large tables that are read few times: about two thirds of the space.
DENSE = "zstd"
#: Whether files of shuffles go with the command that wrote them.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write to the shared folder and read again: lineage ends at files that survive lost executors.

    The shuffles of the write are its own and nothing reads them again, so their files go when it is done, not when
    garbage happens to be collected. codec: of the files, Spark's own if it is not given.
    """
    return cut_parts([df], name, codec)


def cut_parts(parts: Iterable[DataFrame], name: str, codec: str | None = None) -> DataFrame:
    """As ``cut``, tables of the same columns as one. Each is written before the next is made, so their shuffles are never
    on the disk together."""
    path = None
    for df in parts:
        spark = df.sparkSession
        path = path or new_folder(spark, name) + "/t"
        _write(df, path, codec)
    out = spark.read.schema(df.schema).parquet(path)
    _WRITTEN[out] = path
    return out


def _write(df: DataFrame, path: str, codec: str | None) -> None:
    spark = df.sparkSession
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.parquet(path, "append", compression=codec)
    finally:
        spark.conf.unset(CLEAN_UP) if before is None else spark.conf.set(CLEAN_UP, before)


#: Rows of a small side up to which it may be broadcast; beyond it the join is shuffled.
BROADCAST_ROWS = 500_000


def small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Marked for broadcast if its counted rows are within the limit, unchanged otherwise."""
    return F.broadcast(df) if rows <= limit else df


def drop_cut(*tables: DataFrame) -> None:
    """Delete tables written by cut() that nothing reads any more; they are named as cut() returned them (KeyError otherwise)."""
    for df in tables:
        at = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop(df))
        at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Let files of shuffles go that no table refers to any more; Spark finds them when both sides collect garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
