"""The folder that driver and executors share, and tables that the library writes there on its way."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import threading
import uuid
import weakref
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Ends the shuffles of a query with it, instead of when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: The paths of frames that materialise() returned.
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
#: For each settled() that a thread is in, the frames written since.
_open = threading.local()


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a folder of our own where that is unset and all is local (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="varsparq-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def table_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it is deleted when the driver ends."""
    path = f"{shared_folder(spark)}/varsparq-{name}-{uuid.uuid4().hex}"
    atexit.register(delete, spark, path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the session is gone: whoever owns the folder clears it
        return


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again: cuts lineage, outlives any executor, and fixes rows that an evaluation draws.

    The shuffles of the write end with it.
    """
    spark, path = df.sparkSession, table_path(df.sparkSession, name)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    held = spark.read.schema(df.schema).parquet(path)
    _paths[held] = path
    for written in getattr(_open, "scopes", [])[-1:]:
        written.append((spark, path))
    return held


def discard(df: DataFrame) -> None:
    """Delete the table of a frame that materialise() returned and nothing will read again; other frames are left alone."""
    if df in _paths:
        delete(df.sparkSession, _paths[df])


def settled(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """materialise(make()), after which the tables that ``make`` wrote on its way go: only the result may be read later."""
    scopes = _open.__dict__.setdefault("scopes", [])
    scopes.append([])
    try:
        df = make()
        own = scopes.pop()
        scopes.append([])  # not the result
        held = materialise(df, name)
        scopes[-1] = own
    finally:
        for spark, path in scopes.pop():
            delete(spark, path)
    for written in scopes[-1:]:
        written.append((held.sparkSession, _paths[held]))
    return held


def collect_garbage(spark: SparkSession) -> None:
    """The shuffles of frames that are gone end, which Spark else does when the driver's heap is full."""
    gc.collect()
    spark._jvm.System.gc()
