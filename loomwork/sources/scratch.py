"""Intermediate tables in the folder that driver and executors share: they cut lineage and survive lost executors.

Each application has a folder of its own, which goes when its driver ends; ``sweep`` deletes those that a killed driver left.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import time
import uuid
from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_SWEPT: set[str] = set()
_KEPT: dict[tuple, object] = {}


def root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset, as in tests, a temporary folder, which only a local master can share."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="loomwork-")
    return _OWN[app]


def folder(spark: SparkSession) -> str:
    """The application's folder for intermediate tables."""
    path = f"{root(spark)}/loomwork/tables/{spark.sparkContext.applicationId}"
    if path not in _SWEPT:
        _SWEPT.add(path)
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())

        def end() -> None:
            with contextlib.suppress(Exception):  # where the JVM ended first, the next sweep finds the folder
                fs.delete(at, True)

        atexit.register(end)
    return path


def sweep(spark: SparkSession, days: float = 7) -> int:
    """Delete the folders of other applications that nothing was written to for so many days; their number."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{root(spark)}/loomwork/tables")
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return 0
    old = [s for s in fs.listStatus(at) if s.getPath().getName() != spark.sparkContext.applicationId and s.getModificationTime() < (time.time() - days * 86400) * 1000]
    for s in old:
        fs.delete(s.getPath(), True)
    return len(old)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet and read back."""
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def replaced(name: str, df: DataFrame, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """``written``, in folders by the columns ``partition_by``."""
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def once(table: DataFrame, name: str, make: Callable[[], object]) -> object:
    """What ``make`` gives, made once an application for the files that ``table`` is now; other files, or the same ones written anew, count as
    another table. Only for what ``make`` has written out."""
    spark = table.sparkSession
    files = set(table.inputFiles())
    names, stamps = {unquote(f.rsplit("/", 1)[1]) for f in files}, [len(files)]
    for folder_ in sorted({f.rsplit("/", 1)[0] for f in files}):  # a listing a folder, not a call a file
        at = spark._jvm.org.apache.hadoop.fs.Path(unquote(folder_))
        found = at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)
        stamps += [(folder_, s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in found if s.getPath().getName() in names]
    key = (spark.sparkContext.applicationId, name, tuple(stamps))
    if key not in _KEPT:
        _KEPT[key] = make()
    return _KEPT[key]
