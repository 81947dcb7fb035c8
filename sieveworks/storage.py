"""Tables that jobs write for themselves, in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes of an Arrow batch that a Python task holds at once; long texts need small batches.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20
_MARKED: set[str] = set()
#: The tables written so far in each `settle` that is going on, the innermost last.
_OPEN: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """A new folder for one table, below this application's own, which goes when the driver ends.

    The shared folder is the one that ``spark.checkpoint.dir`` names. Without that setting a
    temporary folder serves on a local master; on any other it is an error, for executors would
    each write to a disk of their own.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="sieveworks-"))
        root = sc.getCheckpointDir()
    own = f"{root.rstrip('/')}/sieveworks-{sc.applicationId}"
    if own not in _MARKED:
        path = sc._jvm.org.apache.hadoop.fs.Path(own)
        system = path.getFileSystem(sc._jsc.hadoopConfiguration())
        system.mkdirs(path)
        system.deleteOnExit(path)
        _MARKED.add(own)
    return f"{own}/{uuid.uuid4().hex}"


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session, so that whole long texts fit a Python worker whatever the size of a table."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        held = spark.conf.get(key).lower().removesuffix("b")  # a number of bytes may have its unit
        if not held.lstrip("-").isdigit() or not 0 < int(held) <= most:
            spark.conf.set(key, str(most))


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again.

    Later steps start from that table: nothing before it runs twice, a lost executor
    costs no more than the tasks it held, and Spark knows the table's real size.
    """
    path = shared_folder(df.sparkSession)
    if _OPEN:
        _OPEN[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """The tables that are cut within the block go at its end, or if it fails; what it returns must not read them."""
    _OPEN.append([])
    try:
        yield
    finally:
        for own in _OPEN.pop():
            delete(spark, own)


def settle(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """`cut` of what ``make`` returns; the tables that it has cut on the way go once that is written, or if it fails."""
    with passing(spark):
        out = make()
        path = shared_folder(spark)
        out.write.parquet(path)
    if _OPEN:
        _OPEN[-1].append(path)
    return spark.read.schema(out.schema).parquet(path)


def _path(spark: SparkSession, path: str) -> tuple:
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), there


def exists(spark: SparkSession, path: str) -> bool:
    system, there = _path(spark, path)
    return system.exists(there)


def matches(spark: SparkSession, path: str) -> bool:
    """Whether anything is at a path or glob; no folder is listed for it."""
    system, there = _path(spark, path)
    return bool(system.globStatus(there))


def writable(spark: SparkSession, path: str) -> str:
    """``path`` made a folder, with its scheme."""
    system, there = _path(spark, path)
    system.mkdirs(there)
    return str(system.makeQualified(there).toString())


def file_system(uri: str) -> tuple:
    """Arrow's file system of a URI, and the path within it."""
    from pyarrow import fs

    uri = re.sub(r"^file:/+", "file:///", uri)
    return fs.FileSystem.from_uri(uri) if not uri.startswith("file:") else (fs.LocalFileSystem(), uri.removeprefix("file://"))


def delete(spark: SparkSession, path: str) -> None:
    """Remove a table or folder, if it is there."""
    system, there = _path(spark, path)
    system.delete(there, True)


def spread(scan: DataFrame) -> DataFrame:
    """A table scan over all cores: a file that is too small to be split is dealt out.

    Large tables have more splits than there are cores and stay as they are.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan
