"""Intermediate tables and files in the folder that driver and executors share.

The folder is ``spark.checkpoint.dir``. Where the session does not set it, a temporary folder of this machine is used
if Spark runs in one process (``local[...]``); on a cluster that is an error, as others could not see the files. Tables
are Parquet, so they cut lineage and outlive a lost executor. They are deleted with ``Workspace.drop`` once consumed, else at exit.
"""

from __future__ import annotations

import atexit
import contextlib
import functools
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def shared_dir(spark: SparkSession) -> str:
    """The shared folder as a URI."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir is not set: driver and executors have no shared folder for intermediate tables")
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="rasterloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    if "://" not in found and found.startswith("/"):
        found = "file://" + found
    return found.rstrip("/")


_SCOPES: list[list[Workspace]] = []


@contextlib.contextmanager
def scope() -> Iterator[None]:
    """Deletes the folders that operators have made inside, at its end: for callers that have stored the operators' results by then."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for ws in _SCOPES.pop():
            ws.drop()


#: Spark's setting for deleting a query's shuffle files when it ends; otherwise they stay until the driver happens to collect its garbage.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(DROP_SHUFFLES, None)
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(DROP_SHUFFLES)
        else:
            spark.conf.set(DROP_SHUFFLES, before)


class Workspace:
    """One operator call's folder for intermediate tables."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/rasterloom/{name}-{uuid.uuid4().hex}"
        atexit.register(self._drop_quietly)
        if _SCOPES:
            _SCOPES[-1].append(self)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Writes the rows as Parquet and returns a scan of them. What was shuffled for it goes then: nothing reads it again."""
        with _shuffles_dropped(self.spark):
            df.write.mode("errorifexists").parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, name: str = "") -> None:
        """Deletes a table (or all of them) that no later plan reads."""
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

    def _drop_quietly(self) -> None:
        try:
            if self.spark.sparkContext._jsc is not None:
                self.drop()
        except Exception:  # the session is gone: nothing is left to delete with
            pass


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


class Packed:
    """Rows whose columns beyond a few known ones travel in one struct, by position, so that no name of theirs meets one of the operator's."""

    def __init__(self, docs: DataFrame, *own: str):
        self.names, self.own = docs.columns, own
        self.others = [c for c in docs.columns if c not in own]

    def rest(self) -> Column:
        """The struct; a literal where there is nothing to carry."""
        if not self.others:
            return F.lit(0).alias("rest")
        return F.struct(*[F.col(quoted(c)).alias(f"c{k}") for k, c in enumerate(self.others)]).alias("rest")

    def columns(self, **now: Column | str) -> list[Column]:
        """The columns as they were, in their order; now: what stands for the known ones (default: the column of that name)."""
        at = {c: F.col(f"rest.c{k}").alias(c) for k, c in enumerate(self.others)}
        for c in self.own:
            new = now.get(c, c)
            at[c] = (F.col(new) if isinstance(new, str) else new).alias(c)
        return [at[c] for c in self.names]


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def open_fs(uri: str):
    """(file system, path) by which an executor's Python reaches a shared URI (file, s3, gs, hdfs)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def releasing(run):
    """A map over batches that gives freed memory back to the system when its partition ends: Python workers live on, idle ones too, and share the executor's memory."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release_memory()

    return wrapped


def release_memory() -> None:
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass
