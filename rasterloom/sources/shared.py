"""Tables and files of a running job in the folder that driver and executors share.

The folder is ``spark.checkpoint.dir``, or the context's checkpoint folder; where neither is set, a temporary folder of this machine if Spark runs in one process, else an error. Tables are Parquet: they cut lineage, and a lost executor
loses none of them. What a job has written goes when it is dropped, or when the session's process ends.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def root(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set: driver and executors have no shared folder")
        found = "file://" + tempfile.mkdtemp(prefix="rasterloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Folder:
    """A new folder of one job."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{root(spark)}/{name}-{uuid.uuid4().hex}"
        atexit.register(self._drop_quietly)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Writes the rows and returns a scan of them."""
        df.write.mode("errorifexists").parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, name: str = "") -> None:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

    def _drop_quietly(self) -> None:
        try:
            if self.spark.sparkContext._jsc is not None:
                return self.drop()
        except Exception:  # the session is gone
            pass
        if local := re.fullmatch("(?:file:/*)?(/.*)", re.sub("^file:/*", "/", self.path)):  # without Spark, what this machine sees is deleted
            shutil.rmtree(local[1], ignore_errors=True)
