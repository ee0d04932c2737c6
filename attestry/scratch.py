"""Tables written between the steps of an operator.

Lineage is cut by writing Parquet below the folder named in ``spark.checkpoint.dir``, which all
executors share, so a lost executor costs only a re-read.  Only where the session names no folder
(tests, notebooks on one machine) one is made below the system's temporary directory.
"""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
_WRITTEN: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """Folder for intermediate tables: ``spark.checkpoint.dir``, or a private one if that is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _LOCAL[app] = tempfile.mkdtemp(prefix="attestry-")
        atexit.register(shutil.rmtree, _LOCAL[app], True)
    return "file://" + _LOCAL[app]


class Scratch:
    """Writes intermediate tables of one operator call and forgets those no longer needed."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_root(spark)}/attestry-{name}-{uuid.uuid4().hex[:12]}"
        _WRITTEN.append(self.base)

    def write(self, df: DataFrame, table: str, by: list[str] | None = None) -> DataFrame:
        """Write ``df`` and return a reader of what was written, with the same schema."""
        path = f"{self.base}/{table}"
        writer = df.write.mode("overwrite").option("compression", "zstd")
        (writer.partitionBy(*by) if by else writer).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, table: str) -> None:
        """Delete a table that no later result reads."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(f"{self.base}/{table}")
        path.getFileSystem(conf).delete(path, True)

    def release(self) -> None:
        """Let Spark's cleaner remove the shuffle files of steps whose result has been written.

        Python's and then the JVM's handles on a plan must go before its shuffles do, hence twice.
        """
        for _ in range(2):
            gc.collect()
            self.spark._jvm.System.gc()
            time.sleep(0.25)


def clear(spark: SparkSession) -> None:
    """Deletes all intermediate tables this driver has written; results that read them can't be read afterwards."""
    while _WRITTEN:
        path = spark._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
