"""Intermediate tables in the shared folder."""

from __future__ import annotations

import gc
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir.

    Where that is unset, a local session gets a folder of its own, once; on a cluster, where executors share no local
    folder, it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not spark.sparkContext.master.partition("[")[0] == "local":
        raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    return _own_folder(spark.sparkContext.applicationId)


@lru_cache
def _own_folder(application: str) -> str:
    return tempfile.mkdtemp(prefix="spark-")


class Scratch:
    """Intermediate tables of one run in the shared folder, dropped as soon as nothing reads them any more.

    What the run's result is read from stays until ``close``, which its caller can call once the result is written.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.root = spark, f"{shared_folder(spark)}/docloom-{uuid.uuid4().hex}"
        self.tables: dict[int, tuple[DataFrame, str]] = {}

    def store(self, df: DataFrame) -> DataFrame:
        """The rows as a Parquet table, read again: lineage ends there and survives lost executors."""
        path = f"{self.root}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        self.tables[id(back)] = back, path
        return back

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            self._delete(self.tables.pop(id(t))[1])

    def release(self) -> None:
        """Has Spark delete what finished steps shuffled: it does so once the driver's garbage collectors find no use of it."""
        for _ in range(2):  # what the first round frees lets go of the rest
            gc.collect()
            self.spark._jvm.System.gc()

    def close(self) -> None:
        self._delete(self.root)
        self.tables.clear()

    def _delete(self, path: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
