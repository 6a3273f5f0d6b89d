"""Cutting lineage for loops, in the folder that all executors share, and deleting what is spent."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a local session without one gets a folder of its own, a cluster is refused."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


#: Spark's setting by which the shuffle files of a query are deleted when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _put(df: DataFrame, path: str) -> DataFrame:
    """``df`` written under ``path``; what was shuffled for it goes when it is written, not when the driver happens to collect its garbage."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written(df: DataFrame, label: str) -> DataFrame:
    return _put(df, f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}")


class Work:
    """Tables that an operator writes on its way, in one folder of the shared folder; each is deleted once it is spent."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.path = spark, f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
        self._held: list[tuple[DataFrame, str]] = []
        self._n = 0

    def write(self, df: DataFrame, label: str) -> DataFrame:
        self._n += 1
        path = f"{self.path}/{self._n}-{label}"
        table = _put(df, path)
        self._held.append((table, path))
        return table

    def drop(self, *tables: DataFrame) -> None:
        """Delete ``tables``; nothing that is read later may come from them."""
        for _, path in [x for x in self._held if any(x[0] is t for t in tables)]:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
        self._held = [x for x in self._held if not any(x[0] is t for t in tables)]

    def keep(self, *tables: DataFrame) -> None:
        """Delete all but ``tables``."""
        self.drop(*[t for t, _ in self._held if not any(t is k for k in tables)])
