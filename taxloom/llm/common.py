"""Shared helpers: reading tables, cutting lineage in the folder all executors share, naming work columns."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that one broadcast table may hold; beyond it the join shuffles.  At 24 bytes a row this is under 50 MB.
BROADCAST_ROWS = 2_000_000
#: Spark's setting by which the shuffle files of a query are deleted when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and every executor can read, from ``spark.checkpoint.dir``.

    Where it is unset a local session gets a folder of its own; a cluster without one is refused.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there and the file sizes are known to the planner."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared folder, wherever that is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Work:
    """The tables that an operator writes on its way, in one folder of the shared folder; each is deleted as soon as it is spent."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.path = spark, f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self._held: list[tuple[DataFrame, str]] = []
        self._n = 0

    def write(self, df: DataFrame, label: str) -> DataFrame:
        self._n += 1
        path = f"{self.path}/{self._n}-{label}"
        # what was shuffled for the table goes when it is written, not when the driver happens to collect its garbage
        before = self.spark.conf.get(CLEANUP, "false")
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(CLEANUP, before)
        table = self.spark.read.schema(df.schema).parquet(path)
        self._held.append((table, path))
        return table

    def drop(self, *tables: DataFrame) -> None:
        """Delete ``tables``; nothing that is read later may come from them."""
        for _, path in [x for x in self._held if any(x[0] is t for t in tables)]:
            delete(self.spark, path)
        self._held = [x for x in self._held if not any(x[0] is t for t in tables)]

    def keep(self, *tables: DataFrame) -> None:
        """Delete all but ``tables``."""
        self.drop(*[t for t, _ in self._held if not any(t is k for k in tables)])


#: Bits of the map that :func:`thinned` broadcasts, at most: 2^20 rows of two longs, 16 MB.
MAP_BITS = 1 << 26


def thinned(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """``rows`` whose ``key`` is in the column ``key`` of ``wanted`` (a written table), and by chance a few others; null keys go.

    The wanted keys set bits in a map of bounded size, which is broadcast.  So the join that must follow moves little of ``rows``, whatever
    its width.  When keys are too many for the map more rows pass, and none is lost."""
    bits = min(MAP_BITS, 1 << max(10, (16 * wanted.count()).bit_length()))
    place = F.pmod(F.xxhash64(F.lit(90210), F.col(key)), F.lit(bits))
    slot, bit = F.shiftright("_place", 6).alias("_slot"), F.col("_place").bitwiseAND(F.lit(63).cast("long")).cast("int")
    marks = wanted.select(place.alias("_place")).select(slot, F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("_bit"))
    marks = marks.groupBy("_slot").agg(F.bit_or("_bit").alias("_bits"))
    placed = rows.select("*", place.alias("_place")).select("*", slot)
    return placed.join(F.broadcast(marks), "_slot").where(F.getbit("_bits", bit) == 1).select(*rows.columns)


def dealt_out(df: DataFrame) -> DataFrame:
    """``df`` in as many partitions as there are cores, if it is read in fewer, as a small file is; larger tables stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if its counted ``rows`` are within ``limit``, else as it is."""
    return F.broadcast(df) if rows <= limit else df


def normal_text(text: Column) -> Column:
    """Lower case, runs of white space as one blank, none at the ends; null stays null."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def words_of(text: Column) -> Column:
    """Words of the normal text; an empty array for null or blank text."""
    t = normal_text(text)
    return F.when(t.isNull() | (t == ""), F.array().cast("array<string>")).otherwise(F.split(t, " "))


def fold(parts: Column, seed: int = 42) -> Column:
    """A 64-bit key of several columns."""
    return F.xxhash64(F.lit(seed), parts)
