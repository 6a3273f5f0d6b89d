"""Structured Streaming over events: alerts, once-only intake, quiet repeats, and a file inbox.

Each job takes what is there, commits it under its checkpoint and ends, so running it again continues where it stopped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """The events as a stream of files, with ``ts`` as a timestamp for watermarks."""
    return spark.readStream.schema(EVENTS).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def alerts(events: DataFrame, event_type: str, window: str, slide: str, least: int) -> DataFrame:
    """(start, user_id, n): sliding windows in which a user has at least ``least`` events of a type; a day's lateness is allowed."""
    some = events.where(F.col("event_type") == event_type).withWatermark("ts", "1 day")
    counts = some.groupBy(F.window("ts", window, slide).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") >= least).select(F.col("w.start").alias("start"), "user_id", "n")


def once(events: DataFrame, key: str = "event_id") -> DataFrame:
    """Each key's first row within the watermark."""
    return events.withWatermark("ts", "1 day").dropDuplicatesWithinWatermark([key])


def quiet_repeats(events: DataFrame, quiet: float = 600.0) -> DataFrame:
    """(user_id, ts, event_id): a user's success, and the next only when ``quiet`` seconds have passed since the last that was let through.

    State is the time of that one event a user, and goes when the watermark has left it behind."""

    def let_through(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        out = []
        for _, r in pd.concat(batches).sort_values(["ts", "event_id"]).iterrows():
            at = r["ts"].timestamp()
            if last is None or at - last >= quiet:
                last = at
                out.append({"user_id": key[0], "ts": r["ts"], "event_id": r["event_id"]})
        state.update((last,))
        state.setTimeoutTimestamp(max(int((last + quiet) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["user_id", "ts", "event_id"])

    some = events.where("event_type = 'signup'").withWatermark("ts", "1 day").select("user_id", "ts", "event_id")
    return some.groupBy("user_id").applyInPandasWithState(let_through, "user_id long, ts timestamp, event_id long", "last double", "append", "EventTimeTimeout")


def run_once(stream: DataFrame, out: str, checkpoint: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Process what is there into Parquet under ``out`` and read it.

    With ``keys``, those of an aggregation, each micro-batch writes the rows that it changed into a folder of its own, and of a key the latest row is read: so
    windows that the watermark hasn't closed are in the result too.  A micro-batch that is run again overwrites its folder."""
    spark, writer = stream.sparkSession, stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if not keys:
        writer.format("parquet").option("path", out).outputMode("append").start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(out)
    writer.outputMode("update").foreachBatch(lambda rows, i: rows.write.mode("overwrite").parquet(f"{out}/_batch={i}")).start().awaitTermination()
    rows = spark.read.schema(stream.schema).option("basePath", out).parquet(f"{out}/_batch=*")
    rest = [c for c in stream.columns if c not in keys]
    latest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col("_batch").cast("int")).alias("_r"))
    return latest.select(*keys, "_r.*").select(*stream.columns)


def inbox(spark: SparkSession, path: str, schema: str, checkpoint: str, take: Callable[[DataFrame, int], None], attempts: int = 3) -> int:
    """Hand the files that are new under ``path`` to ``take``, a micro-batch at a time, and return how many micro-batches that took.

    The checkpoint remembers files that are done; a micro-batch that fails is handed out again with the same files, ``attempts`` times at most."""
    for attempt in range(attempts):
        stream = spark.readStream.schema(schema).option("cleanSource", "off").json(path)
        query = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(take).start()
        try:
            query.awaitTermination()
            return len([p for p in query.recentProgress if p["numInputRows"]])
        except StreamingQueryException:
            if attempt == attempts - 1:
                raise
    return 0
