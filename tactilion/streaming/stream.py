"""Streaming extension: documents and events as files arrive; state is a checkpoint in the shared folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def once_per_content(documents: DataFrame, time: str, delay: str = "1 day") -> DataFrame:
    """Drops texts already seen within the watermark, by digest."""
    return documents.withColumn("key", F.sha2("text", 256)).withWatermark(time, delay).dropDuplicatesWithinWatermark(["key"])


def tumbling(events: DataFrame, size: str = "10 minutes", delay: str = "10 minutes") -> DataFrame:
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return timed.withWatermark("ts", delay).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))


def read_files(spark: SparkSession, like: DataFrame, path: str) -> DataFrame:
    return spark.readStream.schema(like.schema).parquet(path)


def append(stream: DataFrame, out: str, checkpoint: str):
    """Appends to Parquet; files already taken are known from the checkpoint, so a restart repeats nothing."""
    return stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", out).trigger(availableNow=True).start()


def signature(blocks: DataFrame, options: str) -> DataFrame:
    """``blocks`` with ``key``: a digest of everything that a block's lines depend on, the options of its context included."""
    return blocks.withColumn("key", F.sha2(F.concat(F.to_json(F.struct("type", "level", "text")), F.lit(options)), 256))


def lines_cached(blocks: DataFrame, cache: DataFrame, options: str, make: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Lines of ``blocks`` from ``cache(key, lines)``, and the rows to add to it: ``make`` sees each new distinct block once."""
    keyed = signature(blocks, options)
    fresh = keyed.select("key", "type", "level", "text").dropDuplicates(["key"]).join(cache.select("key"), "key", "left_anti")
    made = make(fresh).select("key", "lines")
    return keyed.join(cache.unionByName(made), "key").drop("key"), made


def push(stream: DataFrame, send: Callable[[list], None], checkpoint: str, rows: int = 10):
    """Sends the newest rows of each batch to a device; the next batch waits until it has taken them."""
    def deliver(batch: DataFrame, number: int) -> None:
        send(batch.limit(rows).collect())

    return stream.writeStream.foreachBatch(deliver).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
