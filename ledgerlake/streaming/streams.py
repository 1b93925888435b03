"""Structured Streaming forms of the event operators; the batch forms are in ``operators.events``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def coalesce_windows(stream: DataFrame, width: str, types: list[str], late: str) -> DataFrame:
    """Windows over ``stream(ts, type, value)`` with a count of each type; state goes when the watermark passes."""
    counts = [F.count_if(F.col("type") == t).alias(f"n_{t}") for t in types]
    found = stream.withWatermark("ts", late).groupBy(F.window("ts", width)).agg(F.count("*").alias("n"), *counts)
    return found.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "n", *(f"n_{t}" for t in types))


def downsample(stream: DataFrame, key: str, width: str, late: str) -> DataFrame:
    found = stream.withWatermark("ts", late).groupBy(F.window("ts", width), key)
    return found.agg(F.max_by("value", "ts").alias("last"), F.avg("value").alias("mean"), F.max("value").alias("most"), F.min("value").alias("least")).select(key, F.col("window.start").alias("window_start"), "last", "mean", "most", "least")


def storms(stream: DataFrame, key: str, width: str, slide: str, most: int, late: str) -> DataFrame:
    """Keys with more than ``most`` events in a sliding window."""
    found = stream.withWatermark("ts", late).groupBy(F.window("ts", width, slide), key).agg(F.count("*").alias("n"))
    return found.where(F.col("n") > most).select(key, F.col("window.start").alias("window_start"), "n")


def first_of_each(stream: DataFrame, key: list[str], late: str) -> DataFrame:
    """Repeated requests dropped, while the watermark still covers the first."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(key)


def latest_states(stream: DataFrame, key: str, checkpoint: str, path: str) -> StreamingQuery:
    """Folds ``stream(key, ts, state)`` into a table of latest states, a version for each micro-batch.

    A batch only merges what it touches with the version before; a version is written whole, so
    a batch that runs again after a failure gives the same version.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        news = batch.groupBy(key).agg(F.max_by(F.struct("ts", "state"), "ts").alias("v")).select(key, "v.*")
        if number:
            news = news.unionByName(spark.read.parquet(f"{path}/version={number - 1}"))
        news.groupBy(key).agg(F.max_by(F.struct("ts", "state"), "ts").alias("v")).select(key, "v.*").write.mode("overwrite").parquet(f"{path}/version={number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
