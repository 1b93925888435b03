"""Logical inputs (mutation log, telemetry, runs, gossip, samples ...) derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.functions.times import millis
from ledgerlake.operators import ordering


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, value, tombstone, ttl_ms, term, idx, ms): a multi-version log with a unique version order."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("key"),
        "value",
        (F.col("event_type") == "error").alias("tombstone"),
        F.when(F.col("event_type") == "view", F.lit(432_000_000).cast("long")).alias("ttl_ms"),
        F.lit(0).cast("long").alias("term"),
        F.col("event_id").alias("idx"),
        millis("ts").alias("ms"),
    )


def telemetry(spark: SparkSession, sf_dir: str, nodes: int = 8) -> DataFrame:
    """(event_id, ms, node, type, shard, value); shard is null for one type, as for events without a shard."""
    return table(spark, sf_dir, "events").select(
        "event_id",
        millis("ts").alias("ms"),
        (F.col("user_id") % nodes).cast("int").alias("node"),
        F.col("event_type").alias("type"),
        F.when(F.col("event_type") != "signup", F.get_json_object("props", "$.k").cast("int") % 16).alias("shard"),
        "value",
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_number, level, slot, size, min_key, max_key, entries, tombstone_count): one sorted run a month."""
    o = table(spark, sf_dir, "orders")
    month = (F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("long")
    key = F.lpad(F.col("o_orderkey").cast("string"), 8, "0")
    return (
        o.groupBy(month.alias("file_number"))
        .agg(F.count("*").alias("entries"), F.min(key).alias("min_key"), F.max(key).alias("max_key"), F.count_if(F.col("o_orderstatus") == "F").alias("tombstone_count"))
        .select("file_number", (F.col("file_number") % 4).cast("int").alias("level"), (F.col("file_number") % 3).cast("int").alias("slot"), (F.col("entries") * 120).alias("size"), "min_key", "max_key", "entries", "tombstone_count")
    )


def gossip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, ms, id, from_id, state, incarnation)."""
    state = F.when(F.col("event_type") == "click", "suspect").when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "left").otherwise("alive")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), millis("ts").alias("ms"), (F.col("user_id") % 40).alias("id"), (F.col("event_id") % 7).alias("from_id"), state.alias("state"), F.floor(F.col("event_id") / 2000).cast("long").alias("incarnation")
    )


def samples(spark: SparkSession, sf_dir: str, nodes: int = 4) -> DataFrame:
    """(ms, operation, node, value): running counters per series, with a reset every 150 increments."""
    e = table(spark, sf_dir, "events").select(millis("ts").alias("ms"), F.col("event_type").alias("operation"), (F.col("user_id") % nodes).cast("int").alias("node"), "event_id")
    n = ordering.ranked(e, ["operation", "node"], ["event_id"])
    return n.select("ms", "operation", "node", "event_id", (F.col("rank") % 150).cast("double").alias("value"))
