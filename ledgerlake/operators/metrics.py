"""Recipes over counter and histogram samples (ms, <labels>, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.functions.times import window_start
from ledgerlake.operators import ordering


def increases(samples: DataFrame, series: list[str], order: str = "event_id") -> DataFrame:
    """Samples with the increase since the one before; a counter that falls was reset, so its value counts.

    No extrapolation to the edges of a window.
    """
    before = F.col("_before.value")
    found = ordering.with_last(samples, series, [order], F.struct("value"), "_before")
    return found.withColumn("increase", F.when(before.isNull(), 0.0).when(F.col("value") < before, F.col("value")).otherwise(F.col("value") - before)).drop("_before")


def rate(samples: DataFrame, series: list[str], width: int) -> DataFrame:
    """Increase a second of each series in each window."""
    found = increases(samples, series).groupBy(*series, window_start("ms", width).alias("window_start"))
    return found.agg((F.sum("increase") / (width / 1000)).alias("rate"))


def share(totals: DataFrame, over: list[str], value: str) -> DataFrame:
    """Percent of the total within ``over``."""
    return totals.withColumn("percent", 100 * F.col(value) / F.sum(value).over(Window.partitionBy(*over)))


def histogram_quantile(buckets: DataFrame, key: list[str], q: float) -> DataFrame:
    """``buckets(<key>, le, n)``, n cumulative, le up to infinity: linear within the bucket; in the last one its finite bound."""
    w = Window.partitionBy(*key).orderBy("le")
    rows = buckets.select(
        *key, "le", "n", F.lag("le", 1, 0.0).over(w).alias("low"), F.lag("n", 1, 0).over(w).alias("below"), F.max("n").over(Window.partitionBy(*key)).alias("total")
    ).where((F.col("n") >= q * F.col("total")) & (F.col("below") < q * F.col("total")))
    inside = F.col("low") + (F.col("le") - F.col("low")) * (q * F.col("total") - F.col("below")) / (F.col("n") - F.col("below"))
    return rows.select(*key, F.when(F.col("le") == float("inf"), F.col("low")).otherwise(inside).alias("quantile"))


def gauge_delta(samples: DataFrame, series: list[str], width: int) -> DataFrame:
    """Last minus first value of each series in each window."""
    g = samples.groupBy(*series, window_start("ms", width).alias("window_start"))
    return g.agg((F.max_by("value", "event_id") - F.min_by("value", "event_id")).alias("delta"))


def lag_behind(positions: DataFrame, group: str, value: str) -> DataFrame:
    """How far each replica is behind the one furthest ahead."""
    furthest = positions.groupBy(F.col(group).alias("_group")).agg(F.max(value).alias("_furthest"))
    return positions.join(furthest, F.col(group).eqNullSafe(F.col("_group"))).withColumn("lag", F.col("_furthest") - F.col(value)).drop("_group", "_furthest")


def sustained(points: DataFrame, key: list[str], at: str, condition: str, least: int) -> DataFrame:
    """(key, begin, end) of stretches of points that all satisfy ``condition`` and last ``least`` or longer."""
    rows = points.withColumn("_bad", F.when(F.expr(condition), 0).otherwise(1))
    rows = ordering.ranked(rows.select(*key, at, "_bad", (-F.col("_bad")).alias("_good")), key, [at, "_good"], weight="_bad")
    runs = rows.where("_bad = 0").groupBy(*key, "rank").agg(F.min(at).alias("begin_ms"), F.max(at).alias("end_ms"))
    return runs.where(F.col("end_ms") - F.col("begin_ms") >= least).drop("rank")


def gauge(samples: DataFrame, series: list[str], by: list[str]) -> DataFrame:
    """Sum and maximum of the latest values of all series in each group."""
    latest = samples.groupBy(*series).agg(F.max_by("value", "event_id").alias("value"))
    return latest.groupBy(*by).agg(F.sum("value").alias("total"), F.max("value").alias("most"))


def mean_latency(samples: DataFrame, series: list[str], width: int, total: str, count: str) -> DataFrame:
    """Mean by window: the rate of a running total over the rate of its running count."""
    sums = rate(samples.withColumn("value", F.col(total)), series, width).withColumnRenamed("rate", "_total")
    counts = rate(samples.withColumn("value", F.col(count)), series, width).withColumnRenamed("rate", "_count")
    return sums.join(counts, [*series, "window_start"]).where("_count > 0").select(*series, "window_start", (F.col("_total") / F.col("_count")).alias("mean"))


def between_buckets(buckets: DataFrame, key: list[str], low: float, high: float) -> DataFrame:
    """``buckets(le, n)``, cumulative: observations above ``low`` and up to ``high``."""
    at = lambda b: F.max(F.when(F.col("le") == b, F.col("n")))
    return buckets.groupBy(*key).agg((at(high) - at(low)).alias("n"))
