"""Storage statistics: levels, amplification, pressure, heat."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.operators import ordering

#: Heat of an operation.
HEAT = {"get": 1.0, "scan": 2.0, "put": 0.5, "delete": 0.5}


def levels(runs: DataFrame) -> DataFrame:
    return runs.groupBy("level").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), F.count_distinct("slot").alias("slots"))


def amplification(records: DataFrame) -> DataFrame:
    """``records(bytes_in, bytes_out)``: compaction ratio (in / out), write amplification (out / in), bytes saved; 1 for no bytes."""
    share = lambda a, b: F.when(F.col(b) == 0, 1.0).otherwise(F.col(a) / F.col(b))
    total = records.agg(F.sum("bytes_in").alias("i"), F.sum("bytes_out").alias("o"), F.count("*").alias("n"))
    return total.select(share("i", "o").alias("compaction_ratio"), share("o", "i").alias("write_amplification"), (F.col("i") - F.col("o")).alias("saved"), "n")


def pressure(ratio: Column) -> Column:
    return F.when(ratio >= 1.1, 4).when(ratio >= 0.9, 3).when(ratio >= 0.75, 2).when(ratio >= 0.5, 1).otherwise(0)


def pressure_score(l0: Column, memory: Column, slots: Column) -> Column:
    return 0.4 * l0 + 0.4 * memory + 0.2 * slots


def alpha(half_life: int) -> float:
    return min(math.log(2) / half_life, 1.0) if half_life else 0.5


def heat(operations: DataFrame, half_life: int) -> DataFrame:
    """``operations(slot, seq, op)``: exponentially weighted heat of each slot, as a weighted sum.

    Each operation's weight depends only on how many follow it, so no fold is needed.
    """
    a = alpha(half_life)
    later = F.col("of") - F.col("rank")
    weight = F.coalesce(F.create_map(*(F.lit(x) for kv in HEAT.items() for x in kv))[F.col("op")], F.lit(0.0))
    return ordering.ranked(operations.select("slot", "seq", "op"), ["slot"], ["seq"]).select("slot", (a * weight * F.pow(F.lit(1 - a), later)).alias("h")).groupBy("slot").agg(F.sum("h").alias("heat"))


def decayed(heat_column: Column, a: float, idle_seconds: Column) -> Column:
    return heat_column * F.pow(F.lit(1 - a), 10_000 * idle_seconds)


def slot_class(heat_column: Column) -> Column:
    return F.when(heat_column >= 0.8, "hot").when(heat_column <= 0.2, "cold").otherwise("warm")


def tombstone_density(runs: DataFrame) -> DataFrame:
    """Tombstones per estimated entry (100 bytes each, rounded down by file); 0 without entries."""
    total = runs.agg(F.sum("tombstone_count").alias("t"), F.sum(F.floor(F.col("size") / 100)).alias("e"))
    return total.select(F.when(F.col("e") == 0, 0.0).otherwise(F.col("t") / F.col("e")).alias("density"))


def target_runs(heat_column: Column, current: Column, default: Column, pressed: Column) -> Column:
    """Runs a slot may have: one if hot, one more up to the default if cold while writes press, else as many as now."""
    kind = slot_class(heat_column)
    return F.when(kind == "hot", 1).when((kind == "cold") & pressed, F.least(current + 1, default)).otherwise(current)


def level_heat(slots: DataFrame, hot: float = 0.7) -> DataFrame:
    """``slots(level, heat)``: mean, most and number of hot slots of each level."""
    return slots.groupBy("level").agg(F.avg("heat").alias("mean"), F.max("heat").alias("most"), F.count_if(F.col("heat") > hot).alias("hot"))


def write_pressure(operations: DataFrame, half_life: int, threshold: float = 0.5) -> DataFrame:
    """(ratio, pressed): running share of writes in ``operations(seq, write)``, from 0, as a weighted sum.

    The weight of an operation depends on how many follow it, which range partitions tell.
    """
    a = alpha(half_life)
    ranked = ordering.ranked(operations.select("seq", "write"), [], ["seq"])
    later = F.col("of") - F.col("rank")
    ratio = F.coalesce(F.sum(F.when(F.col("write"), a * F.pow(F.lit(1 - a), later))), F.lit(0.0))
    return ranked.agg(ratio.alias("ratio")).withColumn("pressed", F.col("ratio") > threshold)


def lsm_statistics(runs: DataFrame, records: DataFrame, memory_bytes: int, filter_bytes: int, flush_bytes: int) -> DataFrame:
    """One row of ``runs(level, size)`` and ``records(bytes_in, bytes_out)``: files, bytes and amplifications.

    Reads look into every file of level 0 and one of each deeper level that holds any; space is
    measured against the deepest level; the memory ratio against the flush limit and the filters' budget.
    """
    level = lambda test, value: F.coalesce(F.sum(F.when(test, value)), F.lit(0))
    each = runs.groupBy("level").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))
    total = each.agg(
        F.coalesce(F.sum("files"), F.lit(0)).alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), level(F.col("level") == 0, F.col("files")).alias("l0_files"), level(F.col("level") > 0, F.lit(1)).alias("deeper"), F.max_by("bytes", "level").alias("last")
    )
    written = amplification(records).select("write_amplification")
    return total.crossJoin(F.broadcast(written)).select(
        "files", "bytes", "l0_files", "write_amplification", (F.col("l0_files") + F.col("deeper")).cast("double").alias("read_amplification"),
        F.when(F.col("last") > 0, F.col("bytes") / F.col("last")).otherwise(1.0).alias("space_amplification"),
        ((memory_bytes + F.when(F.col("files") > 0, filter_bytes).otherwise(0)) / (flush_bytes + filter_bytes)).alias("memory_ratio"),
    )


def overall_pressure(l0: Column, memory: Column, buffer: Column) -> Column:
    """The highest class of the three ratios."""
    return F.greatest(pressure(l0), pressure(memory), pressure(buffer))


def slot_history(samples: DataFrame) -> DataFrame:
    """``samples(level, slot, heat)``: least, most and mean heat of each slot."""
    return samples.groupBy("level", "slot").agg(F.min("heat").alias("least"), F.max("heat").alias("most"), F.avg("heat").alias("mean"))


def selection_statistics(choices: DataFrame, by: str, n: int = 10) -> DataFrame:
    """``choices(by, seq, explored, ucb, reward)``: of the last ``n`` of each the share of explorations, mean bound and mean reward."""
    nth = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("seq")))
    last = choices.withColumn("_nth", nth).where(F.col("_nth") <= n)
    return last.groupBy(by).agg((F.count_if("explored") / F.count("*")).alias("explored"), F.avg("ucb").alias("ucb"), F.avg("reward").alias("reward"))
