"""Compaction as dataflow: merges, guards and slots, candidates, rewards, sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlake.operators import ordering


def merge(entries: DataFrame, drop_tombstones: bool) -> DataFrame:
    """``entries(key, value, tombstone, run)``: of each key the one from the newest run (largest number)."""
    rest = [c for c in entries.columns if c != "key"]
    out = entries.groupBy("key").agg(F.max_by(F.struct(*rest), "run").alias("v")).select("key", "v.*")
    return out.where(~F.col("tombstone")) if drop_tombstones else out


def oldest_runs(runs: DataFrame, k: int) -> DataFrame:
    """The ``k`` oldest runs of each slot above level 0, and all runs of level 0."""
    nth = F.row_number().over(Window.partitionBy("level", "slot").orderBy("file_number"))
    return runs.withColumn("nth", nth).where((F.col("level") == 0) | (F.col("nth") <= k)).drop("nth")


def overlaps(start: str | None, end: str | None) -> Column:
    """Whether a run shares keys with [start, end); no bound: none."""
    found = F.lit(True)
    if start is not None:
        found = found & (F.col("max_key") >= start)
    if end is not None:
        found = found & (F.col("min_key") < end)
    return found


def prefix_number(key: Column) -> Column:
    """The first eight bytes of a key as a number (shorter keys aren't padded), exact to the last digit."""
    return F.conv(F.hex(F.substring(key, 1, 8)), 16, 10).cast("decimal(20,0)")


def key_distance(start: Column, end: Column) -> Column:
    """How far apart two keys are by their first eight bytes, subtracted before they become doubles; 0 if reversed."""
    return F.greatest((prefix_number(end) - prefix_number(start)).cast("double"), F.lit(0.0))


def overlap_fraction(start: str, end: str) -> Column:
    """The share of a run's key range within [start, end): 1 if contained, 0.5 if the range is empty."""
    low, high = F.greatest(F.col("min_key"), F.lit(start)), F.least(F.col("max_key"), F.lit(end))
    whole, part = key_distance(F.col("min_key"), F.col("max_key")), key_distance(low, high)
    inside = (F.col("min_key") >= start) & (F.col("max_key") <= end)
    return F.when(inside, 1.0).when(whole == 0, 0.5).otherwise(F.least(F.lit(1.0), part / whole))


def approximate_size(runs: DataFrame, start: str, end: str) -> DataFrame:
    """(bytes, files) of the runs that share keys with [start, end)."""
    return runs.where(overlaps(start, end)).agg(F.coalesce(F.sum(F.floor(F.col("size") * overlap_fraction(start, end))), F.lit(0)).cast("long").alias("bytes"), F.count("*").alias("files"))


def propose_guards(keys: DataFrame, slots: int) -> DataFrame:
    """(guard_id, guard): quantiles of the distinct keys; with fewer keys than slots, all of them.

    Keys are range-partitioned and ranked within partitions, whose offsets come from a count by
    partition: no task sorts all keys.
    """
    ranked = ordering.with_rank(keys.select("key").distinct(), "key")
    n = ranked.count()
    if n <= slots:
        return ranked.select((F.col("rank") - 1).alias("guard_id"), F.col("key").alias("guard"))
    step = n // slots
    return ranked.where(((F.col("rank") - 1) % step == 0) & (F.col("rank") > 1) & ((F.col("rank") - 1) / step < slots)).select(((F.col("rank") - 1) / step).cast("long").alias("guard_id"), F.col("key").alias("guard"))


def slot_of(key: Column, guards: list[str]) -> Column:
    """The number of the first guard behind the key: guards at or before it, counted."""
    return F.size(F.filter(F.array(*map(F.lit, guards)), lambda g: g <= key)) if guards else F.lit(0)


def candidates(runs: DataFrame, slots: DataFrame, now_ms: int, l0_max: int = 12, max_level: int = 4, base_size: int = 64 << 20, fanout: int = 10, hot: float = 0.8, density: float = 0.15, k: int = 3, least_bytes: int = 1 << 20) -> DataFrame:
    """(level, slot, action, runs, trigger): what the compactor may do.

    ``runs(level, slot, size, entries, tombstone_count)``, ``slots(level, slot, heat, k, compacted_ms)``; a slot that
    isn't listed is cold, takes the default ``k`` and was never compacted. Level 0 is one slot, merged whole from a number of files
    that falls as it fills. Deeper slots: a single run moves down; two runs or more are merged if
    together beyond one and a half times the level's target (``base_size`` times ``fanout`` a level), or a day old, or made one if hot; more than k
    are merged; dense tombstones on the last level are cleaned. A level out of balance has its guards moved (no slot).
    """
    day = 86_400_000
    first = runs.where("level = 0").agg(F.count("*").cast("int").alias("n"))
    first = first.where(F.col("n") >= pressure_settings(F.col("n") / l0_max)["l0_threshold"])
    first = first.select(F.lit(0).alias("level"), F.lit(0).alias("slot"), F.lit("tier").alias("action"), F.col("n").alias("runs"), F.lit("level 0").alias("trigger"))
    found = runs.where("level > 0").groupBy("level", "slot").agg(F.count("*").cast("int").alias("n"), F.sum("size").alias("bytes"), (F.sum("tombstone_count") / F.greatest(F.sum("entries"), F.lit(1))).alias("density"))
    found = found.join(slots.select("level", "slot", "heat", F.col("k").cast("int").alias("k"), "compacted_ms"), ["level", "slot"], "left").fillna({"heat": 0.0, "k": k, "compacted_ms": 0})
    n, few = F.col("n"), F.least("n", F.lit(4))
    target = base_size * F.pow(F.lit(float(fanout)), F.col("level") - 1)
    rules = [
        ("promote", "single run", n, (n == 1) & (F.col("level") < max_level)),
        ("tier", "size", few, (n >= 2) & (F.col("bytes") > 1.5 * target)),
        ("tier", "count", F.least("k", F.lit(4)), n > F.col("k")),
        ("eager", "hot", n, (n > 1) & (F.col("heat") >= hot)),
        ("cleanup", "tombstones", n, (F.col("level") == max_level) & (F.col("density") >= density)),
        ("tier", "age", few, (n >= 2) & (now_ms - F.col("compacted_ms") > day)),
    ]
    offers = F.array_compact(F.array(*(F.when(test, F.struct(F.lit(action).alias("action"), number.alias("runs"), F.lit(why).alias("trigger"))) for action, why, number, test in rules)))
    deeper = found.select("level", "slot", F.inline(offers))
    moved = imbalanced_levels(found.select("level", "slot", "bytes", "compacted_ms"), now_ms, least_bytes)
    moved = moved.select("level", F.lit(None).cast("int").alias("slot"), F.lit("guard move").alias("action"), F.lit(0).alias("runs"), F.lit("imbalance").alias("trigger"))
    return first.unionByName(deeper).unionByName(moved)


def imbalanced_levels(slots: DataFrame, now_ms: int, least_bytes: int) -> DataFrame:
    """``slots(level, slot, bytes, compacted_ms)``: levels whose largest slot is 3 times the mean or more, none compacted within an hour."""
    found = slots.groupBy("level").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"), F.max("bytes").alias("largest"), F.max("compacted_ms").alias("last"))
    ratio = F.col("largest") / (F.col("bytes") / F.col("n"))
    return found.where((F.col("n") > 1) & (F.col("bytes") >= least_bytes) & (ratio >= 3) & (F.col("last") <= now_ms - 3_600_000)).select("level", ratio.alias("ratio"))


def pressure_settings(ratio: Column) -> dict[str, Column]:
    """Threshold for level 0, exploration and slice by the share of allowed level-0 files."""
    by = lambda *v: F.when(ratio >= 0.9, v[3]).when(ratio >= 0.75, v[2]).when(ratio >= 0.5, v[1]).otherwise(v[0])
    return {"l0_threshold": by(4, 3, 2, 2), "epsilon": by(0.10, 0.05, 0.02, 0.0), "slice_mib": by(128, 64, 32, 16)}


def reward(latency_ms: Column, heat: Column, written: Column, ratio: Column, is_l0: Column) -> Column:
    weight = F.when(ratio >= 0.9, 3.0).when(ratio >= 0.75, 2.0).when(ratio >= 0.5, 1.5).otherwise(1.0)
    extra = F.when(is_l0 & (ratio >= 0.75), 1.5).otherwise(1.0)
    return F.when(written == 0, 0.0).otherwise(latency_ms * heat / written * weight * extra)


def arm_statistics(rewards: DataFrame) -> DataFrame:
    """``rewards(action, seq, reward)``: running mean 0.1 r + 0.9 mean from the first reward, as a weighted sum.

    The weight of a reward depends only on how many follow, so sums replace the fold.
    """
    numbered = ordering.ranked(rewards.select("action", "seq", "reward"), ["action"], ["seq"])
    weight = F.pow(F.lit(0.9), F.col("of") - F.col("rank")) * F.when(F.col("rank") == 1, 1.0).otherwise(0.1)
    return numbered.select("action", (F.col("reward") * weight).alias("part")).groupBy("action").agg(F.sum("part").alias("mean"), F.count("*").alias("n"))


def ucb(arms: DataFrame, c: float = 2.0) -> DataFrame:
    """Arms with their upper confidence bound; an arm never tried comes first."""
    total = arms.agg(F.sum("n").alias("total"))
    score = F.when(F.col("n") == 0, F.lit(float("inf"))).otherwise(F.col("mean") + c * F.sqrt(F.log(F.greatest(F.col("total"), F.lit(1))) / F.col("n")))
    return arms.crossJoin(F.broadcast(total)).select("action", "mean", "n", score.alias("ucb"))


def fold_manifest(edits: DataFrame) -> DataFrame:
    """``edits(seq, edit, level, slot, file_number, size)``: files added and not deleted since."""
    last = edits.groupBy("level", "slot", "file_number").agg(F.max_by(F.struct("edit", "size"), "seq").alias("v"))
    return last.where("v.edit = 'add'").select("level", "slot", "file_number", "v.size")


def slot_bounds(spark: SparkSession, guards: list[str]) -> DataFrame:
    """(slot, low, high) of the slots between guards; the outermost bounds are null."""
    edges = [None, *guards, None]
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(edges, edges[1:]))], "slot int, low string, high string")


def slots_touched(start: Column, end: Column, guards: list[str]) -> tuple[Column, Column]:
    """First and last slot that [start, end) touches: an end on a guard leaves that guard's slot out."""
    return slot_of(start, guards), slot_of(end, guards) - end.isin(guards).cast("int") if guards else F.lit(0)


def ranges_meet(low: Column, high: Column, other_low: Column, other_high: Column) -> Column:
    """Whether two ranges share a key, ends included."""
    return (low <= other_high) & (other_low <= high)


def range_compaction(runs: DataFrame, start: str | None, end: str | None) -> DataFrame:
    """The runs that a compaction of [start, end) rewrites."""
    if start is not None and end is not None and start >= end:
        raise ValueError(f"empty range {start!r} to {end!r}")
    return runs.where(overlaps(start, end))


def find_block(blocks: DataFrame, key: str) -> DataFrame:
    """Of ``blocks(block, first_key)`` the one that may hold ``key``: the last that starts at or before it."""
    return blocks.where(F.col("first_key") <= key).agg(F.max_by("block", "first_key").alias("block")).where("block is not null")


def promote(runs: DataFrame, level: int, slot: int) -> DataFrame:
    """``runs`` with those of a slot one level deeper; no entry is read."""
    moved = (F.col("level") == level) & (F.col("slot") == slot)
    return runs.withColumn("level", F.when(moved, F.col("level") + 1).otherwise(F.col("level")))


def resplit(entries: DataFrame, guards: list[str]) -> DataFrame:
    """``entries(key, run, idx)`` cut at the guards: (run, slot, entries, min_key, max_key, min_idx, max_idx)."""
    return entries.groupBy("run", slot_of(F.col("key"), guards).alias("slot")).agg(
        F.count("*").alias("entries"), F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.min("idx").alias("min_idx"), F.max("idx").alias("max_idx")
    )


def drops_tombstones(action: Column, level: Column, max_level: int) -> Column:
    """A tombstone may go only where nothing older lies below: on the last level, or in a forced cleanup."""
    return (action == "cleanup") | (level == max_level)


def select_action(arms: DataFrame, offered: DataFrame) -> DataFrame:
    """Of ``offered(position, action)`` the one with the largest bound; a new arm counts as infinite, ties go to the first."""
    score = F.coalesce(F.col("ucb"), F.lit(float("inf")))
    judged = offered.join(ucb(arms).select("action", "ucb"), "action", "left")
    return judged.agg(F.max_by("action", F.struct(score, -F.col("position"))).alias("action"))


def sample_keys(keys: DataFrame, n: int) -> DataFrame:
    """``n`` distinct keys, chosen alike in every run: those with the smallest digests."""
    return keys.select("key").distinct().orderBy(F.md5(F.col("key").cast("binary")), "key").limit(n)


def filter_kind(runs: DataFrame, by: list[str]) -> DataFrame:
    """What filter the merged run gets: ``quotient`` if any input (``version`` 2) has one, else ``bloom``."""
    return runs.groupBy(*by).agg(F.when(F.max("version") >= 2, "quotient").otherwise("bloom").alias("filter"))
