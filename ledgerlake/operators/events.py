"""Analytics of telemetry (event_id, ms, node, type, shard, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.functions.times import window_start
from ledgerlake.operators import ordering


def parse_numbers(text: Column) -> Column:
    """'1, x,3' as [1, 3]: items that aren't numbers are dropped."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x).try_cast("int")), lambda x: x.isNotNull())


def parse_names(text: Column) -> Column:
    """Trimmed lower-case items, empty ones dropped."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.lower(F.trim(x))), lambda x: x != "")


def matches(nodes: list[int] = (), types: list[str] = (), shards: list[int] = ()) -> Column:
    """An empty list lets everything through; events without a shard pass any list of shards."""
    found = F.lit(True)
    if nodes:
        found = found & F.col("node").isin(list(nodes))
    if types:
        found = found & F.lower("type").isin([t.lower() for t in types])
    if shards:
        found = found & (F.col("shard").isNull() | F.col("shard").isin(list(shards)))
    return found


def coalesce_windows(events: DataFrame, width: int, types: list[str]) -> DataFrame:
    """One row for each window that has events: bounds, events in it, and a count of each type."""
    start = window_start("ms", width)
    counts = [F.count_if(F.col("type") == t).alias(f"n_{t}") for t in types]
    return events.groupBy(start.alias("window_start")).agg(F.count("*").alias("n"), *counts).withColumn("window_end", F.col("window_start") + width)


def retain(batches: DataFrame, keep_ms: int, most: int) -> DataFrame:
    """Batches that end within ``keep_ms`` of the newest, the newest ``most`` of them."""
    newest = batches.agg(F.max("window_end").alias("_newest"))
    kept = batches.crossJoin(F.broadcast(newest)).where(F.col("window_end") >= F.col("_newest") - keep_ms).drop("_newest")
    return kept.orderBy(F.desc("window_end")).limit(most)


def replay(batches: DataFrame, start: int, end: int) -> DataFrame:
    """Whole batches within [start, end]."""
    return batches.where((F.col("window_start") >= start) & (F.col("window_end") <= end))


def downsample(events: DataFrame, key: list[str], width: int) -> DataFrame:
    """Last, mean, max, min and sum of each window, stamped with its midpoint."""
    start = window_start("ms", width)
    return (
        events.groupBy(*key, (start + width // 2).alias("mid_ms"))
        .agg(F.max_by("value", F.struct("ms", "event_id")).alias("last"), F.avg("value").alias("mean"), F.max("value").alias("most"), F.min("value").alias("least"), F.sum("value").alias("total"))
    )


def series_statistics(events: DataFrame, key: list[str]) -> DataFrame:
    return events.groupBy(*key).agg(F.min("value").alias("least"), F.max("value").alias("most"), F.avg("value").alias("mean"), F.count("value").alias("n"))


def percentiles(events: DataFrame, key: list[str], points: dict[str, float]) -> DataFrame:
    """Values at rank floor(n * p) from 0. Equal values are counted before they are ranked."""
    counts = events.groupBy(*key, "value").agg(F.count("*").alias("_n"))
    found = ordering.ranked(counts, key, ["value"], weight="_n")
    at = lambda p: F.least(F.floor(F.col("of") * p), F.col("of") - 1)
    here = lambda p: (at(p) < F.col("rank")) & (at(p) >= F.col("rank") - F.col("_n"))
    return found.groupBy(*key).agg(*(F.max(F.when(here(p), F.col("value"))).alias(name) for name, p in points.items()))


def histogram(events: DataFrame, bounds: list[float]) -> DataFrame:
    """(bucket, label, n) for every bucket, empty ones too; a value at a bound belongs above it."""
    bucket = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col("value")))
    counts = events.where("value is not null").groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))
    labels = [f"<{bounds[0]:g}"] + [f"{a:g}-{b:g}" for a, b in zip(bounds, bounds[1:])] + [f">={bounds[-1]:g}"]
    every = events.sparkSession.createDataFrame(list(enumerate(labels)), "bucket int, label string")
    return F.broadcast(every).join(counts, "bucket", "left").select("bucket", "label", F.coalesce("n", F.lit(0)).alias("n"))


def cumulative_histogram(events: DataFrame, powers: int) -> DataFrame:
    """(le, n): events with value <= 1, 2, 4 ...; one pass, one row for each bound."""
    bounds = [float(1 << i) for i in range(powers)]
    counts = events.agg(*(F.count_if(F.col("value") <= b).alias(f"b{i}") for i, b in enumerate(bounds)))
    return counts.select(F.explode(F.arrays_zip(F.array(*map(F.lit, bounds)).alias("le"), F.array(*(f"b{i}" for i in range(powers))).alias("n"))).alias("x")).select("x.le", "x.n")


def last_n(events: DataFrame, key: list[str], n: int) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("ms"), F.desc("event_id")))
    return events.withColumn("nth", nth).where(F.col("nth") <= n)


def trend(events: DataFrame, key: list[str]) -> DataFrame:
    """Whether the mean of the later half exceeds that of the earlier (the middle belongs to the later)."""
    found = ordering.ranked(events.select(*key, "value", "ms", "event_id"), key, ["ms", "event_id"])
    early = F.col("rank") <= F.floor(F.col("of") / 2)
    return found.groupBy(*key).agg((F.avg(F.when(~early, F.col("value"))) > F.avg(F.when(early, F.col("value")))).alias("rising"))


def sliding_total(events: DataFrame, key: list[str], width: int) -> DataFrame:
    """Events with the sum and the number of those up to ``width`` ms before them, themselves included.

    Each event goes to its own stretch of ``width`` ms and, as a mere summand, to the next, so
    a task holds two stretches of a key. Events without a time are each other's neighbours.
    """
    stretch = F.floor(F.col("ms") / width)
    places = F.when(F.col("ms").isNull(), F.array(F.lit(None).cast("long"))).otherwise(F.array(stretch, stretch + 1))
    each = events.select("*", F.posexplode(places).alias("_summand", "_stretch"))
    w = Window.partitionBy(*key, "_stretch").orderBy("ms").rangeBetween(-width, 0)
    found = each.withColumns({"window_total": F.sum("value").over(w), "window_n": F.count("*").over(w)})
    return found.where("_summand = 0").drop("_summand", "_stretch")


def as_of(points: DataFrame, facts: DataFrame, by: str, point_ms: str, fact_ms: str, value: str) -> DataFrame:
    """For each point the value of the latest fact of its key at or before it; null without one.

    Points and facts are merged and ordered once by key, instead of a range join that pairs them all.
    """
    both = points.select(by, F.col(point_ms).alias("at"), F.lit(1).alias("kind"), F.lit(None).cast(dict(facts.dtypes)[value]).alias("v"), F.lit(None).cast("long").alias("tie")).unionByName(
        facts.select(by, F.col(fact_ms).alias("at"), F.lit(0).alias("kind"), F.col(value).alias("v"), F.col("event_id").alias("tie"))
    )
    found = ordering.with_last(both, [by], ["at", "kind", "tie"], F.col("v"), "last", own=True)
    return found.where("kind = 1").select(by, F.col("at").alias(point_ms), F.col("last").alias(value))


def per_minute(events: DataFrame, end_ms: int, minutes: int) -> DataFrame:
    """(minute_ms, n) of the last ``minutes`` minutes up to ``end_ms``, zeros included."""
    last = end_ms - end_ms % 60_000
    first = last - 60_000 * (minutes - 1)
    every = events.sparkSession.range(first, last + 1, 60_000).select(F.col("id").alias("minute_ms"))
    counts = events.where(f"ms >= {first} and ms < {last + 60_000}").groupBy(window_start("ms", 60_000).alias("minute_ms")).agg(F.count("*").alias("n"))
    return every.join(counts, "minute_ms", "left").select("minute_ms", F.coalesce("n", F.lit(0)).alias("n"))


def totals(batches: DataFrame) -> DataFrame:
    """Batches, events in them, and the time they span."""
    return batches.agg(F.count("*").alias("batches"), F.sum("n").alias("events"), F.min("window_start").alias("oldest"), F.max("window_end").alias("newest"))


def recent(batches: DataFrame, n: int) -> DataFrame:
    """The ``n`` newest batches."""
    return batches.orderBy(F.desc("window_end")).limit(n)


def last_breach(events: DataFrame, key: list[str], condition: str) -> DataFrame:
    """The newest event of each key that satisfies ``condition``; keys without one have no row."""
    rest = [c for c in events.columns if c not in key]
    return events.where(condition).groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct("ms", "event_id")).alias("v")).select(*key, "v.*")


def hit_ratio(events: DataFrame, key: list[str], hit: str, miss: str, width: int) -> DataFrame:
    """Share of hits in the newest window of each key, and its mean over windows; windows with neither kind don't count."""
    n = lambda t: F.count_if(F.col("type") == t)
    each = events.where(F.col("type").isin(hit, miss)).groupBy(*key, window_start("ms", width).alias("w")).agg((n(hit) / F.count("*")).alias("ratio"))
    return each.groupBy(*key).agg(F.max_by("ratio", "w").alias("current"), F.avg("ratio").alias("mean"))


def node_of(own: Column, envelope: Column) -> Column:
    """The node of an event: its own if it names one, else that of the message around it."""
    return F.coalesce(own, envelope)


def unite_filters(filters: DataFrame) -> DataFrame:
    """``filters(nodes, types, shards)``, arrays, as one filter that lets through what any of them lists, sorted."""
    one = lambda c: F.sort_array(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    return filters.agg(one("nodes"), one("types"), one("shards"))


def filter_batches(events: DataFrame, keep: Column, width: int, types: list[str]) -> DataFrame:
    """Batches of the events that ``keep`` lets through; a batch left with none is not there."""
    return coalesce_windows(events.where(keep), width, types)


def stability(elections: DataFrame, now_ms: int) -> DataFrame:
    """``elections(shard, ms)``: time since the last one, and whether that is recent (30 s), within a minute, or long past (5 min)."""
    age = now_ms - F.max("ms")
    return elections.groupBy("shard").agg(age.alias("stable_ms")).withColumns({"recent": F.col("stable_ms") < 30_000, "within_minute": F.col("stable_ms") < 60_000, "stable": F.col("stable_ms") > 300_000})


def node_states(events: DataFrame) -> DataFrame:
    """The fold of ``events(node, ms, event_id, type, value)`` into one state a node: last event and type, counts, shards seen."""
    last = F.max_by(F.struct("event_id", "type"), F.struct("ms", "event_id")).alias("l")
    return events.groupBy("node").agg(last, F.count("*").alias("n"), F.count_if(F.col("type") == "error").alias("errors"), F.count_distinct("shard").alias("shards")).select("node", F.col("l.event_id").alias("last_id"), F.col("l.type").alias("last_type"), "n", "errors", "shards")


def watch(views: DataFrame) -> DataFrame:
    """``views(cluster, seq, view)``: the first and every changed one, with an epoch that grows by one each time."""
    before = F.col("_before.view")
    seen = ordering.with_last(views, ["cluster"], ["seq"], F.struct("view"), "_before")
    changed = seen.where(before.isNull() | (before != F.col("view")))
    return ordering.ranked(changed.select("cluster", "seq", "view"), ["cluster"], ["seq"]).select("cluster", "seq", "view", F.col("rank").cast("int").alias("epoch"))
