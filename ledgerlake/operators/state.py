"""Folds of gossip and telemetry into cluster state."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.operators import ordering


def latest_status(gossip: DataFrame) -> DataFrame:
    return gossip.groupBy("id").agg(F.max_by("state", "seq").alias("state"))


def health(status: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("state") == s)
    return status.agg(F.count("*").alias("total"), n("alive").alias("alive"), n("suspect").alias("suspect"), n("failed").alias("dead")).withColumn("healthy", (F.col("suspect") == 0) & (F.col("dead") == 0))


def transitions(gossip: DataFrame, keep: int) -> DataFrame:
    """Changes of state (before the first a node is alive), the last ``keep`` of each node."""
    known = ordering.with_last(gossip.select("id", "seq", "state"), ["id"], ["seq"], F.struct("state"), "_b")
    changed = known.withColumn("before", F.when(F.col("_b").isNull(), "alive").otherwise(F.col("_b.state"))).where("state <> before")
    nth = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("seq")))
    return changed.withColumn("nth", nth).where(F.col("nth") <= keep).select("id", "seq", "before", "state")


def members(gossip: DataFrame) -> DataFrame:
    """(id, state, incarnation) after all updates in order.

    A higher incarnation wins; within one, suspect beats alive, failed only follows suspect, and left
    is final. So an update counts if no earlier one has a higher incarnation, the first counted
    ``left`` ends it, and else the last incarnation's first state, first suspicion and last failure tell
    the state: aggregates by incarnation instead of a fold over all updates of a node.
    """
    counted = ordering.with_last(gossip, ["id"], ["seq"], F.col("incarnation"), "_top", own=True, most=True).where("incarnation = _top")
    at = lambda f, s: f(F.when(F.col("state") == s, F.col("seq")))
    each = counted.groupBy("id", "incarnation").agg(F.min_by("state", "seq").alias("first"), at(F.min, "suspect").alias("suspect"), at(F.max, "failed").alias("failed"), at(F.min, "left").alias("left"))
    suspected = (F.col("first") == "suspect") | ((F.col("first") == "alive") & F.col("suspect").isNotNull())
    state = F.when(suspected & (F.col("failed") > F.col("suspect")), "failed").when(suspected, "suspect").otherwise(F.col("first"))
    one = each.withColumn("state", state).groupBy("id").agg(F.min_by("incarnation", "left").alias("left_in"), F.min("left").alias("left"), F.max_by("state", "incarnation").alias("state"), F.max("incarnation").alias("incarnation"))
    gone = F.col("left").isNotNull()
    return one.select("id", F.when(gone, "left").otherwise(F.col("state")).alias("state"), F.when(gone, F.col("left_in")).otherwise(F.col("incarnation")).alias("incarnation"))


def suspicions(gossip: DataFrame) -> DataFrame:
    """(id, suspected_by): how many nodes suspect each node."""
    return gossip.where("state = 'suspect'").groupBy("id").agg(F.count_distinct("from_id").alias("suspected_by"))


def confirm_latency(gossip: DataFrame) -> DataFrame:
    """(id, seq, latency_ms) from a node's last suspicion to each failure; null without suspicion."""
    suspected = F.when(F.col("state") == "suspect", F.col("ms"))
    return ordering.with_last(gossip, ["id"], ["seq"], suspected, "since").where("state = 'failed'").select("id", "seq", (F.col("ms") - F.col("since")).alias("latency_ms"))


def elections(terms: DataFrame) -> DataFrame:
    """``terms(shard, ms, event_id, term)``: the term of each shard, its elections (rises) and the last one's time."""
    rose = ordering.with_last(terms, ["shard"], ["ms", "event_id"], F.col("term"), "before", most=True)
    rose = rose.withColumn("rose", F.col("term") > F.coalesce("before", F.lit(0)))
    return rose.groupBy("shard").agg(F.max("term").alias("term"), F.count_if("rose").alias("elections"), F.max(F.when(F.col("rose"), F.col("ms"))).alias("last_ms"))


def storms(events: DataFrame, width: int, most: int) -> DataFrame:
    """Shards with more than ``most`` events in a window of ``width`` ms, and how many such windows."""
    counts = events.where("shard is not null").groupBy("shard", F.floor(F.col("ms") / width).alias("w")).agg(F.count("*").alias("n")).where(F.col("n") > most)
    return counts.groupBy("shard").agg(F.count("*").alias("windows"), F.max("n").alias("most"))


def happens_before(history: DataFrame) -> DataFrame:
    """(id, n): of each operation how many of its key returned before it was invoked.

    Counted by merging invocations and returns in time order, not by pairing operations.
    """
    marks = history.select("key", F.col("invoke_ms").alias("at"), F.lit(0).alias("returned"), "id").unionByName(history.select("key", F.col("return_ms").alias("at"), F.lit(1).alias("returned"), "id"))
    counted = ordering.ranked(marks, ["key"], ["at", "returned", "id"], weight="returned")
    return counted.where("returned = 0").select("id", F.col("rank").alias("n"))


def placement_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(shard, node, change) between two assignments."""
    return new.exceptAll(old).withColumn("change", F.lit("added")).unionByName(old.exceptAll(new).withColumn("change", F.lit("removed")))


def commit_index(progress: DataFrame) -> DataFrame:
    """``progress(shard, node, matched)``: the largest index that a majority holds."""
    return progress.groupBy("shard").agg(F.element_at(F.sort_array(F.collect_list("matched"), asc=False), F.floor(F.count("*") / 2).cast("int") + 1).alias("commit"))


def shards_per_leader(leaders: DataFrame) -> DataFrame:
    """``leaders(shard, leader)``: how many shards each node leads; shards without a leader are a group of their own."""
    return leaders.groupBy("leader").agg(F.count("*").alias("shards"))


def failure_detection(gossip: DataFrame) -> DataFrame:
    """Suspicions, failures, false alarms, mean time from suspicion to failure, failures per 100 suspicions (100 without any).

    A false alarm is a node that is alive after a suspicion that no failure has followed.
    """
    of = lambda s: F.when(F.col("state") == s, F.struct("seq", "ms"))
    seen = ordering.with_last(gossip.select("id", "seq", "state", "ms"), ["id"], ["seq"], of("suspect"), "s", most=True)
    seen = ordering.with_last(seen, ["id"], ["seq"], of("failed"), "f", most=True)
    is_ = lambda s: F.col("state") == s
    alarm = is_("alive") & F.col("s").isNotNull() & (F.col("f").isNull() | (F.col("f.seq") < F.col("s.seq")))
    found = seen.agg(
        F.count_if(is_("suspect")).alias("suspects"), F.count_if(is_("failed")).alias("confirms"), F.count_if(alarm).alias("false_alarms"), F.coalesce(F.avg(F.when(is_("failed"), F.col("ms") - F.col("s.ms"))), F.lit(0.0)).alias("mean_ms")
    )
    return found.withColumn("accuracy", F.when(F.col("suspects") > 0, F.col("confirms") / F.col("suspects") * 100).otherwise(100.0))


def snapshots(events: DataFrame) -> DataFrame:
    """``events(shard, seq, ms, kind)``, kind ``start``, ``done`` or ``cutover``: what each shard's snapshot is at.

    A cutover forgets what came before it, and a start forgets an earlier completion.
    """
    last = lambda k: F.max(F.when(F.col("kind") == k, F.struct("seq", "ms")))
    found = events.groupBy("shard").agg(last("start").alias("s"), last("cutover").alias("c"), F.max_by(F.struct("kind", "ms"), "seq").alias("l"))
    status = F.when(F.col("l.kind") == "start", "in_progress").when(F.col("l.kind") == "done", "completed").otherwise("idle")
    started = F.when(F.col("c").isNull() | (F.col("s.seq") > F.col("c.seq")), F.col("s.ms"))
    return found.select("shard", status.alias("status"), started.alias("started_ms"), F.when(F.col("l.kind") == "done", F.col("l.ms")).alias("completed_ms"))


def shard_roll_up(shards: DataFrame) -> DataFrame:
    """``shards(node, shard, leader)``: by node the numbers of active, led and followed shards, with the first ten led or not."""
    led = F.col("leader") == F.col("node")
    counts = shards.groupBy("node").agg(F.count("*").alias("active"), F.count_if(led).alias("leaders"), F.count_if(~led).alias("followers"))
    nth = F.row_number().over(Window.partitionBy("node").orderBy("shard"))
    few = shards.select("node", "shard").distinct().withColumn("_nth", nth).where("_nth <= 10")
    sample = few.groupBy("node").agg(F.array_join(F.sort_array(F.collect_list("shard")).cast("array<string>"), ",").alias("sample"))
    return counts.join(sample, "node", "left")


def replica_sets(progress: DataFrame) -> DataFrame:
    """``progress(shard, node)``: the nodes seen to hold each shard, in order."""
    return progress.groupBy("shard").agg(F.array_join(F.sort_array(F.collect_set("node")).cast("array<string>"), ",").alias("replicas"))


def leader_first(replicas: DataFrame) -> DataFrame:
    """``replicas(shard, node, leader)`` with the place of each in its shard: the leader, then by node."""
    order = Window.partitionBy("shard").orderBy(F.desc(F.col("node") == F.col("leader")), "node")
    return replicas.select("shard", "node", F.row_number().over(order).alias("place"))


def last_terms(terms: DataFrame, n: int = 10) -> DataFrame:
    """``terms(shard, term)``: the ``n`` highest terms of each shard."""
    nth = F.row_number().over(Window.partitionBy("shard").orderBy(F.desc("term")))
    return terms.select("shard", "term").distinct().withColumn("_nth", nth).where(F.col("_nth") <= n).drop("_nth")


def stability_counts(shards: DataFrame) -> DataFrame:
    """``shards(stable_ms, recent, stable)``: how many are stable, recently elected, in between for under two minutes, and all."""
    between = ~F.col("stable") & ~F.col("recent") & (F.col("stable_ms") < 120_000)
    return shards.agg(F.count_if("stable").alias("stable"), F.count_if("recent").alias("recent"), F.count_if(between).alias("warning"), F.count("*").alias("total"))


def lease_valid(expiry_ms: Column, now_ms: int) -> Column:
    """Whether a read may rely on a lease: there is one, and it hasn't expired."""
    return F.coalesce(expiry_ms > now_ms, F.lit(False))


def log_up_to_date(term: Column, idx: Column, own_term: Column, own_idx: Column) -> Column:
    """Whether a candidate's log may win a vote: a later last term, or as long a log in the same."""
    return (term > own_term) | ((term == own_term) & (idx >= own_idx))


def expired_suspicions(gossip: DataFrame, now_ms: int, timeout_ms: int) -> DataFrame:
    """(id, suspected_ms) of nodes that have been suspected since ``timeout_ms`` or longer, and nothing else since."""
    other = gossip.groupBy("id").agg(F.max(F.when(F.col("state") != "suspect", F.col("seq"))).alias("_other"))
    since = gossip.where("state = 'suspect'").join(other, "id").where("_other is null or seq > _other").groupBy("id").agg(F.min("ms").alias("suspected_ms"))
    return since.where(now_ms - F.col("suspected_ms") >= timeout_ms)


def route(keys: DataFrame, view: DataFrame) -> DataFrame:
    """``keys(key, shard)`` with leader and replicas from ``view(shard, node, leader)``; null for a shard the view doesn't know."""
    known = view.groupBy("shard").agg(F.max("leader").alias("leader"), F.array_join(F.sort_array(F.collect_set("node")).cast("array<string>"), ",").alias("replicas"))
    return keys.join(known, "shard", "left")
