"""Versioned key-value operators over a mutation log (key, value, tombstone, ttl_ms, term, idx, ms).

Versions are ranked by partial aggregates (``max_by``), which need no sort and pre-aggregate
before the shuffle. Filters on the key reach the scan; tombstones and expiry are applied
after the newest version is known, the snapshot bound before.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CONSISTENCY = {"strong": "strong", "linearizable": "strong", "lease": "strong", "eventual": "eventual", "stale_ok": "eventual", "bounded_staleness": "bounded_staleness"}
#: Limits of keys and values in bytes.
KEY_LIMIT, VALUE_LIMIT = 1024, 1 << 20
MUTATION = "key string, value double, tombstone boolean, ttl_ms long, term long, idx long, ms long"


def newest(mutations: DataFrame) -> DataFrame:
    """The newest version of each key, tombstones and expired ones included."""
    rest = [c for c in mutations.columns if c != "key"]
    return mutations.groupBy("key").agg(F.max_by(F.struct(*rest), F.struct("term", "idx")).alias("v")).select("key", "v.*")


def alive(as_of_ms: int) -> Column:
    """Neither deleted nor expired at ``as_of_ms``: an entry is gone from the moment it expires."""
    return ~F.col("tombstone") & (F.col("ttl_ms").isNull() | (F.col("ms") + F.col("ttl_ms") > as_of_ms))


def state(mutations: DataFrame, as_of_ms: int, snapshot: tuple[int, int] | None = None, consistency: str = "strong") -> DataFrame:
    """The visible entries: newest version up to ``snapshot``, if it is alive. Older versions never show through."""
    if consistency not in CONSISTENCY:
        raise ValueError(f"unknown consistency {consistency!r}")
    if snapshot is not None:
        mutations = mutations.where(F.struct("term", "idx") <= F.struct(F.lit(snapshot[0]).cast("long").alias("term"), F.lit(snapshot[1]).cast("long").alias("idx")))
    return newest(mutations).where(alive(as_of_ms))


def get(mutations: DataFrame, key: str, as_of_ms: int) -> DataFrame:
    return state(mutations.where(F.col("key") == key), as_of_ms)


def multi_get(mutations: DataFrame, keys: Sequence[str], as_of_ms: int) -> DataFrame:
    return state(mutations.where(F.col("key").isin(list(keys))), as_of_ms)


def scan(mutations: DataFrame, start: str | None, end: str | None, as_of_ms: int) -> DataFrame:
    """Visible entries with start <= key < end, in key order."""
    return state(mutations.where(between(start, end)), as_of_ms).orderBy("key")


def seek(mutations: DataFrame, key: str, n: int, as_of_ms: int) -> DataFrame:
    """The first ``n`` visible entries at or behind ``key``."""
    return scan(mutations, key, None, as_of_ms).limit(n)


def write_batch(mutations: DataFrame, operations: DataFrame, base: int, ms: int) -> DataFrame:
    """The log with ``operations(seq, key, value, tombstone, ttl_ms)`` behind version ``base``: consecutive versions in seq order.

    A batch is a commit, so small by nature: its numbering is one ordered window.
    """
    number = F.row_number().over(Window.orderBy("seq")).cast("long") + base
    new = operations.select("key", "value", "tombstone", "ttl_ms", F.lit(0).cast("long").alias("term"), number.alias("idx"), F.lit(ms).cast("long").alias("ms"))
    return mutations.unionByName(new)


def compare_and_set(mutations: DataFrame, requests: DataFrame, as_of_ms: int) -> DataFrame:
    """(key, outcome) of ``requests(key, expected_idx, value)``: ``written``, ``not_found`` or ``conflict``.

    Requests on one key are judged in order of ``expected_idx``, and the first that matches wins.
    """
    current = state(mutations, as_of_ms).select("key", F.col("idx").alias("current"))
    judged = requests.join(current, "key", "left")
    outcome = F.when(F.col("current").isNull(), "not_found").when(F.col("current") == F.col("expected_idx"), "written").otherwise("conflict")
    judged = judged.withColumn("outcome", outcome)
    nth = F.row_number().over(Window.partitionBy("key", "outcome").orderBy("expected_idx", "value"))
    return judged.withColumn("outcome", F.when((F.col("outcome") == "written") & (nth > 1), "conflict").otherwise(F.col("outcome"))).select("key", "expected_idx", "value", "outcome")


def first_per_idempotency_key(requests: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """The first request of each idempotency key: later ones get its result."""
    rest = [c for c in requests.columns if c not in key]
    return requests.groupBy(*key).agg(F.min_by(F.struct(*rest), order).alias("v")).select(*key, "v.*")


def rejected(entries: DataFrame, key: str, value: str) -> DataFrame:
    """Entries beyond the size limits, with the reason."""
    reason = F.when(F.octet_length(key) == 0, "empty key").when(F.octet_length(key) > KEY_LIMIT, "key too long").when(F.octet_length(value) > VALUE_LIMIT, "value too long")
    return entries.withColumn("reason", reason).where("reason is not null")


def recover(log: DataFrame) -> DataFrame:
    """``log(segment, pos, ok, ...)`` up to the first record of each segment whose checksum fails."""
    bad = log.groupBy("segment").agg(F.min(F.when(~F.col("ok"), F.col("pos"))).alias("_bad"))
    return log.join(bad, "segment").where(F.col("_bad").isNull() | (F.col("pos") < F.col("_bad"))).drop("_bad")


def between(start: str | None, end: str | None) -> Column:
    """start <= key < end; no bound: open."""
    found = F.lit(True)
    if start is not None:
        found = found & (F.col("key") >= start)
    if end is not None:
        found = found & (F.col("key") < end)
    return found


def put(spark: SparkSession, key: str, value: float, idx: int, ms: int, ttl_ms: int | None = None) -> DataFrame:
    """One version of ``key``, to be united with a log."""
    return spark.createDataFrame([(key, value, False, ttl_ms, 0, idx, ms)], MUTATION)


def delete(spark: SparkSession, key: str, idx: int, ms: int) -> DataFrame:
    """A tombstone for ``key``, whether or not it is there."""
    return spark.createDataFrame([(key, None, True, None, 0, idx, ms)], MUTATION)


def hidden(mutations: DataFrame, as_of_ms: int) -> DataFrame:
    """Keys whose newest version doesn't show, with the reason: ``deleted`` or ``expired``."""
    reason = F.when(F.col("tombstone"), "deleted").otherwise("expired")
    return newest(mutations).where(~alive(as_of_ms)).withColumn("reason", reason)


def apply_compare_and_set(mutations: DataFrame, requests: DataFrame, base: int, ms: int) -> DataFrame:
    """The log with the requests that ``compare_and_set`` lets through, behind version ``base``.

    Versions are consecutive in key order, so a later write behind them is newer than all. The
    requests are a commit, so small by nature: their numbering is one ordered window.
    """
    won = compare_and_set(mutations, requests, ms).where("outcome = 'written'")
    number = F.row_number().over(Window.orderBy("key")).cast("long") + base
    new = won.select("key", "value", F.lit(False).alias("tombstone"), F.lit(None).cast("long").alias("ttl_ms"), F.lit(0).cast("long").alias("term"), number.alias("idx"), F.lit(ms).cast("long").alias("ms"))
    return mutations.unionByName(new)


def source_priority(level: Column, position: Column) -> Column:
    """Order of sources that hold the same version: memory (level null), then level 0, then deeper ones."""
    return F.when(level.isNull(), 0).when(level == 0, 1000 + position).otherwise(10000 + level * 100 + position)


def flush_due(size_bytes: Column, age_ms: Column) -> Column:
    """Whether what is in memory is to be written: 64 MiB or 30 seconds."""
    return (size_bytes >= 64 << 20) | (age_ms >= 30_000)


def read_from(log: DataFrame, segment: int, pos: int) -> DataFrame:
    """Records of ``log(segment, pos, ...)`` at or behind a position."""
    return log.where((F.col("segment") > segment) | ((F.col("segment") == segment) & (F.col("pos") >= pos)))


def apply_log(commands: DataFrame) -> DataFrame:
    """(space, key, seq) left by ``commands(seq, kind, space, key)``, ``put`` and ``delete`` of keys; the last command on a key decides."""
    last = commands.where(F.col("kind").isin("put", "delete")).groupBy("space", "key").agg(F.max_by("kind", "seq").alias("_kind"), F.max("seq").alias("seq"))
    return last.where("_kind = 'put'").select("space", "key", "seq")
