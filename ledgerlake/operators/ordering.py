"""Ordered computations in which no task needs all rows of a key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ledgerlake.sources.storage import written

#: A key's rows are ordered in one task up to so many; if any key has more, all are cut into ranges.
LARGE = 1_000_000
_EARLIER = (Window.unboundedPreceding, -1)


def carried(df: DataFrame, key: list[str], order: list[str], of_part: list[Column], ahead: Callable[[WindowSpec], list[Column]]) -> tuple[DataFrame, WindowSpec]:
    """Rows in range partitions, each key's rows in a partition behind a head row (``_head``), and the window over them.

    ``of_part`` aggregates a key's rows in a partition; ``ahead`` makes of these, in a window over the
    key's partitions in order, what the head carries into its partition. So a key's rows are ordered by
    many tasks, and one row for each key and partition is all that meets elsewhere. The partitions are
    written: their bounds come from a sample, and both uses must see the same ones.
    """
    ranged = df.repartitionByRange(*(F.asc(c) for c in (*key, *order)))
    parts = written(ranged.withColumn("_part", F.spark_partition_id()))
    heads = parts.groupBy("_part", *key).agg(*of_part)
    heads = heads.select("_part", *key, *ahead(Window.partitionBy(*key).orderBy("_part")), F.lit(0).alias("_head"))
    both = parts.withColumn("_head", F.lit(1)).unionByName(heads, allowMissingColumns=True)
    return both, Window.partitionBy("_part", *key).orderBy("_head", *order)


def _fits(df: DataFrame, key: list[str], large: int) -> bool:
    """Whether no key has more than ``large`` rows; reads the key's columns only."""
    most = df.groupBy(*key).agg(F.count("*").alias("_n")).agg(F.max("_n")).first()[0]
    return (most or 0) <= large


def ranked(df: DataFrame, key: list[str], order: list[str], weight: str | None = None, large: int | None = None) -> DataFrame:
    """``df`` with ``rank``, the rows of its key up to and including it, and ``of``, all of its key.

    ``weight``: a column of how many rows a row stands for. ``order`` must tell a key's rows apart.
    """
    one = F.col(weight) if weight else F.lit(1).cast("long")
    rows = df.withColumn("_one", one)
    if _fits(df, key, LARGE if large is None else large):
        w = Window.partitionBy(*key)
        upto = w.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return rows.withColumns({"rank": F.sum("_one").over(upto), "of": F.sum("_one").over(w)}).drop("_one")

    def ahead(w: WindowSpec) -> list[Column]:
        every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        return [F.coalesce(F.sum("_n").over(w.rowsBetween(*_EARLIER)), F.lit(0)).alias("_one"), F.sum("_n").over(every).alias("_of")]

    both, w = carried(rows, key, order, [F.sum("_one").alias("_n")], ahead)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumns({"rank": F.sum("_one").over(upto), "of": F.first("_of").over(upto)})
    return found.where("_head = 1").drop("_one", "_of", "_part", "_head")


def with_last(df: DataFrame, key: list[str], order: list[str], value: Column, name: str, own: bool = False, most: bool = False, large: int | None = None) -> DataFrame:
    """``df`` with the last (``most``: the largest) non-null ``value`` of the rows of its key before each; null without one.

    ``own``: a row's own value counts too.
    """
    rows = df.withColumn("_v", value)
    pick = F.max if most else (lambda c: F.last(c, ignorenulls=True))
    until = Window.currentRow if own else -1
    if _fits(df, key, LARGE if large is None else large):
        w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, until)
        return rows.withColumn(name, pick("_v").over(w)).drop("_v")
    of_part = F.max("_v") if most else F.max_by("_v", F.when(F.col("_v").isNotNull(), F.struct(*order)))
    both, w = carried(rows, key, order, [of_part.alias("_m")], lambda w: [pick("_m").over(w.rowsBetween(*_EARLIER)).alias("_v")])
    found = both.withColumn(name, pick("_v").over(w.rowsBetween(Window.unboundedPreceding, until)))
    return found.where("_head = 1").drop("_v", "_part", "_head")


def with_rank(df: DataFrame, order: str) -> DataFrame:
    """``df`` with ``rank`` from 1 in the order of a unique column, over the whole table."""
    return ranked(df, [], [order], large=0).drop("of")
