"""What the operators of this folder share: cut lineage, checked joins, components."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table is sent to all executors only if it has at most so many (short) rows.
BROADCAST_ROWS = 50_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only where none is set and all runs on this machine."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="ledgerlake-"))
        named = sc.getCheckpointDir()
    return named.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: a lost executor loses nothing.

    Parquet rather than ``checkpoint()``: compressed, prunable, and of known size, so
    that Spark picks joins by what is really there. Files go when the session ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tables-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Has Spark delete the shuffle files of plans that nothing refers to any more.

    Spark does so when the driver collects its garbage, which a driver with little to do seldom does.
    """
    gc.collect()
    spark._jvm.System.gc()


def tidy() -> None:
    """Gives memory back to the system: Spark's Python workers live on, and other stages use them."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def kernel(run):
    """A function over Arrow batches that tidies up behind itself."""

    @wraps(run)
    def tidied(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            tidy()

    return tidied


def join_checked(df: DataFrame, small: DataFrame, on, how: str = "left", most: int = BROADCAST_ROWS) -> DataFrame:
    """Join with a table (already cut) that is broadcast only if its counted rows allow it."""
    if small.limit(most + 1).count() <= most:
        small = F.broadcast(small)
    return df.join(small, on, how)


def empty_like(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def rows_of(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def bytes_of(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """A string column as UTF-8 bytes, without decoding."""
    return batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()


def key_runs(batches: Iterable[pa.RecordBatch], key: list[str]) -> Iterator[pa.Table]:
    """Whole runs of equal keys from batches sorted by key; each table holds many whole runs."""
    rest: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = pa.Table.from_batches([batch])
        now = now if rest is None else pa.concat_tables([rest, now]).combine_chunks()
        same = np.ones(now.num_rows, dtype=bool)
        for k in key:
            column, last = now.column(k), now.column(k)[now.num_rows - 1]
            equal = pc.equal(column, last).fill_null(False) if last.is_valid else column.is_null()
            same &= equal.to_numpy(zero_copy_only=False)
        away = np.flatnonzero(~same)
        start = int(away[-1]) + 1 if len(away) else 0
        if start:
            yield now.slice(0, start)
        rest = now.slice(start)
    if rest is not None and rest.num_rows:
        yield rest


def run_starts(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin, and the end."""
    n = len(keys[0])
    new = np.zeros(n, dtype=bool)
    if n:
        new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.append(np.flatnonzero(new), n)


def spanning_forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) links that connect what the links u-v connect, at most one for each node."""
    ids, where = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = where[: len(u)], where[len(u) :]
    p = np.arange(len(ids))
    while len(a):
        low, high = np.minimum(p[a], p[b]), np.maximum(p[a], p[b])
        live = low != high
        a, b = a[live], b[live]
        np.minimum.at(p, high[live], low[live])
        while not np.array_equal(q := p[p], p):
            p = q
    moved = p != np.arange(len(ids))
    return ids[moved], ids[p[moved]]


def connected_components(links: DataFrame) -> DataFrame:
    """(node long, component long) of every node in ``links(u, v)``; component: its smallest node.

    Contraction: each node points to the neighbour that comes first in a fresh pseudo-random
    order, links are carried over to what they point to, until none is left. An order by hash
    shrinks chains as fast as stars. Every level is written to the shared folder, keys with
    very many links meet only partial aggregates and joins that Spark can split, and nothing
    is collected. Nulls and links of a node to itself are ignored; no links: no rows.
    """
    rest = cut(links.where("u is not null and v is not null and u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    at: DataFrame | None = None
    level = 0
    while not rest.isEmpty():
        both = rest.select(F.col("u").alias("n"), F.col("v").alias("m")).unionAll(rest.select(F.col("v"), F.col("u")))
        order = lambda c: F.struct(F.xxhash64(F.lit(level), F.col(c)).alias("h"), F.col(c).alias("id"))  # noqa: B023, E731
        to = cut(both.groupBy("n").agg(F.min(order("m")).alias("best")).select("n", F.least(order("n"), F.col("best"))["id"].alias("p")))
        left, right = to.select(F.col("n").alias("u"), F.col("p").alias("pu")), to.select(F.col("n").alias("v"), F.col("p").alias("pv"))
        rest = cut(rest.join(left, "u").join(right, "v").where("pu <> pv").select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct())
        if at is None:
            at = to.select(F.col("n").alias("node"), F.col("p").alias("root"))
        else:
            at = at.join(to.select(F.col("n").alias("root"), "p"), "root", "left").select("node", F.coalesce("p", "root").alias("root"))
        level += 1
    if at is None:
        return empty_like(links.sparkSession, "node long, component long")
    at = cut(at)
    least = cut(at.groupBy("root").agg(F.min("node").alias("component")))
    return at.join(least, "root").select("node", "component")
