"""Nearest neighbours over (vec_id, embedding, label)."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.functions.vectors import distance, is_valid

#: Queries that are sent to all executors at once; more are taken in several passes.
QUERIES = 2000
#: Pairs of a query and a vector that are compared by differences at once.
PAIRS = 1 << 16
#: Limits of names in bytes, and of dimensions.
NAMESPACE_LIMIT, ID_LIMIT, DIMENSION_LIMIT = 256, 512, 4096
FOUND = "query_id long, vec_id long, distance double"


def nearest(vectors: DataFrame, query: list[float], k: int, kind: str = "l2") -> DataFrame:
    """The ``k`` nearest vectors, ties by id: one scan, k rows from each task."""
    q = F.array(*(F.lit(float(x)) for x in query))
    found = vectors.where(is_valid(F.col("embedding"), len(query))).select("vec_id", distance(kind, F.col("embedding"), q).alias("distance"))
    return found.orderBy("distance", "vec_id").limit(k)


def _matrix(column: list) -> np.ndarray:
    return np.array(column, dtype=np.float64)


def distances(kind: str, queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """(queries, vectors) by one matrix product; of a single query by differences, which cancel nothing."""
    if kind == "l2" and len(queries) == 1:
        return np.sqrt(((vectors - queries) ** 2).sum(1))[None]
    dots = queries @ vectors.T
    if kind == "inner_product":
        return -dots
    norms = (queries**2).sum(1)[:, None], (vectors**2).sum(1)[None, :]
    if kind == "l2":
        return np.sqrt(np.maximum(norms[0] + norms[1] - 2 * dots, 0))
    product = np.sqrt(norms[0] * norms[1])
    return np.where(product < 1.1920929e-7, 1.0, 1 - np.clip(dots / np.maximum(product, 1e-300), -1, 1))


def nearest_distances(kind: str, queries: np.ndarray, vectors: np.ndarray, k: int) -> np.ndarray:
    """``distances``, infinite where a vector can't be among the ``k`` nearest of a query.

    A product of matrices loses the distance of vectors that are close for their length. It
    tells by a bound on its error which vectors may be among the nearest; these are compared by differences.
    """
    if kind != "l2" or not len(vectors):
        return distances(kind, queries, vectors)
    norms = (queries**2).sum(1)[:, None] + (vectors**2).sum(1)[None, :]
    squares = norms - 2 * (queries @ vectors.T)
    error = 4 * (queries.shape[1] + 4) * np.finfo(np.float64).eps * norms
    near = np.ones(squares.shape, bool)
    if k < len(vectors):
        near = squares - error <= np.partition(squares + error, k - 1, axis=1)[:, k - 1 : k]
    out = np.full(squares.shape, np.inf)
    q, v = np.nonzero(near)
    for at in range(0, len(q), PAIRS):
        a, b = q[at : at + PAIRS], v[at : at + PAIRS]
        out[a, b] = np.sqrt(((queries[a] - vectors[b]) ** 2).sum(1))
    return out


def nearest_of_many(vectors: DataFrame, queries: DataFrame, k: int, kind: str = "l2", passes: int | None = None) -> DataFrame:
    """(query_id, vec_id, distance, rank): exact nearest of ``queries(query_id, vector)``.

    A task keeps k for each query, in blocks; the shuffle has tasks * queries * k rows.
    """
    spark = vectors.sparkSession
    n = passes or max(1, -(-queries.count() // QUERIES))
    out = None
    for number in range(n):
        some = queries if n == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == number)
        rows = sorted((r["query_id"], r["vector"]) for r in some.collect())
        if not rows:
            continue
        sent = spark.sparkContext.broadcast((np.array([r[0] for r in rows]), _matrix([r[1] for r in rows])))

        def search(batches: Iterable[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, matrix = sent.value
            best_d, best_v = np.full((len(ids), 0), np.inf), np.zeros((len(ids), 0), np.int64)
            for batch in batches:
                own = [(v, e) for v, e in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if e is not None and len(e) == matrix.shape[1] and None not in e]
                if not own:
                    continue
                x, v = _matrix([e for _, e in own]), np.array([i for i, _ in own])
                good = np.isfinite(x).all(1)
                d = np.concatenate([best_d, nearest_distances(kind, matrix, x[good], k)], 1)
                v = np.concatenate([best_v, np.broadcast_to(v[good], (len(ids), good.sum()))], 1)
                order = np.lexsort((v, d))[:, : min(k, np.isfinite(d).sum(1).min(initial=k))]
                best_d, best_v = np.take_along_axis(d, order, 1), np.take_along_axis(v, order, 1)
            q = np.repeat(ids, best_d.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(best_v.ravel()), pa.array(best_d.ravel())], ["query_id", "vec_id", "distance"])

        found = vectors.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(search, FOUND)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], FOUND + ", rank int")
    return top_k(out, k)


def top_k(found: DataFrame, k: int) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "vec_id"))
    return found.withColumn("rank", nth).where(F.col("rank") <= k)


def merge_tiers(tiers: list[DataFrame], k: int) -> DataFrame:
    """(vec_id, distance): the ``k`` closest over several result lists, of each id its closest match."""
    both = tiers[0]
    for t in tiers[1:]:
        both = both.unionByName(t)
    return both.groupBy("vec_id").agg(F.min("distance").alias("distance")).orderBy("distance", "vec_id").limit(k)


def nearest_by_tier(vectors: DataFrame, query: list[float], k: int, by: str, kind: str = "l2") -> DataFrame:
    """(by, vec_id, distance): the ``k`` nearest within each value of ``by``, null too; one scan, in which each task keeps k of each."""
    q = F.array(*(F.lit(float(x)) for x in query))
    found = vectors.where(is_valid(F.col("embedding"), len(query))).select(by, "vec_id", distance(kind, F.col("embedding"), q).alias("distance"))
    nth = F.row_number().over(Window.partitionBy(by).orderBy("distance", "vec_id"))
    return found.withColumn("_nth", nth).where(F.col("_nth") <= k).drop("_nth")


def newest_vectors(log: DataFrame) -> DataFrame:
    """``log(vec_id, embedding, deleted, seq)``: the newest version of each id, deleted ones gone."""
    return log.groupBy("vec_id").agg(F.max_by(F.struct("embedding", "deleted"), "seq").alias("v")).where("not v.deleted").select("vec_id", "v.embedding")


def namespaces(vectors: DataFrame, by: str = "label") -> DataFrame:
    """Vectors and dimensions of each namespace."""
    return vectors.groupBy(by).agg(F.count("*").alias("vectors"), F.max(F.size("embedding")).alias("dimensions"))


def apply_commands(commands: DataFrame) -> DataFrame:
    """(namespace, id, seq) left by ``commands(seq, kind, namespace, id)`` of kinds create, drop, insert and delete.

    A create of a namespace that exists, and any command on one that doesn't, has no effect. A drop
    takes all vectors with it. An open namespace is one whose last create or drop was a create, so
    windows within namespaces replace the fold.
    """
    past = Window.partitionBy("namespace").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    c = commands.withColumn("_open", F.max_by(F.col("kind") == "create", F.when(F.col("kind").isin("create", "drop"), F.col("seq"))).over(past))
    dropped = commands.where("kind = 'drop'").groupBy("namespace").agg(F.max("seq").alias("_dropped"))
    last = c.where("_open and kind in ('insert', 'delete')").groupBy("namespace", "id").agg(F.max("seq").alias("seq"), F.max_by("kind", "seq").alias("_kind"))
    left = last.join(dropped, "namespace", "left").where("_kind = 'insert' and (_dropped is null or seq > _dropped)")
    return left.select("namespace", "id", "seq")


def found_for_deletion(vectors: DataFrame, ids: DataFrame) -> DataFrame:
    """(vec_id, found) of ``ids(vec_id)``: whether a deletion finds its vector."""
    here = vectors.select("vec_id").distinct().withColumn("_here", F.lit(True))
    return ids.join(here, "vec_id", "left").select("vec_id", F.col("_here").isNotNull().alias("found"))


def shrink_degree(edges: DataFrame, most: int) -> DataFrame:
    """Of ``edges(node, neighbour, distance)`` the nearest ``most`` of each node, ties by neighbour."""
    nth = F.row_number().over(Window.partitionBy("node").orderBy("distance", "neighbour"))
    return edges.withColumn("_nth", nth).where(F.col("_nth") <= most).drop("_nth")


def command_outcomes(commands: DataFrame) -> DataFrame:
    """(seq, kind, namespace, outcome) of ``commands(seq, kind, namespace)``: ``exists`` for a create of an open namespace, ``missing`` for others on a closed one, else ``ok``."""
    past = Window.partitionBy("namespace").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    opened = F.coalesce(F.max_by(F.col("kind") == "create", F.when(F.col("kind").isin("create", "drop"), F.col("seq"))).over(past), F.lit(False))
    create = F.col("kind") == "create"
    outcome = F.when(create & opened, "exists").when(~create & ~opened, "missing").otherwise("ok")
    return commands.select("seq", "kind", "namespace", outcome.alias("outcome"))


def rejected(vectors: DataFrame, dims: int | None = None) -> DataFrame:
    """``vectors(namespace, id, embedding)`` beyond the limits, with the reason."""
    size = F.coalesce(F.size("embedding"), F.lit(0))
    reason = F.when(F.octet_length("namespace") == 0, "empty namespace").when(F.octet_length("namespace") > NAMESPACE_LIMIT, "namespace too long")
    reason = reason.when(F.octet_length("id") == 0, "empty id").when(F.octet_length("id") > ID_LIMIT, "id too long")
    reason = reason.when(size <= 0, "empty vector").when(size > DIMENSION_LIMIT, "too many dimensions")
    reason = reason if dims is None else reason.when(size != dims, "other dimensions")
    return vectors.withColumn("reason", reason).where("reason is not null")


def get(vectors: DataFrame, ids: DataFrame, with_vectors: bool = True) -> DataFrame:
    """``ids(vec_id)`` with whether they are there and, if asked for, their vectors."""
    columns = ["vec_id", "embedding"] if with_vectors else ["vec_id"]
    here = vectors.select(*columns).withColumn("found", F.lit(True))
    return ids.join(here, "vec_id", "left").withColumn("found", F.coalesce("found", F.lit(False)))
