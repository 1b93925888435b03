"""Approximate neighbours: product quantisation with exact re-ranking, and layered proximity graphs by partition."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.functions.vectors import is_valid
from ledgerlake.operators.vector import FOUND, QUERIES, distances, top_k

#: Vectors that codebooks are trained on.
SAMPLE = 10_000
#: Queries that a task compares with a batch at once.
BLOCK = 256
#: Queries of one pass over graphs: each pass builds them again, which costs about as much as some thousand searches.
GRAPH_QUERIES = 20_000

Queries = list[tuple[int, list[float]]]


def _valid(batch: pa.RecordBatch, dims: int) -> list[tuple[int, list[float]]]:
    """(vec_id, embedding) of a batch's vectors with an id, ``dims`` components, none of them null or non-finite."""
    rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
    return [(v, e) for v, e in rows if v is not None and e is not None and len(e) == dims and None not in e and np.isfinite(e).all()]


def train_codebooks(vectors: DataFrame, subspaces: int = 16, bits: int = 8, rounds: int = 25) -> np.ndarray:
    """(subspaces, 2^bits, width) centroids by k-means on a bounded sample, first by a hash of the id.

    The dimensions are those of most vectors; others and vectors with null or non-finite
    components teach nothing. Without a vector there are no codebooks.
    """
    whole = vectors.where("embedding is not null and size(embedding) > 0")
    most = whole.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    rows = [] if most is None else whole.where(is_valid(F.col("embedding"), most["d"])).select("vec_id", "embedding").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()
    if not rows:
        return np.zeros((0, 0, 0))
    x = np.array([r["embedding"] for r in rows], dtype=np.float64)
    if x.shape[1] % subspaces:
        raise ValueError(f"{x.shape[1]} dimensions can't be cut into {subspaces} subspaces")
    rng = np.random.default_rng(42)
    books = []
    for part in np.split(x, subspaces, axis=1):
        centers = part[rng.choice(len(part), min(len(part), 1 << bits), replace=False)]
        for _ in range(rounds):
            near = distances("l2", part, centers).argmin(1)
            n = np.bincount(near, minlength=len(centers))
            sums = np.stack([np.bincount(near, part[:, j], len(centers)) for j in range(part.shape[1])], 1)
            centers = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centers)
        books.append(centers)
    return np.array(books)


def encode(vectors: np.ndarray, books: np.ndarray) -> np.ndarray:
    """(n, subspaces) nearest centroids; of equally near ones the first."""
    return np.stack([distances("l2", part, book).argmin(1) for part, book in zip(np.split(vectors, len(books), axis=1), books)], 1).astype(np.uint8)


def distance_tables(query: np.ndarray, books: np.ndarray) -> np.ndarray:
    """(subspaces, centroids) squared distances of a query's parts."""
    return np.stack([((book - part) ** 2).sum(1) for part, book in zip(np.split(query, len(books)), books)])


def search_quantised(vectors: DataFrame, queries: list[tuple[int, list[float]]], books: np.ndarray, k: int, kind: str = "l2", widen: int = 10) -> DataFrame:
    """(query_id, vec_id, distance, rank): each task takes the k * widen nearest by code, compares them exactly, and keeps k."""
    queries = [(i, q) for i, q in queries if len(q) == books.shape[0] * books.shape[2]]
    sent = vectors.sparkSession.sparkContext.broadcast((books, [i for i, _ in queries], np.array([q for _, q in queries], dtype=np.float64)))

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, asked, matrix = sent.value
        tables = np.stack([distance_tables(q, books) for q in matrix]) if asked else np.zeros((0, 0, 0))
        best_d, best_v = np.full((len(asked), 0), np.inf), np.zeros((len(asked), 0), np.int64)
        for batch in batches:
            rows = _valid(batch, matrix.shape[1]) if asked else []
            if not rows:
                continue
            ids, x = np.array([v for v, _ in rows]), np.array([e for _, e in rows], dtype=np.float64)
            codes = encode(x, books)
            new_d, new_v = [], []
            for at in range(0, len(asked), BLOCK):
                near = sum(tables[at : at + BLOCK, s][:, codes[:, s]] for s in range(len(books)))
                some = np.argpartition(near, min(k * widen, near.shape[1]) - 1, axis=1)[:, : k * widen]
                exact = np.concatenate([distances(kind, q[None], x[s]) for q, s in zip(matrix[at : at + BLOCK], some)])
                d, v = np.concatenate([best_d[at : at + BLOCK], exact], 1), np.concatenate([best_v[at : at + BLOCK], ids[some]], 1)
                order = np.lexsort((v, d))[:, :k]
                new_d.append(np.take_along_axis(d, order, 1))
                new_v.append(np.take_along_axis(v, order, 1))
            best_d, best_v = np.concatenate(new_d), np.concatenate(new_v)
        q = np.repeat(np.array(asked, dtype=np.int64), best_d.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(best_v.ravel()), pa.array(best_d.ravel())], ["query_id", "vec_id", "distance"])

    return top_k(vectors.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(search, FOUND), k)


class Graph:
    """A layered proximity graph over a few thousand vectors.

    Layers are drawn by position with a fixed seed, so the same vectors in the same order give the
    same graph. Fixed values: the default degrees 16 and 32, and beams of 200 and 100.
    """

    def __init__(self, dims: int, m: int = 16, m0: int = 32, build: int = 200, kind: str = "l2"):
        self.m, self.m0, self.build, self.kind = m, m0, build, kind
        self.x, self.ids = np.zeros((0, dims)), []
        self.links: list[dict[int, list[int]]] = []
        self.entry = -1

    def _to(self, q: np.ndarray, nodes: list[int]) -> np.ndarray:
        return distances(self.kind, q[None], self.x[nodes])[0]

    def _near(self, q: np.ndarray, entry: list[int], ef: int, layer: int) -> list[tuple[float, int]]:
        seen = set(entry)
        found = [(d, n) for d, n in zip(self._to(q, entry).tolist(), entry)]
        open_, best = list(found), [(-d, n) for d, n in found]
        heapq.heapify(open_)
        heapq.heapify(best)
        while open_:
            d, node = heapq.heappop(open_)
            if d > -best[0][0] and len(best) >= ef:
                break
            new = [n for n in self.links[layer].get(node, ()) if n not in seen]
            seen.update(new)
            for e, n in zip(self._to(q, new).tolist() if new else (), new):
                if len(best) < ef or e < -best[0][0]:
                    heapq.heappush(open_, (e, n))
                    heapq.heappush(best, (-e, n))
                    if len(best) > ef:
                        heapq.heappop(best)
        return sorted((-d, n) for d, n in best)

    def add_all(self, ids: list[int], x: np.ndarray) -> None:
        first = len(self.ids)
        self.x, self.ids = np.concatenate([self.x, x]), self.ids + list(ids)
        draw = np.random.default_rng(42).random(len(ids)).clip(1e-4)
        for node, u in enumerate(draw, first):
            self._insert(node, min(15, int(-np.log(u) / np.log(self.m))))

    def _insert(self, node: int, top: int) -> None:
        q, at = self.x[node], [self.entry]
        height = len(self.links)
        for layer in range(height - 1, top, -1):
            at = [self._near(q, at, 1, layer)[0][1]]
        for layer in range(min(top, height - 1), -1, -1):
            found = self._near(q, at, self.build, layer)
            most = self.m0 if layer == 0 else self.m
            for _, n in found[: self.m]:
                own = self.links[layer].setdefault(n, [])
                own.append(node)
                if len(own) > most:
                    self.links[layer][n] = [own[i] for i in np.argsort(self._to(self.x[n], own), kind="stable")[:most]]
            self.links[layer][node] = [n for _, n in found[: self.m]]
            at = [n for _, n in found]
        while len(self.links) <= top:
            self.links.append({node: []})
            self.entry = node

    def search(self, q: np.ndarray, k: int, ef: int = 100) -> list[tuple[float, int]]:
        if not self.ids or not k:
            return []
        at = [self.entry]
        for layer in range(len(self.links) - 1, 0, -1):
            at = [self._near(q, at, 1, layer)[0][1]]
        return [(d, self.ids[n]) for d, n in self._near(q, at, max(ef, k), 0)[:k]]


def search_graphs(vectors: DataFrame, queries: list[tuple[int, list[float]]], k: int, kind: str = "l2", size: int = 5000) -> DataFrame:
    """(query_id, vec_id, distance, rank): a graph for each ``size`` vectors of a task, results merged."""
    queries = [(i, q) for i, q in queries if len(q) == len(queries[0][1])]
    sent = vectors.sparkSession.sparkContext.broadcast([(i, np.array(q, dtype=np.float64)) for i, q in queries])

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = sorted(_valid(batch, len(sent.value[0][1]))) if sent.value else []
            for at in range(0, len(rows), size):
                part = rows[at : at + size]
                graph = Graph(len(part[0][1]), kind=kind)
                graph.add_all([v for v, _ in part], np.array([e for _, e in part], dtype=np.float64))
                found = [(i, v, d) for i, q in sent.value for d, v in graph.search(q, k)]
                columns = list(zip(*found)) or [()] * 3
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()))], ["query_id", "vec_id", "distance"])

    return top_k(vectors.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(search, FOUND), k)


def in_passes(queries: DataFrame, search: Callable[[Queries], DataFrame], most: int = QUERIES) -> DataFrame:
    """``search`` of all ``queries(query_id, vector)``, ``most`` or so at once; null vectors find nothing."""
    queries = queries.where("vector is not null")
    n = max(1, -(-queries.count() // most))
    out = None
    for number in range(n):
        some = queries if n == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == number)
        rows = sorted((r["query_id"], list(r["vector"])) for r in some.collect())
        if rows:
            found = search(rows)
            out = found if out is None else out.unionByName(found)
    return queries.sparkSession.createDataFrame([], FOUND + ", rank int") if out is None else out
