"""Near-duplicate embeddings by E8 lattice hashing.

Each of ``TABLES`` tables projects a vector on two random orthonormal sets of eight
directions, decodes both projections (scaled by ``SCALE``) to nearby points of the lattice
E8 (the better of D8 and D8 shifted by a half, with the next best parity-keeping
roundings), and probes the ``PROBES`` nearest combinations of cells. Vectors of one label
that share a cell meet, and their cosine is verified in double precision. With these
values a pair at cosine 0.93 meets with probability 0.98, at 0.98 almost surely.

Equal vectors are one class with a count. Cells are counted by their keys alone, and only
for cells with two classes or more does a class's vector travel, with its keys. A bucket returns no pairs: for each class the
number of vectors it is linked to, and a spanning forest. A pair that meets in several
cells is counted in the first only, which each bucket can tell from the vectors alone.
Buckets beyond ``BUCKET`` classes are cut into a grid whose cells are tasks of their own.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.llm import common

COSINE = 0.93
TABLES, PROBES, SCALE = 4, 5, 0.25
BUCKET = 4096
BLOCK = 256
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_NEVER = np.iinfo(np.int64).max

KEYED = "label int, dim int, cid long, n long, vec binary, keys array<long>"
OUT = "u long, v long, n long"


@lru_cache(maxsize=64)
def directions(dim: int, table: int) -> np.ndarray:
    """(dim, 16) orthonormal directions of a table (as far as the dimension allows), scaled."""
    per = max(1, dim // 16)
    rng = np.random.default_rng([dim, table // per])
    basis = np.concatenate([np.linalg.qr(rng.normal(size=(dim, dim)))[0] for _ in range(-(-16 // dim))], axis=1)
    at = 16 * (table % per)
    return basis[:, at : at + 16] * (np.sqrt(dim / 64) / SCALE)


def lattice_points(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The three nearest of six roundings to E8 (doubled, so whole numbers) and their squared distances."""
    found = []
    rows = np.arange(len(x))
    for shift in (0.0, 0.5):
        r = np.rint(x - shift)
        e = x - shift - r
        order = np.argsort(-np.abs(e), axis=1, kind="stable")
        step = np.where(e >= 0, 1, -1)
        odd = (r.sum(1).astype(np.int64) & 1) == 1
        for even_flips, odd_flips in (((), (0,)), ((0, 1), (1,)), ((0, 2), (2,))):
            q = r.copy()
            for flips, mask in ((even_flips, ~odd), (odd_flips, odd)):
                for j in flips:
                    q[rows[mask], order[mask, j]] += step[rows[mask], order[mask, j]]
            found.append(q + shift)
    points = np.stack(found, 1)
    distance = ((x[:, None] - points) ** 2).sum(2)
    best = np.argsort(distance, axis=1, kind="stable")[:, :3]
    return np.rint(np.take_along_axis(points, best[:, :, None], 1) * 2).astype(np.int64), np.take_along_axis(distance, best, 1)


def keys_of(vectors: np.ndarray, table: int) -> np.ndarray:
    """(n, PROBES) cell keys of unit vectors in one table."""
    projected = vectors @ directions(vectors.shape[1], table)
    (a, da), (b, db) = lattice_points(projected[:, :8]), lattice_points(projected[:, 8:])
    total = (da[:, :, None] + db[:, None, :]).reshape(len(vectors), 9)
    chosen = np.argsort(total, axis=1, kind="stable")[:, :PROBES]
    key = np.full((len(vectors), PROBES), table + 1, np.uint64)
    for points, index in ((a, chosen // 3), (b, chosen % 3)):
        cell = np.take_along_axis(points, index[:, :, None], 1).astype(np.uint64)
        for j in range(8):
            key = (key + cell[:, :, j]) * _MULTIPLIER
            key ^= key >> np.uint64(29)
    return key.view(np.int64)


def _units(column: list[bytes], dim: int) -> np.ndarray:
    x = np.frombuffer(b"".join(column), dtype="<f8").reshape(-1, dim)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _keyed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The vector of each class as doubles, and the keys of all its cells, table by table."""
    names = [x.split()[0] for x in KEYED.split(", ")]
    for batch in batches:
        label, cid, n, embedding = (common.rows_of(batch, c) for c in ("label", "cid", "n", "embedding"))
        sizes = np.array([len(e) for e in embedding], int)
        for dim in np.unique(sizes).tolist():
            own = np.flatnonzero(sizes == dim).tolist()
            raw = [np.array(embedding[i], dtype="<f8").tobytes() for i in own]
            units = _units(raw, dim)
            keys = np.concatenate([keys_of(units, table) for table in range(TABLES)], 1)
            keys = pa.ListArray.from_arrays(np.arange(len(own) + 1, dtype=np.int32) * keys.shape[1], keys.ravel())
            columns = ([label[i] for i in own], [dim] * len(own), [cid[i] for i in own], [n[i] for i in own], raw)
            types = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)] + [keys], names)


def first_meeting(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The first cell, by table and then key, that pairs share; keys: (n, TABLES, PROBES)."""
    first = np.full(len(a), _NEVER)
    for table in range(TABLES):
        at = np.flatnonzero(first == _NEVER)
        x, y = a[at, table], b[at, table]
        first[at] = np.where((x[:, :, None] == y[:, None, :]).any(2), x, _NEVER).min(1, initial=_NEVER)
    return first


def _compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in common.key_runs(batches, ["label", "dim", "key", "cell"]):
        label, dim, key, cell, cid, n, g, part = (table.column(c).to_numpy() for c in ("label", "dim", "key", "cell", "cid", "n", "g", "part"))
        vec = table.column("vec").combine_chunks()
        cells = table.column("keys").combine_chunks().flatten().to_numpy().reshape(-1, TABLES, PROBES)
        starts = common.run_starts(label, dim, key, cell)
        us, vs, counted, added = ([np.zeros(0, np.int64)] for _ in range(4))
        for x, y in zip(starts[:-1].tolist(), starts[1:].tolist()):
            if y - x < 2:
                continue
            ids, weight, of = cid[x:y], n[x:y], part[x:y]
            units = _units(vec[x:y].to_pylist(), int(dim[x]))
            diagonal = cell[x] // g[x] == cell[x] % g[x]
            keys, total = cells[x:y], np.zeros(y - x, np.int64)
            for i in range(0, y - x, BLOCK):
                p, q = np.nonzero(units[i : i + BLOCK] @ units[i:].T >= COSINE)
                p, q = p + i, q + i
                once = (p < q) & (diagonal | (of[p] != of[q]))
                p, q = p[once], q[once]
                if not len(p):
                    continue
                first = first_meeting(keys[p], keys[q]) == key[x]
                np.add.at(total, p[first], weight[q[first]])
                np.add.at(total, q[first], weight[p[first]])
                a, b = common.spanning_forest(ids[p], ids[q])
                us.append(a)
                vs.append(b)
            counted.append(ids[total > 0])
            added.append(total[total > 0])
        u, v = common.spanning_forest(np.concatenate(us), np.concatenate(vs))
        c, m = np.concatenate(counted), np.concatenate(added)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([u, c])), pa.array(v.tolist() + [None] * len(c), pa.int64()), pa.array([0] * len(u) + m.tolist(), pa.int64())], ["u", "v", "n"])


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors(vec_id, embedding, label, ...)``.

    Rows with equal non-null labels and equally long vectors are compared. Null vectors, zero
    vectors and vectors with null or non-finite components link with nothing: n_links 0 and
    themselves as component. Rows with a null vec_id link others but name no component. Equal
    vectors and rows that repeat an id are vectors of their own. Other columns are ignored;
    no rows: no rows.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("int").alias("label"))
    finite = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    valid = F.coalesce(F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite & F.exists("embedding", lambda c: c != 0), F.lit(False))
    grouped = rows.where(valid).groupBy("label", "embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"))
    classes = common.cut(grouped.withColumn("cid", F.monotonically_increasing_id()))
    keyed = common.cut(classes.select("label", "cid", "n", "embedding").mapInArrow(_keyed, KEYED))
    at = ["label", "dim", "key"]
    cells = keyed.select("label", "dim", "cid", F.explode("keys").alias("key"))
    shared = common.cut(cells.groupBy(*at).agg(F.count("*").alias("m")).where("m > 1").select(*at, F.ceil(F.col("m") / BUCKET).cast("int").alias("g")))
    part = F.pmod(F.xxhash64("cid"), F.col("g")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("g") - 1), lambda j: F.least(F.col("part"), j) * F.col("g") + F.greatest(F.col("part"), j))
    dealt = common.join_checked(cells, shared, at, "inner").withColumn("part", part).select(*at, "cid", "g", "part", F.explode(pairs).alias("cell"))
    dealt = dealt.join(keyed.select("cid", "n", "vec", "keys"), "cid")
    by = [*at, "cell"]
    found = common.cut(dealt.repartition(*by).sortWithinPartitions(*by).mapInArrow(_compare, OUT))
    linked = common.cut(found.where("v is null").groupBy(F.col("u").alias("cid")).agg(F.sum("n").alias("others")))
    node = common.connected_components(found.where("v is not null").select("u", "v")).withColumnsRenamed({"node": "cid", "component": "root"})
    rooted = common.cut(classes.select("cid", "least", "n").join(node, "cid", "left").select("cid", "least", "n", F.coalesce("root", "cid").alias("root")))
    of_root = common.cut(rooted.groupBy("root").agg(F.min("least").alias("component_id")))
    of_class = rooted.join(of_root, "root").join(linked, "cid", "left").select("cid", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    known = common.cut(classes.select("label", "embedding", "cid").join(of_class, "cid").drop("cid"))
    alone = rows.where(~valid).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = rows.where(valid).join(known, ["label", "embedding"]).select("vec_id", "n_links", "component_id").unionByName(alone)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


#: All pairs of a label; the query finds those that share a lattice cell.
ORACLE_SQL = f"""with recursive e as (select vec_id, label, embedding::double[] as e from embeddings where label is not null and list_sum(list_transform(embedding, lambda x: x::double * x)) > 0 and isfinite(list_sum(embedding::double[])) and list_count(embedding) = len(embedding)),
 l as (select a.vec_id as u, b.vec_id as v from e a join e b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e) and list_cosine_similarity(a.e, b.e) >= {COSINE}),
 r as (select vec_id as u, vec_id as c from embeddings union select l.v, r.c from r join l on l.u = r.u), c as (select u as vec_id, min(c) as component_id from r group by 1), n as (select u as vec_id, count(*) as n from l group by 1)
 select vec_id, coalesce(n, 0) as n_links, component_id, vec_id = component_id as kept from embeddings join c using (vec_id) left join n using (vec_id)"""


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "embeddings"))
