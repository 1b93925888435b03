import numpy as np
import pytest

from ledgerlake.llm import op8_embeddings as op

VECTORS = "vec_id long, embedding array<float>, label int, n long, key string"


def brute(rows):
    def unit(e):
        if e is None or any(c is None for c in e):
            return None
        x = np.array(e, np.float32).astype(float)
        return x / np.linalg.norm(x) if np.isfinite(x).all() and np.linalg.norm(x) > 0 else None

    units = [unit(e) for _, e, _ in rows]
    n, root = [0] * len(rows), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, _, a) in enumerate(rows):
        for j in range(i):
            if a is not None and a == rows[j][2] and units[i] is not None and units[j] is not None and len(units[i]) == len(units[j]) and units[i] @ units[j] >= op.COSINE:
                n[i], n[j] = n[i] + 1, n[j] + 1
                root[find(i)] = find(j)
    least = {}
    for i, (v, _, _) in enumerate(rows):
        if v is not None:
            least[find(i)] = min(v, least.get(find(i), v))
    comp = [v if n[i] == 0 else least.get(find(i)) for i, (v, _, _) in enumerate(rows)]
    return sorted(((v, n[i], comp[i], v is not None and v == comp[i]) for i, (v, _, _) in enumerate(rows)), key=str)


def result(df):
    return sorted(map(tuple, df.select("vec_id", "n_links", "component_id", "kept").collect()), key=str)


@pytest.mark.parametrize("bucket", [4096, 16])
def test_equals_brute_force(spark, sf, bucket, monkeypatch):
    monkeypatch.setattr(op, "BUCKET", bucket)
    rng = np.random.default_rng(0)
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    base = rng.normal(size=64)
    for i in range(120):
        rows.append((10_000 + i, (base + 0.05 * rng.normal(size=64)).tolist(), 3))
    e = rows[0][1]
    odd = [None, [], [0.0] * 64, [float("nan")] + e[1:], [float("inf")] + e[1:], [None] + e[1:], e[:10], [2 * x for x in e], e]
    rows += [(20_000 + i, v, rows[0][2]) for i, v in enumerate(odd)]
    rows += [(30_000, e, None), (None, e, rows[0][2]), (None, [1.0, 2.0], 1), (None, None, None), (20_008, e, rows[0][2]), (30_001, [1.0, 2.0, 2.0], 1), (30_002, [1.0, 2.0, 2.1], 1)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], VECTORS)
    assert result(op.near_duplicates(df)) == brute(rows)


def test_recall_at_the_threshold():
    rng = np.random.default_rng(1)
    a = rng.normal(size=(4000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.normal(size=a.shape)
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    b = 0.93 * a + np.sqrt(1 - 0.93**2) * b
    keys = [np.stack([op.keys_of(x, t) for t in range(op.TABLES)], 1) for x in (a, b)]
    assert (op.first_meeting(*keys) != op._NEVER).mean() >= 0.95


def test_lattice_points_are_in_e8():
    points, _ = op.lattice_points(np.random.default_rng(2).normal(size=(500, 8)))
    assert ((points % 2 == 0).all(2) | (points % 2 == 1).all(2)).all() and (points.sum(2) % 4 == 0).all()


def test_empty(spark):
    assert op.near_duplicates(spark.createDataFrame([], VECTORS)).count() == 0
