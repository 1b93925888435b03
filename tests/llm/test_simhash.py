import numpy as np
import pytest
import xxhash

from ledgerlake.llm import common, op2_simhash as op

DOCS = "doc_id long, text string, lang string, fp long"


def brute_fingerprint(text):
    out, word = [], ""
    for c in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""):
        if c == " " or "\t" <= c <= "\r":
            out, word = out + [word] * bool(word), ""
        else:
            word += c
    words = out + [word] * bool(word)
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(pairs_of, n):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if pairs_of(i, j):
                root[find(i)] = find(j)
    return [find(i) for i in range(n)]


def brute(rows):
    fps = [brute_fingerprint(t) for _, t in rows]
    roots = brute_components(lambda i, j: bin(fps[i] ^ fps[j]).count("1") <= 3, len(rows))
    least = {}
    for (d, _), r in zip(rows, roots):
        if d is not None:
            least[r] = min(d, least.get(r, d))
    return sorted(((d, f"{f:016x}", least.get(r)) for (d, _), f, r in zip(rows, fps, roots)), key=str)


def result(df):
    return sorted(map(tuple, df.select("doc_id", "fingerprint", "component_id").collect()), key=str)


def test_golay_code_is_perfect_and_has_one_or_six_codewords():
    filled = (op.PATTERNS >= 0).sum(axis=1)
    assert sorted(set(filled)) == [1, 6] and (op.PATTERNS[:, 0] >= 0).all()
    words = np.random.default_rng(0).integers(0, 1 << 23, 5000)
    nearest, near = op.codewords(words)[:, 0], op.codewords(words ^ (1 << np.random.default_rng(1).integers(0, 23, 5000)))
    assert (near == nearest[:, None]).any(axis=1).all()


def test_keys_lose_no_pair_within_the_radius():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 2**64, 3000, dtype=np.uint64)
    b = a.copy()
    for _ in range(3):
        b ^= np.uint64(1) << rng.integers(0, 64, 3000).astype(np.uint64)
    shared = {}
    for f, k in ((a, 0), (b, 1)):
        for key, at in zip(*op.keys_of(f)):
            shared.setdefault((at, k), set()).add(key)
    assert all(shared[i, 0] & shared[i, 1] for i in range(3000))


def test_links_in_large_runs():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**64, 1, dtype=np.uint64)[0]
    f = np.unique(base ^ (np.uint64(1) << rng.integers(0, 64, 1500).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 1500).astype(np.uint64)))
    u, v = op.links_in([np.zeros(len(f), int)], f)
    assert len(u) == len(f) - 1


@pytest.mark.parametrize("bucket", [4096, 8])
def test_equals_brute_force(spark, sf, bucket, monkeypatch):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    long = "word " * 3000 + " ".join(f"w{i}" for i in range(20000))
    rows += [(10**6, long), (10**6 + 1, long + " end"), (-5, None), (10**6 + 2, ""), (10**6 + 3, " \n "), (10**6 + 4, "one two"), (10**6 + 5, "ONE Two"), (None, "one two"), (None, None), rows[0], rows[3]]
    words = "alpha beta gamma delta eps zeta eta theta iota kappa".split()
    rng = np.random.default_rng(5)
    base = [words[i] for i in rng.integers(0, 10, 400)]
    for i in range(60):
        copy = list(base)
        copy[rng.integers(0, 400)] = f"x{i}"
        rows.append((2 * 10**6 + i, " ".join(copy)))
    monkeypatch.setattr(op, "BUCKET", bucket)
    monkeypatch.setattr(op, "ONE_IN", 1)
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], DOCS)
    assert result(op.near_duplicates(df)) == brute(rows)


def test_empty(spark):
    assert op.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
    assert op.keep_one(spark.createDataFrame([], DOCS)).count() == 0


def test_keep_one(spark):
    rows = [(3, "a b c d"), (2, "a b c d"), (2, "a b c d"), (None, "q r s t u"), (None, "q r s t u"), (None, "a b c d"), (9, "other words go here now")]
    kept = op.keep_one(spark.createDataFrame([(d, t, "x", 1) for d, t in rows], DOCS))
    assert kept.columns == ["doc_id", "text", "lang", "fp"]
    assert sorted((r[0] for r in kept.collect()), key=str) == [2, 9, None]


def test_components(spark):
    chain = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(300)] + [(7, 7), (None, 3)]
    got = dict(common.connected_components(spark.createDataFrame(chain, "u long, v long")).collect())
    assert got == {i: 0 for i in range(201)} | {1000 + i: 1000 for i in range(300)}
