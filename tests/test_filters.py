import xxhash
from pyspark.sql import functions as F

from ledgerlake.functions import hashing
from ledgerlake.operators import vector


def test_bloom_filter_holds_its_keys(spark):
    keys = [f"key{i}" for i in range(500)]
    bits, hashes = hashing.bloom_size(len(keys))
    assert (bits, hashes) == (8192, 7) and hashing.bloom_size(0)[0] == 0
    words = {r["word"]: r["bits"] for r in hashing.bloom_filter(spark.createDataFrame([(k,) for k in keys], "k string"), "k").collect()}

    def holds(key):
        a, b = (xxhash.xxh64_intdigest(key, seed) for seed in (0, 1))
        return all(words.get(p >> 6, 0) >> (p & 63) & 1 for p in ((a + i * b) % 2**64 % bits for i in range(hashes)))

    assert all(map(holds, keys))
    assert sum(holds(f"other{i}") for i in range(2000)) < 60


def test_quotients_and_remainders(spark):
    assert [hashing.quotient_bits(n) for n in (0, 1, 12, 13, 10**9)] == [4, 4, 4, 5, 16]
    h = spark.createDataFrame([(-1,), (0x1234567800000000,), (0x1234567900000000,)], "h long")
    got = h.select(*hashing.fingerprint(F.col("h"), 16, 7)).collect()
    assert [tuple(r) for r in got] == [(0xFFFF, 0x7F), (0x1234, 0x5678 >> 9), (0x1234, 0x5678 >> 9)]
    assert hashing.quotient_filter(h, "h", 16, 7).count() == 2


def test_vectors_beyond_limits(spark):
    rows = [("n", "i", [1.0, 2.0]), ("n" * 257, "i", [1.0, 2.0]), ("n", "i" * 513, [1.0, 2.0]), ("n", "i", []), ("n", "i", None), ("n", "i", [1.0])]
    got = vector.rejected(spark.createDataFrame(rows, "namespace string, id string, embedding array<double>"), 2)
    assert [r["reason"] for r in got.collect()] == ["namespace too long", "id too long", "empty vector", "empty vector", "other dimensions"]
