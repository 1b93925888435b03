"""Routing hashes: XXH64 with a seed, and jump consistent hashing, in Arrow batches."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_STEP = np.uint64(2862933555777941757)  # fixed value of the jump hash


def jump(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets of unsigned 64-bit hashes: all keys step on together until none is below ``buckets``."""
    key = hashes.astype(np.uint64)
    at, ahead = np.full(len(key), -1, np.int64), np.zeros(len(key), np.int64)
    live = np.arange(len(key))
    while len(live):
        at[live] = ahead[live]
        key[live] = key[live] * _STEP + np.uint64(1)
        ahead[live] = ((at[live] + 1) * (float(1 << 31) / ((key[live] >> np.uint64(33)).astype(np.float64) + 1))).astype(np.int64)
        live = live[ahead[live] < buckets]
    return at


def xxh64(column: Column, seed: int = 0) -> Column:
    """XXH64 of the UTF-8 bytes of a string column, as a signed long."""

    @F.pandas_udf("long")
    def run(keys: pd.Series) -> pd.Series:
        return pd.Series(np.array([xxhash.xxh64_intdigest(k, seed) for k in keys], dtype=np.uint64).view(np.int64))

    return run(column.cast("binary"))


def shard(column: Column, shards: int = 1024) -> Column:
    """The shard of a string key."""

    @F.pandas_udf("int")
    def run(keys: pd.Series) -> pd.Series:
        return pd.Series(jump(np.array([xxhash.xxh64_intdigest(k, 0) for k in keys], dtype=np.uint64), shards).astype(np.int32))

    return run(column.cast("binary"))


def jump_bucket(column: Column, buckets: int) -> Column:
    """The jump-hash bucket of a long column."""

    @F.pandas_udf("int")
    def run(keys: pd.Series) -> pd.Series:
        return pd.Series(jump(keys.to_numpy(np.int64).view(np.uint64), buckets).astype(np.int32))

    return run(column)


def bloom_positions(first: Column, second: Column, bits: int, hashes: int) -> Column:
    """Positions first + i * second (mod bits, a power of two) that a Bloom filter sets for a key with these two hashes."""
    mask = F.lit(bits - 1)
    return F.array(*((first.bitwiseAND(mask) + i * second.bitwiseAND(mask)).bitwiseAND(mask) for i in range(hashes)))


def bloom_size(keys: int, bits_per_key: int = 10) -> tuple[int, int]:
    """(bits, hashes) of a filter: a power of two, and 0.693 hashes for each bit of a key."""
    wanted = keys * bits_per_key
    return (1 << (wanted - 1).bit_length() if wanted else 0), max(1, math.ceil(bits_per_key * 0.693))


def bloom_filter(keys: DataFrame, key: str, bits_per_key: int = 10) -> DataFrame:
    """(word, bits): the words of a Bloom filter over a string column that have a bit set, 64 bits each."""
    bits, hashes = bloom_size(keys.count(), bits_per_key)
    if not bits:
        return keys.sparkSession.createDataFrame([], "word long, bits long")
    hashed = keys.select(xxh64(F.col(key), 0).alias("a"), xxh64(F.col(key), 1).alias("b"))
    at = hashed.select(F.explode(bloom_positions(F.col("a"), F.col("b"), bits, hashes)).alias("at"))
    return at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits"))


def quotient_bits(keys: int, load: float = 0.75) -> int:
    """Bits of the quotient for so many keys at a share of filled slots, 4 to 16."""
    slots = math.ceil(keys / min(0.9, max(0.5, load)))
    return min(16, max(4, math.ceil(math.log2(slots)))) if slots else 4


def fingerprint(hashed: Column, quotient: int, remainder: int) -> tuple[Column, Column]:
    """Quotient and remainder of a 64-bit hash: its highest bits, and those behind them."""
    return F.shiftrightunsigned(hashed, 64 - quotient), F.shiftrightunsigned(hashed, 64 - quotient - remainder).bitwiseAND(F.lit((1 << remainder) - 1))


def quotient_filter(hashes: DataFrame, hashed: str, quotient: int, remainder: int) -> DataFrame:
    """(quotient, remainder): the distinct fingerprints of a column of hashes; filters merge by union and distinct."""
    q, r = fingerprint(F.col(hashed), quotient, remainder)
    return hashes.select(q.alias("quotient"), r.alias("remainder")).distinct()
