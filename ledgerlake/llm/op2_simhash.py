"""SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments of 22, 21 and 21 bits, each read as a
word of the perfect binary Golay code [23, 12, 7]. If two fingerprints differ in three
bits at most, at least two of their three segments differ in one bit at most (pigeonhole).
Two words that differ in one bit at most have a codeword in common that is the nearest
one (distance 3 at most) of the first and within distance 4 of the second, and the same
the other way round. A word has one or six codewords within distance 4. So for each pair
of segments a fingerprint gets the keys (nearest, each near) and (each near, nearest),
and linked fingerprints share a key for certain: no link is lost. Keys meet in a join,
which verifies the number of differing bits.

Distinct fingerprints travel, not documents. A bucket returns a spanning forest of its
links, never all pairs. Buckets of about ``BUCKET`` rows or more (estimated from a
part of the fingerprints) are cut into a grid of parts and each cell of the grid goes to a
task of its own; the comparisons are the same however buckets are cut.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.llm import common

RADIUS = 3
#: Rows of one key that a single task compares; more are cut into a grid.
BUCKET = 4096
#: One in so many fingerprints, by a hash, is counted to find keys with many; the count decides only how a key is split.
ONE_IN = 64
#: Fixed value: the generator polynomial x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0xC75


def _remainder(word: int) -> int:
    for bit in range(22, 10, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - 11)
    return word


def golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """Syndromes of the upper 12 bits, and by syndrome the 1 or 6 error patterns of weight 4 at most.

    The first pattern leads to the nearest codeword; -1: none.
    """
    upper = np.array([_remainder(i << 11) for i in range(4096)], dtype=np.int64)
    single = [_remainder(1 << i) for i in range(23)]
    patterns = np.full((2048, 6), -1, dtype=np.int64)
    filled = np.zeros(2048, dtype=int)
    for weight in range(5):
        for bits in combinations(range(23), weight):
            syndrome, pattern = 0, 0
            for b in bits:
                syndrome, pattern = syndrome ^ single[b], pattern | 1 << b
            if weight < 4 or bin(int(patterns[syndrome, 0])).count("1") == 3:
                patterns[syndrome, filled[syndrome]] = pattern
                filled[syndrome] += 1
    return upper, patterns


UPPER, PATTERNS = golay_tables()


def codewords(words: np.ndarray) -> np.ndarray:
    """Indices (12 bits) of the codewords within distance 4, nearest first; -1: none. Shape (n, 6)."""
    found = PATTERNS[UPPER[words >> 11] ^ (words & 0x7FF)]
    return np.where(found >= 0, (words[:, None] ^ np.maximum(found, 0)) >> 11, -1)


def keys_of(fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, position of its fingerprint), each once."""
    f = fingerprints.astype(np.uint64)
    parts = [codewords((f >> np.uint64(shift) & np.uint64((1 << width) - 1)).astype(np.int64)) for shift, width in ((42, 22), (21, 21), (0, 21))]
    keys, positions = [], []
    for number, (a, b) in enumerate(combinations(parts, 2)):
        for first, second in ((a[:, :1], b), (a[:, 1:], b[:, :1])):
            whole = np.where((first >= 0) & (second >= 0), number << 24 | first << 12 | second, -1)
            rows, columns = np.nonzero(whole >= 0)
            keys.append(whole[rows, columns])
            positions.append(rows)
    return np.concatenate(keys), np.concatenate(positions)


def fingerprint(text: bytes | None) -> int:
    """SimHash of the 3-word shingles (repeats count) of UTF-8 text; 0 without words."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    grams = list(map(b" ".join, zip(words, words[1:], words[2:]))) if len(words) > 2 else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(g, 42) for g in grams], dtype="<u8")
    total = np.zeros(64, dtype=np.int64)
    for i in range(0, len(h), 65536):
        total += np.unpackbits(h[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > len(h), bitorder="little").tobytes(), "little")


@common.kernel
def _sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        f = np.array([fingerprint(t) for t in common.bytes_of(batch, "text")], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(f)], ["doc_id", "row", "fp"])


@common.kernel
def _spread(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        f = batch.column(0).to_numpy().view(np.uint64)
        for i in range(0, len(f), 8192):
            k, at = keys_of(f[i : i + 8192])
            yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(f[i : i + 8192][at].view(np.int64))], ["key", "fp"])


@common.kernel
def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        k, n = np.unique(keys_of(batch.column(0).to_numpy().view(np.uint64))[0], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(n.astype(np.int64))], ["key", "n"])


def _near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= RADIUS


def links_in(keys: list[np.ndarray], f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within runs of equal keys."""
    starts = common.run_starts(*keys)
    length = np.diff(starts)
    us, vs = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    run = np.repeat(np.arange(len(length)), length)
    short = np.repeat(length <= 32, length) & np.repeat(length > 1, length)
    g, r = f[short], run[short]
    for d in range(1, 32):
        if len(g) <= d or not (same := r[d:] == r[:-d]).any():
            break
        a, b = g[d:][same], g[:-d][same]
        near = _near(a, b) & (a != b)
        us.append(a[near])
        vs.append(b[near])
    for k in np.flatnonzero(length > 32):
        own = np.unique(f[starts[k] : starts[k + 1]])
        for i in range(0, len(own), 512):
            some = own[i : i + 512]
            x, y = np.nonzero(_near(some[:, None], own[None, i:]))
            a, b = common.spanning_forest(some[x], own[i:][y])
            us.append(a)
            vs.append(b)
    return common.spanning_forest(np.concatenate(us), np.concatenate(vs))


@common.kernel
def _compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for runs in common.key_runs(batches, ["key", "cell"]):
        keys = [runs.column(k).to_numpy() for k in ("key", "cell")]
        u, v = links_in(keys, runs.column("fp").to_numpy().view(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])


def link_fingerprints(distinct: DataFrame) -> DataFrame:
    """Links (u, v) whose components are those of all pairs within ``RADIUS`` bits, over ``distinct(fp)``."""
    rows = distinct.mapInArrow(_spread, "key int, fp long")
    some = distinct.where(F.pmod(F.xxhash64(F.lit(1), "fp"), F.lit(ONE_IN)) == 0).mapInArrow(_counted, "key int, n long")
    large = common.cut(some.groupBy("key").agg(F.ceil(F.sum("n") * ONE_IN / BUCKET).cast("int").alias("g")).where("g > 1"))
    if large.isEmpty():
        rows = rows.withColumn("cell", F.lit(0))
    else:
        part = F.pmod(F.xxhash64("fp"), F.col("g")).cast("int")
        cells = F.transform(F.sequence(F.lit(0), F.col("g") - 1), lambda j: F.least(F.col("part"), j) * F.col("g") + F.greatest(F.col("part"), j))
        rows = common.join_checked(rows, large, "key").withColumn("part", part)
        rows = rows.select("key", "fp", F.explode(F.when(F.col("g") > 1, cells).otherwise(F.array(F.lit(0)))).alias("cell"))
    return rows.repartition("key", "cell").sortWithinPartitions("key", "cell").mapInArrow(_compare, "u long, v long")


def _rooted(docs: DataFrame, row: Column) -> tuple[DataFrame, DataFrame]:
    """(doc_id, row, fp) of every row, and (fp, least, root) of every fingerprint; ``least`` is its smallest doc_id."""
    signed = common.cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), row.cast("long").alias("row"), F.col("text").cast("string").alias("text")).mapInArrow(_sign, "doc_id long, row long, fp long"))
    least = common.cut(signed.groupBy("fp").agg(F.min("doc_id").alias("least")))
    node = common.connected_components(link_fingerprints(least.select("fp"))).withColumnsRenamed({"node": "fp", "component": "root"})
    return signed, common.cut(least.join(node, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of ``docs(doc_id, text, ...)``.

    Null or empty text: fingerprint zero, linked like any other. component_id: the smallest
    doc_id that links reach; rows without doc_id link others but name no component. Rows
    that repeat a doc_id are rows of their own. Other columns are ignored; no rows: no rows.
    """
    signed, rooted = _rooted(docs, F.lit(0))
    of_root = common.cut(rooted.groupBy("root").agg(F.min("least").alias("component_id")))
    of_fp = common.cut(rooted.select("fp", "root").join(of_root, "root").select("fp", "component_id"))
    text = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return signed.join(of_fp, "fp").select("doc_id", text, "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` without near-duplicates: of each component the row with the smallest doc_id stays.

    Of its rows that share this doc_id one stays; a component without any doc_id keeps one row.
    Rows are told apart by a number that is written with them, so ids may repeat or be null.
    """
    rows = common.cut(docs.withColumn("_row", F.monotonically_increasing_id()))
    signed, rooted = _rooted(rows, F.col("_row"))
    first = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    of_root = common.cut(signed.join(rooted.select("fp", "root"), "fp").select("row", "doc_id", "root"))
    kept = common.cut(of_root.groupBy("root").agg(F.min(first)["row"].alias("kept"), F.count("*").alias("n")).where("n > 1").select("root", "kept"))
    gone = common.cut(common.join_checked(of_root, kept, "root", "inner").where("row <> kept").select(F.col("row").alias("_row")))
    # what goes is less than what stays: it is sent to the texts if its counted rows allow it
    return common.join_checked(rows, gone, "_row", "left_anti").select(*docs.columns)


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"))
