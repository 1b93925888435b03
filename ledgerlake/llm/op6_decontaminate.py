"""Benchmark decontamination by SimHash windows and multi-index Hamming blocks.

Texts are lower-cased (A-Z), ASCII punctuation counts as space. Every item of the
benchmark has the weighted SimHash of its 5-word shingles, and so has every window of as
many words of a document; a shorter document is one window. A fingerprint is cut into ``BLOCKS`` blocks; two fingerprints
within ``RADIUS`` bits agree in one block up to ``RADIUS // BLOCKS`` bits for certain, so
an index that lists for every value of every block the items nearby finds all of them.
Then the exact weighted Jaccard similarity of the two bags of shingles decides. A shingle
weighs as many as its words have letters (bytes of UTF-8), so long words say more than short
ones; the weight is the shingle's own, whatever else is in the benchmark, and sums of weights
are whole numbers.

Windows of whose weight too little is in the benchmark to reach the similarity with any
item of their length are passed over: that bound is exact, and it is what makes windows at
every word of every document affordable. ``RADIUS`` is 20 of 64 bits: at the smallest
similarity that counts, 0.8, fingerprints differ in 9.7 bits on average (standard
deviation 2.9), and farther pairs differ in more.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.llm import common

SHINGLE = 5
SIMILARITY = 0.8
RADIUS, BLOCKS, BLOCK_BITS = 20, 4, 16
#: Items that are sent to all executors at once; a larger benchmark takes several passes. A worker's
#: tables take BLOCKS * 8192 bytes an item, 131 MB for a pass.
ITEMS = 4_000
#: Items of one index table (its size is BLOCKS * 65536 * INDEXED / 8 bytes).
INDEXED = 512
REMEMBERED = 100_000
#: Windows that are signed at once start within so many words.
STRETCH = 8192

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_SPACED = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
FOUND = "doc_id long, item_id long, similarity double, start long, n_words long"


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().translate(_SPACED).split()


def grams_of(h: np.ndarray, gram: int) -> np.ndarray:
    n = len(h) - gram + 1
    g = h[:n].copy()
    for i in range(1, gram):
        g = g * _MULTIPLIER + h[i : i + n]
    g = (g ^ (g >> np.uint64(32))) * _MULTIPLIER
    return g ^ (g >> np.uint64(29))


def weights_of(sizes: np.ndarray, gram: int) -> np.ndarray:
    """Weight of each gram, from the bytes of each word."""
    total = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes, dtype=np.int64)])
    return total[gram:] - total[:-gram]


def signed(grams: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Weight of each gram towards each of 64 bits."""
    bits = np.unpackbits(grams.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.where(bits, weights[:, None], -weights[:, None])


def fingerprints_of(grams: np.ndarray, weights: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """SimHash of the ``n`` grams at each of ``starts``, which lie within a stretch."""
    low = starts[0]
    total = np.cumsum(signed(grams[low : starts[-1] + n], weights[low : starts[-1] + n]), axis=0, dtype=np.int64)
    total = np.concatenate([np.zeros((1, 64), np.int64), total])
    return packed(total[starts - low + n] - total[starts - low])


def packed(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1, bitorder="little").reshape(-1, 8).copy().view("<u8").ravel()


@dataclass
class Shape:
    """The items of one length: shingles of ``gram`` words each."""

    words: int
    gram: int
    ids: list[int | None] = field(default_factory=list)
    bags: list[Counter] = field(default_factory=list)
    total: list[int] = field(default_factory=list)
    fingerprints: np.ndarray | None = None


class Benchmark:
    """Items by length, with the weights of their shingles."""

    def __init__(self, items: list[tuple[int | None, bytes]]):
        self.shapes: dict[int, Shape] = {}
        self.weight: dict[int, dict[int, int]] = {}
        for item_id, text in items:
            if words := words_of(text):
                gram = min(SHINGLE, len(words))
                grams = grams_of(np.array([xxhash.xxh64_intdigest(w) for w in words], dtype=np.uint64), gram)
                weights = weights_of(np.array([len(w) for w in words]), gram)
                self.weight.setdefault(gram, {}).update(zip(grams.tolist(), weights.tolist()))
                shape = self.shapes.setdefault(len(words), Shape(len(words), gram))
                shape.ids.append(item_id)
                shape.bags.append(Counter(grams.tolist()))
                shape.total.append(int(weights.sum()))
                fp = packed(signed(grams, weights).sum(0, keepdims=True))
                shape.fingerprints = fp if shape.fingerprints is None else np.append(shape.fingerprints, fp)
        self.grams = {g: np.array(sorted(of), dtype=np.uint64) for g, of in self.weight.items()}
        self.flags = {}
        for g, of in self.grams.items():
            flag = np.zeros(1 << 20, bool)
            flag[(of & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
            self.flags[g] = flag


def similarity(bag: Counter, other: Counter, weight: dict[int, int]) -> float:
    """Weighted Jaccard similarity; ``weight`` has the grams of both."""
    both = either = 0
    for s in bag.keys() | other.keys():
        both += weight[s] * min(bag[s], other[s])
        either += weight[s] * max(bag[s], other[s])
    return both / either if either else 0.0


class Index:
    """For every value of every block, the items whose block is within the block's radius."""

    def __init__(self, fingerprints: np.ndarray):
        self.fingerprints = fingerprints
        self.parts = []
        values = np.arange(1 << BLOCK_BITS, dtype=np.uint64)
        for at in range(0, len(fingerprints), INDEXED):
            some = fingerprints[at : at + INDEXED]
            table = np.zeros((BLOCKS, 1 << BLOCK_BITS, -(-len(some) // 8)), np.uint8)
            for i, f in enumerate(some):
                for b in range(BLOCKS):
                    near = np.bitwise_count(values ^ (f >> np.uint64(BLOCK_BITS * b) & np.uint64((1 << BLOCK_BITS) - 1))) <= RADIUS // BLOCKS
                    table[b, near, i // 8] |= np.uint8(1 << i % 8)
            self.parts.append((at, table))

    def near(self, fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) of every pair within ``RADIUS`` bits."""
        windows, items = [np.zeros(0, int)], [np.zeros(0, int)]
        for at, table in self.parts:
            hit = np.zeros((len(fingerprints), table.shape[2]), np.uint8)
            for b in range(BLOCKS):
                hit |= table[b, (fingerprints >> np.uint64(BLOCK_BITS * b) & np.uint64((1 << BLOCK_BITS) - 1)).astype(np.int64)]
            w, i = np.nonzero(np.unpackbits(hit, axis=1, bitorder="little"))
            close = np.bitwise_count(fingerprints[w] ^ self.fingerprints[i + at]) <= RADIUS
            windows.append(w[close])
            items.append(i[close] + at)
        return np.concatenate(windows), np.concatenate(items)


class Matcher:
    """Finds items in documents; index tables are built when a window first needs them."""

    def __init__(self, benchmark: Benchmark):
        self.benchmark = benchmark
        self.known: dict[bytes, int] = {}
        self.indexes: dict[int, Index] = {}

    def hashes(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh64_intdigest(w)
        return np.array([known[w] for w in words], dtype=np.uint64)

    def document(self, text: bytes | None) -> list[tuple[int | None, float, int, int]]:
        """(item_id, similarity, first word, words) of the best window of each item that a text holds."""
        found: dict[tuple[int, int], tuple[float, int, int]] = {}
        words = words_of(text)
        if not words:
            return []
        bench, h, sizes = self.benchmark, self.hashes(words), np.array([len(w) for w in words])
        for gram, known in bench.grams.items():
            if len(h) < gram:
                continue
            grams = grams_of(h, gram)
            maybe = np.flatnonzero(bench.flags[gram][(grams & np.uint64((1 << 20) - 1)).astype(np.int64)])
            maybe = maybe[known[np.minimum(np.searchsorted(known, grams[maybe]), len(known) - 1)] == grams[maybe]]
            if not len(maybe):
                continue
            weights = weights_of(sizes, gram)
            shared = np.zeros(len(grams), np.int64)
            shared[maybe] = weights[maybe]
            reached, whole = (np.append(0, np.cumsum(x)) for x in (shared, weights))
            for shape in bench.shapes.values():
                if shape.gram != gram:
                    continue
                n = min(shape.words - gram + 1, len(grams))
                # the weight of what both hold is SIMILARITY of either's weight or more
                least = np.maximum(whole[n:] - whole[:-n], min(shape.total))
                starts = np.flatnonzero(reached[n:] - reached[:-n] >= SIMILARITY * least - 1e-6)
                for part in np.split(starts, np.flatnonzero(np.diff(starts // STRETCH)) + 1):
                    if len(part):
                        self._windows(shape, grams, weights, part, n, found)
        return [(bench.shapes[words].ids[item], *best) for (words, item), best in found.items()]

    def _windows(self, shape: Shape, grams: np.ndarray, weights: np.ndarray, starts: np.ndarray, n: int, found: dict) -> None:
        if shape.words not in self.indexes:
            self.indexes[shape.words] = Index(shape.fingerprints)
        known = self.benchmark.weight[shape.gram]
        for w, item in zip(*self.indexes[shape.words].near(fingerprints_of(grams, weights, starts, n))):
            start, key = int(starts[w]), (shape.words, int(item))
            own = grams[start : start + n].tolist()
            weight = {s: known[s] for s in shape.bags[item]} | dict(zip(own, weights[start : start + n].tolist()))
            value = similarity(Counter(own), shape.bags[item], weight)
            if value >= SIMILARITY - 1e-12 and value > found.get(key, (0.0,))[0]:
                found[key] = (value, start, n + shape.gram - 1)


#: The pass that a worker is at: what it has built of it serves all its tasks, and goes before the next is built.
_MATCHERS: dict[str, Matcher] = {}


def matcher_of(name: str, items: Broadcast) -> Matcher:
    if name not in _MATCHERS:
        _MATCHERS.clear()
        _MATCHERS[name] = Matcher(Benchmark(items.value))
    return _MATCHERS[name]


def _passes(benchmark: DataFrame) -> Iterator[tuple[str, Broadcast]]:
    """The items, sent in passes of about ``ITEMS``, each under a name; what a document holds doesn't depend on the passes."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    passes = max(1, -(-items.count() // ITEMS))
    for number in range(passes):
        part = items if passes == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == number)
        yield uuid.uuid4().hex, benchmark.sparkSession.sparkContext.broadcast([(i, t.encode()) for i, t in sorted(map(tuple, part.collect()), key=str)])


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, similarity, start, n_words) of every item that a document holds.

    ``docs(doc_id, text, ...)``, ``benchmark(item_id, text, ...)``. similarity: the best weighted
    Jaccard similarity of a window, ``SIMILARITY`` or more; start: its first word (ties: the
    first); n_words: its words, all of a document shorter than the item. Null, empty and wordless texts match nothing; an item with under
    five words has one shingle, its whole sequence. Rows that repeat an id are rows of their own, documents and items.
    Other columns are ignored; no documents or no items: no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for name, own in _passes(benchmark):

        @common.kernel
        def find(batches: Iterable[pa.RecordBatch], name=name, own=own) -> Iterator[pa.RecordBatch]:
            matcher = matcher_of(name, own)
            for batch in batches:
                found = []
                for doc_id, text in zip(common.rows_of(batch, "doc_id"), common.bytes_of(batch, "text")):
                    found += [(doc_id, *best) for best in matcher.document(text)]
                columns = list(zip(*found)) or [()] * 5
                types = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["doc_id", "item_id", "similarity", "start", "n_words"])

        hits = rows.mapInArrow(find, FOUND)
        out = hits if out is None else out.unionByName(hits)
    return out


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text holds an item of the benchmark; ids may repeat or be null.

    What a pass leaves is written before the next one reads it, so that no task holds the tables of two.
    """
    for number, (name, own) in enumerate(_passes(benchmark)):
        docs = common.cut(docs) if number else docs

        @common.kernel
        def clean(batches: Iterable[pa.RecordBatch], name=name, own=own) -> Iterator[pa.RecordBatch]:
            matcher = matcher_of(name, own)
            for batch in batches:
                yield batch.filter(pa.array([not matcher.document(t) for t in common.bytes_of(batch, "text")], pa.bool_()))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
