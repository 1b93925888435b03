"""Substring deduplication by super-k-mer partitioning.

Every window of ``WINDOW`` words has a minimiser: the smallest hash of its grams of
``GRAM`` words. Consecutive windows of a document with the same minimiser travel as one
packed string to the minimiser's bucket; equal windows have equal minimisers, so all of
them meet there. In its bucket the windows' own words are sorted, and every window that
is not the first of its kind is a repeat. The strings of one bucket and chunk of documents
are compressed together, since they overlap by design; the number of buckets follows the
bytes to send, so that a bucket has about ``BUCKET_BYTES``.

Strings that occur again within one batch of documents travel once: the others' windows
are repeats already. A minimiser with more strings than a task should hold is not used as
a key: its windows are dealt by their own words, pre-aggregated, and joined. How many strings
a minimiser has is estimated from a random one in ``ONE_IN`` of all strings; the estimate
decides only where windows meet, not what is compared.

Rows are places: where ids repeat or are null, rows are told apart by 63 bits of a hash of
their text, and rows that share both id and text are one place.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.llm import common

WINDOW = 20
GRAM = 4
#: Strings of one minimiser that a task may hold, about as many as a bucket holds; more are dealt by window.
BUCKET = 50_000
#: One in so many strings is counted, at random, to find minimisers with more than that.
ONE_IN = 500
#: Bytes of text that are cut into segments at once.
CHUNK = 4_000_000
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_SPACES = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])

#: Bytes of packed strings that a bucket and a partition of buckets hold, about; a task holds one bucket at a time.
BUCKET_BYTES, PARTITION_BYTES = 8_000_000, 64_000_000
#: Strings of one bucket and chunk, compressed together.
BLOCKS = "bucket int, block binary"
WINDOWS = "doc_id long, own long, start int, words binary"
RANGES = "doc_id long, own long, a int, b int"
#: Stands for a null id, whose rows have negative marks: they come after all others.
_LAST = 2**63 - 1


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MULTIPLIER
    return h ^ (h >> np.uint64(29))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2^64."""
    inverse = np.uint64(pow(int(_MULTIPLIER), -1, 1 << 64))
    return tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, m, np.uint64)])) for m in (_MULTIPLIER, inverse))


class Chunk:
    """The super-k-mers of some documents, by numpy over all their bytes.

    ``text``: every word followed by one space; ``begins``, ``ends``: of words in it. By run of
    windows with one minimiser: ``first`` and ``behind`` (first window, and the one behind the last; a
    window has the number of its first word), ``minis``, ``doc``, ``start`` (word in the document),
    ``cyclic``. Equal windows within one run have its minimiser, a gram, twice within a window's
    reach; ``cyclic`` says whether any gram of the run is repeated that near.
    """

    def __init__(self, texts: list[bytes], window: int, gram: int):
        raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        space = _SPACES[raw]
        after_space = np.concatenate([[True], space[:-1]])
        keep = ~space | ~after_space
        text = raw[keep]
        text[space[keep]] = 32
        self.text = text.tobytes()
        self.ends = np.flatnonzero(text == 32)
        self.begins = np.concatenate([[0], self.ends[:-1] + 1]) if len(self.ends) else self.ends
        offsets = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
        doc = np.searchsorted(offsets, np.flatnonzero(~space & after_space), "right") - 1
        n = len(doc)
        self.first = self.behind = self.doc = self.start = np.zeros(0, np.int64)
        self.minis, self.cyclic = np.zeros(0, np.int64), np.zeros(0, bool)
        if n < window:
            return
        power, inverse = _powers((len(text) | (1 << 20) - 1) + 1)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((text.astype(np.uint64) + np.uint64(1)) * power[: len(text)])])
        words = _mixed((total[self.ends] - total[self.begins]) * inverse[self.begins])
        grams = words[: n - gram + 1].copy()
        for i in range(1, gram):
            grams = grams * _MULTIPLIER + words[i : n - gram + 1 + i]
        grams = _mixed(grams)
        least, width, span = grams, 1, window - gram + 1
        while width * 2 <= span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if rest := span - width:
            least = np.minimum(least[:-rest], least[rest:])
        whole = doc[: n - window + 1] == doc[window - 1 :]
        joined = np.concatenate([[False], whole[1:] & whole[:-1] & (least[1:] == least[:-1])])
        self.first = np.flatnonzero(whole & ~joined)
        self.behind = np.flatnonzero(whole & ~np.concatenate([joined[1:], [False]])) + 1
        self.minis = least[self.first].view(np.int64)
        self.doc = doc[self.first]
        self.start = self.first - np.searchsorted(doc, self.doc)
        again = np.zeros(len(grams) + 1, np.int64)
        for lag in range(1, min(span + 1, len(grams))):
            again[1 : len(grams) - lag + 1] |= grams[lag:] == grams[:-lag]
        again = np.cumsum(again)
        self.cyclic = again[self.behind + span - 1] > again[self.first]


def mark(text: bytes) -> int:
    """What tells rows of one id apart; ``_mark`` is the same as a column."""
    return xxhash.xxh64_intdigest(text, 42) >> 1


def _mark(text: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.coalesce(text, F.lit(""))), 1)


def _chunks(batch: pa.RecordBatch, window: int, gram: int, marked: bool) -> Iterator[tuple[np.ndarray, np.ndarray, Chunk]]:
    """(ids, marks, chunk) of the batch's documents in order of their ids; a null id comes last, with a negative mark."""
    ids = common.rows_of(batch, "doc_id")
    texts = [t or b"" for t in common.bytes_of(batch, "text")]
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
    some, size = [], 0
    for number, i in enumerate(order, 1):
        some.append(i)
        size += len(texts[i])
        if size > CHUNK or number == len(order):
            marks = [-1 - mark(texts[j]) if ids[j] is None else mark(texts[j]) if marked else 0 for j in some]
            yield np.array([_LAST if ids[j] is None else ids[j] for j in some], np.int64), np.array(marks, np.int64), Chunk([texts[j] for j in some], window, gram)
            some, size = [], 0


def _counter(window: int, gram: int, one_in: int):
    """Minimisers of some strings at random, counted by batch, and without one the bytes of the batch's packed strings."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(TaskContext.get().partitionId())
        for batch in batches:
            found, size = [np.zeros(0, np.int64)], 0
            for _, _, chunk in _chunks(batch, window, gram, False):
                found.append(chunk.minis[rng.random(len(chunk.minis)) * one_in < 1])
                size += int((chunk.ends[chunk.behind + window - 2] - chunk.begins[chunk.first]).sum()) if len(chunk.first) else 0
            k, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([*k.tolist(), None], pa.int64()), pa.array([*(n * one_in).tolist(), size], pa.int64())], ["mini", "n"])

    return count


def _known(doc_id: np.ndarray, own: np.ndarray, start: np.ndarray, packed: list[bytes]) -> np.ndarray:
    """Which strings repeat one of the chunk at an earlier place; rows of one id are not earlier than each other at the same start."""
    seen: dict[bytes, int] = {}
    one = np.array([seen.setdefault(p, i) for i, p in enumerate(packed)], np.int64)
    return (doc_id[one] != doc_id) | ((own[one] < 0) != (own < 0)) | (start[one] != start)


def _is_large(large: np.ndarray, minis: np.ndarray) -> np.ndarray:
    return large[np.minimum(np.searchsorted(large, minis), len(large) - 1)] == minis if len(large) else np.zeros(len(minis), bool)


def _segmenter(window: int, gram: int, large: np.ndarray, buckets: int, marked: bool):
    """Blocks of the packed strings of all minimisers but the ``large`` ones (sorted)."""

    def segment(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=6).compress
        for batch in batches:
            for ids, marks, c in _chunks(batch, window, gram, marked):
                rest = ~_is_large(large, c.minis)
                bucket = (c.minis.view(np.uint64) >> np.uint64(20)) % np.uint64(buckets)
                order = np.flatnonzero(rest)[np.argsort(bucket[rest], kind="stable")]
                first, behind, doc, start = c.first[order], c.behind[order], c.doc[order], c.start[order]
                packed = [c.text[x:y] for x, y in zip(c.begins[first].tolist(), c.ends[behind + window - 2].tolist())]
                doc_id, own = ids[doc], marks[doc]
                repeat = _known(doc_id, own, start, packed)
                fields = (c.minis[order].astype(np.int32), doc_id, own, start.astype(np.int32), (behind - first).astype(np.int32), c.cyclic[order].astype(np.int32), np.where(repeat, -1, [len(p) for p in packed]).astype(np.int32))
                starts = common.run_starts(bucket[order])
                keys = bucket[order][starts[:-1]].astype(np.int32) if len(order) else np.zeros(0, np.int32)
                blocks = []
                for x, y in zip(starts[:-1].tolist(), starts[1:].tolist()):
                    strings = [p for p, r in zip(packed[x:y], repeat[x:y].tolist()) if not r]
                    blocks.append(squeeze(b"".join([*(f[x:y].tobytes() for f in fields), *strings, np.int32(y - x).tobytes()])))
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(blocks, pa.binary())], ["bucket", "block"])

    return segment


def _unpack(block: bytes) -> tuple[list[np.ndarray], list[bytes | None]]:
    """(mini, doc_id, own, start, windows, cyclic) and the strings; None: windows known to be repeats.

    32 bits of a minimiser are enough within a bucket: windows are compared by their words.
    """
    n, at, fields = int(np.frombuffer(block[-4:], np.int32)[0]), 0, []
    for kind in (np.int32, np.int64, np.int64, *[np.int32] * 4):
        fields.append(np.frombuffer(block, kind, n, at))
        at += fields[-1].nbytes
    strings: list[bytes | None] = []
    for length in fields.pop().tolist():
        strings.append(None if length < 0 else block[at : at + length])
        at += max(length, 0)
    return fields, strings


def _by_window(window: int, gram: int, large: np.ndarray, marked: bool):
    """The windows of ``large`` minimisers one by one, by digest; without: known to be repeats."""

    def cut_up(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, marks, c in _chunks(batch, window, gram, marked):
                chosen = _is_large(large, c.minis)
                n = (c.behind - c.first)[chosen]
                step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                first, start, doc = (np.repeat(x[chosen], n) for x in (c.first, c.start, c.doc))
                first, start = first + step, start + step
                packed = [c.text[x:y] for x, y in zip(c.begins[first].tolist(), c.ends[first + window - 1].tolist())]
                doc_id, own = ids[doc], marks[doc]
                words = [None if r else hashlib.sha256(p).digest() for p, r in zip(packed, _known(doc_id, own, start, packed).tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(doc_id), pa.array(own), pa.array(start.astype(np.int32)), pa.array(words, pa.binary())], ["doc_id", "own", "start", "words"])

    return cut_up


def _bucket_repeats(rows: list[tuple[int, int, int, bytes]], window: int) -> list[tuple[int, int, int, int]]:
    """(doc_id, own, a, b): words a to b - 1 that repeats cover. rows: (doc_id, start, own, packed), of one minimiser.

    Equal strings are taken once: of these, all windows but the first string's are repeats.
    """
    rows.sort(key=lambda r: (r[0], r[2] < 0, *r[1:]))
    out, first, found = [], {}, []
    for doc_id, start, own, packed in rows:
        place = (doc_id, own < 0, start)
        one = first.setdefault(packed, place)
        n = packed.count(b" ") + 2 - window
        if one != place:
            out.append((doc_id, own, start, start + n + window - 1))
            continue
        at = list(accumulate((len(w) + 1 for w in packed.split(b" ")), initial=0))
        found += [(packed[at[i] : at[i + window] - 1], doc_id, own < 0, start + i, own) for i in range(n)]
    found.sort()
    before, earliest = None, None
    for words, doc_id, unnamed, start, own in found:
        if before != words:
            before, earliest = words, (doc_id, unnamed, start)
        elif earliest != (doc_id, unnamed, start):
            out.append((doc_id, own, start, start + window))
    return out


def _comparer(window: int):
    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor().decompress
        for table in common.key_runs(batches, ["bucket"]):
            starts = common.run_starts(table.column("bucket").to_numpy())
            for x, y in zip(starts[:-1].tolist(), starts[1:].tolist()):
                parts = [_unpack(expand(b)) for b in table.column("block").slice(x, y - x).to_pylist()]
                mini, doc_id, own, start, windows, cyclic = map(np.concatenate, zip(*(fields for fields, _ in parts)))
                packed = [p for _, strings in parts for p in strings]
                resolved = np.array([p is None for p in packed])
                known = np.flatnonzero(resolved)
                out = list(zip(doc_id[known].tolist(), own[known].tolist(), start[known].tolist(), (start[known] + windows[known] + window - 1).tolist()))
                order = np.flatnonzero(~resolved)
                order = order[np.argsort(mini[order], kind="stable")]
                runs = common.run_starts(mini[order])
                a, b = runs[:-1], runs[1:]
                looked = (b - a > 1) | ((cyclic[order[a]] > 0) & (windows[order[a]] > 1)) if len(a) else np.zeros(0, bool)
                for i, j in zip(a[looked].tolist(), b[looked].tolist()):
                    own_rows = order[i:j]
                    rows = list(zip(doc_id[own_rows].tolist(), start[own_rows].tolist(), own[own_rows].tolist(), [packed[k] for k in own_rows.tolist()]))
                    out += _bucket_repeats(rows, window)
                columns = list(zip(*_merged(out))) or [(), (), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], ["doc_id", "own", "a", "b"])

    return compare


def _merged(ranges: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Ranges of one document that touch become one."""
    out: list[tuple[int, int, int, int]] = []
    for d, o, a, b in sorted(ranges):
        if out and out[-1][:2] == (d, o) and a <= out[-1][3]:
            out[-1] = (d, o, out[-1][2], max(b, out[-1][3]))
        else:
            out.append((d, o, a, b))
    return out


def repeated_ranges(docs: DataFrame, marked: bool, window: int = WINDOW, gram: int = GRAM, bucket: int = BUCKET, one_in: int = ONE_IN) -> DataFrame:
    """(doc_id, own, a, b): word ranges of ``docs(doc_id, text)`` that repeated windows cover."""
    spark = docs.sparkSession
    source = docs.select("doc_id", "text")
    counted = common.cut(source.mapInArrow(_counter(window, gram, one_in), "mini long, n long").groupBy("mini").agg(F.sum("n").alias("n")).where(F.col("mini").isNull() | (F.col("n") > bucket)))
    size = (counted.where("mini is null").agg(F.sum("n")).collect()[0][0] or 0)
    # Minimisers beyond the bound, of which there are fewer than rows / bucket; beyond the
    # number that may be sent to all executors, the largest ones are taken: the others still
    # meet in their buckets, which only makes those tasks longer.
    large = np.sort(np.array([r[0] for r in counted.where("mini is not null").orderBy(F.desc("n"), "mini").limit(common.BROADCAST_ROWS).collect()], np.int64))
    blocks = source.mapInArrow(_segmenter(window, gram, large, max(16, size // BUCKET_BYTES), marked), BLOCKS)
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // PARTITION_BYTES)
    found = blocks.repartition(partitions, "bucket").sortWithinPartitions("bucket").mapInArrow(_comparer(window), RANGES)
    if not len(large):
        return found
    rows = common.cut(source.mapInArrow(_by_window(window, gram, large, marked), WINDOWS))
    known = rows.where("words is null").select("doc_id", "own", F.col("start").alias("a"), (F.col("start") + window).alias("b"))
    place = F.struct("doc_id", (F.col("own") < 0).alias("unnamed"), "start")
    rows = rows.where("words is not null")
    first = common.cut(rows.groupBy("words").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select("words", "first"))
    again = rows.join(first, "words").where(place != F.col("first"))
    return found.unionByName(known).unionByName(again.select("doc_id", "own", F.col("start").alias("a"), (F.col("start") + window).alias("b")))


def _removed(texts: bool):
    """Cuts the ranges out; ``texts``: with the kept text."""

    def remove(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, digests, kept_texts = [], [], [], []
            for text, ranges in zip(common.bytes_of(batch, "text"), common.rows_of(batch, "ranges")):
                words = (text or b"").split()
                kept, at = [], 0
                for r in sorted((x["a"], x["b"]) for x in ranges or []):
                    kept += words[at : max(at, r[0])]
                    at = max(at, r[1])
                kept += words[at:]
                whole = b" ".join(kept)
                n_words.append(len(words))
                n_removed.append(len(words) - len(kept))
                digests.append(hashlib.sha256(whole).hexdigest())
                if texts:
                    kept_texts.append(whole.decode())
            columns = {"doc_id": batch.column(0), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": pa.array(digests, pa.string())}
            yield pa.RecordBatch.from_pydict(columns | ({"kept": pa.array(kept_texts, pa.string())} if texts else {}))

    return remove


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, bucket: int = BUCKET, texts: bool = True, one_in: int = ONE_IN) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, and with ``texts`` kept) of every row of ``docs(doc_id, text, ...)``.

    A word goes if a window of ``window`` words covers it whose words also start earlier: in
    a smaller doc_id, or earlier in the same document. Null text has no words. A null doc_id
    comes after all others. Rows with the same doc_id, null or not, are one document: a window
    of one is earlier than that of another if it starts at a smaller word, and each row keeps
    what is its own. Texts
    shorter than a window stay whole. Other columns are ignored; no rows: no rows.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ids = source.groupBy("doc_id").agg(F.count("*").alias("n"))
    marked = not ids.where("n > 1 and doc_id is not null").isEmpty()
    ranges = repeated_ranges(source, marked, window, gram, bucket, one_in).groupBy("doc_id", "own").agg(F.collect_list(F.struct("a", "b")).alias("ranges"))
    ranges = common.cut(ranges).withColumnsRenamed({"doc_id": "_id", "own": "_own"})
    common.release(docs.sparkSession)
    own = F.when(F.col("doc_id").isNull(), -1 - _mark(F.col("text"))).otherwise(_mark(F.col("text")) if marked else F.lit(0).cast("long"))
    joined = source.join(ranges, (F.coalesce("doc_id", F.lit(_LAST)) == F.col("_id")) & (own == F.col("_own")), "left")
    return joined.select("doc_id", "text", "ranges").mapInArrow(_removed(texts), "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept string" if texts else ""))


#: For documents with distinct ids.
ORACLE_SQL = r"""with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
 p as (select doc_id, unnest(list_transform(range(1, len(w) - 18), lambda i: array_to_string(w[i:i + 19], ' '))) as words, unnest(range(1, len(w) - 18)) as i from d where len(w) > 19),
 r as (select doc_id, i from p qualify row_number() over (partition by words order by doc_id, i) > 1), c as (select distinct doc_id, unnest(range(i, i + 20)) as i from r),
 u as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as i from d), k as (select doc_id, string_agg(word, ' ' order by i) as kept, count(*) as n from u anti join c using (doc_id, i) group by 1)
 select doc_id, len(w) as n_words, len(w) - coalesce(n, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from d left join k using (doc_id)"""


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(common.table(spark, sf_dir, "documents"), texts=False)
