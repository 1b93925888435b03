"""Vector best-fit packing of token sequences.

Every open sequence has three residual capacities: tokens, documents and attention cost
(the sum of squared piece lengths). Pieces, longest first, go to the open sequence that
satisfies every constraint and scores best, by the weighted norm of what would be left or
by the weighted dot product of demand and residual; if none can take the piece, a
sequence is opened. Sequences are held by their residuals: a bound on the score of every level of
residual tokens tells which levels can hold the best one, so the choice is exact.

Pieces are dealt into groups of about ``GROUP`` by a hash of the document, and each group
is packed by one task: the loss is at most one partly filled sequence for each group.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerlake.llm import common

TOKENS = 2048
GROUP = 100_000
#: Units whose ids a worker remembers, and bytes of text that are looked up at once.
REMEMBERED, CHUNK = 700_000, 500_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACES = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def _kinds() -> np.ndarray:
    """By byte: 0 white space, 1 ASCII letter, 2 digit, 3 punctuation, 4 apostrophe, 5 not ASCII."""
    kinds = np.full(256, 3, np.uint8)
    kinds[[9, 10, 11, 12, 13, 32]] = 0
    kinds[[c for c in range(128) if chr(c).isalpha()]] = 1
    kinds[48:58] = 2
    kinds[39] = 4
    kinds[128:] = 5
    return kinds


KINDS = _kinds()


class UnitIds:
    """Token ids of whole texts, by units that repeat.

    The tokenizer never joins what white space parts, nor a letter, a digit or punctuation
    with another of these (next to an apostrophe or a byte beyond ASCII it may, so nothing is
    cut there), and it takes upper case for lower. So a text's ids are those of its units in
    order, and each unit is given to the tokenizer once. A unit is looked up by 64 hash bits and
then compared byte by byte; a text with a unit that only shares its hash goes to the tokenizer whole.
    A letter may become a letter and a mark in lower case (U+0130 does), and the tokenizer
    parts these: only units that are letters in lower case too are one word for certain.
    Texts with combining marks, which may compose with a letter of one case only, and texts
    with control strings are given to the tokenizer whole.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.hashes = np.zeros(0, np.uint64)  # sorted
        self.offset = self.length = np.zeros(0, np.int32)  # of a unit's ids in the pool
        self.pool = np.zeros(0, np.uint32)
        self.at = self.size = np.zeros(0, np.int32)  # of a unit's own bytes
        self.spelt = np.zeros(0, np.uint8)

    def _learn(self, hashes: np.ndarray, units: list[str]) -> None:
        """Adds units; ``hashes`` are sorted and new."""
        plain = [u.isalpha() and max(u) < "\u0250" and u.lower().isalpha() for u in units]
        simple = [u for u, p in zip(units, plain) if p]
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(simple)], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(simple):  # one of them isn't one word of the tokenizer
            plain, ids, ends = [False] * len(units), ids[:0], ends[:0]
        other = [u for u, p in zip(units, plain) if not p]
        odd = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(other, add_special_tokens=False)]
        length = np.zeros(len(units), np.int64)
        offset = np.zeros(len(units), np.int64)
        mask = np.array(plain)
        length[mask] = np.diff(ends, prepend=0)
        offset[mask] = ends - length[mask]
        length[~mask] = [len(x) for x in odd]
        offset[~mask] = len(ids) + np.cumsum(length[~mask]) - length[~mask]
        at = np.searchsorted(self.hashes, hashes)
        spelt = [u.encode() for u in units]
        size = np.array([len(b) for b in spelt])
        self.at = np.insert(self.at, at, np.cumsum(size) - size + len(self.spelt))
        self.size = np.insert(self.size, at, size)
        self.spelt = np.concatenate([self.spelt, np.frombuffer(b"".join(spelt), np.uint8)])
        self.offset = np.insert(self.offset, at, offset + len(self.pool))
        self.length = np.insert(self.length, at, length)
        self.hashes = np.insert(self.hashes, at, hashes)
        self.pool = np.concatenate([self.pool, ids, *odd])

    def __call__(self, texts: list[bytes]) -> tuple[list[np.ndarray], list[int]]:
        """Ids of each text, and the texts whose ids aren't theirs: a unit's hash is that of another."""
        raw = np.frombuffer(b"\n".join(t.lower() for t in texts) + b"\n", np.uint8)
        kind = KINDS[raw]
        now, after = kind[:-1], kind[1:]
        split = (now != after) | (now == 2)  # digits are tokens of their own
        split &= (now < 4) & (after < 4)
        begins = np.flatnonzero((kind > 0) & np.concatenate([[True], split | (now == 0)]))
        ends = np.flatnonzero((kind > 0) & np.concatenate([split | (after == 0), [True]])) + 1
        power, inverse = powers(len(raw) + 1)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[: len(raw)])])
        found, first, where = np.unique((total[ends] - total[begins]) * inverse[begins], return_index=True, return_inverse=True)
        if len(self.hashes) + len(found) > REMEMBERED:
            self.forget()
        at = np.searchsorted(self.hashes, found)
        new = np.ones(len(found), bool)
        if len(self.hashes):
            new = self.hashes[np.minimum(at, len(self.hashes) - 1)] != found
        if new.any():
            text = raw.tobytes()
            self._learn(found[new], [text[x:y].decode() for x, y in zip(begins[first[new]].tolist(), ends[first[new]].tolist())])
            at = np.searchsorted(self.hashes, found)
        row = at[where]
        size = ends - begins
        other = self.size[row] != size
        known = np.repeat(self.at[row] - np.cumsum(size) + size, size) + np.arange(size.sum())
        differs = self.spelt[np.minimum(known, len(self.spelt) - 1)] != raw[kind > 0] if len(size) else np.zeros(0, bool)
        if differs.any():
            other |= np.add.reduceat(differs, np.cumsum(size) - size) > 0
        limits = np.searchsorted(begins, np.cumsum([len(t) + 1 for t in texts]))
        wrong = np.unique(np.searchsorted(limits, np.flatnonzero(other), "right")).tolist()
        length = self.length[row].astype(np.int64)
        behind = np.cumsum(length)
        ids = self.pool[np.repeat(self.offset[row] - behind + length, length) + np.arange(behind[-1] if len(behind) else 0)]
        cuts = np.concatenate([[0], behind])[limits]
        return (np.split(ids, cuts[:-1]) if texts else []), wrong

    def batch(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each text; odd texts go to the tokenizer whole."""
        odd = [i for i, t in enumerate(texts) if b"<|" in t or b"\xcc" in t or b"\xcd" in t]
        left = set(odd)
        out, wrong = self([b"" if i in left else t for i, t in enumerate(texts)] if odd else texts)
        for i in odd + wrong:
            out[i] = np.array(self.tokenizer.encode_batch_fast([texts[i].decode()], add_special_tokens=False)[0].ids, np.uint32)
        return out


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``n`` powers, or more, of an odd number and of its inverse modulo 2^64; only the usual number of them is kept."""
    return _usual_powers() if n <= 1 << 20 else _powers(n)


@lru_cache(maxsize=1)
def _usual_powers() -> tuple[np.ndarray, np.ndarray]:
    return _powers(1 << 20)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    odd = 0x9E3779B97F4A7C15
    both = (np.uint64(odd), np.uint64(pow(odd, -1, 1 << 64)))
    return tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, m, np.uint64)])) for m in both)


@lru_cache(maxsize=2)
def unit_ids(path: str) -> UnitIds:
    """One for each worker and tokenizer: what it remembers serves all tasks of the worker."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return UnitIds(path)


def pieces(docs: DataFrame, tokenizer: str, tokens: int = TOKENS, end_id: int = 0) -> DataFrame:
    """The token pieces of ``docs(doc_id, text, ...)``; only documents beyond ``tokens`` are cut."""
    mark = np.array([end_id], dtype="<u4").tobytes()

    @common.kernel
    def cut_up(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = unit_ids(tokenizer)
        types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        for batch in batches:
            doc_ids, texts = common.rows_of(batch, "doc_id"), [t or b"" for t in common.bytes_of(batch, "text")]
            some, size = 0, 0
            for i, text in enumerate(texts, 1):
                size += len(text)
                if size > CHUNK or i == len(texts):
                    rows: list[list] = [[], [], [], [], []]
                    for doc_id, ids in zip(doc_ids[some:i], ids_of.batch(texts[some:i])):
                        ids = ids.astype("<u4").tobytes() + mark
                        for number, at in enumerate(range(0, len(ids), 4 * tokens)):
                            part = ids[at : at + 4 * tokens]
                            for column, value in zip(rows, (doc_id, number, at // 4, len(part) // 4, zlib.crc32(part))):
                                column.append(value)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types)], ["doc_id", "piece", "start", "length", "ids_crc32"])
                    some, size = i, 0

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut_up, PIECES)


class Packer:
    """Best fit under the capacities (tokens, documents, attention cost).

    Open sequences are held by level (residual tokens), then by their other residuals, so that
    equal ones are scored once. ``bound`` has the best other residuals of each level: with
    them no sequence of a level scores better than the level's bound, and levels are searched
    in the order of their bounds until no other can hold a better one.
    """

    def __init__(self, capacities: tuple[int, int, int], weights: tuple[float, float, float] = (1.0, 0.05, 0.05), rule: str = "norm"):
        if rule not in ("norm", "dot"):
            raise ValueError(f"unknown rule {rule!r}")
        self.capacities, self.weights, self.rule = capacities, weights, rule
        self.best = min if rule == "norm" else max
        self.left: list[tuple[int, int, int]] = []
        self.levels: list[dict[tuple[int, int], list[int]]] = [{} for _ in range(capacities[0] + 1)]
        self.bound = np.full((3, capacities[0] + 1), np.nan)
        self.bound[0] = np.arange(capacities[0] + 1)

    def score(self, left, demand: tuple[int, int, int]):
        """Smaller is better; ``left`` are residuals or arrays of them."""
        parts = zip(self.weights, demand, left, self.capacities)
        if self.rule == "dot":
            return -sum(w * (d / c) * (r / c) for w, d, r, c in parts)
        return sum(w * ((r - d) / c) ** 2 for w, d, r, c in parts)

    def choose(self, demand: tuple[int, int, int]) -> tuple[int, tuple[int, int]] | None:
        """(level, other residuals) of the feasible sequence that scores best; of equal ones that with the fewest tokens left."""
        left = self.bound[:, demand[0] :]
        if self.rule == "norm":  # what is infeasible scores no better than what just fits
            left = np.maximum(left, np.array(demand)[:, None])
        bounds = np.nan_to_num(self.score(left, demand), nan=np.inf)
        best, found = np.inf, None
        while (at := int(bounds.argmin()), bounds[at] < best)[1]:
            level = at + demand[0]
            for other in self.levels[level]:
                if other[0] >= demand[1] and other[1] >= demand[2] and (value := self.score((level, *other), demand)) < best:
                    best, found = value, (level, other)
            bounds[at] = np.inf
        return found

    def _open(self, level: int, other: tuple[int, int], bin_id: int) -> None:
        self.levels[level].setdefault(other, []).append(bin_id)
        self._bound(level)

    def _bound(self, level: int) -> None:
        held = self.levels[level]
        self.bound[1:, level] = [self.best(x) for x in zip(*held)] if held else np.nan

    def _take(self, level: int, other: tuple[int, int]) -> int:
        own = self.levels[level][other]
        bin_id = own.pop()
        if not own:
            del self.levels[level][other]
            self._bound(level)
        return bin_id

    def place(self, length: int) -> tuple[int, int]:
        """(sequence, offset) of a piece."""
        demand = (length, 1, length * length)
        if any(d > c for d, c in zip(demand, self.capacities)):
            raise ValueError(f"a piece of {length} tokens exceeds a capacity")
        at = self.choose(demand)
        if at is None:
            bin_id, left = len(self.left), self.capacities
            self.left.append(left)
        else:
            bin_id = self._take(*at)
            left = self.left[bin_id]
        self.left[bin_id] = now = (left[0] - demand[0], left[1] - 1, left[2] - demand[2])
        if all(now):
            self._open(now[0], now[1:], bin_id)
        return bin_id, self.capacities[0] - left[0]


def pack(parts: DataFrame, tokens: int = TOKENS, documents: int | None = None, attention: int | None = None, weights: tuple[float, float, float] = (1.0, 0.05, 0.05), rule: str = "norm") -> DataFrame:
    """``parts`` (already cut) with sequence_id and offset.

    The default capacities for documents and attention cost hold for any sequence that the
    tokens allow, so they cost no sequences; smaller ones bind. Rows repeated in ``parts`` and
    rows without id are packed one by one and dealt over the groups like any others; equally
    long pieces go by document and piece, nulls first; no rows: no rows.
    """
    capacities = (tokens, documents or tokens, attention or tokens * tokens)
    groups = max(1, -(-parts.count() // GROUP))

    def pack_group(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        length = group.column("length").to_numpy()
        packer = Packer(capacities, weights, rule)
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        doc_id, piece = (group.column(c).fill_null(-1).to_numpy() for c in ("doc_id", "piece"))
        for i in np.lexsort((piece, doc_id, -length)):
            sequence[i], offset[i] = packer.place(int(length[i]))
        group = group.drop_columns(["part"])
        return group.append_column("sequence_id", pa.array(sequence + (key[0].as_py() << 32))).append_column("offset", pa.array(offset))

    dealt = parts.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", F.monotonically_increasing_id()), F.lit(groups)).cast("long"))
    return dealt.groupBy("part").applyInArrow(pack_group, PLACES)


def pack_documents(docs: DataFrame, tokenizer: str | None = None, **capacities) -> DataFrame:
    """Pieces of ``docs(doc_id, text, ...)`` and their places, as ``pieces`` and ``pack`` say.

    Null text counts as empty: one piece, the end id. Rows that repeat an id, or have none, are
    documents of their own. Other columns are ignored; no rows: no rows.
    """
    parts = common.cut(pieces(docs, tokenizer or public_tokenizers.path("word_bpe_49k.json"), capacities.get("tokens", TOKENS)))
    return pack(parts, **capacities)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(common.table(spark, sf_dir, "documents"))
