"""Language identification by a linear-chain conditional random field.

Every word gets a label; a word's score is the sum of the weights of its affixes, its
letter pairs, the word itself and the lexicons that list it, and neighbouring labels
have learned transition scores. Forward-backward gives each word's label probabilities,
also in text that switches languages; a document's score for a language is the mean over
its words with letters. Lines are chains of their own.

Words are not strings here: letters are code points in one array, and words, their hashes
and their features are computed by numpy over blocks of text, once for each distinct word
of a block. Nothing is remembered from block to block.

Training data are a bounded sample: ``TRAIN_DOCS`` labelled documents, of each up to
``TRAIN_WORDS`` words in slices taken over its whole length, words of over ``TRAIN_LETTERS``
bytes left out. Half of the sequences are spliced from two documents, so that transitions
are seen. Everything else covers all text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.llm import common

TRAIN_DOCS, TRAIN_WORDS, TRAIN_LETTERS = 1500, 192, 64
SEQUENCE = 24
BUCKETS = 1 << 16
LEXICON = 300
ROUNDS = 40
#: Characters of one block, and words of one step of the chains.
BLOCK, SEGMENT = 400_000, 128
UNKNOWN = "und"
#: A document whose words' most probable labels have a smaller mean probability is rejected by the pipeline.
LEAST_SCORE = 0.5
#: Scores lie this far below a word's best one at most, so that products of them stay above zero.
DEEPEST = 30.0

PREDICTED = "doc_id long, held_out boolean, lang_pred string, score double"
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (h ^ (h >> np.uint64(29))) * _ODD


@lru_cache(maxsize=1)
def _characters() -> tuple[np.ndarray, np.ndarray]:
    """By code point: 0 other, 1 letter, 2 space, 3 end of line; and the (first) lower-case character."""
    kind, lower = np.zeros(0x110000, np.uint8), np.arange(0x110000, dtype=np.uint32)
    found = [c for c in range(0x110000) if chr(c).isalpha()]
    kind[found] = 1
    lower[found] = [ord(chr(c).lower()[0]) for c in found]
    kind[[9, 11, 12, 13, 32]], kind[10] = 2, 3
    return kind, lower


class Words:
    """The words of some texts: ``doc`` and ``line`` of each word, and its ``type``, -1 without a letter.

    By type, a distinct sequence of lower-case letters: ``hashes``, sorted, and the letters
    ``letters[first : first + length]``. A hash adds up mixed values of (letter, place), 64 bits.
    """

    def __init__(self, texts: list[str]):
        kinds, lower = _characters()
        points = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "replace"), np.uint32)
        kind = kinds[points]
        space = kind >= 2
        begins = ~space
        begins[1:] &= space[:-1]
        at = np.flatnonzero(begins)
        self.doc = np.searchsorted(np.cumsum([0] + [len(t) + 1 for t in texts[:-1]]), at, "right") - 1
        self.line = np.cumsum(kind == 3)[at]
        spelt = np.flatnonzero(kind == 1)
        letters = lower[points[spelt]]
        limits = np.searchsorted(spelt, np.append(at, len(points)))
        length = np.diff(limits)
        place = np.arange(len(letters)) - np.repeat(limits[:-1], length)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mixed(letters.astype(np.uint64) * _ODD + place.astype(np.uint64)))])
        lettered = np.flatnonzero(length)
        self.hashes, one, where = np.unique((total[limits[1:]] - total[limits[:-1]])[lettered], return_index=True, return_inverse=True)
        self.type = np.full(len(at), -1)
        self.type[lettered] = where
        self.letters, self.first, self.length = letters, limits[:-1][lettered[one]], length[lettered[one]]


def features(words: Words, lexicons: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, type) of the features of every type: the word, prefixes of 1 to 3 letters, suffixes of 1 to 4, pairs, lexicons."""
    n, first, length = len(words.hashes), words.first, words.length
    every = np.arange(n)
    buckets, owners = [_mixed(words.hashes ^ np.uint64(1))], [every]
    for kind, sizes in ((2, (1, 2, 3)), (3, (1, 2, 3, 4))):
        h = np.full(n, kind, np.uint64)
        for size in sizes:
            at = first + size - 1 if kind == 2 else first + length - size
            h = _mixed(h * _ODD + words.letters[np.clip(at, 0, max(0, len(words.letters) - 1))].astype(np.uint64)) if n else h
            long_enough = length >= size
            buckets.append(h[long_enough])
            owners.append(every[long_enough])
    inside = np.repeat(first - np.cumsum(length) + length, length) + np.arange(length.sum())
    own = words.letters[inside].astype(np.uint64)
    owner = np.repeat(every, length)
    ends = np.cumsum(length)
    before, after = np.concatenate([np.zeros(1, np.uint64), own[:-1]])[: len(own)], np.concatenate([own[1:], np.zeros(1, np.uint64)])[: len(own)]
    before[ends - length], after[ends - 1] = 0, 0
    buckets += [_mixed((before << np.uint64(24) | own) * _ODD + np.uint64(4)), _mixed((own[ends - 1] << np.uint64(24)) * _ODD + np.uint64(4))]
    owners += [owner, every]
    for i, listed in enumerate(lexicons):
        found = np.flatnonzero(np.isin(words.hashes, listed))
        buckets.append(_mixed(np.full(len(found), 16 + i, np.uint64)))
        owners.append(found)
    return (np.concatenate(buckets) >> np.uint64(48)).astype(np.int64) % BUCKETS, np.concatenate(owners)


def forward_backward(emission: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label probabilities (n, t, l) and expected transitions (l, l) of equally long chains; inputs exponentiated."""
    n, t, k = emission.shape
    a, b = np.empty_like(emission), np.empty_like(emission)
    a[:, 0] = emission[:, 0] / emission[:, 0].sum(1, keepdims=True)
    for i in range(1, t):
        x = (a[:, i - 1] @ transition) * emission[:, i]
        a[:, i] = x / x.sum(1, keepdims=True)
    b[:, -1] = 1
    for i in range(t - 2, -1, -1):
        x = (emission[:, i + 1] * b[:, i + 1]) @ transition.T
        b[:, i] = x / x.sum(1, keepdims=True)
    p = a * b
    p /= p.sum(2, keepdims=True)
    moves = np.zeros((k, k))
    for i in range(1, t):
        ahead = emission[:, i] * b[:, i]
        scale = np.einsum("ni,ij,nj->n", a[:, i - 1], transition, ahead)
        moves += np.einsum("ni,nj->ij", a[:, i - 1] / scale[:, None], ahead) * transition
    return p, moves


def chain_probabilities(e: np.ndarray, starts: np.ndarray, transition: np.ndarray, segment: int = SEGMENT) -> np.ndarray:
    """Label probabilities of the words of chains that begin at ``starts``; word scores and transitions exponentiated.

    Chains are cut into segments, all of which advance together. What a segment hands to the
    next is a product of matrices, so a chain of any length takes ``segment`` steps and one
    more for each of its segments.
    """
    n, k = e.shape
    if not n:
        return e
    length = np.diff(np.append(starts, n))
    pieces = -(-length // segment)
    chain = np.repeat(np.arange(len(starts)), pieces)
    number = np.arange(len(chain)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    size = np.minimum(segment, length[chain] - number * segment)
    order = np.argsort(-size, kind="stable")
    first, size = (starts[chain] + number * segment)[order], size[order]
    active = np.searchsorted(-size, -np.arange(1, size[0] + 1), side="right")  # segments with a word t
    at = np.concatenate([first[:m] + t for t, m in enumerate(active)])  # words by step, then segment
    behind = np.cumsum(active)
    e = e[at]
    into, back = np.ones((len(order), k)), np.ones((len(order), k))
    if pieces.max() > 1:
        _hand_over(e, behind, active, order, chain, number, pieces, transition, into, back)
    p = np.empty_like(e)
    now = into
    for t, m in enumerate(active):
        here = slice(behind[t] - m, behind[t])
        now = (now[:m] @ transition if t else now[:m]) * e[here]
        now /= now.sum(1, keepdims=True)
        p[here] = now
    ahead = back.copy()
    for t in range(len(active) - 1, -1, -1):
        m, here = active[t], slice(behind[t] - active[t], behind[t])
        p[here] *= ahead[:m]
        x = (e[here] * ahead[:m]) @ transition.T
        ahead[:m] = x / x.sum(1, keepdims=True)
    p /= p.sum(1, keepdims=True)
    out = np.empty_like(p)
    out[at] = p
    return out


def _hand_over(e, behind, active, order, chain, number, pieces, transition, into, back) -> None:
    """Fills what long chains' segments get from the segment before (``into``) and behind (``back``)."""
    k = e.shape[1]
    product = np.tile(np.eye(k), (len(order), 1, 1))
    for t, m in enumerate(active):
        here = product[:m] @ transition if t else product[:m]
        here = here * e[behind[t] - m : behind[t], None, :]
        product[:m] = here / here.max((1, 2), keepdims=True)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))  # of a segment, in chain order
    opening = np.cumsum(pieces) - pieces
    for step in range(1, int(pieces.max())):
        some = opening[pieces > step]
        x = np.einsum("ni,nij->nj", into[place[some + step - 1]], product[place[some + step - 1]]) @ transition
        into[place[some + step]] = x / x.sum(1, keepdims=True)
        last = (opening + pieces)[pieces > step] - step  # of those behind which ``back`` is known
        x = np.einsum("nij,nj->ni", product[place[last]], back[place[last]]) @ transition.T
        back[place[last - 1]] = x / x.sum(1, keepdims=True)


@dataclass
class Crf:
    labels: list[str]
    lexicons: list[np.ndarray]
    weights: np.ndarray
    transition: np.ndarray

    def scores(self, words: Words) -> np.ndarray:
        """Exponentiated scores of the types, the largest of each 1."""
        bucket, owner = features(words, self.lexicons)
        s = np.stack([np.bincount(owner, self.weights[bucket, j], len(words.hashes)) for j in range(len(self.labels))], 1)
        return np.exp(np.maximum(s - s.max(1, keepdims=True), -DEEPEST)) if len(s) else s

    def sums(self, texts: list[str]) -> np.ndarray:
        """By text: the sums of label probabilities over words with letters, their number, and the sum of their largest."""
        k, words = len(self.labels), Words(texts)
        out = np.zeros((len(texts), k + 2))
        if not len(words.doc):
            return out
        e = np.concatenate([self.scores(words), np.ones((1, k))])[words.type]
        p = chain_probabilities(e, common.run_starts(words.line)[:-1], self.transition)
        counted = words.type >= 0
        doc, p = words.doc[counted], p[counted]
        for j in range(k):
            out[:, j] = np.bincount(doc, p[:, j], len(texts))
        out[:, k] = np.bincount(doc, minlength=len(texts))
        out[:, k + 1] = np.bincount(doc, p.max(1) if len(p) else None, len(texts))
        return out


def slices(text: str) -> list[str]:
    """Up to ``TRAIN_WORDS`` words with letters of a text, in slices of ``SEQUENCE`` over its whole length."""
    words = [w for w in text.split() if len(w) <= TRAIN_LETTERS and any(map(str.isalpha, w))]
    step = max(SEQUENCE, len(words) // (TRAIN_WORDS // SEQUENCE))
    found = (words[at : at + SEQUENCE] for at in range(0, len(words), step))
    return [" ".join(part) for part in found if len(part) >= min(4, len(words))][: TRAIN_WORDS // SEQUENCE]


def train(texts: list[tuple[str, str]], rounds: int = ROUNDS, penalty: float = 1e-3) -> Crf | None:
    """From (text, language); None without any language. Full-batch likelihood, Adam, fixed seed."""
    labels = sorted({lang for _, lang in texts})
    if not labels:
        return None
    rng = np.random.default_rng(7)
    parts = [(part, labels.index(lang)) for text, lang in texts for part in slices(text)]
    if not parts:
        return Crf(labels, [], np.zeros((BUCKETS, len(labels))), np.ones((len(labels),) * 2))
    words = Words([part for part, _ in parts])
    runs = common.run_starts(words.doc)
    x = np.stack([np.resize(words.type[a:b], SEQUENCE) for a, b in zip(runs[:-1], runs[1:])])
    y = np.repeat(np.array([label for _, label in parts])[:, None], SEQUENCE, 1)
    k, n = len(labels), len(words.hashes)
    # each language's most frequent words, as (sorted) hashes
    of = [np.bincount(x[y[:, 0] == j].ravel(), minlength=n) for j in range(k)]
    common_ones = [np.lexsort((np.arange(n), -c))[:LEXICON] for c in of]
    lexicons = [np.sort(words.hashes[top[c[top] > 0]]) for c, top in zip(of, common_ones)]
    other, cut = rng.permutation(len(x)), rng.integers(4, SEQUENCE - 3, len(x))
    spliced = (rng.random(len(x)) < 0.5)[:, None] & (np.arange(SEQUENCE) >= cut[:, None])
    x, y = np.where(spliced, x[other], x), np.where(spliced, y[other], y)
    bucket, owner = features(words, lexicons)
    w, t = np.zeros((BUCKETS, k)), np.zeros((k, k))
    seen = np.zeros((k, k))
    np.add.at(seen, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
    true = np.stack([np.bincount(x[y == j], minlength=n) for j in range(k)], 1)
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(t), np.zeros_like(t)]
    for step in range(1, rounds + 1):
        s = np.stack([np.bincount(owner, w[bucket, j], n) for j in range(k)], 1)
        e = np.exp(np.maximum(s - s.max(1, keepdims=True), -DEEPEST))[x]
        p, moves = forward_backward(e, np.exp(t))
        expected = np.stack([np.bincount(x.ravel(), p[:, :, j].ravel(), n) for j in range(k)], 1)
        of_word = (true - expected) / len(x)
        gw = np.stack([np.bincount(bucket, of_word[owner, j], BUCKETS) for j in range(k)], 1) - penalty * w / SEQUENCE
        gt = (seen - moves) / len(x) - penalty * t
        for value, gradient, m, v, rate in ((w, gw, state[0], state[1], 0.1), (t, gt, state[2], state[3], 0.1)):
            m += 0.1 * (gradient - m)
            v += 0.01 * (gradient**2 - v)
            value += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    return Crf(labels, lexicons, w, np.exp(t))


def sample_of(docs: DataFrame) -> list[tuple[str, str]]:
    """The bounded training sample: slices of labelled rows that are not held out, first by a hash of their id.

    Equal rows (id, text and language) count once. A row's slices have ``TRAIN_WORDS`` words at
    most, so what the driver gets is bounded whatever the texts are.
    """
    mark = [F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_text"), F.col("lang").alias("_lang")]
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~F.col("held_out")).select("text", *mark)
    own = ["_id", "_text", "_lang"]
    chosen = common.cut(labelled.select(*own).distinct().orderBy(F.xxhash64("_id"), *own).limit(TRAIN_DOCS))
    same = [F.col(c).eqNullSafe(F.col(f"{c}2")) for c in own]
    texts = labelled.join(F.broadcast(chosen.withColumnsRenamed({c: f"{c}2" for c in own})), same)

    def reduce(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            short = [" \n".join(slices(t)) for t in common.rows_of(batch, "text")]
            yield batch.set_column(0, "text", pa.array(short, pa.string()))

    short = texts.select("text", *own).mapInArrow(reduce, "text string, _id long, _text long, _lang string")
    return sorted(map(tuple, short.groupBy(*own).agg(F.first("text").alias("text")).select("text", "_lang").collect()))


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of ``docs(doc_id, text, lang, ...)``.

    Held out: crc32 of doc_id as text is divisible by 5 (null id: not held out); such rows teach
    nothing. ``und`` with score 0: null text, no letter, or no labelled row to learn from. Rows
    that repeat an id are judged one by one. Other columns are ignored; no rows: no rows.
    """
    rows = _read(docs)
    model = docs.sparkSession.sparkContext.broadcast(train(sample_of(rows)))

    @common.kernel
    def predict(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, names, score, _ in _judged(batches, model.value):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(names, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    return rows.select("doc_id", "text", "held_out").mapInArrow(predict, PREDICTED)


def _read(docs: DataFrame) -> DataFrame:
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), held.alias("held_out"))


def blocks(texts: Iterable[str | None], size: int) -> Iterator[tuple[list[int], list[str]]]:
    """(numbers, texts) of about ``size`` characters; longer texts are cut between lines."""
    numbers, some, held = [], [], 0
    for number, text in enumerate(texts):
        at = 0
        while text and at < len(text):
            end = len(text)
            if end - at > size:
                end = text.rfind("\n", at, at + size) + 1 or text.find("\n", at + size) + 1 or end
            numbers.append(number)
            some.append(text[at:end])
            held += end - at
            at = end
            if held >= size:
                yield numbers, some
                numbers, some, held = [], [], 0
    if some:
        yield numbers, some


def _judged(batches: Iterable[pa.RecordBatch], crf: Crf | None) -> Iterator[tuple[pa.RecordBatch, list[str], np.ndarray, np.ndarray]]:
    """Batches with the language and score of each row, and how surely its words are labelled."""
    for batch in batches:
        sums = np.zeros((batch.num_rows, len(crf.labels) + 2 if crf else 3))
        if crf:
            for numbers, texts in blocks(common.rows_of(batch, "text"), BLOCK):
                np.add.at(sums, numbers, crf.sums(texts))
        best, n = sums[:, :-2].argmax(1), sums[:, -2]
        score = np.where(n > 0, sums[np.arange(len(n)), best] / np.maximum(n, 1), 0.0)
        names = [crf.labels[b] if m > 0 else UNKNOWN for b, m in zip(best, n)]
        yield batch, names, np.clip(score, 0, 1), sums[:, -1] / np.maximum(n, 1)


def keep_identified(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows whose language can't be told; ids may repeat or be null.

    That is ``und``, or words whose most probable labels have a mean probability under
    ``LEAST_SCORE``: text that mixes languages stays if its words are surely labelled.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(sample_of(_read(docs))))

    @common.kernel
    def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, names, _, sure in _judged(batches, model.value):
            yield batch.filter(pa.array([name != UNKNOWN and s >= LEAST_SCORE for name, s in zip(names, sure)], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(common.table(spark, sf_dir, "documents"))
