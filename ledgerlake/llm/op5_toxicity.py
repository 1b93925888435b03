"""Toxicity by a counterfactual-regularised classifier.

Logistic regression over a document's distinct words, each with the features word and
prefixes, so that inflected forms of a stem share weights. Only features that are surely more
frequent in toxic text are used. For labelled sentences that name a group, the name
is swapped for other groups' names, and the squared change of the score is part of the
loss: a neutral mention of any group scores like a mention of any other. The names are a
parameter; by default they are those of ``IDENTITIES``, in the corpus's four languages.

A score reads the text alone. It adds up word weights over distinct words, so repeated
or long text doesn't drown a word, and workers remember the weight of each word.
Training data are a bounded sample of labelled rows: ``TRAIN_TOXIC`` and ``TRAIN_OTHER``, with
their whole texts. Their features and swaps are counted by Spark; what the driver gets are the
chosen features, for each row the numbers of those it has, and a count for each kind of swap.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.llm import common

TRAIN_TOXIC, TRAIN_OTHER = 2000, 3000
PREFIXES = (4, 5, 6, 7)
#: A feature is used if its smoothed odds ratio, less two standard errors of its logarithm, reaches this.
LEAST_ODDS = 3.5
ROUNDS = 500
THRESHOLD = 0.7
REMEMBERED = 300_000

Groups = tuple[tuple[str, ...], ...]
#: Names of groups, by language and kind; swaps stay within a line.
IDENTITIES: Groups = (
    ("women", "men", "girls", "boys", "transgender"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "african", "european", "american", "mexican", "chinese"),
    ("gay", "lesbian", "bisexual", "straight", "queer"),
    ("immigrant", "refugee", "foreigner", "native"),
    ("blind", "deaf", "disabled", "elderly", "young"),
    ("frauen", "männer", "mädchen", "jungen", "transgeschlechtliche"),
    ("muslime", "christen", "juden", "hindus", "buddhisten", "atheisten"),
    ("schwarze", "weiße", "asiaten", "afrikaner", "europäer", "amerikaner", "türken", "polen"),
    ("schwule", "lesben", "bisexuelle", "heterosexuelle"),
    ("einwanderer", "flüchtlinge", "ausländer", "einheimische"),
    ("blinde", "gehörlose", "behinderte", "alte", "junge"),
    ("femmes", "hommes", "filles", "garçons", "transgenres"),
    ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées"),
    ("noirs", "blancs", "asiatiques", "arabes", "africains", "européens", "américains"),
    ("gays", "lesbiennes", "bisexuels", "hétérosexuels"),
    ("immigrés", "réfugiés", "étrangers", "autochtones"),
    ("aveugles", "sourds", "handicapés", "vieux", "jeunes"),
    ("mujeres", "hombres", "niñas", "niños", "transexuales"),
    ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos"),
    ("negros", "blancos", "asiáticos", "latinos", "africanos", "europeos", "gitanos"),
    ("homosexuales", "lesbianas", "bisexuales", "heterosexuales"),
    ("inmigrantes", "refugiados", "extranjeros", "nativos"),
    ("ciegos", "sordos", "discapacitados", "ancianos", "jóvenes"),
)

_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[.!?\n]+")
SCORED = "doc_id long, held_out boolean, score double, predicted int"


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def word_features(word: str) -> list[str]:
    return [f"={word}"] + [word[:n] for n in PREFIXES if len(word) >= n]


@dataclass
class Model:
    bias: float
    weights: dict[str, float]

    def word(self, word: str) -> float:
        return sum(self.weights.get(f, 0.0) for f in word_features(word))

    def score(self, words: Iterable[str]) -> float:
        z = self.bias + sum(map(self.word, words))
        return 1 / (1 + np.exp(-min(500.0, max(-500.0, z))))


def swaps(sentence: str, groups: Groups) -> Iterator[tuple[str, str]]:
    """(what goes, what comes) for each name in a sentence and each other of its line; nothing comes if the other stands there already."""
    words = words_of(sentence)
    for line in groups:
        for name in words.intersection(line):
            for other in line:
                if other != name:
                    yield name, "" if other in words else other


def training_sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(_id, toxic, text) of the bounded training sample, first by a hash of the id; of rows that share an id the one whose text has the least hash."""
    usable = labels.where("toxic is not null and doc_id is not null").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)
    usable = usable.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    parts = [usable.where(f"toxic {test}").orderBy(F.xxhash64("_id"), "_id").limit(most) for test, most in (("= 1", TRAIN_TOXIC), ("= 0", TRAIN_OTHER))]
    chosen = common.cut(parts[0].unionByName(parts[1]))
    found = docs.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    return common.cut(found.groupBy("_id", "toxic").agg(F.min_by(F.coalesce("text", F.lit("")), F.xxhash64("text")).alias("text")))


def _features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """By feature the numbers of toxic and other rows that have it."""
    for batch in batches:
        counts = (Counter(), Counter())
        for text, y in zip(common.rows_of(batch, "text"), common.rows_of(batch, "toxic")):
            counts[y].update({f for w in words_of(text) for f in word_features(w)})
        names = list(counts[1])  # a feature that no toxic row has is of no use
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([counts[1][f] for f in names], pa.int64()), pa.array([counts[0][f] for f in names], pa.int64())], ["feature", "p", "q"])
        rest = [f for f in counts[0] if f not in counts[1]]
        yield pa.RecordBatch.from_arrays([pa.array(rest, pa.string()), pa.array([0] * len(rest), pa.int64()), pa.array([counts[0][f] for f in rest], pa.int64())], ["feature", "p", "q"])


def chosen_features(sample: DataFrame, toxic: int, other: int) -> list[str]:
    """The features that are surely more frequent in toxic rows, in order."""
    counted = sample.mapInArrow(_features, "feature string, p long, q long").groupBy("feature").agg(F.sum("p").alias("p"), F.sum("q").alias("q")).where("p > 1")
    odds = lambda n, total: (F.col(n) + 0.5) / (total - F.col(n) + 0.5)
    sure = F.log(odds("p", toxic) / odds("q", other)) - 2 * F.sqrt(1 / (F.col("p") + 0.5) + 1 / (F.col("q") + 0.5))
    return sorted(r[0] for r in counted.where(sure >= float(np.log(LEAST_ODDS))).select("feature").collect())


def _swapped(groups: Groups):
    """Kinds of swaps in sentences that name groups, counted."""
    pattern = re.compile(r"(?<!\w)(?:" + "|".join(sorted({re.escape(n) for line in groups for n in line})) + r")(?!\w)", re.IGNORECASE)

    def swapped(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter = Counter()
            for text in common.rows_of(batch, "text"):
                if groups and pattern.search(text):
                    for sentence in _SENTENCE.split(text):
                        found.update(swaps(sentence, groups))
            columns = list(zip(*found)) or [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(list(found.values()), pa.int64())], ["name", "other", "n"])

    return swapped


def counted_swaps(sample: DataFrame, groups: Groups) -> list[tuple[str, str, int]]:
    """(what goes, what comes, how often); as many rows as there are pairs of names in ``groups`` at most, and a few."""
    counted = sample.mapInArrow(_swapped(groups), "name string, other string, n long").groupBy("name", "other").agg(F.sum("n").alias("n"))
    return sorted(map(tuple, counted.collect()))


def _encoded(sample: DataFrame, features: list[str]) -> list[tuple[int, list[int]]]:
    """By row its label and the numbers of the features it has, one for each word that has it."""
    sent = sample.sparkSession.sparkContext.broadcast({f: i for i, f in enumerate(features)})

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = sent.value
        for batch in batches:
            rows = [sorted(ids[f] for w in words_of(text) for f in word_features(w) if f in ids) for text in common.rows_of(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("toxic")), pa.array(rows, pa.list_(pa.int32()))], ["toxic", "found"])

    return sorted((y, list(found)) for y, found in sample.mapInArrow(encode, "toxic int, found array<int>").collect())


def fit(rows: list[tuple[int, list[int]]], features: list[str], swapped: list[tuple[str, str, int]], penalty: float = 1.0, l2: float = 1e-5) -> Model:
    """Logistic regression with the swaps' squared changes of score as a penalty; fixed start, full batches."""
    n, k, ids = len(rows), len(features), {f: i for i, f in enumerate(features)}
    y = np.array([label for label, _ in rows], float)
    index = np.array([f for _, found in rows for f in found], int)
    owner = np.repeat(np.arange(n), [len(found) for _, found in rows])
    changes = []
    for name, other, times in swapped:
        d = Counter(f for f in (word_features(other) if other else ()) if f in ids)
        d.subtract(f for f in word_features(name) if f in ids)
        if any(d.values()):
            changes.append(({ids[f]: v for f, v in d.items() if v}, times))
    pi = np.array([f for d, _ in changes for f in d], int)
    po = np.repeat(np.arange(len(changes)), [len(d) for d, _ in changes])
    pv = np.array([v for d, _ in changes for v in d.values()], float)
    share = np.array([times for _, times in changes], float) / max(1, sum(times for *_, times in swapped))
    w, b = np.zeros(k), float(np.log((y.sum() + 0.5) / (n - y.sum() + 0.5)))
    m, v, mb, vb = np.zeros(k), np.zeros(k), 0.0, 0.0
    for step in range(1, ROUNDS + 1 if 0 < y.sum() < n else 1):
        z = b + np.bincount(owner, w[index], n)
        r = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y) / n
        g = np.bincount(index, r[owner], k) + l2 * w
        if changes:
            change = np.bincount(po, w[pi] * pv, len(changes)) * share
            g += penalty * np.bincount(pi, change[po] * pv, k)
        gb = r.sum()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        w -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
        b -= 0.1 * (mb / (1 - 0.9**step)) / (np.sqrt(vb / (1 - 0.99**step)) + 1e-7)
    return Model(b, {f: float(w[i]) for f, i in ids.items()})


def train(docs: DataFrame, labels: DataFrame, identities: Groups = IDENTITIES, penalty: float = 1.0) -> Model:
    """The model of ``docs(doc_id, text)`` and ``labels(doc_id, toxic)``; with labels of one kind or none, it knows their share alone."""
    sample = training_sample(docs, labels)
    n = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    features = chosen_features(sample, n[1], n[0]) if n.get(0) and n.get(1) else []
    return fit(_encoded(sample, features), features, counted_swaps(sample, identities), penalty)


def score_documents(docs: DataFrame, labels: DataFrame, identities: Groups = IDENTITIES, penalty: float = 1.0) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs(doc_id, text, ...)``.

    Held out: crc32 of doc_id as text leaves 1 when divided by 3 (null id: not held out); such
    rows teach nothing. Null and empty texts get the score of no words. Several labels of one
    id count as their largest, null labels not at all; with labels of one kind or none, every
    document gets their share. Other columns are ignored; no rows: no rows.
    """
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held.alias("held_out"))
    model = docs.sparkSession.sparkContext.broadcast(train(rows, labels, identities, penalty))

    @common.kernel
    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge, known = model.value, {}
        for batch in batches:
            if len(known) > REMEMBERED:
                known.clear()
            z = []
            for text in common.rows_of(batch, "text"):
                total = judge.bias
                for w in words_of(text):
                    if (s := known.get(w)) is None:
                        s = known[w] = judge.word(w)
                    total += s
                z.append(total)
            p = 1 / (1 + np.exp(-np.clip(np.array(z, float), -500, 500)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(score, SCORED)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
