"""Personal data by weak-supervision aggregation.

Base spans follow four fixed patterns. Looser candidates (disguised addresses, digit runs
that read like numbers of people, secrets next to their names) get votes of labelers:
patterns, gazetteers and context words, each for, against or silent. Votes are counted
over all documents by pattern of votes; expectation-maximisation over these counts
estimates each labeler's reliability and the share of true candidates of each kind, and a
final classifier (logistic regression over kind and votes, trained on all patterns with
their soft labels) judges the candidates. Accepted ones join the base spans, which stay.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.llm import common

#: The base patterns are
#: email [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
#: ip [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
#: card [0-9]([\x20-]?[0-9])+
#: phone \+[0-9][\x20().0-9-]+[0-9]
#: They are matched in linear time: from the start of a run of digits, possessively (what
#: follows a run is never in it, so giving back doesn't help), or from a mark outwards.
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
KINDS = ("email", "ip", "card", "phone", "secret")

_AT = re.compile(r"\(at\)|\[at\]", re.IGNORECASE)
_HIDDEN_DOMAIN = re.compile(r" ?[A-Za-z0-9-]++(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]++)++", re.IGNORECASE)
_DIGITS = re.compile(r"(?<![0-9A-Za-z.])\(?[0-9][0-9 ().-]{7,22}[0-9](?![0-9A-Za-z])")
_SECRET = re.compile(r"(?:passw(?:or)?d|pwd|token|secret|api[_-]?key)\s*[=:]\s*\"?([^\s\"]{6,})\"?", re.IGNORECASE)
_PHONE_SHAPE = re.compile(r"\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}$")
_GROUPS = re.compile(r"[0-9]+")

#: Gazetteers and context words.
TOP_LEVEL = frozenset("com org net edu gov info io de fr es uk eu".split())
SECRET_NAMES = frozenset("password passwd pwd token secret api_key apikey api-key".split())
CUES = {
    "email": frozenset("mail email e-mail contact write".split()),
    "phone": frozenset("phone tel telephone call mobile fax telefon teléfono téléphone".split()),
    "card": frozenset("card credit visa mastercard karte carte tarjeta".split()),
    "secret": frozenset("password passwd pwd token secret login key".split()),
}
LABELERS = ("pattern", "gazetteer", "context", "shape")
CONTEXT = 40

DETECTED = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def luhn(digits: str) -> bool:
    values = [int(d) for d in reversed(digits)]
    return sum(values[0::2] + [2 * v - 9 * (v > 4) for v in values[1::2]]) % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind as listed, then start."""
    found = [("email", *span) for span in _around(text, ((i, i + 1) for i in _places(text, "@")), _DOMAIN, "")]
    found += [("ip", *m.span()) for m in _IP.finditer(text) if all(_small(p) for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
    if "+" in text:
        found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return found


def _places(text: str, mark: str) -> Iterator[int]:
    at = text.find(mark)
    while at >= 0:
        yield at
        at = text.find(mark, at + 1)


def _around(text: str, marks: Iterable[tuple[int, int]], domain: re.Pattern, gap: str) -> Iterator[tuple[int, int]]:
    """Spans of addresses: before each mark a local part (and ``gap``), behind it a domain; none overlap.

    Only what lies between two marks is looked at for the second, so each character is once.
    """
    low = 0
    for at, behind in marks:
        if at < low:
            continue
        before = text[low:at]
        if gap and before.endswith(gap):
            before = before[: -len(gap)]
        start = low + len(before.rstrip(_LOCAL))
        m = domain.match(text, behind) if start < low + len(before) else None
        if m:
            yield start, m.end()
        low = m.end() if m else behind


def _small(part: str) -> bool:
    """Whether a run of digits is at most 255, however many zeros lead."""
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int, tuple[int, ...]]]:
    """(kind, start, end, votes) of looser spans that no base span and no earlier candidate overlaps."""
    loose = [("email", *span) for span in _around(text, (m.span() for m in _AT.finditer(text)), _HIDDEN_DOMAIN, " ")]
    if "=" in text or ":" in text:
        loose += [("secret", *m.span(1)) for m in _SECRET.finditer(text)]
    for m in _DIGITS.finditer(text):
        n = sum(map(len, _GROUPS.findall(m[0])))
        if 8 <= n <= 19:
            loose.append(("phone" if n <= 15 else "card", *m.span()))
    taken: list[list[int]] = []  # the base spans, united
    for x, y in sorted((x, y) for _, x, y in base):
        if taken and x < taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], y)
        else:
            taken.append([x, y])
    out, last = [], 0
    for kind, a, b in sorted(loose, key=lambda x: (x[1], -x[2])):
        at = bisect_left(taken, a, key=lambda span: span[1])  # the first that may reach behind a
        while at < len(taken) and taken[at][1] <= a:
            at += 1
        if a >= last and (at == len(taken) or taken[at][0] >= b):
            last = b
            out.append((kind, a, b, votes(kind, text, a, b)))
    return out


def votes(kind: str, text: str, a: int, b: int) -> tuple[int, ...]:
    """1, 0 or -1 (silent) of each of ``LABELERS``."""
    value = text[a:b]
    before = text[max(0, a - CONTEXT) : a].lower()
    groups = _GROUPS.findall(value)
    context = 1 if any(w.strip(".,:;=()\"'") in CUES.get(kind, ()) for w in before.split()[-4:]) else -1
    if kind == "email":
        ending = re.split(r"[\s.)\]]+", value.strip(")] "))[-1].lower()
        return (1, 1 if ending in TOP_LEVEL else 0, context, 1 if len(value) <= 80 else 0)
    if kind == "secret":
        name = re.split(r"[\s=:\"]+", before.rstrip(" =:\""))[-1]
        mixed = any(c.isdigit() for c in value) and any(c.isalpha() for c in value)
        return (1, 1 if name in SECRET_NAMES else -1, context, 1 if mixed else 0)
    if kind == "phone":
        return (1 if _PHONE_SHAPE.match(value) else 0, 1 if groups and len(groups[0]) == 3 and groups[0][0] not in "01" else 0, context, 1 if 2 < len(groups) < 6 else 0)
    digits = "".join(groups)
    return (1 if luhn(digits) else 0, 1 if digits[0] in "3456" else 0, context, 1 if {len(g) for g in groups} <= {4} or len(groups) == 1 else 0)


@dataclass
class Judge:
    """The final classifier: probability by kind and votes, and the labelers' reliabilities."""

    weights: np.ndarray
    reliability: dict[str, np.ndarray]

    def accepts(self, kind: str, given: tuple[int, ...]) -> bool:
        return bool(_features(kind, given) @ self.weights > 0)


def _features(kind: str, given: tuple[int, ...]) -> np.ndarray:
    x = np.zeros(1 + len(KINDS) + 2 * len(KINDS) * len(LABELERS))
    k = KINDS.index(kind)
    x[0] = x[1 + k] = 1
    for i, v in enumerate(given):
        if v >= 0:
            x[1 + len(KINDS) + 2 * (k * len(LABELERS) + i) + v] = 1
    return x


def aggregate(counts: dict[tuple[str, tuple[int, ...]], int], rounds: int = 50) -> Judge:
    """Expectation-maximisation by kind over counted vote patterns, then the final classifier."""
    patterns = sorted(counts)
    soft, reliability = {}, {}
    for kind in KINDS:
        own = [p for p in patterns if p[0] == kind]
        if not own:
            continue
        v = np.array([p[1] for p in own])
        n = np.array([counts[p] for p in own], float)
        q = np.clip((v == 1).sum(1) / np.maximum((v >= 0).sum(1), 1), 0.02, 0.98)
        for _ in range(rounds):
            true, false = n * q, n * (1 - q)
            share = (true.sum() + 1) / (n.sum() + 2)
            # for: P(vote for | true), P(vote for | false), smoothed towards a fairly reliable labeler
            up = np.stack([((v == 1) * true[:, None]).sum(0) + 4, ((v == 1) * false[:, None]).sum(0) + 1])
            down = np.stack([((v == 0) * true[:, None]).sum(0) + 1, ((v == 0) * false[:, None]).sum(0) + 4])
            p = up / (up + down)
            log = lambda y: np.where(v == 1, np.log(p[y]), np.where(v == 0, np.log(1 - p[y]), 0)).sum(1)  # noqa: B023, E731
            z = np.log(share) - np.log(1 - share) + log(0) - log(1)
            q = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        soft.update(zip(own, q))
        reliability[kind] = p
    if not patterns:
        return Judge(np.zeros(len(_features("email", ()))) - 1, reliability)
    x = np.array([_features(*p) for p in patterns])
    y = np.array([soft[p] for p in patterns])
    w = np.log1p([counts[p] for p in patterns])
    weights = np.zeros(x.shape[1])
    for _ in range(50):  # Newton steps
        p = 1 / (1 + np.exp(-x @ weights))
        g = x.T @ (w * (p - y)) + 0.05 * weights
        h = (x * (w * p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(x.shape[1])
        weights -= np.linalg.solve(h, g)
    return Judge(weights, reliability)


def _votes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: dict[tuple[str, str], int] = {}
        for text in common.rows_of(batch, "text"):
            for kind, _, _, given in candidates(text or "", base_spans(text or "")):
                key = (kind, ",".join(map(str, given)))
                counts[key] = counts.get(key, 0) + 1
        rows = [(*k, n) for k, n in counts.items()]
        columns = list(zip(*rows)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64()))], ["kind", "votes", "n"])


def learn(texts: DataFrame) -> Judge:
    """The judge of ``texts(text)``. The collected counts have a row for each pattern of votes, 5 * 3^4 at most."""
    counted = texts.mapInArrow(_votes, "kind string, votes string, n long").groupBy("kind", "votes").agg(F.sum("n").alias("n"))
    return aggregate({(k, tuple(map(int, v.split(",")))): n for k, v, n in counted.collect()})


def _joined(spans: Iterable[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


def all_spans(text: str, judge: Judge) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, all spans) of a text."""
    base = base_spans(text)
    return base, base + [(k, a, b) for k, a, b, given in candidates(text, base) if judge.accepts(k, given)]


def detect(docs: DataFrame) -> DataFrame:
    """Counts and spans of every row of ``docs(doc_id, text, ...)``.

    Null text: no span, no count. Offsets are code points, ends exclusive. Spans of different
    base kinds may overlap; added spans overlap none. Rows that repeat an id are rows of their
    own. Other columns are ignored; no rows: no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    judge = docs.sparkSession.sparkContext.broadcast(learn(rows.select("text")))

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text in zip(common.rows_of(batch, "doc_id"), common.rows_of(batch, "text")):
                base, spans = all_spans(text or "", judge.value)
                n = [sum(k == kind for k, _, _ in base) for kind in KINDS[:4]]
                out.append((doc_id, *n, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans)))
            columns = list(zip(*out)) or [()] * 7
            types = (*[pa.int64()] * 5, pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], [x.split()[0] for x in DETECTED.split(", ")])

    return rows.mapInArrow(find, DETECTED)


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every span replaced by its kind; spans that overlap become one mark."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join(out) + text[at:]


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with the spans of ``text`` replaced by marks and ``n_chars`` brought up to date; null text stays null."""
    judge = docs.sparkSession.sparkContext.broadcast(learn(docs.select(F.col("text").cast("string").alias("text"))))

    @common.kernel
    def replace(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if t is None else masked(t, all_spans(t, judge.value)[1]) for t in common.rows_of(batch, "text")]
            at = batch.schema.get_field_index("text")
            batch = batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
            if (at := batch.schema.get_field_index("n_chars")) >= 0:
                batch = batch.set_column(at, batch.schema.field(at), pa.array([None if t is None else len(t) for t in texts], batch.schema.field(at).type))
            yield batch

    return docs.mapInArrow(replace, docs.schema)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(common.table(spark, sf_dir, "documents"))
