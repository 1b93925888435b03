import hashlib
import random
import re
import time

import pytest

from ledgerlake.llm import op7_pii as op

DOCS = "doc_id long, text string, n_chars long, spans string"
TEXT = "Mail a.b@c.example.org. or 10.0.255.256 10.1.2.3, card 4111 1111 1111 1111 or 4111-1111-1111-1112; +1 (555) 010-9999 é x@y"


def test_base_spans():
    assert [(k, TEXT[a:b]) for k, a, b in op.base_spans(TEXT)] == [("email", "a.b@c.example.org"), ("ip", "10.1.2.3"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (555) 010-9999")]
    assert op.base_spans("") == [] and op.base_spans("0000001.2.3.4")[0] == ("ip", 0, 13) and not op.base_spans("+1234567")


def luhn(digits):
    total = 0
    for place, d in enumerate(map(int, reversed(digits))):
        total += d if place % 2 == 0 else sum(divmod(2 * d, 10))
    return total % 10 == 0


def spans_by_definition(text):
    """The base patterns as stated, by the regular expression engine, with the checks written anew."""
    digits = lambda t: [c for c in t if c in "0123456789"]
    checks = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda t: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda t: all(int(x) <= 255 for x in t.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda t: 16 <= len(digits(t)) <= 19 and luhn(digits(t))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda t: 8 <= len(digits(t)) <= 15),
    }
    return [(kind, *m.span()) for kind, (pattern, fits) in checks.items() for m in re.finditer(pattern, text) if fits(m[0])]


def test_base_spans_equal_their_definition():
    rng = random.Random(5)
    for alphabet, n in (("a@.-_+1", 60), ("12.0", 60), ("4111 -", 80), ("+1 ().-9x", 80), ("aZ0@.%+- (1)\n\u00e9\u0661", 200), ("ab@c.d 10.2.3.4 4111111111111111 +1555", 300)):
        for _ in range(2000):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, n)))
            assert op.base_spans(text) == spans_by_definition(text), repr(text)
    cards = ["4111111111111111", "4111 1111-1111 1111", "6011000990139424", "4111111111111112"]
    for _ in range(500):
        text = rng.choice(["", " ", "x", "1 ", "-"]).join(rng.choice(cards) for _ in range(3))
        assert op.base_spans(text) == spans_by_definition(text), repr(text)


@pytest.mark.parametrize("unit", ["a", "1", "1 ", "1.", "@", "a@", "a@b.", "(at)", "a (at) ", "a(at)b.", "+1", "+1 (", "((", "token", "token=", "password ", "a.b@c.de 10.1.2.3 ", "555-123-4567 "])
def test_long_runs_take_linear_time(unit):
    judge = op.aggregate({})
    began = time.perf_counter()
    op.all_spans(unit * (1_000_000 // len(unit)), judge)
    op.all_spans(unit * (500_000 // len(unit)) + "@x", judge)
    assert time.perf_counter() - began < 6


def test_reliabilities_are_recovered():
    # labelers 0 and 1 agree mostly, labeler 3 is a coin
    counts = {}
    for n, v in ((400, (1, 1, -1, 1)), (400, (1, 1, -1, 0)), (500, (0, 0, -1, 1)), (500, (0, 0, -1, 0)), (30, (1, 0, -1, 1)), (30, (0, 1, -1, 0))):
        counts["phone", v] = n
    judge = op.aggregate(counts)
    assert judge.accepts("phone", (1, 1, -1, 0)) and not judge.accepts("phone", (0, 0, -1, 1))
    p = judge.reliability["phone"]
    assert p[0, 0] > 0.9 > 0.6 > p[0, 3] > 0.4 and p[1, 0] < 0.1


def test_detect_and_redact(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    docs += [(9000, TEXT), (9001, None), (9002, ""), (9003, "login password=ab12cd34 and token = \"0123abcd0123abcd\" done"), (9004, "tel (212) 664-7665 call"), (9004, TEXT), (None, TEXT), (9005, "1" * 50_000)]
    docs += [(9100 + i, f"write joe{i} (at) mail (dot) com") for i in range(5)]
    df = spark.createDataFrame([(d, t, None if t is None else len(t), "x") for d, t in docs], DOCS)
    got = op.detect(df).collect()
    assert len(got) == len(docs)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    for d, t in docs:
        base = op.base_spans(t or "")
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        rows = [r for r in by[d] if r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()]
        assert rows and [rows[0][f"n_{k}"] for k in op.KINDS[:4]] == [sum(x[0] == k for x in base) for k in op.KINDS[:4]]
        assert any(set(filter(None, joined.split(","))) <= set(r["spans"].split(",")) for r in rows)
    assert by[9003][0]["spans"].count("secret") == 2 and "email" in by[9100][0]["spans"] and by[9005][0]["spans"] == ""
    clean = {r["doc_id"]: r for r in op.redact(df).collect()}
    assert clean[9003]["text"] == 'login password=<SECRET> and token = "<SECRET>" done' and clean[9001]["text"] is None
    assert "<EMAIL>" in clean[9100]["text"] and clean[9003]["n_chars"] == len(clean[9003]["text"])
    assert op.redact(df).columns == df.columns


def test_overlapping_spans_are_masked_once():
    assert op.masked("abcdef", [("card", 1, 4), ("phone", 2, 5)]) == "a<CARD>f"


def test_empty(spark):
    empty = spark.createDataFrame([], DOCS)
    assert op.detect(empty).count() == 0 == op.redact(empty).count()
