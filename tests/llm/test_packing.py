import random
import struct
import zlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ledgerlake.llm import op4_packing as op

DOCS = "doc_id long, text string, piece int, start long"


def test_contract(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    rows += [(9000, None), (9001, ""), (9002, "İstanbul’s   don't <|endoftext|> x\x1cy é ΑΣ Σ 12.5"), (9003, "long " * 20000), (None, "no id"), (9004, "twice"), (9004, "twice"), (9005, "It's 3.5% of x--'s 'tis A1b2!? é...è. “q”. x'. Don'T \u1e98 W\u030a \u00bd+\u2460,9"), (9006, "<|ENDOFTEXT|> A,b")]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    expected = []
    for d, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        for n, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            expected.append((d, n, at, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))))
    got = op.pack_documents(spark.createDataFrame([(d, t, 7, 8) for d, t in rows], DOCS)).collect()
    assert sorted(map(str, (tuple(r)[:5] for r in got))) == sorted(map(str, expected))
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= 1.02 * -(-sum(e[3] for e in expected) // 2048) + 1


def test_empty(spark):
    assert op.pack_documents(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_every_constraint_holds(rule):
    rng = random.Random(1)
    packer = op.Packer((100, 4, 3000), rule=rule)
    used = {}
    for length in sorted((rng.randint(1, 50) for _ in range(2000)), reverse=True):
        b, offset = packer.place(length)
        t, n, c = used.get(b, (0, 0, 0))
        assert offset == t
        used[b] = (t + length, n + 1, c + length**2)
    assert all(t <= 100 and n <= 4 and c <= 3000 for t, n, c in used.values())
    assert sum(t for t, _, _ in used.values()) / 100 / len(used) > 0.6


def test_a_piece_beyond_a_capacity_is_refused():
    with pytest.raises(ValueError):
        op.Packer((10, 2, 50)).place(9)


def test_units_equal_whole_texts():
    ids_of, tokenizer = op.UnitIds(public_tokenizers.path("word_bpe_49k.json")), Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(3)
    alphabet = "aB z.,'9\n-é…Ω²$<|_ \u0301\u00a0st"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    for text, ids in zip(texts, ids_of.batch([t.encode() for t in texts])):
        assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_every_latin_letter_equals_whole_texts():
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    letters = [chr(c) for c in range(0x250) if chr(c).isalpha()]
    texts = [t for c in letters for t in (c, f"{c}stanbul", f"a {c}stanbul b", f"ab{c} Z{c}z, {c}{c}", f"9{c}'s")]
    for text, ids in zip(texts, op.UnitIds(path).batch([t.encode() for t in texts])):
        assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_a_document_with_a_dotted_capital(spark):
    got = op.pack_documents(spark.createDataFrame([(1, "\u0130stanbul is large", 7, 8), (2, "plain", 7, 8)], DOCS)).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert {r["doc_id"]: r["length"] for r in got} == {1: len(tokenizer.encode("\u0130stanbul is large", add_special_tokens=False).ids) + 1, 2: len(tokenizer.encode("plain", add_special_tokens=False).ids) + 1}


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_the_choice_is_the_best_of_all_feasible_sequences(rule):
    rng = random.Random(2)
    packer = op.Packer((100, 4, 3000), weights=(1.0, 0.5, 0.7), rule=rule)
    for _ in range(1500):
        length = rng.randint(1, 50)
        demand, before = (length, 1, length * length), list(packer.left)
        scores = [packer.score(left, demand) for left in before if all(r >= d for r, d in zip(left, demand)) and all(left)]
        b, _ = packer.place(length)
        if scores:
            assert packer.score(before[b], demand) == pytest.approx(min(scores), abs=1e-12)
        else:
            assert b == len(before)


def check(texts):
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    for text, ids in zip(texts, op.UnitIds(path).batch([t.encode() for t in texts])):
        assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_every_character_in_many_places_equals_whole_texts():
    characters = [chr(c) for c in [*range(0x3000), 0xFB01, 0xFEFF, 0x1F600, 0x1D400, 0x10FFFF]]
    for form in ("a{0}b", "1{0}2 {0}", ".{0}, I{0} {0}S", "x'{0}s {0}{0}"):
        check([form.format(c) for c in characters])


def test_words_that_share_a_hash_keep_their_own_ids():
    word, other = "a", "b"
    for _ in range(11):
        word, other = word + other, other + word  # their polynomial hashes modulo 2^64 are equal
    check([word, other, f"{word} {other} x", f"{other} x", word])
    ids_of = op.UnitIds(public_tokenizers.path("word_bpe_49k.json"))
    assert [ids_of([t.encode()])[1] for t in (word, other, "x")] == [[], [0], []]


def test_rows_repeated_often_are_dealt_over_groups(spark, monkeypatch):
    monkeypatch.setattr(op, "GROUP", 50)
    got = op.pack_documents(spark.createDataFrame([(1, "same words", 7, 8)] * 300 + [(None, None, 1, 1)] * 100, DOCS)).collect()
    groups = {}
    for r in got:
        groups[r["sequence_id"] >> 32] = groups.get(r["sequence_id"] >> 32, 0) + 1
    assert len(got) == 400 and len(groups) > 4 and max(groups.values()) < 150
