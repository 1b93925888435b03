import hashlib
import zlib

import numpy as np
import pytest

from ledgerlake.llm import op10_substrings as op

DOCS = "doc_id long, text string, own int, a int"


def brute(rows, window=20):
    first, words_of = {}, [(t or "").encode().split() for _, t in rows]
    key = lambda d: (d is None, d or 0)
    for (d, _), w in zip(rows, words_of):
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            first[k] = min(first.get(k, (key(d), i)), (key(d), i))
    out = []
    for (d, _), w in zip(rows, words_of):
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] != (key(d), i):
                gone[i : i + window] = True
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), int(gone.sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def result(df):
    return sorted(map(tuple, df.drop("kept").collect()), key=str)


def rows_for(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    passage = " ".join(f"p{i}" for i in range(60))
    rows += [(5000 + i, f"before{i} and more {passage} after{i} it") for i in range(50)]
    rows += [(-1, None), (6000, ""), (6001, "a " * 21), (6002, "a " * 5000), (6003, "x y z " * 40), (None, passage), (None, passage), rows[0], (rows[1][0], "another text " + passage)]
    rows += [(2**63 - 1, "the largest id " + passage), (None, "it no id " + passage), (-(2**63), "the smallest id " + passage)]
    rows += [(7000, " ".join(f"v{i * i % 9973}" for i in range(20000))), (7001, "one\ttwo\x0b" + passage.replace(" ", "\n"))]
    return rows


@pytest.mark.parametrize("bucket,one_in,named", [(2048, 500, False), (20, 1, False), (20, 1, True)])
def test_equals_brute_force(spark, sf, bucket, one_in, named, monkeypatch):
    rows = rows_for(spark, sf)
    if named:  # every id once
        rows = list({d: (d, t) for d, t in rows if d is not None}.values())
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], DOCS).repartition(5)
    monkeypatch.setattr(op, "PARTITION_BYTES", 20_000)
    assert result(op.remove_repeats(df, bucket=bucket, one_in=one_in, texts=not named)) == brute(rows)


def test_rows_without_id_are_told_apart(spark):
    rng = np.random.default_rng(0)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 10**6, 26)) for _ in range(600)]
    by = {}
    for t in texts:
        by.setdefault(zlib.crc32(t.encode()) & 0xFFFF, []).append(t)
    clash = next(v for v in by.values() if len(v) > 1)[:2]
    passage = " ".join(clash[0].split()[:22])
    rows = [(1, passage), (None, clash[0]), (None, clash[1]), (2, clash[1] + " x"), (2, "other words " + passage), *[(None, t) for t in texts[:50]]]
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], DOCS).repartition(3)
    assert result(op.remove_repeats(df)) == brute(rows)


def test_small_windows(spark):
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(str(x) for x in rng.integers(0, 3, rng.integers(0, 40)))) for i in range(60)]
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], DOCS)
    assert result(op.remove_repeats(df, window=6, gram=2)) == brute(rows, 6)


def test_empty(spark):
    assert op.remove_repeats(spark.createDataFrame([], DOCS)).count() == 0
