from collections import Counter

import numpy as np

from ledgerlake.llm import op6_decontaminate as op

DOCS = "doc_id long, text string, item_id long, start long"
ITEMS = "item_id long, text string, doc_id long"


def jaccard(a, b):
    """Weighted Jaccard similarity of the 5-word shingles (shorter: the whole sequence) of two lists of words."""
    n = min(op.SHINGLE, len(b))
    bags = [Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) for w in (a, b)]
    weigh = lambda pick: sum(len(b"".join(s)) * pick(bags[0][s], bags[1][s]) for s in bags[0] | bags[1])
    return weigh(min) / weigh(max) if weigh(max) else 0.0


def best_windows(rows, items):
    """By (doc_id, item_id): the best similarity and window, over all pairs of a window and an item."""
    out = {}
    items = [(i, w) for i, t in items if (w := op.words_of((t or "").encode()))]
    for d, t in rows:
        words = op.words_of((t or "").encode())
        for item, own in items:
            for at in range(max(1, len(words) - len(own) + 1) if words else 0):
                window = words[at : at + len(own)]
                value = jaccard(window, own)
                if value >= 0.8 and value > out.get((d, item), (0.0,))[0]:
                    out[d, item] = (value, at, len(window))
    return out


def test_equals_brute_force(spark, sf):
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").limit(12).collect()]
    items += [(900, None), (901, ""), (902, "two words"), (903, " ".join(f"i{n}" for n in range(60))), (904, items[0][1])]
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect() if len(r["text"]) < 3000][:40]
    near = [f"i{n}" for n in range(60)]
    rows += [(5000 + k, "before it " + " ".join(near[:k] + ["changed"] + near[k + 1 :]) + " after it") for k in range(0, 60, 7)]
    rows += [(6000, items[1][1].upper() + "!"), (6001, "x " + items[0][1].replace(" ", ", ")), (6002, None), (6003, ""), (6004, "Two, words"), (None, items[2][1]), (6000, items[1][1])]
    got = op.contaminated(spark.createDataFrame([(*r, 1, 2) for r in rows], DOCS), spark.createDataFrame([(*i, 1) for i in items], ITEMS))
    found = {(r["doc_id"], r["item_id"]) for r in got.collect()}
    want = best_windows(rows, items)
    assert found == set(want)
    for r in got.where("doc_id is not null and doc_id not in (6000)").collect():
        value, start, n = want[r["doc_id"], r["item_id"]]
        assert abs(r["similarity"] - value) < 1e-12 and (r["start"], r["n_words"]) == (start, n)
    assert {(6000, items[1][0]), (6001, items[0][0]), (6001, 904), (5000, 903), (6004, 902), (None, items[2][0])} <= found


def test_several_passes(spark, sf, monkeypatch):
    docs, items = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "benchmark"))
    items = items.unionAll(items.limit(3)).unionAll(spark.createDataFrame([(None, "a null id and some more words of it"), (None, "another null id and more words of it")], items.schema))
    docs = docs.select("doc_id", "text").unionAll(spark.createDataFrame([(-5, "has a null id and some more words of it and another null id and more words of it")], "doc_id long, text string"))
    pairs = lambda: sorted((tuple(r) for r in op.contaminated(docs, items).collect()), key=str)
    one = pairs()
    monkeypatch.setattr(op, "ITEMS", 7)
    monkeypatch.setattr(op, "INDEXED", 2)
    assert pairs() == one and len([r for r in one if r[0] == -5]) == 2
    hit = {r[0] for r in one}
    assert {r["doc_id"] for r in op.keep_clean(docs, items).collect()} == {r["doc_id"] for r in docs.collect()} - hit


def test_index_finds_every_pair_within_the_radius():
    rng = np.random.default_rng(0)
    items = rng.integers(0, 2**64, 50, dtype=np.uint64)
    windows = items[rng.integers(0, 50, 300)].copy()
    for _ in range(op.RADIUS):
        windows ^= np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)
    got = set(zip(*map(np.ndarray.tolist, op.Index(items).near(windows))))
    want = {(w, i) for w in range(300) for i in range(50) if int(windows[w] ^ items[i]).bit_count() <= op.RADIUS}
    assert got == want


def test_empty_and_stage(spark):
    docs, items = spark.createDataFrame([(1, "a b c d e f g", 1, 1)], DOCS), spark.createDataFrame([(1, "a b c d e f g", 1)], ITEMS)
    assert op.contaminated(docs.limit(0), items).count() == 0 == op.contaminated(docs, items.limit(0)).count()
    assert op.keep_clean(docs, items).count() == 0 and op.keep_clean(docs, items.limit(0)).columns == docs.columns


def test_documents_shorter_than_an_item(spark):
    items = [(1, " ".join(f"i{n}" for n in range(37))), (2, " ".join(f"k{n % 11} j{n}" for n in range(20)))]
    rows = [(100 * i + n, " ".join(t.split()[:n])) for i, t in items for n in range(3, len(t.split()) + 1)]
    want = {(d, i, n) for (d, i), (_, _, n) in best_windows(rows, items).items()}
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], DOCS)
    table = spark.createDataFrame([(*i, 1) for i in items], ITEMS)
    assert {(r["doc_id"], r["item_id"], r["n_words"]) for r in op.contaminated(docs, table).collect()} == want
    assert {(136, 1, 36), (239, 2, 39)} <= want and (110, 1, 10) not in want
    assert op.keep_clean(docs.where("doc_id in (136, 110)"), table).count() == 1
