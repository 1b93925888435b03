import zlib

import numpy as np

from ledgerlake.llm import op5_toxicity as tox
from ledgerlake.llm import op9_language as lang

DOCS = "doc_id long, text string, lang string, source string, score double"
SMALL = "/root/testdata/sf0.01"


def auc(y, s):
    order = np.argsort(s, kind="stable")
    rank = np.empty(len(s))
    rank[order] = np.arange(1, len(s) + 1)
    n = y.sum()
    return (rank[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = {r["doc_id"]: r for r in lang.identify(docs).collect()}
    held = [(r["lang"], got[r["doc_id"]]) for r in docs.collect() if r["doc_id"] % 1 == 0 and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and r["lang"]]
    assert all(g["held_out"] for _, g in held) and len(got) == docs.count()
    assert np.mean([g["lang_pred"] == x for x, g in held]) > 0.97


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(0)
    e, t = rng.random((2, 4, 3)) + 0.1, rng.random((3, 3)) + 0.1
    p, moves = lang.forward_backward(e, t)
    for i in range(2):
        want, total = np.zeros((4, 3)), 0.0
        for path in np.ndindex(3, 3, 3, 3):
            w = np.prod([e[i, k, s] for k, s in enumerate(path)]) * np.prod([t[a, b] for a, b in zip(path, path[1:])])
            total += w
            for k, s in enumerate(path):
                want[k, s] += w
        assert np.allclose(p[i], want / total)
    assert np.isclose(moves.sum(), 6)


def small_model(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").where("lang in ('en', 'es')").limit(200).collect()
    by = {k: next(r["text"] for r in docs if r["lang"] == k and 40 < len(r["text"].split()) < 400).replace("\n", " ").split() for k in ("en", "es")}
    return lang.train([(r["text"], r["lang"]) for r in docs]), by


def test_texts_together_equal_texts_alone_and_switches_are_seen(spark):
    model, by = small_model(spark)
    mixed = by["en"][:20] + by["es"][:20]
    texts = [" ".join(by["en"]) + "\n12 !", "", " ".join(mixed), "\n".join([" ".join(by["es"])] * 3), "\u0130stanbul \u03a3\u0391\u03a3"]
    assert np.allclose(model.sums(texts), np.concatenate([model.sums([t]) for t in texts]))
    words = lang.Words([texts[2]])
    p = lang.chain_probabilities(model.scores(words)[words.type], np.array([0]), model.transition)
    assert (p.argmax(1)[2:18] == model.labels.index("en")).all() and (p.argmax(1)[22:38] == model.labels.index("es")).all()


def test_long_chains_in_segments_equal_whole_ones():
    rng = np.random.default_rng(1)
    e, t, starts = np.exp(-8 * rng.random((500, 3))), rng.random((3, 3)) + 0.05, np.array([0, 5, 6, 300, 499])
    want = np.concatenate([lang.forward_backward(e[a:b][None], t)[0][0] for a, b in zip(starts, [*starts[1:], 500])])
    for segment in (1, 7, 64, 1000):
        assert np.allclose(lang.chain_probabilities(e, starts, t, segment), want)


def test_words_and_their_features():
    words = lang.Words(["Ab, ab 12 \u00c9a\tx", "ab"])
    assert words.doc.tolist() == [0, 0, 0, 0, 0, 1] and words.type[2] == -1
    assert words.type[0] == words.type[1] == words.type[5] and len(set(words.type.tolist())) == 4
    spelt = ["".join(map(chr, words.letters[a : a + n])) for a, n in zip(words.first, words.length)]
    assert sorted(spelt) == ["ab", "x", "\u00e9a"]
    _, owner = lang.features(words, [words.hashes[:1]])
    n = dict(zip(spelt, np.bincount(owner)))
    # the word, prefixes, suffixes, pairs with both ends; the first type is in the lexicon
    assert {w: c - (w == spelt[0]) for w, c in n.items()} == {"ab": 1 + 2 + 2 + 3, "\u00e9a": 1 + 2 + 2 + 3, "x": 1 + 1 + 1 + 2}
    long, ends = lang.Words(["a" * 5000 + " " + "a" * 5000 + "b"]), lang.Words(["ab" * 2048, "ba" * 2048])
    assert len(long.hashes) == 2 and len(ends.hashes) == 2


def test_blocks_and_slices_cover_whole_texts():
    texts = ["one two\n" * 40, None, "", "x" * 95, "a b"]
    found = list(lang.blocks(texts, 50))
    assert len(found) > 4 and max(sum(map(len, t)) for _, t in found) <= 150
    whole = {}
    for numbers, parts in found:
        for i, part in zip(numbers, parts):
            whole[i] = whole.get(i, "") + part
    assert whole == {0: texts[0], 3: texts[3], 4: texts[4]}
    parts = lang.slices("word " * 10_000 + "x" * 1000)
    assert len(parts) == lang.TRAIN_WORDS // lang.SEQUENCE and all(len(p.split()) == lang.SEQUENCE for p in parts)
    assert lang.slices("12 !") == [] and lang.slices("a 1 b") == ["a b"]


def test_language_odd_rows(spark):
    rows = [(i, "the quick brown fox jumps over lazy dogs", "xx", "s", 1.0) for i in range(20)] + [(50, None, "xx", "s", 1.0), (51, "", None, "s", 1.0), (52, "12 !! 34", "xx", None, None), (None, "the fox", None, None, None), (53, "fox " * 20_000, None, None, None), (53, "fox", None, None, None)]
    df = spark.createDataFrame(rows, DOCS)
    got = lang.identify(df).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["lang_pred"] == ("und" if r["doc_id"] in (50, 51, 52) else "xx") and 0 <= r["score"] <= 1
    assert {r["lang_pred"] for r in lang.identify(df.withColumn("lang", df.lang.cast("string")).where("doc_id = 53").replace("xx", "yy")).collect()} == {"und"}
    assert lang.identify(df.limit(0)).count() == 0
    kept = lang.keep_identified(df)
    assert kept.columns == df.columns and kept.where("doc_id in (50, 51, 52)").count() == 0 and kept.count() == len(rows) - 3


def test_toxicity_of_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    got = {r["doc_id"]: r for r in tox.score_documents(docs, labels).collect()}
    assert len(got) == docs.count()
    held = [(r["toxic"], got[r["doc_id"]]) for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 and r["doc_id"] in got]
    y, s, p = (np.array(x) for x in zip(*((t, g["score"], g["predicted"]) for t, g in held)))
    assert all(g["held_out"] for _, g in held) and ((s >= 0.7) == p).all()
    assert auc(y, s) > 0.95 and p[y == 1].mean() > 0.8 and p[y == 0].mean() < 0.01


def planted(spark, groups, n=900):
    """Documents in which one name of a line is mostly in toxic texts, the other in clean ones; and a word that is toxic."""
    rng = np.random.default_rng(0)
    words = [f"w{chr(97 + i)}" for i in range(26)]
    docs, labels = [], []
    for i in range(n):
        y = int(i % 3 == 0)
        bad, good = groups[i % len(groups)][:2]
        name = bad if rng.random() < (0.9 if y else 0.1) else good
        text = " ".join([*rng.choice(words, 8), name.title(), *(["vile"] if y and rng.random() < 0.7 else [])])
        docs.append((i, f"Neutral words before. {text}! More neutral words."))
        labels.append((i, y))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_swaps_reduce_the_difference_between_groups(spark):
    groups = (("muslims", "methodists"), ("m\u00e4dchen", "jungen"))
    docs, labels = planted(spark, groups)
    assert tox.counted_swaps(tox.training_sample(docs, labels), groups) and not tox.counted_swaps(tox.training_sample(docs, labels), ())
    gap = lambda m: sum(abs(m.word(a) - m.word(b)) for a, b in groups)
    with_swaps, without = tox.train(docs, labels, groups, penalty=5.0), tox.train(docs, labels, ())
    assert gap(without) > 2 and gap(with_swaps) < 0.1 * gap(without)
    assert with_swaps.word("vile") > 1
    neutral = spark.createDataFrame([(-1, "The muslims and the rest"), (-2, "The methodists and the rest")], "doc_id long, text string")
    score = lambda **k: [r["score"] for r in tox.score_documents(docs.unionAll(neutral), labels, **k).where("doc_id < 0").orderBy("doc_id").collect()]
    fair, unfair = score(identities=groups, penalty=5.0), score(identities=())
    assert abs(fair[0] - fair[1]) < 0.1 < abs(unfair[0] - unfair[1])


def test_swaps_of_a_sentence():
    assert set(tox.swaps("Old Women and boys", (("women", "men", "boys"),))) == {("women", "men"), ("women", ""), ("boys", ""), ("boys", "men")}
    assert all(len(set(line)) == len(line) and all(n == n.lower() for n in line) for line in tox.IDENTITIES)


def test_one_text_of_an_id_teaches(spark):
    known = next(i for i in range(50) if zlib.crc32(str(i).encode()) % 3 != 1)
    docs = spark.createDataFrame([(known, f"text {i}") for i in range(50)] + [(None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(known, 1), (known, 0), (None, 1)], "doc_id long, toxic int")
    assert [(r["_id"], r["toxic"]) for r in tox.training_sample(docs, labels).collect()] == [(known, 1)]


def test_toxicity_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "x", "s", 0.0), (2, "", "x", "s", 0.0), (None, "words", None, None, None), (3, "a " * 100_000, "x", "s", 0.0), (3, "again", "x", "s", 0.0)], DOCS)
    labels = spark.createDataFrame([(1, 0, None), (1, 1, 1), (None, 1, 1), (7, 1, 0)], "doc_id long, quality int, toxic int")
    for y in (labels, labels.limit(0)):
        got = tox.score_documents(docs, y).collect()
        assert len(got) == 5 and all(0 <= r["score"] <= 1 for r in got)
    assert tox.score_documents(docs.limit(0), labels).count() == 0


def test_mixed_languages_stay(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = [r[0] for r in docs.where("lang is not null").groupBy("lang").count().orderBy("count", ascending=False).limit(3).collect()]
    by = {k: " ".join(" ".join(r["text"] for r in docs.where(docs.lang == k).orderBy("doc_id").limit(20).collect()).split()[:300]) for k in labels}
    rows = docs.select("doc_id", "text", "lang", "source", docs.doc_id.cast("double").alias("score")).unionAll(spark.createDataFrame([(-1, "\n".join(by.values()), None, "mixed", None)], DOCS))
    got = {r["doc_id"]: r["score"] for r in lang.identify(rows).where("doc_id = -1").collect()}
    assert 0.2 < got[-1] < lang.LEAST_SCORE
    assert lang.keep_identified(rows).where("doc_id = -1").count() == 1
