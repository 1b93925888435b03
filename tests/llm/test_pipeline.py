import corpus_pipeline
from ledgerlake.llm import catalogue, common, op2_simhash, op6_decontaminate, op9_language


def test_names():
    found = catalogue.queries()
    assert [sum(k.startswith(f"op{n}_") for k in found) for n in range(1, 11)] == [1] * 10 and "pipeline" in found


def test_stages(spark, sf):
    docs = common.table(spark, sf, "documents")
    columns, counts = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = common.cut(stage(spark, docs, sf))
        counts.append(docs.count())
        if name != "packing":
            assert docs.columns == columns
    assert counts[0] >= 190 and counts[1] < counts[0] and counts[2] < counts[1] and counts[3] == counts[2] <= counts[4]


def test_run_on_an_empty_table(spark, sf, tmp_path):
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{sf}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_decide_by_row(spark):
    schema = "doc_id long, text string, lang string, note string"
    kept = lambda df: sorted(r["note"] for r in df.collect())
    one, two, three = ("the first of the texts about rivers and their banks", "another text that tells of mountains instead", "a third one says how bread is made at home")
    rows = [(None, one, "en", "a"), (None, one, "en", "b"), (None, two, "en", "c"), (None, two, "en", "d"), (5, two + " again", "en", "e"), (5, three, "en", "f"), (7, three, "en", "g"), (7, one + " now", "en", "h"), (3, one + " now", "en", "i")]
    got = op2_simhash.keep_one(spark.createDataFrame(rows, schema))
    assert got.columns == ["doc_id", "text", "lang", "note"]
    names = kept(got)
    assert len(names) == 5 and set(names) >= {"e", "f", "i"} and {"a", "b"} & set(names) and {"c", "d"} & set(names)

    rows = [(None, "", "en", "a"), (None, "clean words of a page", "en", "b"), (4, None, "en", "c"), (4, "more clean words of it", "en", "d"), *[(100 + i, "the quick brown fox jumps over dogs", "en", f"z{i}") for i in range(20)]]
    assert [n for n in kept(op9_language.keep_identified(spark.createDataFrame(rows, schema))) if n[0] != "z"] == ["b", "d"]

    item = "which of these seven words comes before the last of all of them"
    rows = [(None, f"see {item} here", "en", "a"), (None, "clean words of a page", "en", "b"), (4, item, "en", "c"), (4, "more clean words of it", "en", "d")]
    bench = spark.createDataFrame([(1, item), (2, "nothing of this one is in any of the documents here")], "item_id long, text string")
    assert kept(op6_decontaminate.keep_clean(spark.createDataFrame(rows, schema), bench)) == ["b", "d"]
