import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerlake.functions import hashing
from ledgerlake.functions.vectors import distance
from ledgerlake.operators import ann, compact, events, kv, metrics, ordering, state, vector
from ledgerlake.plans import catalogue
from ledgerlake.sources import storage
from ledgerlake.streaming import streams

LOG = "key string, value double, tombstone boolean, ttl_ms long, term long, idx long, ms long"


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("abcd"), st.floats(0, 9), st.booleans(), st.one_of(st.none(), st.integers(1, 50))), min_size=1, max_size=25), st.integers(0, 60), st.integers(0, 30))
def test_state_equals_a_model(spark, ops, now, snapshot):
    rows = [(k, v, t, ttl, 0, i, i) for i, (k, v, t, ttl) in enumerate(ops)]
    model = {}
    for k, v, t, ttl, _, i, ms in rows:
        if i <= snapshot:
            model[k] = None if t or (ttl is not None and ms + ttl <= now) else v
    got = kv.state(spark.createDataFrame(rows, LOG), now, (0, snapshot)).collect()
    assert {r["key"]: r["value"] for r in got} == {k: v for k, v in model.items() if v is not None}


def test_consistency_names(spark):
    with pytest.raises(ValueError):
        kv.state(spark.createDataFrame([], LOG), 0, consistency="maybe")
    assert kv.state(spark.createDataFrame([], LOG), 0, consistency="lease").count() == 0


def test_hashes(spark):
    # fixed values: XXH64 with seed 0
    df = spark.createDataFrame([("hello",), ("",)], "k string").select(hashing.xxh64(F.col("k")).alias("h"), hashing.shard(F.col("k"), 1024).alias("s"))
    assert [r["h"] % 2**64 for r in df.collect()] == [2794345569481354659, 17241709254077376921]
    assert hashing.jump(np.array([0, 1, 2**64 - 1], dtype=np.uint64), 1).tolist() == [0, 0, 0]
    before, after = (hashing.jump(np.arange(5000, dtype=np.uint64) * np.uint64(11400714819323198485), n) for n in (10, 11))
    assert ((before == after) | (after == 10)).all()


def test_distances(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0], [4.0, 5.0, 6.0]), ([0.0, 0.0, 0.0], [1.0, 0.0, 0.0])], "a array<float>, b array<float>")
    got = df.select(*(distance(k, F.col("a"), F.col("b")).alias(k) for k in ("l2", "cosine", "inner_product"))).collect()
    assert got[0]["inner_product"] == -32 and abs(got[0]["l2"] - 5.196152) < 1e-6 and got[1]["cosine"] == 1


def test_line_of_vectors(spark):
    rows = [(i, [float(i), 0.0, 0.0], 0) for i in range(20)] + [(99, [float("nan"), 0.0, 0.0], 0), (98, None, 0)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert [r["vec_id"] for r in vector.nearest(v, [5.0, 0.0, 0.0], 3).collect()] == [5, 4, 6]
    q = spark.createDataFrame([(1, [5.0, 0.0, 0.0])], "query_id long, vector array<double>")
    assert [r["vec_id"] for r in vector.nearest_of_many(v, q, 3, passes=2).orderBy("rank").collect()] == [5, 4, 6]
    found = ann.search_graphs(v.where("vec_id < 50"), [(1, [5.0, 0.0, 0.0])], 3).orderBy("rank").collect()
    assert [r["vec_id"] for r in found] == [5, 4, 6]


def test_merge_of_tiers(spark):
    tiers = [spark.createDataFrame(t, "vec_id string, distance double") for t in ([("a", 2.0), ("c", 1.5), ("d", 9.0)], [("a", 1.0), ("b", 1.25)])]
    assert [tuple(r) for r in vector.merge_tiers(tiers, 3).collect()] == [("a", 1.0), ("b", 1.25), ("c", 1.5)]


def test_tiers_include_null(spark):
    v = spark.createDataFrame([(i, [float(i)], None if i % 3 == 0 else i % 3) for i in range(30)], "vec_id long, embedding array<float>, label int")
    got = vector.nearest_by_tier(v, [0.0], 2, "label").collect()
    assert sorted(r["vec_id"] for r in got) == [0, 1, 2, 3, 4, 5]


def test_distances_of_close_vectors_are_exact(spark):
    rng = np.random.default_rng(0)
    base = 1000 * rng.normal(size=16)
    x = np.stack([base, base + 1e-8, base + 1e-7, base - 3e-8, *(1000 * rng.normal(size=(200, 16)))])
    v = spark.createDataFrame([(i, e.tolist(), 0) for i, e in enumerate(x)], "vec_id long, embedding array<double>, label int")
    q = spark.createDataFrame([(i, x[i].tolist()) for i in range(4)], "query_id long, vector array<double>")
    got = {}
    for r in vector.nearest_of_many(v, q, 4).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["distance"]))
    for i in range(4):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        want = sorted(range(len(x)), key=lambda j: (d[j], j))[:4]
        assert [j for j, _ in got[i]] == want and np.allclose([e for _, e in got[i]], d[want], rtol=1e-9, atol=0)


def test_approximate_searches_pass_over_invalid_vectors(spark):
    rows = [(i, [float(i), 1.0], 0) for i in range(30)] + [(90, [float("nan"), 1.0], 0), (91, None, 0), (92, [1.0], 0), (93, [float("inf"), 0.0], 0), (94, [None, 1.0], 0), (95, [], 0)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    books = ann.train_codebooks(v, subspaces=2)
    for found in (ann.search_quantised(v, [(1, [5.0, 1.0])], books, 3), ann.search_graphs(v, [(1, [5.0, 1.0])], 3)):
        assert [r["vec_id"] for r in found.orderBy("rank").collect()] == [5, 4, 6]
    none = v.limit(0)
    assert ann.train_codebooks(none).shape == (0, 0, 0)
    assert ann.search_quantised(none, [(1, [5.0, 1.0])], ann.train_codebooks(none), 3).count() == 0 == ann.search_graphs(v, [], 3).count()


def test_compaction_candidates(spark):
    now, mib = 10 * 86_400_000, 1 << 20
    runs = spark.createDataFrame([(0, s, mib, 10, 0) for s in (0, 1, 2, 2)] + [(1, 0, mib, 10, 0)] + [(1, 1, 60 * mib, 10, 0)] * 2 + [(2, 0, mib, 10, 0)] * 5 + [(4, 0, mib, 10, 2), (4, 1, mib, 10, 1)], "level int, slot int, size long, entries long, tombstone_count long")
    slots = spark.createDataFrame([(1, 1, 0.9, 3, now), (2, 0, 0.1, 3, now)], "level int, slot int, heat double, k int, compacted_ms long")
    got = {(r["level"], r["slot"], r["trigger"]): (r["action"], r["runs"]) for r in compact.candidates(runs, slots, now).collect()}
    assert got == {(0, 0, "level 0"): ("tier", 4), (1, 0, "single run"): ("promote", 1), (1, 1, "size"): ("tier", 2), (1, 1, "hot"): ("eager", 2), (2, 0, "count"): ("tier", 3), (4, 0, "tombstones"): ("cleanup", 1)}
    old = compact.candidates(runs, slots.where("level = 1"), now).where("trigger = 'age'").collect()
    assert [(r["level"], r["slot"], r["runs"]) for r in old] == [(2, 0, 4)]


def test_recall(spark, sf):
    v = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label")
    queries = [(r["vec_id"], list(r["embedding"])) for r in v.where("vec_id < 20").collect()]
    q = spark.createDataFrame(queries, "query_id long, vector array<double>")
    exact = {(r[0], r[1]) for r in vector.nearest_of_many(v, q, 10).collect()}
    for found in (ann.search_graphs(v, queries, 10), ann.search_quantised(v, queries, ann.train_codebooks(v), 10)):
        assert len(exact & {(r[0], r[1]) for r in found.collect()}) >= 0.9 * len(exact)


def test_guards_and_ranks(spark):
    keys = spark.range(1000).select(F.format_string("%04d", "id").alias("key"))
    got = compact.propose_guards(keys, 4).orderBy("guard_id").collect()
    assert [tuple(r) for r in got] == [(1, "0250"), (2, "0500"), (3, "0750")]
    assert compact.propose_guards(keys.limit(2), 4).count() == 2


def test_members(spark):
    rows = [(1, 0, 7, 0, "alive", 1), (2, 0, 7, 0, "failed", 1), (3, 0, 7, 0, "suspect", 1), (4, 0, 7, 0, "alive", 1), (5, 0, 7, 0, "failed", 1), (6, 0, 8, 0, "left", 3), (7, 0, 8, 0, "alive", 4)]
    g = spark.createDataFrame(rows, "seq long, ms long, id long, from_id long, state string, incarnation long")
    assert {r["id"]: (r["state"], r["incarnation"]) for r in state.members(g).collect()} == {7: ("failed", 1), 8: ("left", 3)}


def test_sources(spark, tmp_path):
    df = spark.range(100).select(F.format_string("%03d", "id").alias("key"), "id")
    storage.write_run(df, f"{tmp_path}/r", files=2)
    back = storage.read_runs(spark, [f"{tmp_path}/r"])
    assert back.count() == 100 and back.where("key = '042'").first()["id"] == 42
    e = spark.createDataFrame([("click", 1, 2.5)], "type string, node int, value double")
    assert storage.from_json(storage.to_json(e), "node int, value double").collect() == [("click", 1, 2.5)]
    assert storage.exposition(e, "m", ["type", "node"]).first()[0] == 'm{type="click",node="1"} 2.5'
    assert storage.missing_files(spark.range(3).withColumnRenamed("id", "file_number"), spark.range(2).withColumnRenamed("id", "file_number")).collect() == [(2,)]


def test_streams_equal_batches(spark, sf, tmp_path):
    whole = spark.read.parquet(f"{sf}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("type"), "value", "user_id")
    whole.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")

    def run(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/c-{name}").trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name)

    got = run(streams.coalesce_windows(stream, "1 hour", ["click", "error"], "60 days"), "windows", "complete")
    want = whole.groupBy(F.window("ts", "1 hour")).agg(F.count("*").alias("n"))
    assert sorted(r["n"] for r in got.collect()) == sorted(r["n"] for r in want.collect())
    down = run(streams.downsample(stream, "type", "1 day", "60 days"), "down", "complete")
    assert down.count() == whole.groupBy(F.window("ts", "1 day"), "type").count().count()
    fold = streams.latest_states(stream.select(F.col("user_id").alias("id"), "ts", F.col("type").alias("state")), "id", f"{tmp_path}/fold-c", f"{tmp_path}/fold")
    fold.awaitTermination(120)
    last = max(int(p.name.split("=")[1]) for p in (tmp_path / "fold").iterdir())
    got = {r["id"]: r["state"] for r in spark.read.parquet(f"{tmp_path}/fold/version={last}").collect()}
    want = {r[0]: r[1] for r in whole.groupBy("user_id").agg(F.max_by("type", "ts")).collect()}
    assert got == want


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 10
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_histogram_bounds(spark):
    e = spark.createDataFrame([(0.5,), (1.0,), (5.0,), (None,)], "value double")
    assert [r["n"] for r in events.histogram(e, [1.0, 5.0]).orderBy("bucket").collect()] == [1, 1, 1]


def test_slot_bounds_and_ends_on_guards(spark):
    from ledgerlake.operators import compact

    assert [tuple(r) for r in compact.slot_bounds(spark, ["d", "m"]).orderBy("slot").collect()] == [(0, None, "d"), (1, "d", "m"), (2, "m", None)]
    assert [tuple(r) for r in compact.slot_bounds(spark, []).collect()] == [(0, None, None)]
    rows = spark.createDataFrame([("a", "d"), ("a", "e"), ("d", "z"), ("b", "m")], "s string, e string")
    first, last = compact.slots_touched(F.col("s"), F.col("e"), ["d", "m"])
    assert [tuple(r) for r in rows.select(first, last).collect()] == [(0, 0), (0, 1), (1, 2), (0, 1)]


def test_snapshot_states(spark):
    from ledgerlake.operators import state

    rows = [(1, 1, 10, "start"), (1, 2, 20, "done"), (2, 1, 5, "start"), (2, 2, 6, "cutover"), (3, 1, 7, "done"), (3, 2, 9, "start")]
    out = state.snapshots(spark.createDataFrame(rows, "shard int, seq long, ms long, kind string"))
    assert sorted(tuple(r) for r in out.collect()) == [(1, "completed", 10, 20), (2, "idle", None, None), (3, "in_progress", 9, None)]


def test_failure_detection_without_rows(spark):
    from ledgerlake.operators import state

    out = state.failure_detection(spark.createDataFrame([], "id long, seq long, ms long, state string"))
    assert [tuple(r) for r in out.collect()] == [(0, 0, 0, 0.0, 100.0)]


def test_dropped_namespace_takes_its_vectors(spark):
    rows = [(1, "insert", "a", 1), (2, "create", "a", 0), (3, "insert", "a", 2), (4, "drop", "a", 0), (5, "insert", "a", 3), (6, "create", "a", 0), (7, "insert", "a", 4), (8, "insert", "a", 5), (9, "delete", "a", 5)]
    left = vector.apply_commands(spark.createDataFrame(rows, "seq long, kind string, namespace string, id long"))
    assert [tuple(r) for r in left.collect()] == [("a", 4, 7)]


def test_first_of_equal_offers_is_selected(spark):
    arms = spark.createDataFrame([("x", 0.5, 4), ("y", 0.5, 4)], "action string, mean double, n long")
    offer = lambda *a: spark.createDataFrame(list(enumerate(a)), "position int, action string")
    assert compact.select_action(arms, offer("y", "x")).first()[0] == "y"
    assert compact.select_action(arms, offer("x", "new")).first()[0] == "new"


def test_compare_and_put_lets_one_request_through(spark):
    log = kv.put(spark, "k", 1.0, 5, 0)
    requests = spark.createDataFrame([("k", 5, 2.0), ("k", 5, 3.0), ("k", 4, 9.0)], "key string, expected_idx long, value double")
    got = kv.state(kv.apply_compare_and_set(log, requests, 100, 10), 10)
    assert [(r.value, r.idx) for r in got.collect()] == [(2.0, 101)]
    later = kv.apply_compare_and_set(log, requests, 100, 10).unionByName(kv.put(spark, "k", 7.0, 102, 11))
    assert [(r.value, r.idx) for r in kv.state(later, 11).collect()] == [(7.0, 102)]


def test_expired_and_deleted_are_told_apart(spark):
    log = kv.put(spark, "a", 1.0, 1, 0, 10).unionByName(kv.put(spark, "b", 1.0, 2, 0)).unionByName(kv.delete(spark, "b", 3, 5)).unionByName(kv.put(spark, "c", 1.0, 4, 0))
    assert {(r.key, r.reason) for r in kv.hidden(log, 10).collect()} == {("a", "expired"), ("b", "deleted")}


def test_empty_range_is_refused(spark):
    with pytest.raises(ValueError):
        compact.range_compaction(spark.range(1), "b", "a")


def test_registered_approximate_searches_take_all_stated_queries(spark, sf, monkeypatch):
    v = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label")
    q = v.where("vec_id % 20 = 0").selectExpr("vec_id as query_id", "embedding as vector")
    exact = {(r[0], r[1]) for r in vector.nearest_of_many(v, q, 10).collect()}
    assert len(exact) == 10 * q.count() > 100
    monkeypatch.setattr(ann, "BLOCK", 7)
    for name in ("v8_graph_search", "v15_quantised_search"):
        found = [(r[0], r[1]) for r in catalogue.queries()[name](spark, sf).collect()]
        assert len(found) == len(exact) and len(exact & set(found)) >= 0.9 * len(exact)


def test_searches_in_passes(spark, sf):
    v = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label")
    q = v.where("vec_id % 20 = 0").selectExpr("vec_id as query_id", "embedding as vector").unionAll(spark.createDataFrame([(-1, None)], "query_id long, vector array<float>"))
    books = ann.train_codebooks(v)
    one, many = (sorted(map(tuple, ann.in_passes(q, lambda some: ann.search_quantised(v, some, books, 10), most).select("query_id", "vec_id", "rank").collect())) for most in (1000, 9))
    assert one == many != []
    assert ann.in_passes(q.limit(0), None).count() == 0


ROWS = [(k, t, float(v) if v is not None else None) for t, (k, v) in enumerate([("a", 3), (None, 1), ("a", None), ("b", 2), (None, None), ("a", 2), ("a", 5), (None, 7), ("a", 1), ("b", None)])]


@pytest.mark.parametrize("large", [0, 100])
def test_ranks_and_last_values_of_keys(spark, monkeypatch, large):
    monkeypatch.setattr(ordering, "LARGE", large)
    df = spark.createDataFrame(ROWS, "key string, t int, value double").repartition(4)
    ranks = {r["t"]: (r["rank"], r["of"]) for r in ordering.ranked(df, ["key"], ["t"]).collect()}
    last = {r["t"]: (r["before"], r["most"]) for r in ordering.with_last(ordering.with_last(df, ["key"], ["t"], F.col("value"), "before"), ["key"], ["t"], F.col("value"), "most", own=True, most=True).collect()}
    for k, t, v in ROWS:
        mine = [x for x in ROWS if x[0] == k]
        seen = [x[2] for x in mine if x[1] < t and x[2] is not None]
        upto = seen + [v] * (v is not None)
        assert ranks[t] == (sum(x[1] <= t for x in mine), len(mine))
        assert last[t] == (seen[-1] if seen else None, max(upto) if upto else None)
    assert ordering.ranked(df.where("t < 0"), ["key"], ["t"]).count() == 0
    assert [r["rank"] for r in ordering.with_rank(df, "t").orderBy("t").collect()] == list(range(1, 11))


def test_sliding_totals_across_stretches(spark):
    rows = [("a", t, float(t or 0), i) for i, t in enumerate([0, 4, 5, 9, 10, 14, 20, 20, None, None, -3])]
    df = spark.createDataFrame(rows, "key string, ms long, value double, event_id long")
    got = {r["event_id"]: (r["window_total"], r["window_n"]) for r in events.sliding_total(df, ["key"], 5).collect()}
    for _, t, _, i in rows:
        near = [x[2] for x in rows if (t is None and x[1] is None) or (t is not None and x[1] is not None and t - 5 <= x[1] <= t)]
        assert got[i] == (sum(near), len(near))


def test_lag_of_replicas_without_a_group(spark):
    df = spark.createDataFrame([(None, 1), (None, 4), ("g", 2)], "g string, at int")
    assert sorted(r["lag"] for r in metrics.lag_behind(df, "g", "at").collect()) == [0, 0, 3]
