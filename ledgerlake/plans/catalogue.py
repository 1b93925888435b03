"""The registered queries, each with the SQL that gives the same rows where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.functions import hashing
from ledgerlake.functions.times import millis
from ledgerlake.functions.vectors import distance, is_valid
from ledgerlake.operators import ann, compact, events, kv, metrics, state, stats, vector
from ledgerlake.sources import inputs, storage

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

DAY = 86_400_000
NOW = 1_705_000_000_000  # 2024-01-11, within the events
TYPES = ["click", "error", "purchase", "signup", "view"]

M = """m as (select cast(user_id as varchar) as key, value, event_type = 'error' as tombstone,
 case when event_type = 'view' then 432000000 end::bigint as ttl_ms, 0::bigint as term, event_id as idx, epoch_us(ts) // 1000 as ms from events)"""
LIVE = "not tombstone and (ttl_ms is null or ms + ttl_ms > 1705000000000)"
T = """t as (select event_id, epoch_us(ts) // 1000 as ms, (user_id % 8)::int as node, event_type as type,
 case when event_type <> 'signup' then json_extract(props, '$.k')::int % 16 end as shard, value from events)"""
R = """r as (select (year(o_orderdate) * 12 + month(o_orderdate))::bigint as file_number, (file_number % 4)::int as level, (file_number % 3)::int as slot,
 count(*) * 120 as size, min(lpad(o_orderkey::varchar, 8, '0')) as min_key, max(lpad(o_orderkey::varchar, 8, '0')) as max_key, count(*) as entries,
 count(*) filter (o_orderstatus = 'F') as tombstone_count from orders group by all)"""
G = """g as (select event_id as seq, epoch_us(ts) // 1000 as ms, user_id % 40 as id, event_id % 7 as from_id,
 case event_type when 'click' then 'suspect' when 'error' then 'failed' when 'purchase' then 'left' else 'alive' end as state, (event_id // 2000)::bigint as incarnation from events)"""
S = """s as (select epoch_us(ts) // 1000 as ms, event_type as operation, (user_id % 4)::int as node, event_id,
 (row_number() over (partition by event_type, user_id % 4 order by event_id) % 150)::double as value from events)"""
NEWEST = "n as (select * from m qualify row_number() over (partition by key order by term desc, idx desc) = 1)"


def query(sql: str | None = None):
    """Registers a function under its name, with its oracle SQL."""

    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _log(spark, d):
    return inputs.mutations(spark, d)


# --- key-value -------------------------------------------------------------------------


@query(f"with {M}, {NEWEST} select key, value, tombstone, ttl_ms, term, idx, ms from n where {LIVE}")
def k0_state(spark, d):
    return kv.state(_log(spark, d), NOW)


@query(f"with {M}, {NEWEST} select key, value, tombstone, ttl_ms, term, idx, ms from n where {LIVE} and key = '17'")
def k1_get(spark, d):
    return kv.get(_log(spark, d), "17", NOW)


@query(f"with {M}, {NEWEST} select key, value, tombstone, ttl_ms, term, idx, ms from n where {LIVE} and key in ('3', '5', '7', '11', 'none')")
def k2_multi_get(spark, d):
    return kv.multi_get(_log(spark, d), ["3", "5", "7", "11", "none"], NOW)


@query(f"with {M}, {NEWEST} select key, value, idx from n where {LIVE} and key >= '1' and key < '5'")
def k6_range_scan(spark, d):
    return kv.scan(_log(spark, d), "1", "5", NOW).select("key", "value", "idx")


@query(f"with {M}, {NEWEST} select key, value, idx from n where {LIVE} and key >= '3' order by key limit 12")
def s4_seek(spark, d):
    return kv.seek(_log(spark, d), "3", 12, NOW).select("key", "value", "idx")


@query(f"with {M}, m2 as (select * from m where idx <= 500), {NEWEST.replace('from m', 'from m2')} select key, value, idx from n where {LIVE}")
def f7_snapshot(spark, d):
    return kv.state(_log(spark, d), NOW, (0, 500)).select("key", "value", "idx")


@query(
    f"""with {M}, b as (select n_nationkey::varchar as key, n_regionkey::double as value, n_nationkey % 5 = 0 as tombstone, case when n_nationkey % 3 = 0 then 1000 end::bigint as ttl_ms,
 0::bigint as term, 10000000 + row_number() over (order by n_nationkey) as idx, 1705000000000 - 5000 * (n_nationkey % 2) as ms from nation),
 m2 as (select * from m union all select key, value, tombstone, ttl_ms, term, idx, 1705000000000 as ms from b), {NEWEST.replace('from m', 'from m2')} select key, value, idx from n where {LIVE}"""
)
def k5_write_batch(spark, d):
    ops = inputs.table(spark, d, "nation").select(
        F.col("n_nationkey").alias("seq"), F.col("n_nationkey").cast("string").alias("key"), F.col("n_regionkey").cast("double").alias("value"), (F.col("n_nationkey") % 5 == 0).alias("tombstone"), F.when(F.col("n_nationkey") % 3 == 0, F.lit(1000).cast("long")).alias("ttl_ms")
    )
    return kv.state(kv.write_batch(_log(spark, d), ops, 10_000_000, NOW), NOW).select("key", "value", "idx")


@query(
    f"""with {M}, {NEWEST}, c as (select key, idx from n where {LIVE}), q as (select distinct cast(user_id as varchar) as key, event_id as expected_idx, value from events where event_id % 3 = 0 union all select 'missing', 1, 0.5),
 j as (select q.*, case when c.idx is null then 'not_found' when c.idx = expected_idx then 'written' else 'conflict' end as outcome from q left join c using (key)) select key, expected_idx, value, outcome from j"""
)
def f15_compare_and_set(spark, d):
    e = inputs.table(spark, d, "events").where("event_id % 3 = 0").select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("expected_idx"), "value")
    return kv.compare_and_set(_log(spark, d), e.unionByName(spark.createDataFrame([("missing", 1, 0.5)], "key string, expected_idx long, value double")), NOW)


@query("select user_id, event_type, event_id, value from events qualify row_number() over (partition by user_id, event_type order by event_id) = 1")
def f16_idempotency(spark, d):
    return kv.first_per_idempotency_key(inputs.table(spark, d, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "event_id")


@query("select doc_id, octet_length(encode(text))::int as bytes, case when octet_length(encode(text)) = 0 then 'empty key' else 'key too long' end as reason from documents where octet_length(encode(text)) > 1024 or octet_length(encode(text)) = 0")
def f13_size_limits(spark, d):
    docs = inputs.table(spark, d, "documents").select("doc_id", F.col("text").alias("key"), F.lit("").alias("value"))
    return kv.rejected(docs, "key", "value").select("doc_id", F.octet_length("key").alias("bytes"), "reason")


@query("with l as (select event_id % 20 as segment, event_id as pos, event_type <> 'error' or event_id % 7 > 0 as ok from events), b as (select segment, min(pos) filter (not ok) as bad from l group by 1) select segment, pos from l join b using (segment) where bad is null or pos < bad")
def s12_recover(spark, d):
    log = inputs.table(spark, d, "events").select((F.col("event_id") % 20).alias("segment"), F.col("event_id").alias("pos"), ((F.col("event_type") != "error") | (F.col("event_id") % 7 > 0)).alias("ok"))
    return kv.recover(log).select("segment", "pos")


# --- compaction ------------------------------------------------------------------------

ENTRIES = "e as (select cast(user_id as varchar) as key, value, event_type = 'error' as tombstone, event_id as run from events)"


def _entries(spark, d):
    return inputs.table(spark, d, "events").select(F.col("user_id").cast("string").alias("key"), "value", (F.col("event_type") == "error").alias("tombstone"), F.col("event_id").alias("run"))


@query(f"with {ENTRIES} select * from e qualify row_number() over (partition by key order by run desc) = 1")
def c1_merge(spark, d):
    return compact.merge(_entries(spark, d), False)


@query(f"with {ENTRIES}, n as (select * from e qualify row_number() over (partition by key order by run desc) = 1) select * from n where not tombstone")
def c6_cleanup(spark, d):
    return compact.merge(_entries(spark, d), True)


@query(f"with {R} select file_number, level, slot, size from r qualify level = 0 or row_number() over (partition by level, slot order by file_number) <= 2")
def c3_tier_choice(spark, d):
    return compact.oldest_runs(inputs.runs(spark, d), 2).select("file_number", "level", "slot", "size")


@query(f"with {R} select file_number, min_key, max_key from r where max_key >= '00001000' and min_key < '00009000'")
def f2_overlapping_runs(spark, d):
    return inputs.runs(spark, d).where(compact.overlaps("00001000", "00009000")).select("file_number", "min_key", "max_key")


def _num(k: str) -> str:
    return "(" + " + ".join(f"ascii(substr({k}, {i}, 1))::hugeint * {256 ** (8 - i)}" for i in range(1, 9)) + ")"


@query(
    f"""with {R}, o as (select *, greatest(min_key, '00000500') as low, least(max_key, '00000900') as high from r where max_key >= '00000500' and min_key < '00000900')
 select coalesce(sum(floor(size * case when min_key >= '00000500' and max_key <= '00000900' then 1.0::double when min_key = max_key then 0.5::double else least(1.0::double, ({_num('high')} - {_num('low')})::double / ({_num('max_key')} - {_num('min_key')})::double) end)), 0)::bigint as bytes, count(*) as files from o"""
)
def k8_approximate_size(spark, d):
    return compact.approximate_size(inputs.runs(spark, d), "00000500", "00000900")


@query("with k as (select distinct lpad(o_orderkey::varchar, 8, '0') as key from orders), n as (select key, row_number() over (order by key) - 1 as i, count(*) over () as n from k) select (i // (n // 16))::bigint as guard_id, key as guard from n where i > 0 and i % (n // 16) = 0 and i // (n // 16) < 16")
def c15_guards(spark, d):
    return compact.propose_guards(inputs.table(spark, d, "orders").select(F.lpad(F.col("o_orderkey").cast("string"), 8, "0").alias("key")), 16)


@query("select ((key >= '00000300')::int + (key >= '00000700')::int + (key >= '00002000')::int) as slot, count(*) as n from (select lpad(o_orderkey::varchar, 8, '0') as key from orders) group by 1")
def c17_slots(spark, d):
    key = F.lpad(F.col("o_orderkey").cast("string"), 8, "0")
    return inputs.table(spark, d, "orders").groupBy(compact.slot_of(key, ["00000300", "00000700", "00002000"]).alias("slot")).agg(F.count("*").alias("n"))


@query(
    f"""with {R}, z as (select count(*)::int as n, count(*) / 40 as q from r where level = 0),
 s as (select r.level, r.slot, count(*)::int as n, sum(size) as bytes, sum(tombstone_count) / sum(entries) as density, (r.level * 3 + r.slot) / 10 as heat, 5 + r.slot as k, {NOW} - 20 * 3600000 * r.slot as compacted_ms from r where level > 0 group by 1, 2),
 t as (select *, unnest([{{'action': 'promote', 'runs': n, 'trigger': 'single run', 'ok': n = 1 and level < 3}}, {{'action': 'tier', 'runs': least(n, 4), 'trigger': 'size', 'ok': n >= 2 and bytes > 1.5 * 40000 * pow(2, level - 1)}},
 {{'action': 'tier', 'runs': least(k, 4), 'trigger': 'count', 'ok': n > k}}, {{'action': 'eager', 'runs': n, 'trigger': 'hot', 'ok': n > 1 and heat >= 0.8}}, {{'action': 'cleanup', 'runs': n, 'trigger': 'tombstones', 'ok': level = 3 and density >= 0.15}},
 {{'action': 'tier', 'runs': least(n, 4), 'trigger': 'age', 'ok': n >= 2 and {NOW} - compacted_ms > 86400000}}]) as o from s)
 select 0 as level, 0 as slot, 'tier' as action, n as runs, 'level 0' as trigger from z where n >= case when q >= 0.75 then 2 when q >= 0.5 then 3 else 4 end
 union all select level, slot, o.action, o.runs::int, o.trigger from t where o.ok
 union all select level, null, 'guard move', 0, 'imbalance' from s group by level having count(*) > 1 and sum(bytes) >= 10 and max(bytes) / avg(bytes) >= 3 and max(compacted_ms) <= {NOW} - 3600000"""
)
def c8_candidates(spark, d):
    r = inputs.runs(spark, d)
    slots = r.select("level", "slot").distinct().select("level", "slot", ((F.col("level") * 3 + F.col("slot")) / 10).alias("heat"), (F.col("slot") + 5).alias("k"), (NOW - 20 * 3_600_000 * F.col("slot").cast("long")).alias("compacted_ms"))
    return compact.candidates(r, slots, NOW, 40, 3, 40_000, 2, least_bytes=10)


@query("select event_id, case when q >= 0.9 then 2 when q >= 0.75 then 2 when q >= 0.5 then 3 else 4 end as l0_threshold, case when q >= 0.9 then 0.0 when q >= 0.75 then 0.02 when q >= 0.5 then 0.05 else 0.1 end::double as epsilon, case when q >= 0.9 then 16 when q >= 0.75 then 32 when q >= 0.5 then 64 else 128 end as slice_mib from (select event_id, (event_id % 100) / 100.0 as q from events)")
def c9_pressure_settings(spark, d):
    s = compact.pressure_settings((F.col("event_id") % 100) / 100.0)
    return inputs.table(spark, d, "events").select("event_id", *(v.alias(k) for k, v in s.items()))


@query(
    """with a as (select event_type as action, event_id as seq, value / 100 as reward, count(*) over (partition by event_type) - row_number() over (partition by event_type order by event_id) as later,
 row_number() over (partition by event_type order by event_id) = 1 as first from events), b as (select action, sum(reward * pow(0.9, later) * case when first then 1.0 else 0.1 end) as mean, count(*) as n from a group by 1)
 select action, round(mean, 6) as mean, n, round(mean + 2.0 * sqrt(ln((select sum(n) from b)) / n), 6) as ucb from b"""
)
def c11_ucb(spark, d):
    r = inputs.table(spark, d, "events").select(F.col("event_type").alias("action"), F.col("event_id").alias("seq"), (F.col("value") / 100).alias("reward"))
    return compact.ucb(compact.arm_statistics(r)).select("action", F.round("mean", 6).alias("mean"), "n", F.round("ucb", 6).alias("ucb"))


@query("select event_id, case when event_id % 50 = 0 then 0::double else value * 0.5::double / (event_id % 50)::double * (case when q >= 0.9 then 3 when q >= 0.75 then 2 when q >= 0.5 then 1.5 else 1 end)::double * (case when event_id % 2 = 0 and q >= 0.75 then 1.5 else 1 end)::double end as reward from (select *, (event_id % 100)::double / 100 as q from events)")
def c13_reward(spark, d):
    ratio = (F.col("event_id") % 100) / 100.0
    found = compact.reward(F.col("value"), F.lit(0.5), F.col("event_id") % 50, ratio, F.col("event_id") % 2 == 0)
    return inputs.table(spark, d, "events").select("event_id", found.alias("reward"))


@query("with s as (select (o_orderkey % 5)::int as level, least(o_custkey % 20, 4)::int as slot, count(*) as bytes, min(o_orderkey) * 1000 as compacted_ms from orders group by 1, 2), l as (select level, count(*) as n, sum(bytes) as bytes, max(bytes) as largest, max(compacted_ms) as last from s group by 1) select level, round(largest / (bytes / n), 6) as ratio from l where n > 1 and bytes >= 10 and largest / (bytes / n) >= 3 and last <= 1705000000000 - 3600000")
def c14_imbalance(spark, d):
    o = inputs.table(spark, d, "orders")
    s = o.groupBy((F.col("o_orderkey") % 5).cast("int").alias("level"), F.least(F.col("o_custkey") % 20, F.lit(4)).cast("int").alias("slot")).agg(F.count("*").alias("bytes"), (F.min("o_orderkey") * 1000).alias("compacted_ms"))
    return compact.imbalanced_levels(s, NOW, 10).select("level", F.round("ratio", 6).alias("ratio"))


EDITS = "e as (select o_orderkey * 2 as seq, 'add' as edit, (o_orderkey % 3)::int as level, (o_custkey % 4)::int as slot, o_orderkey as file_number, o_custkey as size from orders union all select o_orderkey * 2 + 1, 'delete', (o_orderkey % 3)::int, (o_custkey % 4)::int, o_orderkey, o_custkey from orders where o_orderkey % 4 = 0)"


@query(f"with {EDITS}, l as (select * from e qualify row_number() over (partition by level, slot, file_number order by seq desc) = 1) select level, slot, file_number, size from l where edit = 'add'")
def a30_manifest(spark, d):
    o = inputs.table(spark, d, "orders")
    part = lambda f, seq, edit: f.select(seq.alias("seq"), F.lit(edit).alias("edit"), (F.col("o_orderkey") % 3).cast("int").alias("level"), (F.col("o_custkey") % 4).cast("int").alias("slot"), F.col("o_orderkey").alias("file_number"), F.col("o_custkey").alias("size"))
    return compact.fold_manifest(part(o, F.col("o_orderkey") * 2, "add").unionByName(part(o.where("o_orderkey % 4 = 0"), F.col("o_orderkey") * 2 + 1, "delete")))


# --- statistics ------------------------------------------------------------------------


@query(f"with {R} select level, count(*) as files, sum(size)::bigint as bytes, count(distinct slot) as slots from r group by 1")
def a16_levels(spark, d):
    return stats.levels(inputs.runs(spark, d))


@query("select round(sum(l_extendedprice) / sum(l_extendedprice * (1 - l_discount)), 6) as compaction_ratio, round(sum(l_extendedprice * (1 - l_discount)) / sum(l_extendedprice), 6) as write_amplification, round(sum(l_extendedprice) - sum(l_extendedprice * (1 - l_discount)), 0) as saved, count(*) as n from lineitem")
def a11_amplification(spark, d):
    r = inputs.table(spark, d, "lineitem").select(F.col("l_extendedprice").alias("bytes_in"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("bytes_out"))
    return stats.amplification(r).select(F.round("compaction_ratio", 6).alias("compaction_ratio"), F.round("write_amplification", 6).alias("write_amplification"), F.round("saved", 0).alias("saved"), "n")


@query("select p, count(*) as n, round(avg(0.4 * q + 0.4 * q / 2 + 0.2 * q / 4), 6) as score from (select (event_id % 130)::double / 100 as q, case when q >= 1.1 then 4 when q >= 0.9 then 3 when q >= 0.75 then 2 when q >= 0.5 then 1 else 0 end as p from events) group by 1")
def a17_pressure(spark, d):
    q = (F.col("event_id") % 130).cast("double") / 100
    return inputs.table(spark, d, "events").groupBy(stats.pressure(q).alias("p")).agg(F.count("*").alias("n"), F.round(F.avg(stats.pressure_score(q, q / 2, q / 4)), 6).alias("score"))


@query(
    f"""with o as (select user_id % 16 as slot, event_id as seq, case event_type when 'view' then 1.0 when 'click' then 2.0 when 'error' then 0.5 when 'purchase' then 0.5 else 0.0 end as w from events),
 p as (select slot, w * {stats.alpha(100)!r} * pow(1 - {stats.alpha(100)!r}, count(*) over (partition by slot) - row_number() over (partition by slot order by seq)) as h from o),
 q as (select slot, sum(h) as heat from p group by 1) select slot, round(heat, 6) as heat, case when heat >= 0.8 then 'hot' when heat <= 0.2 then 'cold' else 'warm' end as class from q"""
)
def a18_heat(spark, d):
    op = F.when(F.col("event_type") == "view", "get").when(F.col("event_type") == "click", "scan").when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "purchase", "put").otherwise("other")
    o = inputs.table(spark, d, "events").select((F.col("user_id") % 16).alias("slot"), F.col("event_id").alias("seq"), op.alias("op"))
    return stats.heat(o, 100).select("slot", F.round("heat", 6).alias("heat"), stats.slot_class(F.col("heat")).alias("class"))


@query(f"with {R} select round(sum(tombstone_count) / sum(floor(size / 100)), 6) as density from r")
def a29_tombstone_density(spark, d):
    return stats.tombstone_density(inputs.runs(spark, d)).select(F.round("density", 6).alias("density"))


# --- events ----------------------------------------------------------------------------


@query(f"with {T} select event_id, node, type, shard from t where node in (1, 3) and type in ('click', 'signup') and (shard is null or shard in (2, 4, 6))")
def f8_filter(spark, d):
    return inputs.telemetry(spark, d).where(events.matches([1, 3], ["Click", "signup"], [2, 4, 6])).select("event_id", "node", "type", "shard")


@query("select event_id, array_to_string(list_filter([try_cast(event_id as int), try_cast('x' as int), 7], lambda x: x is not null), ',') as numbers, lower(event_type) || ',b' as names from events")
def f11_parse(spark, d):
    text = F.concat(F.col("event_id").cast("string"), F.lit(" , x,7"))
    names = F.concat(F.lit(" "), F.upper("event_type"), F.lit(", ,B"))
    return inputs.table(spark, d, "events").select("event_id", F.array_join(events.parse_numbers(text).cast("array<string>"), ",").alias("numbers"), F.array_join(events.parse_names(names), ",").alias("names"))


COUNTS = ", ".join(f"count(*) filter (type = '{t}') as n_{t}" for t in TYPES)
BATCHES = f"b as (select ms - ms % 3600000 as window_start, count(*) as n, {COUNTS}, ms - ms % 3600000 + 3600000 as window_end from t group by 1, ms - ms % 3600000)"


def _batches(spark, d):
    return events.coalesce_windows(inputs.telemetry(spark, d), 3_600_000, TYPES)


@query(f"with {T}, {BATCHES} select * from b")
def r1_coalesce(spark, d):
    return _batches(spark, d)


@query(f"with {T}, {BATCHES} select window_start, window_end, n from b where window_end >= (select max(window_end) from b) - 10 * 86400000 order by window_end desc limit 200")
def r2_retention(spark, d):
    return events.retain(_batches(spark, d), 10 * DAY, 200).select("window_start", "window_end", "n")


@query(f"with {T}, {BATCHES} select window_start, window_end, n from b where window_start >= 1704500000000 and window_end <= 1705000000000")
def r3_replay(spark, d):
    return events.replay(_batches(spark, d), 1_704_500_000_000, NOW).select("window_start", "window_end", "n")


@query(f"with {T} select node, ms - ms % 86400000 + 43200000 as mid_ms, arg_max(value, (ms, event_id)) as last, round(avg(value), 6) as mean, max(value) as most, min(value) as least, round(sum(value), 4) as total from t group by 1, 2")
def r7_downsample(spark, d):
    return events.downsample(inputs.telemetry(spark, d), ["node"], DAY).select("node", "mid_ms", "last", F.round("mean", 6).alias("mean"), "most", "least", F.round("total", 4).alias("total"))


@query(f"with {T} select type, min(value) as least, max(value) as most, round(avg(value), 6) as mean, count(value) as n from t group by 1")
def a5_series(spark, d):
    return events.series_statistics(inputs.telemetry(spark, d), ["type"]).select("type", "least", "most", F.round("mean", 6).alias("mean"), "n")


@query(f"with {T}, l as (select type, list_sort(list(value)) as v, count(*) as n from t group by 1) select type, v[floor(n * 0.5)::int + 1] as p50, v[floor(n * 0.95)::int + 1] as p95, v[floor(n * 0.99)::int + 1] as p99 from l")
def a6_percentiles(spark, d):
    return events.percentiles(inputs.telemetry(spark, d), ["type"], {"p50": 0.5, "p95": 0.95, "p99": 0.99})


@query(f"with {T}, h as (select (value >= 1)::int + (value >= 10)::int + (value >= 50)::int + (value >= 100)::int + (value >= 1000000)::int as bucket, count(*) as n from t where value is not null group by 1), e as (select unnest(['<1', '1-10', '10-50', '50-100', '100-1e+06', '>=1e+06']) as label, unnest(range(6))::int as bucket) select bucket, label, coalesce(n, 0) as n from e left join h using (bucket)")
def a7_histogram(spark, d):
    return events.histogram(inputs.telemetry(spark, d), [1.0, 10.0, 50.0, 100.0, 1_000_000.0])


@query(f"with {T}, b as (select pow(2, unnest(range(10)))::double as le) select le, count(*) filter (value <= le) as n from b, t group by 1")
def a8_cumulative_histogram(spark, d):
    return events.cumulative_histogram(inputs.telemetry(spark, d), 10)


@query(f"with {T} select type, event_id, value from t qualify row_number() over (partition by type order by ms desc, event_id desc) <= 10")
def w6_last_n(spark, d):
    return events.last_n(inputs.telemetry(spark, d), ["type"], 10).select("type", "event_id", "value")


@query(f"with {T}, r as (select node, value, row_number() over (partition by node order by ms, event_id) <= count(*) over (partition by node) // 2 as early from t) select node, avg(value) filter (not early) > avg(value) filter (early) as rising from r group by 1")
def w7_trend(spark, d):
    return events.trend(inputs.telemetry(spark, d), ["node"])


@query(f"with {T} select event_id, round(sum(value) over w, 4) as window_total, count(*) over w as window_n from t window w as (partition by node order by ms range between 3600000 preceding and current row)")
def a22_sliding(spark, d):
    return events.sliding_total(inputs.telemetry(spark, d), ["node"], 3_600_000).select("event_id", F.round("window_total", 4).alias("window_total"), "window_n")


@query(f"with {T}, p as (select distinct node, ms - ms % 86400000 as at from t where type = 'view'), f as (select * from t where type = 'error') select p.node, p.at, (select arg_max(f.value, (f.ms, f.event_id)) from f where f.node = p.node and f.ms <= p.at) as value from p")
def j5_as_of(spark, d):
    t = inputs.telemetry(spark, d)
    points = t.where("type = 'view'").select("node", (F.col("ms") - F.col("ms") % DAY).alias("at")).distinct()
    return events.as_of(points, t.where("type = 'error'"), "node", "at", "ms", "value")


@query(f"with {T}, e as (select 1705000000000 - 1705000000000 % 60000 - 60000 * unnest(range(600)) as minute_ms), c as (select ms - ms % 60000 as minute_ms, count(*) as n from t group by 1) select minute_ms, coalesce(n, 0) as n from e left join c using (minute_ms)")
def r10_per_minute(spark, d):
    return events.per_minute(inputs.telemetry(spark, d), NOW, 600)


# --- cluster state ---------------------------------------------------------------------


@query(f"with {G}, l as (select id, arg_max(state, seq) as state from g group by 1) select count(*) as total, count(*) filter (state = 'alive') as alive, count(*) filter (state = 'suspect') as suspect, count(*) filter (state = 'failed') as dead, count(*) filter (state in ('suspect', 'failed')) = 0 as healthy from l")
def a9_health(spark, d):
    return state.health(state.latest_status(inputs.gossip(spark, d)))


@query(f"with {G}, c as (select *, lag(state, 1, 'alive') over (partition by id order by seq) as before from g) select id, seq, before, state from c where state <> before qualify row_number() over (partition by id order by seq desc) <= 20")
def w2_transitions(spark, d):
    return state.transitions(inputs.gossip(spark, d), 20)


@query(
    f"""with recursive {G}, o as (select *, row_number() over (partition by id order by seq) as k from g),
 f as (select id, 1 as k, state, incarnation from o where k = 1 union all
 select f.id, f.k + 1, case when takes then o.state else f.state end, case when takes then o.incarnation else f.incarnation end from f join o on o.id = f.id and o.k = f.k + 1,
 lateral (select f.state <> 'left' and (o.incarnation > f.incarnation or (o.incarnation = f.incarnation and ((f.state = 'alive' and o.state = 'suspect') or (f.state = 'suspect' and o.state = 'failed') or o.state = 'left'))) as takes))
 select id, arg_max(state, k) as state, arg_max(incarnation, k) as incarnation from f group by 1"""
)
def d18_members(spark, d):
    return state.members(inputs.gossip(spark, d))


@query(f"with {G} select id, count(distinct from_id) as suspected_by from g where state = 'suspect' group by 1")
def a28_suspicions(spark, d):
    return state.suspicions(inputs.gossip(spark, d))


@query(f"with {G}, w as (select *, max(case when state = 'suspect' then seq end) over (partition by id order by seq rows between unbounded preceding and 1 preceding) as s from g) select w.id, w.seq, w.ms - g.ms as latency_ms from w left join g on g.seq = w.s where w.state = 'failed'")
def w4_confirm_latency(spark, d):
    return state.confirm_latency(inputs.gossip(spark, d))


@query(f"with {T}, e as (select shard, ms, event_id, event_id // 50 as term from t where shard is not null), b as (select *, coalesce(max(term) over (partition by shard order by ms, event_id rows between unbounded preceding and 1 preceding), 0) as before from e) select shard, max(term) as term, count(*) filter (term > before) as elections, max(case when term > before then ms end) as last_ms from b group by 1")
def w3_elections(spark, d):
    t = inputs.telemetry(spark, d).where("shard is not null").select("shard", "ms", "event_id", F.floor(F.col("event_id") / 50).alias("term"))
    return state.elections(t)


@query(f"with {T}, c as (select shard, ms // 86400000 as w, count(*) as n from t where shard is not null group by 1, 2 having count(*) > 3) select shard, count(*) as windows, max(n) as most from c group by 1")
def r11_storms(spark, d):
    return state.storms(inputs.telemetry(spark, d), DAY, 3)


@query("with h as (select event_id as id, user_id as key, epoch_us(ts) // 1000 as i, epoch_us(ts) // 1000 + (event_id % 100) * 1000000 as r from events) select a.id, count(b.id) as n from h a left join h b on a.key = b.key and b.r < a.i group by 1")
def j6_happens_before(spark, d):
    ms = millis("ts")
    h = inputs.table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("key"), ms.alias("invoke_ms"), (ms + F.col("event_id") % 100 * 1_000_000).alias("return_ms"))
    return state.happens_before(h)


@query("with o as (select s_suppkey as shard, s_nationkey % 5 as node from supplier), n as (select s_suppkey as shard, (s_nationkey + s_suppkey % 2) % 5 as node from supplier) select *, 'added' as change from (select * from n except all select * from o) union all select *, 'removed' from (select * from o except all select * from n)")
def j10_placement_diff(spark, d):
    s = inputs.table(spark, d, "supplier")
    return state.placement_diff(s.select(F.col("s_suppkey").alias("shard"), (F.col("s_nationkey") % 5).alias("node")), s.select(F.col("s_suppkey").alias("shard"), ((F.col("s_nationkey") + F.col("s_suppkey") % 2) % 5).alias("node")))


@query("with p as (select o_custkey as shard, o_orderkey as matched from orders) select shard, (list_sort(list(matched), 'desc'))[(count(*) // 2)::int + 1] as commit from p group by 1")
def a24_commit_index(spark, d):
    return state.commit_index(inputs.table(spark, d, "orders").select(F.col("o_custkey").alias("shard"), F.col("o_orderkey").alias("matched")))


@query("select n_name, r_name, count(c_custkey) as customers from nation left join region on n_regionkey = r_regionkey left join customer on c_nationkey = n_nationkey and c_acctbal < 0 group by 1, 2")
def j9_left_join(spark, d):
    t = lambda n: inputs.table(spark, d, n)
    joined = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"), "left").join(t("customer").where("c_acctbal < 0"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return joined.groupBy("n_name", "r_name").agg(F.count("c_custkey").alias("customers"))


# --- metric recipes --------------------------------------------------------------------

RATE = "i as (select *, case when lag(value) over w is null then 0 when value < lag(value) over w then value else value - lag(value) over w end as increase from s window w as (partition by operation, node order by event_id)), q as (select operation, node, ms - ms % 86400000 as window_start, sum(increase) / 86400 as rate from i group by all)"


def _rates(spark, d):
    return metrics.rate(inputs.samples(spark, d), ["operation", "node"], DAY)


@query(f"with {S}, {RATE} select operation, node, window_start, round(rate, 9) as rate from q")
def p1_rate(spark, d):
    return _rates(spark, d).select("operation", "node", "window_start", F.round("rate", 9).alias("rate"))


@query(f"with {S}, {RATE}, o as (select operation, window_start, sum(rate) as rate from q group by all) select operation, window_start, round(rate, 9) as rate, round(100 * rate / sum(rate) over (partition by window_start), 6) as percent from o")
def p3_share(spark, d):
    totals = _rates(spark, d).groupBy("operation", "window_start").agg(F.sum("rate").alias("rate"))
    return metrics.share(totals, ["window_start"], "rate").select("operation", "window_start", F.round("rate", 9).alias("rate"), F.round("percent", 6).alias("percent"))


@query(
    f"""with {T}, b as (select unnest([1, 2, 4, 8, 16, 32, 64, 128, 256, 'infinity'::double]) as le), c as (select type, le, count(*) filter (value <= le) as n from b, t group by 1, 2),
 w as (select *, lag(le, 1, 0) over o as low, lag(n, 1, 0) over o as below, max(n) over (partition by type) as total from c window o as (partition by type order by le))
 select type, round(case when le = 'infinity'::double then low else low + (le - low) * (0.95 * total - below) / (n - below) end, 6)::double as quantile from w where n >= 0.95 * total and below < 0.95 * total"""
)
def p4_histogram_quantile(spark, d):
    bounds = [float(1 << i) for i in range(9)] + [float("inf")]
    t = inputs.telemetry(spark, d).groupBy("type").agg(F.array(*(F.struct(F.lit(b).alias("le"), F.count_if(F.col("value") <= b).alias("n")) for b in bounds)).alias("b"))
    return metrics.histogram_quantile(t.select("type", F.inline("b")), ["type"], 0.95).select("type", F.round("quantile", 6).alias("quantile"))


@query(f"with {S} select operation, node, ms - ms % 86400000 as window_start, arg_max(value, event_id) - arg_min(value, event_id) as delta from s group by all")
def p9_delta(spark, d):
    return metrics.gauge_delta(inputs.samples(spark, d), ["operation", "node"], DAY)


@query("select s_suppkey, s_nationkey, round(max(s_acctbal) over (partition by s_nationkey) - s_acctbal, 2) as lag from supplier")
def p8_replication_lag(spark, d):
    s = inputs.table(spark, d, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    return metrics.lag_behind(s, "s_nationkey", "s_acctbal").select("s_suppkey", "s_nationkey", F.round("lag", 2).alias("lag"))


@query(f"with {T}, r as (select *, sum(case when value > 5 then 0 else 1 end) over (partition by node order by event_id rows unbounded preceding) as run from t), g as (select node, run, min(event_id) as begin_ms, max(event_id) as end_ms from r where value > 5 group by 1, 2) select node, begin_ms, end_ms from g where end_ms - begin_ms >= 40")
def p10_sustained(spark, d):
    return metrics.sustained(inputs.telemetry(spark, d), ["node"], "event_id", "value > 5", 40)


# --- vectors ---------------------------------------------------------------------------

DOT = "list_sum(list_transform(range(1, 65), lambda i: {a}[i]::double * {b}[i]::double))"
L2 = "sqrt(list_sum(list_transform(range(1, 65), lambda i: ({a}[i]::double - {b}[i]::double) ** 2)))"
COS = f"1 - {DOT} / sqrt({DOT.format(a='{a}', b='{a}')} * {DOT.format(a='{b}', b='{b}')})"
PAIR = {"a": "v.embedding", "b": "q.embedding"}


def _vectors(spark, d):
    return inputs.table(spark, d, "embeddings").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label")


def _first(spark, d, n):
    return [(r[0], list(r[1])) for r in _vectors(spark, d).where(F.col("vec_id") < n).orderBy("vec_id").select("vec_id", "embedding").collect()]


@query(f"select v.vec_id, round({L2.format(**PAIR)}, 6) as distance from embeddings v, embeddings q where q.vec_id = 0 order by {L2.format(**PAIR)}, v.vec_id limit 10")
def v5_exact_knn(spark, d):
    return vector.nearest(_vectors(spark, d), _first(spark, d, 1)[0][1], 10).select("vec_id", F.round("distance", 6).alias("distance"))


@query(f"select v.vec_id, round({COS.format(**PAIR)}, 6) as distance from embeddings v, embeddings q where q.vec_id = 3 order by {COS.format(**PAIR)}, v.vec_id limit 10")
def n9_cosine_knn(spark, d):
    return vector.nearest(_vectors(spark, d), _first(spark, d, 4)[3][1], 10, "cosine").select("vec_id", F.round("distance", 6).alias("distance"))


@query(f"select v.vec_id, round(-{DOT.format(**PAIR)}, 6) as distance from embeddings v, embeddings q where q.vec_id = 5 order by -{DOT.format(**PAIR)}, v.vec_id limit 10")
def n10_inner_product_knn(spark, d):
    return vector.nearest(_vectors(spark, d), _first(spark, d, 6)[5][1], 10, "inner_product").select("vec_id", F.round("distance", 6).alias("distance"))


@query(f"with p as (select q.vec_id as query_id, v.vec_id, {L2.format(**PAIR)} as distance from embeddings v, embeddings q where q.vec_id % 20 = 0) select query_id, vec_id, round(distance, 5) as distance, row_number() over (partition by query_id order by distance, vec_id)::int as rank from p qualify rank <= 5")
def v6_batched_knn(spark, d):
    v = _vectors(spark, d)
    q = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return vector.nearest_of_many(v, q, 5).select("query_id", "vec_id", F.round("distance", 5).alias("distance"), "rank")


@query(f"with d as (select v.vec_id, v.label, {L2.format(**PAIR)} as distance from embeddings v, embeddings q where q.vec_id = 0), t as (select * from d qualify row_number() over (partition by label order by distance, vec_id) <= 10) select vec_id, round(min(distance), 6) as distance from t group by 1 order by min(distance), vec_id limit 5")
def v9_tiered(spark, d):
    tiers = vector.nearest_by_tier(_vectors(spark, d), _first(spark, d, 1)[0][1], 10, "label").select("vec_id", "distance")
    return vector.merge_tiers([tiers], 5).select("vec_id", F.round("distance", 6).alias("distance"))


@query("with l as (select vec_id % 100 as vec_id, vec_id as seq, vec_id % 9 = 0 as deleted from embeddings) select vec_id, seq from l qualify row_number() over (partition by vec_id order by seq desc) = 1 and not deleted")
def v2_upsert_delete(spark, d):
    log = inputs.table(spark, d, "embeddings").select((F.col("vec_id") % 100).alias("vec_id"), F.array(F.col("vec_id").cast("double")).alias("embedding"), F.col("vec_id").alias("seq"), (F.col("vec_id") % 9 == 0).alias("deleted"))
    return vector.newest_vectors(log).select("vec_id", F.col("embedding")[0].cast("long").alias("seq"))


@query("select label, count(*) as n, count(*) filter (len(embedding) = 64 and vec_id % 3 > 0) as valid from embeddings group by 1")
def f14_validity(spark, d):
    broken = F.when(F.col("vec_id") % 3 == 0, F.concat("embedding", F.array(F.lit(float("nan")).cast("float")))).otherwise(F.col("embedding"))
    v = inputs.table(spark, d, "embeddings").select("label", is_valid(broken, 64).alias("ok"))
    return v.groupBy("label").agg(F.count("*").alias("n"), F.count_if("ok").alias("valid"))


@query(f"select v.label, round(avg({L2.format(**PAIR)}), 5) as l2, round(avg({COS.format(**PAIR)}), 5) as cosine from embeddings v, embeddings q where q.vec_id = 7 group by 1")
def n7_distances(spark, d):
    q = F.array(*(F.lit(float(x)) for x in _first(spark, d, 8)[7][1]))
    v = _vectors(spark, d).select("label", distance("l2", F.col("embedding"), q).alias("l"), distance("cosine", F.col("embedding"), q).alias("c"))
    return v.groupBy("label").agg(F.round(F.avg("l"), 5).alias("l2"), F.round(F.avg("c"), 5).alias("cosine"))


def _asked(v):
    return v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


@query()
def v15_quantised_search(spark, d):
    v = _vectors(spark, d)
    books = ann.train_codebooks(v)
    return ann.in_passes(_asked(v), lambda some: ann.search_quantised(v, some, books, 10))


@query()
def v8_graph_search(spark, d):
    v = _vectors(spark, d)
    return ann.in_passes(_asked(v), lambda some: ann.search_graphs(v, some, 10), ann.GRAPH_QUERIES)


# --- routing ---------------------------------------------------------------------------


@query()
def n3_shards(spark, d):
    key = F.col("url")
    return inputs.table(spark, d, "pages").select("page_id", hashing.xxh64(key).alias("hash"), hashing.shard(key, 1024).alias("shard"))


@query(
    """with recursive j as (select o_orderkey as id, o_orderkey::hugeint as k, -1::bigint as b, 0::bigint as a from (select distinct o_orderkey from orders) union all
 select id, (k * 2862933555777941757 + 1) % 18446744073709551616::hugeint, a, floor((a + 1) * (2147483648.0::double / ((((k * 2862933555777941757 + 1) % 18446744073709551616::hugeint) // 8589934592)::double + 1)))::bigint from j where a < 64)
 select id as o_orderkey, max(b)::int as bucket from j group by 1"""
)
def n2_jump_hash(spark, d):
    return inputs.table(spark, d, "orders").select("o_orderkey").distinct().select("o_orderkey", hashing.jump_bucket(F.col("o_orderkey"), 64).alias("bucket"))


# --- summaries -------------------------------------------------------------------------

GUARDS = ["00000300", "00000700", "00002000"]
SLOT = "((({k} >= '00000300')::int + ({k} >= '00000700')::int + ({k} >= '00002000')::int))"


@query(f"with {T}, {BATCHES} select count(*) as batches, sum(n)::bigint as events, min(window_start) as oldest, max(window_end) as newest from b")
def a2_totals(spark, d):
    return events.totals(_batches(spark, d))


@query(f"with {T}, {BATCHES} select window_start, window_end, n from b order by window_end desc limit 10")
def r4_recent(spark, d):
    return events.recent(_batches(spark, d), 10).select("window_start", "window_end", "n")


@query(f"with {T} select node, arg_max(ms, (ms, event_id)) as ms, arg_max(event_id, (ms, event_id)) as event_id, arg_max(value, (ms, event_id)) as value from t where value > 50 group by 1")
def w8_last_breach(spark, d):
    return events.last_breach(inputs.telemetry(spark, d).select("node", "ms", "event_id", "value"), ["node"], "value > 50")


@query(f"with {T}, w as (select node, ms // 86400000 as w, count(*) filter (type = 'view') / count(*) as ratio from t where type in ('view', 'click') group by 1, 2) select node, round(arg_max(ratio, w), 6) as current, round(avg(ratio), 6) as mean from w group by 1")
def a14_hit_ratio(spark, d):
    return events.hit_ratio(inputs.telemetry(spark, d), ["node"], "view", "click", DAY).select("node", F.round("current", 6).alias("current"), F.round("mean", 6).alias("mean"))


@query(f"with {T}, l as (select * from t qualify row_number() over (partition by type order by event_id desc) <= 10) select type, round(count(*) filter (event_id % 3 = 0) / count(*), 6) as explored, round(avg(value * 2 + node), 6) as ucb, round(avg(value), 6) as reward from l group by 1")
def a12_selection_statistics(spark, d):
    t = inputs.telemetry(spark, d).select("type", F.col("event_id").alias("seq"), (F.col("event_id") % 3 == 0).alias("explored"), (F.col("value") * 2 + F.col("node")).alias("ucb"), F.col("value").alias("reward"))
    return stats.selection_statistics(t, "type").withColumns({c: F.round(c, 6) for c in ("explored", "ucb", "reward")})


@query(f"with {T}, l as (select shard, arg_max(node, event_id) filter (type = 'view' and shard % 5 > 0) as leader from t where shard is not null group by 1) select leader, count(*) as shards from l group by 1")
def a10_leaders(spark, d):
    view = (F.col("type") == "view") & (F.col("shard") % 5 > 0)
    t = inputs.telemetry(spark, d).where("shard is not null").groupBy("shard").agg(F.max_by(F.when(view, F.col("node")), F.when(view, F.col("event_id"))).alias("leader"))
    return state.shards_per_leader(t)


@query(
    f"""with {G}, p as (select *, max(case when state = 'suspect' then seq end) over w as s, max(case when state = 'failed' then seq end) over w as f from g window w as (partition by id order by seq rows between unbounded preceding and 1 preceding)),
 j as (select p.*, g.ms as s_ms from p left join g on g.seq = p.s)
 select count(*) filter (state = 'suspect') as suspects, count(*) filter (state = 'failed') as confirms, count(*) filter (state = 'alive' and s is not null and (f is null or f < s)) as false_alarms,
 round(avg(ms - s_ms) filter (state = 'failed'), 3) as mean_ms, round(count(*) filter (state = 'failed') / count(*) filter (state = 'suspect') * 100, 6) as accuracy from j"""
)
def a15_failure_detection(spark, d):
    return state.failure_detection(inputs.gossip(spark, d)).withColumns({"mean_ms": F.round("mean_ms", 3), "accuracy": F.round("accuracy", 6)})


@query(
    f"""with {T}, e as (select shard, event_id as seq, ms, case type when 'view' then 'start' when 'click' then 'done' else 'cutover' end as kind from t where shard is not null and type in ('view', 'click', 'error')),
 l as (select shard, max(seq) filter (kind = 'start') as s, max(seq) filter (kind = 'cutover') as c, max(seq) as l from e group by 1)
 select l.shard, case z.kind when 'start' then 'in_progress' when 'done' then 'completed' else 'idle' end as status, case when c is null or s > c then a.ms end as started_ms, case when z.kind = 'done' then z.ms end as completed_ms
 from l left join e a on a.seq = s join e z on z.seq = l"""
)
def r9_snapshots(spark, d):
    kind = F.when(F.col("type") == "view", "start").when(F.col("type") == "click", "done").otherwise("cutover")
    t = inputs.telemetry(spark, d).where("shard is not null and type in ('view', 'click', 'error')")
    return state.snapshots(t.select("shard", F.col("event_id").alias("seq"), "ms", kind.alias("kind")))


@query("select (user_id % 4)::int as level, round(avg((event_id % 100) / 100), 6) as mean, max((event_id % 100) / 100) as most, count(*) filter ((event_id % 100) / 100 > 0.7::double) as hot from events group by 1")
def a13_level_heat(spark, d):
    slots = inputs.table(spark, d, "events").select((F.col("user_id") % 4).cast("int").alias("level"), (F.col("event_id") % 100 / 100).alias("heat"))
    return stats.level_heat(slots).withColumn("mean", F.round("mean", 6))


@query("select event_id, case when event_id % 100 >= 80 then 'hot' when event_id % 100 <= 20 then 'cold' else 'warm' end as class, case when event_id % 100 >= 80 then 1 when event_id % 100 <= 20 and event_id % 2 = 0 then least(user_id % 5 + 2, 4) else user_id % 5 + 1 end::int as target from events")
def a21_slot_class(spark, d):
    heat, now = F.col("event_id") % 100 / 100, (F.col("user_id") % 5 + 1).cast("int")
    target = stats.target_runs(heat, now, F.lit(4), F.col("event_id") % 2 == 0)
    return inputs.table(spark, d, "events").select("event_id", stats.slot_class(heat).alias("class"), target.alias("target"))


@query("select event_id, round(value * pow(1 - ln(2) / 100000, 10000 * (event_id % 30)), 6) as heat from events")
def a20_idle_decay(spark, d):
    heat = stats.decayed(F.col("value"), stats.alpha(100_000), F.col("event_id") % 30)
    return inputs.table(spark, d, "events").select("event_id", F.round(heat, 6).alias("heat"))


@query(f"with {R} select file_number, {SLOT.format(k='min_key')} as first_slot, {SLOT.format(k='max_key')} - (max_key in ('00000300', '00000700', '00002000'))::int as last_slot from r")
def c18_slots_touched(spark, d):
    first, last = compact.slots_touched(F.col("min_key"), F.col("max_key"), GUARDS)
    return inputs.runs(spark, d).select("file_number", first.alias("first_slot"), last.alias("last_slot"))


@query(f"with {R} select file_number from r where file_number not in (select file_number from r where file_number % 3 > 0)")
def k15_missing_files(spark, d):
    r = inputs.runs(spark, d).select("file_number")
    return storage.missing_files(r, r.where("file_number % 3 > 0"))


@query(f"with {S}, l as (select operation, node, arg_max(value, event_id) as value from s group by all) select operation, sum(value) as total, max(value) as most from l group by 1")
def p7_gauges(spark, d):
    return metrics.gauge(inputs.samples(spark, d), ["operation", "node"], ["operation"])


@query(f"with {S}, {RATE} select operation, window_start, round(sum(rate), 9) as rate from q group by all")
def p2_rate_by_operation(spark, d):
    return _rates(spark, d).groupBy("operation", "window_start").agg(F.round(F.sum("rate"), 9).alias("rate"))


@query(f"with {T} select type, event_id, node, value from t")
def n22_json_round_trip(spark, d):
    lines = storage.to_json(inputs.telemetry(spark, d).select("type", "event_id", "node", "value"))
    return storage.from_json(lines, "event_id: bigint, node: int, value: double")


@query(f"with {T} select 'requests{{operation=\"' || type || '\",node=\"' || node || '\"}} ' || count(*) as line from t group by type, node")
def s22_exposition(spark, d):
    counts = inputs.telemetry(spark, d).groupBy("type", "node").agg(F.count("*").alias("value"))
    return storage.exposition(counts.withColumnRenamed("type", "operation"), "requests", ["operation", "node"])


@query("select label, count(*) as vectors, max(len(embedding))::int as dimensions from embeddings group by 1")
def v4_namespaces(spark, d):
    return vector.namespaces(_vectors(spark, d))


# --- single writes, commands, placement of runs ----------------------------------------

LATE = 10_000_000
MUCH_LATER = 1_710_000_000_000  # behind all events and their lifetimes


@query(f"with {M}, m2 as (select * from m union all select '17', 1.5, false, 1000::bigint, 0, {LATE}, {NOW}), {NEWEST.replace('from m', 'from m2')} select key, value, idx from n where {LIVE}")
def k3_put(spark, d):
    return kv.state(_log(spark, d).unionByName(kv.put(spark, "17", 1.5, LATE, NOW, 1000)), NOW).select("key", "value", "idx")


@query(f"with {M}, m2 as (select * from m union all select '17', null, true, null, 0, {LATE}, {NOW}), {NEWEST.replace('from m', 'from m2')} select key, value, idx from n where {LIVE}")
def k4_delete(spark, d):
    return kv.state(_log(spark, d).unionByName(kv.delete(spark, "17", LATE, NOW)), NOW).select("key", "value", "idx")


@query(f"with {M} select key, value, idx from m where key >= '2' and key < '35'")
def f1_key_range(spark, d):
    return _log(spark, d).where(kv.between("2", "35")).select("key", "value", "idx")


@query(f"with {M}, {NEWEST} select key, idx from n where tombstone")
def f5_tombstones(spark, d):
    return kv.hidden(_log(spark, d), NOW).where("reason = 'deleted'").select("key", "idx")


@query(f"with {M}, {NEWEST} select key, idx, ms + ttl_ms as expired_ms from n where not tombstone and ms + ttl_ms <= {MUCH_LATER}")
def f6_expired(spark, d):
    return kv.hidden(_log(spark, d), MUCH_LATER).where("reason = 'expired'").select("key", "idx", (F.col("ms") + F.col("ttl_ms")).alias("expired_ms"))


@query(f"with {M}, {NEWEST} select key, value, term || '.' || idx as version from n where {LIVE}")
def k16_versioned_read(spark, d):
    return kv.state(_log(spark, d), NOW, consistency="stale_ok").select("key", "value", F.concat_ws(".", "term", "idx").alias("version"))


@query(
    f"""with {M}, {NEWEST}, c as (select key, idx from n where {LIVE}), q as (select cast(user_id as varchar) as key, event_id as idx from events where event_id % 3 = 0), won as (select * from q semi join c using (key, idx)),
 m2 as (select * from m union all select key, -1.0, false, null, 0, row_number() over (order by key) + {LATE}, {NOW} from won union all select '17', 2.5, false, null, 0, {LATE} + 1000, {NOW}), n2 as (select * from m2 qualify row_number() over (partition by key order by term desc, idx desc) = 1) select key, value, idx from n2 where {LIVE}"""
)
def k17_compare_and_put(spark, d):
    q = inputs.table(spark, d, "events").where("event_id % 3 = 0").select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("expected_idx"), F.lit(-1.0).alias("value"))
    after = kv.apply_compare_and_set(_log(spark, d), q, LATE, NOW).unionByName(kv.put(spark, "17", 2.5, LATE + 1000, NOW))
    return kv.state(after, NOW).select("key", "value", "idx")


KIND = "case when event_id % 97 = 0 then 'drop' when event_id % 41 = 0 then 'create' when event_type = 'error' then 'delete' else 'insert' end"


@query(
    f"""with c as (select event_id as seq, {KIND} as kind, user_id % 5 as namespace, user_id as id from events),
 o as (select *, arg_max(kind = 'create', case when kind in ('create', 'drop') then seq end) over (partition by namespace order by seq rows unbounded preceding) as open from c),
 d as (select namespace, max(seq) as dropped from c where kind = 'drop' group by 1), l as (select * from o where open and kind in ('insert', 'delete') qualify row_number() over (partition by namespace, id order by seq desc) = 1)
 select namespace, id, seq from l left join d using (namespace) where kind = 'insert' and (dropped is null or seq > dropped)"""
)
def k18_commands(spark, d):
    return vector.apply_commands(inputs.table(spark, d, "events").select(F.col("event_id").alias("seq"), F.expr(KIND).alias("kind"), (F.col("user_id") % 5).alias("namespace"), F.col("user_id").alias("id")))


@query(f"with {R} select file_number, case when level = 0 then 1000 + slot else 10000 + level * 100 + slot end as priority from r")
def k7_source_priority(spark, d):
    return inputs.runs(spark, d).select("file_number", kv.source_priority(F.col("level"), F.col("slot")).alias("priority"))


@query(f"with {R}, o as (select *, greatest(min_key, '00000500') as low, least(max_key, '00000900') as high from r where max_key >= '00000500' and min_key < '00000900') select file_number, round(case when min_key >= '00000500' and max_key <= '00000900' then 1.0::double when min_key = max_key then 0.5::double else least(1.0::double, ({_num('high')} - {_num('low')})::double / ({_num('max_key')} - {_num('min_key')})::double) end, 9) as fraction from o")
def k9_overlap_fraction(spark, d):
    return inputs.runs(spark, d).where(compact.overlaps("00000500", "00000900")).select("file_number", F.round(compact.overlap_fraction("00000500", "00000900"), 9).alias("fraction"))


@query(f"with {R} select file_number, level, slot from r where max_key >= '00000500' and min_key < '00000900'")
def k10_range_compaction(spark, d):
    return compact.range_compaction(inputs.runs(spark, d), "00000500", "00000900").select("file_number", "level", "slot")


@query("select event_id, value * 1048576 >= 67108864 or event_id % 60 * 1000 >= 30000 as due from events")
def k12_flush_due(spark, d):
    return inputs.table(spark, d, "events").select("event_id", kv.flush_due(F.col("value") * 1048576, F.col("event_id") % 60 * 1000).alias("due"))


@query("select event_id % 20 as segment, event_id as pos from events where event_id % 20 > 7 or (event_id % 20 = 7 and event_id >= 500)")
def s11_read_from(spark, d):
    return kv.read_from(inputs.table(spark, d, "events").select((F.col("event_id") % 20).alias("segment"), F.col("event_id").alias("pos")), 7, 500)


@query(f"with {R} select arg_max(file_number, (min_key, file_number)) as block from r where min_key <= '00000004'")
def s5_find_block(spark, d):
    blocks = inputs.runs(spark, d).groupBy(F.col("min_key").alias("first_key")).agg(F.max("file_number").alias("block"))
    return compact.find_block(blocks, "00000004")


@query(f"with {R} select a.file_number, b.file_number as other from r a join r b on a.level = b.level and a.file_number < b.file_number and a.min_key <= b.max_key and b.min_key <= a.max_key")
def f3_ranges_meet(spark, d):
    r = inputs.runs(spark, d).select("file_number", "level", "min_key", "max_key")
    o = r.select(F.col("file_number").alias("other"), "level", F.col("min_key").alias("low"), F.col("max_key").alias("high"))
    meet = compact.ranges_meet(F.col("min_key"), F.col("max_key"), F.col("low"), F.col("high"))
    return r.join(o, "level").where((F.col("file_number") < F.col("other")) & meet).select("file_number", "other")


@query(f"with {R} select file_number from r where min_key < '00000003'")
def f4_open_range(spark, d):
    return inputs.runs(spark, d).where(compact.overlaps(None, "00000003")).select("file_number")


def _keyed(spark, d):
    return inputs.table(spark, d, "orders").select(F.lpad(F.col("o_orderkey").cast("string"), 8, "0").alias("key"), (F.col("o_custkey") % 6).alias("run"), F.col("o_orderkey").alias("idx"))


KEYED = "k as (select lpad(o_orderkey::varchar, 8, '0') as key, o_custkey % 6 as run, o_orderkey as idx from orders)"


@query(f"with {KEYED} select run, {SLOT.format(k='key')} as slot, count(*) as entries, min(key) as min_key, max(key) as max_key from k group by 1, 2")
def k13_admission(spark, d):
    return compact.resplit(_keyed(spark, d), GUARDS).drop("min_idx", "max_idx")


@query(f"with {KEYED} select run, (key >= '00000500')::int + (key >= '00001000')::int as slot, count(*) as entries, min(key) as min_key, max(key) as max_key, min(idx) as min_idx, max(idx) as max_idx from k group by 1, 2")
def c7_guard_move(spark, d):
    return compact.resplit(_keyed(spark, d), ["00000500", "00001000"])


@query(f"with {KEYED} select key, {SLOT.format(k='key')} as slot from k")
def j4_key_to_slot(spark, d):
    bounds = compact.slot_bounds(spark, GUARDS)
    inside = (F.col("low").isNull() | (F.col("key") >= F.col("low"))) & (F.col("high").isNull() | (F.col("key") < F.col("high")))
    return _keyed(spark, d).join(F.broadcast(bounds), inside).select("key", "slot")


@query(f"with {R} select file_number, case when level = 1 and slot = 2 then level + 1 else level end as level from r")
def c4_promote(spark, d):
    return compact.promote(inputs.runs(spark, d), 1, 2).select("file_number", "level")


@query(f"with {ENTRIES}, s as (select * from e where key >= '2' and key < '4') select * from s qualify row_number() over (partition by key order by run desc) = 1")
def c5_eager_level(spark, d):
    return compact.merge(_entries(spark, d).where(kv.between("2", "4")), False)


@query(f"with {R} select file_number, level = 3 or file_number % 5 = 0 as drops from r")
def c2_tombstone_drop(spark, d):
    action = F.when(F.col("file_number") % 5 == 0, "cleanup").otherwise("tier")
    return inputs.runs(spark, d).select("file_number", compact.drops_tombstones(action, F.col("level"), 3).alias("drops"))


ARMS = """a as (select event_type as action, value / 100 as reward, count(*) over (partition by event_type) - row_number() over (partition by event_type order by event_id) as later,
 row_number() over (partition by event_type order by event_id) = 1 as first from events), b as (select action, sum(reward * pow(0.9, later) * case when first then 1.0 else 0.1 end) as mean, count(*) as n from a group by 1)"""


def _arms(spark, d):
    return compact.arm_statistics(inputs.table(spark, d, "events").select(F.col("event_type").alias("action"), F.col("event_id").alias("seq"), (F.col("value") / 100).alias("reward")))


@query(f"with {ARMS} select action, round(mean, 6) as mean, n from b")
def c10_arm_mean(spark, d):
    return _arms(spark, d).withColumn("mean", F.round("mean", 6))


@query(f"with {ARMS}, u as (select action, mean + 2.0 * sqrt(ln((select sum(n) from b)) / n) as ucb from b where action <> 'error') select arg_max(action, ucb) as action from u")
def c12_select_action(spark, d):
    offered = spark.createDataFrame([(i, t) for i, t in enumerate(TYPES) if t != "error"], "position int, action string")
    return compact.select_action(_arms(spark, d), offered)


@query("select key from (select distinct o_custkey::varchar as key from orders) order by md5(key) limit 50")
def c16_sample_keys(spark, d):
    return compact.sample_keys(inputs.table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("key")), 50)


@query(f"with {R} select level, slot, case when max(case when file_number % 7 = 0 then 2 else 1 end) >= 2 then 'quotient' else 'bloom' end as filter from r group by 1, 2")
def c19_filter_kind(spark, d):
    return compact.filter_kind(inputs.runs(spark, d).withColumn("version", F.when(F.col("file_number") % 7 == 0, 2).otherwise(1)), ["level", "slot"])


@query(f"with {EDITS}, l as (select * from e qualify row_number() over (partition by level, slot, file_number order by seq desc) = 1), s as (select level, slot, file_number, size from l where edit = 'add') select level, slot, count(*) as files, sum(size)::bigint as bytes from s group by 1, 2")
def s17_manifest_recovery(spark, d):
    """A snapshot of the folded manifest, with the edits behind it folded on top, equals the fold of all edits."""
    o = inputs.table(spark, d, "orders")
    edit = lambda f, seq, name: f.select(seq.alias("seq"), F.lit(name).alias("edit"), (F.col("o_orderkey") % 3).cast("int").alias("level"), (F.col("o_custkey") % 4).cast("int").alias("slot"), F.col("o_orderkey").alias("file_number"), F.col("o_custkey").alias("size"))
    edits = edit(o, F.col("o_orderkey") * 2, "add").unionByName(edit(o.where("o_orderkey % 4 = 0"), F.col("o_orderkey") * 2 + 1, "delete"))
    snapshot = compact.fold_manifest(edits.where("seq <= 1000")).select(F.lit(1000).cast("long").alias("seq"), F.lit("add").alias("edit"), "level", "slot", "file_number", "size")
    return compact.fold_manifest(snapshot.unionByName(edits.where("seq > 1000"))).groupBy("level", "slot").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


@query("with o as (select event_id as seq, event_type in ('error', 'purchase') as write, count(*) over () - row_number() over (order by event_id) as later from events), q as (select coalesce(sum(A * pow(1 - A, later)) filter (write), 0) as ratio from o) select round(ratio, 6) as ratio, ratio > 0.5 as pressed from q".replace("A", repr(stats.alpha(100))))
def a19_write_pressure(spark, d):
    o = inputs.table(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("event_type").isin("error", "purchase").alias("write"))
    return stats.write_pressure(o, 100).withColumn("ratio", F.round("ratio", 6))


# --- filters, folds and rankings of events -----------------------------------------------


@query(f"with {T} select node, {COUNTS} from t group by 1")
def a1_batch_summary(spark, d):
    return inputs.telemetry(spark, d).groupBy("node").agg(*(F.count_if(F.col("type") == x).alias(f"n_{x}") for x in TYPES))


@query(f"with {T}, {BATCHES} select sum(n)::bigint as events from b where window_end > {NOW}")
def a3_history_events(spark, d):
    return _batches(spark, d).where(F.col("window_end") > NOW).agg(F.sum("n").alias("events"))


@query(f"with {T} select shard, ms // 3600000 as hour, arg_max(value, (ms, event_id)) as last, max(value) as most from t where shard is not null group by 1, 2")
def a4_downsample_by_shard(spark, d):
    found = events.downsample(inputs.telemetry(spark, d).where("shard is not null"), ["shard"], 3_600_000)
    return found.select("shard", F.floor(F.col("mid_ms") / 3_600_000).alias("hour"), "last", "most")


@query(f"with {T} select event_id, coalesce(case when event_id % 3 = 0 then node end, 99) as node from t")
def f9_event_node(spark, d):
    own = F.when(F.col("event_id") % 3 == 0, F.col("node"))
    return inputs.telemetry(spark, d).select("event_id", events.node_of(own, F.lit(99)).alias("node"))


@query("with u as (select 3 as n union all select 1 union all select 7) select '1,3,7' as nodes, 'click,view' as types, '2,4' as shards")
def f10_filter_union(spark, d):
    filters = spark.createDataFrame([([3, 1], ["view"], [2]), ([1, 7], ["click", "view"], [4, 2])], "nodes array<int>, types array<string>, shards array<int>")
    return events.unite_filters(filters).select(*(F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("nodes", "types", "shards")))


@query(f"with {T}, f as (select * from t where node = 2 and type in ('click', 'view')) select ms - ms % 3600000 as window_start, ms - ms % 3600000 + 3600000 as window_end, count(*) as n, {COUNTS.replace('(type', '(type')} from f group by 1, 2")
def f12_filter_batches(spark, d):
    return events.filter_batches(inputs.telemetry(spark, d), events.matches([2], ["click", "view"], []), 3_600_000, TYPES)


@query(f"with {T} select event_id, type, shard from t where shard is not null")
def f18_type_and_shard(spark, d):
    lines = storage.to_json(inputs.telemetry(spark, d).select("type", "event_id", "shard"))
    return storage.from_json(lines, "event_id: bigint, shard: int").where("shard is not null").select("event_id", "type", "shard")


@query(f"with {T}, s as (select shard, 1706600000000 - max(ms) as stable_ms from t where shard is not null and type = 'error' group by 1) select *, stable_ms < 30000 as recent, stable_ms < 60000 as within_minute, stable_ms > 300000 as stable from s")
def f19_stability(spark, d):
    return events.stability(inputs.telemetry(spark, d).where("shard is not null and type = 'error'"), 1_706_600_000_000)


@query(f"with {T} select node, arg_max(event_id, (ms, event_id)) as last_id, arg_max(type, (ms, event_id)) as last_type, count(*) as n, count(*) filter (type = 'error') as errors, count(distinct shard) as shards from t group by 1")
def r8_node_states(spark, d):
    return events.node_states(inputs.telemetry(spark, d))


@query(f"with {T}, v as (select node as cluster, event_id as seq, type as view, lag(type) over (partition by node order by event_id) as before from t) select cluster, seq, view, (row_number() over (partition by cluster order by seq))::int as epoch from v where before is null or before <> view")
def r12_watch(spark, d):
    return events.watch(inputs.telemetry(spark, d).select(F.col("node").alias("cluster"), F.col("event_id").alias("seq"), F.col("type").alias("view")))


REPLICAS = "p as (select distinct user_id % 24 as shard, user_id % 5 as node from events)"


def _replicas(spark, d):
    return inputs.table(spark, d, "events").select((F.col("user_id") % 24).alias("shard"), (F.col("user_id") % 5).alias("node")).distinct()


@query(f"with {REPLICAS}, s as (select node, list_sort(list(shard))[1:10] as s, count(*) as active, count(*) filter (shard % 5 = node) as leaders, count(*) filter (shard % 5 <> node) as followers from p group by 1) select node, active, leaders, followers, array_to_string(s, ',') as sample from s")
def a23_shard_roll_up(spark, d):
    return state.shard_roll_up(_replicas(spark, d).withColumn("leader", F.col("shard") % 5))


@query(f"with {REPLICAS} select shard, array_to_string(list_sort(list(node)), ',') as replicas from p group by 1")
def u5_replica_sets(spark, d):
    return state.replica_sets(_replicas(spark, d))


@query(f"with {REPLICAS} select shard, node, (row_number() over (partition by shard order by (node = shard % 5) desc, node))::int as place from p")
def t7_leader_first(spark, d):
    return state.leader_first(_replicas(spark, d).withColumn("leader", F.col("shard") % 5))


@query(f"with {REPLICAS} select shard, count(*) as n from p group by 1 order by 1 limit 8")
def t5_first_shards(spark, d):
    return _replicas(spark, d).groupBy("shard").agg(F.count("*").alias("n")).orderBy("shard").limit(8)


@query(f"with {T} select event_id, ms from t where type = 'purchase' order by ms desc, event_id desc limit 50")
def t6_newest_records(spark, d):
    return inputs.telemetry(spark, d).where("type = 'purchase'").select("event_id", "ms").orderBy(F.desc("ms"), F.desc("event_id")).limit(50)


@query(f"with {T} select event_id from t where node in (select s_suppkey % 8 from supplier where s_acctbal > 5000)")
def j7_semi_join(spark, d):
    wanted = inputs.table(spark, d, "supplier").where("s_acctbal > 5000").select((F.col("s_suppkey") % 8).cast("int").alias("node"))
    return inputs.telemetry(spark, d).join(wanted, "node", "left_semi").select("event_id")


@query(f"with {M} select key, idx from m where not tombstone and not exists (select 1 from m t where t.tombstone and t.key = m.key and t.idx > m.idx)")
def j8_not_deleted_since(spark, d):
    m = _log(spark, d)
    last = m.where("tombstone").groupBy("key").agg(F.max("idx").alias("gone"))
    return m.where("not tombstone").join(last, (m.key == last.key) & (last.gone > m.idx), "left_anti").select("key", "idx")


@query(f"with {M} select key, idx, 'low' as source from m where idx <= 300 union all select key, idx, 'high' from m where idx > 300")
def u1_sources(spark, d):
    m = _log(spark, d).select("key", "idx")
    return m.where("idx <= 300").withColumn("source", F.lit("low")).unionByName(m.where("idx > 300").withColumn("source", F.lit("high")))


@query("select user_id, event_type, (epoch_us(ts) // 86400000000)::bigint as day from events where event_id % 2 = 0 except select user_id, event_type, (epoch_us(ts) // 86400000000)::bigint from events where event_id % 2 = 1")
def u4_except(spark, d):
    e = inputs.table(spark, d, "events")
    half = lambda n: e.where(F.col("event_id") % 2 == n).select("user_id", "event_type", F.floor(millis("ts") / DAY).cast("long").alias("day"))
    return half(0).subtract(half(1))


@query("with c as (select *, l_extendedprice as t from lineitem) select l_returnflag as type, count(*) filter (l_quantity <= 40) - count(*) filter (l_quantity <= 10) as n from c group by 1")
def p6_between_buckets(spark, d):
    bounds = [5.0, 10.0, 20.0, 40.0]
    b = inputs.table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("type")).agg(F.array(*(F.struct(F.lit(x).alias("le"), F.count_if(F.col("l_quantity") <= x).alias("n")) for x in bounds)).alias("b"))
    return metrics.between_buckets(b.select("type", F.inline("b")), ["type"], 10.0, 40.0)


@query(
    f"""with {S}, l as (select *, lag(value) over w as v, lag(value * 3 + node) over w as u from s window w as (partition by operation, node order by event_id)),
 i as (select operation, node, ms - ms % 86400000 as window_start, case when v is null then 0 when value < v then value else value - v end as n, case when u is null then 0 when value * 3 + node < u then value * 3 + node else value * 3 + node - u end as t from l)
 select operation, node, window_start, round(sum(t) / sum(n), 6) as mean from i group by all having sum(n) > 0"""
)
def p5_mean_latency(spark, d):
    s = inputs.samples(spark, d).withColumn("count", F.col("value")).withColumn("total", F.col("value") * 3 + F.col("node"))
    return metrics.mean_latency(s, ["operation", "node"], DAY, "total", "count").withColumn("mean", F.round("mean", 6))


# --- vectors, continued ------------------------------------------------------------------


@query("with i as (select distinct o_custkey * 3 as vec_id from orders where o_orderkey % 10 = 0) select i.vec_id, e.vec_id is not null as found from i left join embeddings e using (vec_id)")
def v3_delete_found(spark, d):
    ids = inputs.table(spark, d, "orders").where("o_orderkey % 10 = 0").select((F.col("o_custkey") * 3).alias("vec_id")).distinct()
    return vector.found_for_deletion(_vectors(spark, d), ids)


EDGES = "e as (select o_custkey as node, o_orderkey as neighbour, o_totalprice as distance from orders)"


@query(f"with {EDGES} select * from e qualify row_number() over (partition by node order by distance, neighbour) <= 4")
def w9_shrink_degree(spark, d):
    return vector.shrink_degree(inputs.table(spark, d, "orders").select(F.col("o_custkey").alias("node"), F.col("o_orderkey").alias("neighbour"), F.col("o_totalprice").alias("distance")), 4)


@query("select vec_id, case when label < 5 then len(embedding) end::int as dimensions from embeddings")
def f17_projection(spark, d):
    v = _vectors(spark, d)
    return v.select("vec_id", F.when(F.col("label") < 5, F.size("embedding")).alias("dimensions"))


@query()
def v11_codebooks(spark, d):
    books = ann.train_codebooks(_vectors(spark, d))
    rows = [(s, c, [float(x) for x in book]) for s, part in enumerate(books) for c, book in enumerate(part)]
    return spark.createDataFrame(rows, "subspace int, centroid int, position array<double>")


# --- statistics, leases, routes and filters ------------------------------------------------


@query(f"with {R}, l as (select level, count(*) as files, sum(size) as bytes from r group by 1), w as (select sum(l_extendedprice * (1 - l_discount)) / sum(l_extendedprice) as w from lineitem) select sum(files)::bigint as files, sum(bytes)::bigint as bytes, coalesce(sum(files) filter (level = 0), 0)::bigint as l0_files, round((select w from w), 6) as write_amplification, (coalesce(sum(files) filter (level = 0), 0) + count(*) filter (level > 0))::double as read_amplification, round(sum(bytes) / arg_max(bytes, level), 6) as space_amplification, round((1000 + 5000) / (4000 + 5000), 6) as memory_ratio from l")
def a16_statistics(spark, d):
    r = inputs.table(spark, d, "lineitem").select(F.col("l_extendedprice").alias("bytes_in"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("bytes_out"))
    found = stats.lsm_statistics(inputs.runs(spark, d), r, 1000, 5000, 4000)
    return found.withColumns({c: F.round(c, 6) for c in ("write_amplification", "space_amplification", "memory_ratio")})


PRESSURE = "case when {0} >= 1.1 then 4 when {0} >= 0.9 then 3 when {0} >= 0.75 then 2 when {0} >= 0.5 then 1 else 0 end"


@query(f"select event_id, greatest({PRESSURE.format('(event_id % 130)::double / 100')}, {PRESSURE.format('(event_id % 70)::double / 100')}, {PRESSURE.format('(event_id % 7)::double / 10')}) as pressure from events")
def a17_overall_pressure(spark, d):
    ratio = lambda n, by: (F.col("event_id") % n).cast("double") / by
    return inputs.table(spark, d, "events").select("event_id", stats.overall_pressure(ratio(130, 100), ratio(70, 100), ratio(7, 10)).alias("pressure"))


@query("select (user_id % 4)::int as level, (user_id % 12)::int as slot, min((event_id % 100) / 100) as least, max((event_id % 100) / 100) as most, round(avg((event_id % 100) / 100), 6) as mean from events group by 1, 2")
def a13_slot_history(spark, d):
    e = inputs.table(spark, d, "events").select((F.col("user_id") % 4).cast("int").alias("level"), (F.col("user_id") % 12).cast("int").alias("slot"), (F.col("event_id") % 100 / 100).alias("heat"))
    return stats.slot_history(e).withColumn("mean", F.round("mean", 6))


@query(f"with {T}, s as (select shard, max(ms) + 200000 - shard * 20000 as at, max(ms) as last from t where shard is not null group by 1), a as (select (select max(last) from s) - last + shard * 20000 as age from s) select count(*) filter (age > 300000) as stable, count(*) filter (age < 30000) as recent, count(*) filter (age between 30000 and 119999) as warning, count(*) as total from a")
def a10_stability_counts(spark, d):
    last = inputs.telemetry(spark, d).where("shard is not null").groupBy("shard").agg(F.max("ms").alias("ms"))
    newest = last.agg(F.max("ms")).first()[0]
    return state.stability_counts(events.stability(last.select("shard", (F.col("ms") - F.col("shard") * 20_000).alias("ms")), newest))


@query(f"with {T}, e as (select distinct shard, event_id // 50 as term from t where shard is not null) select shard, term from e qualify row_number() over (partition by shard order by term desc) <= 10")
def w3_last_terms(spark, d):
    return state.last_terms(inputs.telemetry(spark, d).where("shard is not null").select("shard", F.floor(F.col("event_id") / 50).alias("term")))


@query(f"with {T} select event_id, coalesce(case when event_id % 5 > 0 then ms + 3600000 end > {NOW}, false) as valid from t")
def raft_lease(spark, d):
    expiry = F.when(F.col("event_id") % 5 > 0, F.col("ms") + 3_600_000)
    return inputs.telemetry(spark, d).select("event_id", state.lease_valid(expiry, NOW).alias("valid"))


@query("select event_id, (event_id % 4, event_id % 9) >= (user_id % 4, user_id % 9) as wins from events")
def raft_log_up_to_date(spark, d):
    e, u = F.col("event_id"), F.col("user_id")
    return inputs.table(spark, d, "events").select("event_id", state.log_up_to_date(e % 4, e % 9, u % 4, u % 9).alias("wins"))


@query(f"with {G}, o as (select id, max(seq) filter (state <> 'suspect') as o from g group by 1), s as (select g.id, min(ms) as suspected_ms from g join o using (id) where state = 'suspect' and (o is null or seq > o) group by 1) select * from s where {MUCH_LATER} - suspected_ms >= 3600000")
def swim_expired_suspicions(spark, d):
    return state.expired_suspicions(inputs.gossip(spark, d), MUCH_LATER, 3_600_000)


@query(
    _SQL["n2_jump_hash"].replace("select id as o_orderkey, max(b)::int as bucket from j group by 1", "")[:-1]
    + f""", b as (select id, max(b)::int as shard from j group by 1), p as (select distinct user_id % 60 as shard, user_id % 5 as node from events), v as (select shard, shard % 5 as leader, array_to_string(list_sort(list(node)), ',') as replicas from p group by 1)
 select b.id as o_orderkey, b.shard, leader, replicas from b left join v using (shard)"""
)
def placement_route(spark, d):
    view = inputs.table(spark, d, "events").select((F.col("user_id") % 60).cast("int").alias("shard"), (F.col("user_id") % 5).alias("node")).distinct().withColumn("leader", (F.col("shard") % 5).cast("long"))
    keys = inputs.table(spark, d, "orders").select("o_orderkey").distinct().select("o_orderkey", hashing.jump_bucket(F.col("o_orderkey"), 64).alias("shard"))
    return state.route(keys, view)


@query(f"with c as (select event_id as seq, {KIND} as kind, user_id % 5 as namespace from events), o as (select *, coalesce(arg_max(kind = 'create', case when kind in ('create', 'drop') then seq end) over (partition by namespace order by seq rows between unbounded preceding and 1 preceding), false) as open from c) select seq, kind, namespace, case when kind = 'create' and open then 'exists' when kind <> 'create' and not open then 'missing' else 'ok' end as outcome from o")
def v1_command_outcomes(spark, d):
    return vector.command_outcomes(inputs.table(spark, d, "events").select(F.col("event_id").alias("seq"), F.expr(KIND).alias("kind"), (F.col("user_id") % 5).alias("namespace")))


@query("with i as (select distinct o_custkey as vec_id from orders) select i.vec_id, e.vec_id is not null as found, len(embedding)::int as dimensions from i left join embeddings e using (vec_id)")
def v4_get(spark, d):
    ids = inputs.table(spark, d, "orders").select(F.col("o_custkey").alias("vec_id")).distinct()
    return vector.get(_vectors(spark, d), ids).select("vec_id", "found", F.when(F.col("found"), F.size("embedding")).alias("dimensions"))


@query(
    f"""with c as (select event_id as seq, case when event_id % 2 = 0 then case when event_type = 'error' then 'delete' else 'put' end end as kv, {KIND} as kind, user_id % 5 as namespace, user_id as id from events),
 k as (select id, max(seq) as seq, arg_max(kv, seq) as kv from c where kv is not null group by 1),
 o as (select *, arg_max(kind = 'create', case when kind in ('create', 'drop') then seq end) over (partition by namespace order by seq rows unbounded preceding) as open from c where kv is null),
 d as (select namespace, max(seq) as dropped from c where kv is null and kind = 'drop' group by 1), l as (select * from o where open and kind in ('insert', 'delete') qualify row_number() over (partition by namespace, id order by seq desc) = 1)
 select 'keys' as space, id as key, seq from k where kv = 'put' union all select namespace::varchar, id, seq from l left join d using (namespace) where kind = 'insert' and (dropped is null or seq > dropped)"""
)
def k18_command_log(spark, d):
    e = inputs.table(spark, d, "events")
    keyed = e.where("event_id % 2 = 0").select(F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "delete").otherwise("put").alias("kind"), F.lit("keys").alias("space"), F.col("user_id").alias("key"))
    vectors = vector.apply_commands(e.where("event_id % 2 = 1").select(F.col("event_id").alias("seq"), F.expr(KIND).alias("kind"), (F.col("user_id") % 5).alias("namespace"), F.col("user_id").alias("id")))
    return kv.apply_log(keyed).unionByName(vectors.select(F.col("namespace").cast("string").alias("space"), F.col("id").alias("key"), "seq"))


HASH = "('0x' || substr(md5(url), 1, 16))::ubigint"


def _hashes(spark, d):
    return inputs.table(spark, d, "pages").select("page_id", F.conv(F.substring(F.md5(F.col("url").cast("binary")), 1, 16), 16, -10).cast("long").alias("hash"))


@query(f"select page_id, ({HASH} >> 52)::bigint as quotient, (({HASH} >> 44) & 255)::bigint as remainder from pages")
def n5_fingerprints(spark, d):
    q, r = hashing.fingerprint(F.col("hash"), 12, 8)
    return _hashes(spark, d).select("page_id", q.alias("quotient"), r.alias("remainder"))


@query(f"select distinct ({HASH} >> 60)::bigint as quotient, (({HASH} >> 56) & 15)::bigint as remainder from pages")
def a27_quotient_filter(spark, d):
    """Two filters, merged."""
    h = _hashes(spark, d)
    parts = [hashing.quotient_filter(h.where(F.col("page_id") % 2 == n), "hash", 4, 4) for n in (0, 1)]
    return parts[0].unionByName(parts[1]).distinct()


@query()
def a26_bloom_filter(spark, d):
    return hashing.bloom_filter(inputs.table(spark, d, "pages").select("url"), "url")


@query("select vec_id, case when vec_id % 7 = 0 then 'empty namespace' when vec_id % 11 = 0 then 'empty id' else 'other dimensions' end as reason from embeddings where vec_id % 7 = 0 or vec_id % 11 = 0 or vec_id % 13 = 0")
def f13_vector_limits(spark, d):
    broken = F.when(F.col("vec_id") % 13 == 0, F.slice("embedding", 1, 9)).otherwise(F.col("embedding"))
    name = lambda n: F.when(F.col("vec_id") % n == 0, "").otherwise("x")
    return vector.rejected(_vectors(spark, d).select("vec_id", name(7).alias("namespace"), name(11).alias("id"), broken.alias("embedding")), 64).select("vec_id", "reason")
