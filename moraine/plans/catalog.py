"""Registry of the key-value and sketch queries and of their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moraine.functions import bits, codecs, simhash
from moraine.functions.sketches import Bloom, CountMin, HyperLogLog
from moraine.functions.hashing import hash60_sql
from moraine.operators import blocks, folds, levels, merkle, ordered, scan, versions
from moraine.plans import commands
from moraine.sources import frames
from moraine.sources.config import Config
from moraine.sources.kvlog import event_log, name_keys, table, temporary
from moraine.sources.store import RunStore

Query = Callable[[SparkSession, str], DataFrame]

#: name -> (query, oracle SQL or None)
_ALL: dict[str, tuple[Query, str | None]] = {}


def register(name: str, query: Query, oracle: str | None = None) -> None:
    if name in _ALL:
        raise ValueError(f"query {name} is registered twice")
    _ALL[name] = (query, oracle)


def queries() -> dict[str, Query]:
    return {k: q for k, (q, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in _ALL.items() if s is not None}


#: The log of ``kvlog.event_log`` as a DuckDB common table expression, its versions ranked.
LOG_SQL = """log as (
  select epoch_us(ts) as ts, event_id as seq, 'user_' || user_id as key, event_type, value,
         event_type = 'error' as is_tombstone
  from events),
ranked as (select *, row_number() over (partition by key order by ts desc, seq desc) as rn from log),
cur as (select ts, seq, key, event_type, value from ranked where rn = 1 and not is_tombstone)"""
NAMES_SQL = "names as (select c_name as key from customer union all select p_name from part)"


def _current(view: DataFrame) -> DataFrame:
    return view.drop("is_tombstone")


# --- reads -------------------------------------------------------------------------------------------------------------

register("kv_latest", lambda s, d: _current(versions.current(event_log(s, d))), f"with {LOG_SQL} select * from cur")
register("kv_get", lambda s, d: _current(scan.get(event_log(s, d), "user_0")), f"with {LOG_SQL} select * from cur where key = 'user_0'")
register(
    "kv_get_deleted",
    lambda s, d: versions.latest(event_log(s, d)).where("is_tombstone").select("key", "ts", "seq"),
    f"with {LOG_SQL} select key, ts, seq from ranked where rn = 1 and is_tombstone",
)
register(
    "kv_multi_get",
    lambda s, d: _current(scan.multi_get(event_log(s, d), table(s, d, "customer").select(F.concat(F.lit("user_"), F.col("c_custkey").cast("string")).alias("key")))),
    f"with {LOG_SQL} select * from cur where key in (select 'user_' || c_custkey from customer)",
)
register("kv_prefix_scan", lambda s, d: _current(scan.prefix_scan(event_log(s, d), "user_1")), f"with {LOG_SQL} select * from cur where starts_with(key, 'user_1')")
register("kv_prefix_scan_all", lambda s, d: _current(scan.prefix_scan(event_log(s, d), "")), f"with {LOG_SQL} select * from cur")
register(
    "kv_range_scan",
    lambda s, d: _current(scan.range_scan(event_log(s, d), "user_12", "user_3")),
    f"with {LOG_SQL} select * from cur where key between 'user_12' and 'user_3'",
)
register(
    "kv_prefix_page",
    lambda s, d: _current(scan.page(scan.prefix_scan(event_log(s, d), "user_"), 2, 10)),
    f"with {LOG_SQL} select * from cur where starts_with(key, 'user_') order by key limit 10 offset 10",
)
register(
    "kv_range_page",
    lambda s, d: _current(scan.page(scan.range_scan(event_log(s, d), "user_1", "user_9"), 3, 7)),
    f"with {LOG_SQL} select * from cur where key between 'user_1' and 'user_9' order by key limit 7 offset 14",
)
register("kv_page_zero", lambda s, d: _current(scan.page(versions.current(event_log(s, d)), 0, 5)), f"with {LOG_SQL} select * from cur order by key limit 5")
register(
    "kv_reserved_kind",
    lambda s, d: table(s, d, "events").select(F.concat(F.element_at(F.split(F.lit("bf_,cms_,hll_,sh_,user_"), ","), (F.col("user_id") % 5 + 1).cast("int")), F.col("user_id")).alias("key")).distinct().select("key", scan.reserved_kind(F.col("key")).alias("kind"), scan.is_reserved(F.col("key")).alias("reserved")),
    """with k as (select distinct ['bf_', 'cms_', 'hll_', 'sh_', 'user_'][user_id % 5 + 1] || user_id as key from events)
select key, case when starts_with(key, 'bf_') then 'bloom' when starts_with(key, 'cms_') then 'count_min'
  when starts_with(key, 'hll_') then 'hyperloglog' when starts_with(key, 'sh_') then 'simhash' end as kind,
  regexp_matches(key, '^(bf_|cms_|hll_|sh_)') as reserved from k""",
)


def _mutated(spark: SparkSession, d: str) -> DataFrame:
    """The log after every signup user was put again and every key whose newest event is a purchase then deleted, later than all events."""
    log = event_log(spark, d)
    again = log.where("event_type = 'signup'").groupBy("key").agg(F.max("seq").alias("seq")).select(F.lit(4_000_000_000_000_000).alias("ts"), "seq", "key", F.lit("put").alias("event_type"), F.lit(1.0).alias("value"))
    gone = versions.latest(log).where("event_type = 'purchase'").select("key", F.lit(4_000_000_000_000_001).alias("ts"), "seq")
    return versions.delete(versions.put(log, again), gone)


register(
    "kv_put_delete",
    lambda s, d: _current(versions.current(_mutated(s, d))),
    f"""with {LOG_SQL},
p as (select key from ranked where rn = 1 and event_type = 'purchase'),
g as (select key, max(seq) as seq from log where event_type = 'signup' group by key)
select 4000000000000000 as ts, seq, key, 'put' as event_type, 1.0::double as value from g where key not in (from p)
union all select * from cur where key not in (from p) and key not in (select key from g)""",
)

# --- versions and compaction -------------------------------------------------------------------------------------------

register("kv_compact_keep_tombstones", lambda s, d: versions.compact(event_log(s, d)), f"with {LOG_SQL} select * exclude (rn) from ranked where rn = 1")
register("kv_compact_drop_tombstones", lambda s, d: versions.compact(event_log(s, d), True), f"with {LOG_SQL} select * exclude (rn) from ranked where rn = 1 and not is_tombstone")
register(
    "kv_newest_live_version",
    lambda s, d: _current(versions.newest_live_version(event_log(s, d))),
    f"with {LOG_SQL}, lv as (select *, row_number() over (partition by key order by ts desc, seq desc) as r2 from log where not is_tombstone) select ts, seq, key, event_type, value from lv where r2 = 1",
)
register(
    "kv_all_live_versions",
    lambda s, d: _current(versions.all_live_versions(event_log(s, d))),
    f"with {LOG_SQL} select ts, seq, key, event_type, value from log where not is_tombstone and key not in (select key from ranked where rn = 1 and is_tombstone)",
)


#: Bits of an entry's time that hold its seq: a whole bigint, since the log's numbers grow with the log.
SEQ_BITS = 64


def _wal_replay(spark: SparkSession, d: str) -> DataFrame:
    """The newest versions after the log was written as binary segments, a shard for each event type and part of the keys, and read back."""
    folder, log = temporary(spark, "wal"), _sharded(event_log(spark, d))
    log = log.withColumn("frame", blocks.frame_bytes(value="event_type"))
    packed = folds.wal_segments(log, "shard", ["ts", "seq"], "frame", 20_000).select("shard", "segment", "ts", "seq", "key", F.col("event_type").alias("value"), "is_tombstone")
    frames.write_segments(packed, folder, 20_000, SEQ_BITS).write.parquet(f"{folder}-written")
    return versions.latest(frames.read_segments(spark, folder, SEQ_BITS)).select("key", "ts", "seq", "is_tombstone", F.col("value").cast("string").alias("value"))


#: Shards of ordered folds over the log for each event type.
SHARDS = 16


def _sharded(log: DataFrame) -> DataFrame:
    """Adds shard: an event type and a number of SHARDS by a key's bytes, so folds spread over more tasks than types."""
    return log.withColumn("shard", F.concat("event_type", F.lit("-"), F.pmod(F.regexp_extract("key", "[0-9]+", 0).cast("bigint"), F.lit(SHARDS)).cast("string")))


SHARD_SQL = f"event_type || '-' || (cast(regexp_extract(key, '[0-9]+') as bigint) % {SHARDS})"
register("kv_wal_replay", _wal_replay, f"with {LOG_SQL} select key, ts, seq, is_tombstone, case when not is_tombstone then event_type end as value from ranked where rn = 1")


def _runs(spark: SparkSession, d: str) -> DataFrame:
    """The log with the run of each mutation: a run for each 100 mutations of the log's order."""
    log = ordered.numbered(event_log(spark, d), ["ts", "seq"])
    return log.withColumn("run", F.floor((F.col("rn") - 1) / 100).cast("bigint")).drop("rn")


RUNS_SQL = f"{LOG_SQL}, runs as (select *, (row_number() over (order by ts, seq) - 1) // 100 as run from log)"


def _compact_levels(spark: SparkSession, d: str) -> DataFrame:
    runs = _runs(spark, d).checkpoint()
    n = runs.agg((F.max("run") + 1).alias("n"))
    leveled = runs.withColumn("n", n.scalar())
    leveled = leveled.withColumn("level", levels.level_of(F.col("run"), F.col("n"), 4, 3))
    return leveled.groupBy("level").agg(F.count_distinct("run").alias("runs"), F.count_distinct("key").alias("keys"), F.min("run").alias("first_run"))


register(
    "kv_compact_levels",
    _compact_levels,
    f"""with {RUNS_SQL}, c as (select max(run) + 1 as n from runs),
l as (select runs.*, case when run < 16 * (n // 16) then 2 when run < 4 * (n // 4) then 1 else 0 end as level from runs, c)
select cast(level as integer) as level, count(distinct run) as runs, count(distinct key) as keys, min(run) as first_run from l group by level""",
)
register(
    "run_catalog",
    lambda s, d: levels.catalog(_runs(s, d)),
    f"""with {RUNS_SQL} select run, count(*) as n, count(*) filter (is_tombstone) as tombstones, min(key) as first_key,
max(key) as last_key, max(ts) as newest from runs group by run""",
)
register(
    "wal_segment_gaps",
    lambda s, d: levels.missing_segments(table(s, d, "orders").where("o_orderkey % 7 <> 3 and o_orderkey > 2").select(F.col("o_orderkey").alias("segment"))),
    """with k as (select o_orderkey as k from orders where o_orderkey % 7 <> 3 and o_orderkey > 2)
select unnest(range(0, (select max(k) from k))) as segment except select k from k""",
)
register("wal_next_segment", lambda s, d: levels.next_segment(table(s, d, "events").select(F.col("user_id").alias("segment"))), "select max(user_id) + 1 as next_segment from events")
register(
    "kv_memtable_prefix",
    lambda s, d: _current(scan.memtable_prefix(event_log(s, d), "user_2")),
    f"with {LOG_SQL} select * from cur where starts_with(key, 'user_2')",
)
register(
    "kv_memtable_range",
    lambda s, d: _current(scan.memtable_range(event_log(s, d), "user_10", "user_20")),
    f"with {LOG_SQL} select * from cur where key between 'user_10' and 'user_20'",
)
register(
    "kv_sorted_rank",
    lambda s, d: ordered.numbered(versions.current(event_log(s, d)).select("key"), ["key"]),
    f"with {LOG_SQL} select key, row_number() over (order by key) as rn from cur",
)



def _stored(spark: SparkSession, d: str) -> RunStore:
    """The log in a store of runs, a run for each quarter of it, not merged."""
    store = RunStore(spark, temporary(spark, "store"), "ts bigint, seq bigint, key string, event_type string, value double, is_tombstone boolean", Config(level_threshold=20))
    store.init()
    log = event_log(spark, d)
    for quarter in range(4):
        store.add(log.where(F.pmod("seq", F.lit(4)) == quarter).withColumnRenamed("value", "v").select("ts", "seq", "key", "event_type", F.col("v").cast("double").alias("value"), "is_tombstone"), quarter)
    return store


QUARTERS_SQL = f"""{LOG_SQL}, q as (select *, row_number() over (partition by seq % 4, key order by ts desc, seq desc) as r4 from log)"""
register(
    "run_metadata",
    lambda s, d: _stored(s, d).metadata().drop("root"),
    f"with {QUARTERS_SQL} select cast(0 as integer) as level, cast(seq % 4 as integer) as run, min(key) as first_key, max(key) as last_key, count(*) as n, count(*) as leaves from q where r4 = 1 group by seq % 4",
)
register(
    "store_may_have",
    lambda s, d: _stored(s, d).may_have(0, 1, event_log(s, d).select("key")).where("present").select(F.col("item").alias("key")).join(versions.latest(event_log(s, d).where("seq % 4 = 1")).select("key"), "key"),
    "select distinct 'user_' || user_id as key from events where event_id % 4 = 1",
)
register(
    "store_run_index",
    lambda s, d: _stored(s, d).index(0, 2).select("key", "rn", "index_offset"),
    f"with {QUARTERS_SQL} select key, row_number() over (order by key) as rn, row_number() over (order by key) - 1 as index_offset from q where r4 = 1 and seq % 4 = 2",
)
register(
    "store_run_seek",
    lambda s, d: _stored(s, d).seek(0, 3, "user_2", 20).select("key", "ts", "seq"),
    f"with {QUARTERS_SQL} select key, ts, seq from q where r4 = 1 and seq % 4 = 3 and key >= 'user_2' order by key limit 20",
)
register(
    "kv_memtable_update",
    lambda s, d: versions.update(versions.latest(event_log(s, d)), table(s, d, "customer").select(F.concat(F.lit("user_"), F.col("c_custkey")).alias("key"), F.lit(1).cast("bigint").alias("ts"), F.lit(0).cast("bigint").alias("seq"), F.col("c_acctbal").cast("double").alias("value"))),
    f"""with {LOG_SQL}, v as (select * exclude (rn) from ranked where rn = 1), c as (select 'user_' || c_custkey as key, cast(c_acctbal as double) as bal from customer)
select coalesce(ts, 1) as ts, coalesce(seq, 0) as seq, coalesce(v.key, c.key) as key, event_type, case when c.key is not null then bal else value end as value,
  case when c.key is not null then false else is_tombstone end as is_tombstone from v full outer join c on v.key = c.key""",
)
register("store_get", lambda s, d: _current(_stored(s, d).get("user_3")), f"with {LOG_SQL} select * from cur where key = 'user_3'")
register("store_range_scan", lambda s, d: _current(_stored(s, d).range_scan("user_12", "user_3")), f"with {LOG_SQL} select * from cur where key between 'user_12' and 'user_3'")

# --- blocks and index --------------------------------------------------------------------------------------------------

FRAME_SQL = "8 + 4 + 16 + 8 + strlen(key) + 1"
register(
    "log_frame_bytes",
    lambda s, d: event_log(s, d).select("seq", blocks.frame_bytes(value="event_type").alias("frame")),
    f"with {LOG_SQL} select seq, cast({FRAME_SQL} + case when is_tombstone then 0 else 8 + strlen(event_type) end as bigint) as frame from log",
)


def _run_of_names(spark: SparkSession, d: str) -> DataFrame:
    """Distinct names as the keys of a run of live entries whose value is the key."""
    return name_keys(spark, d).distinct().select("key", F.lit(False).alias("is_tombstone")).select("key", blocks.frame_bytes(value="key").alias("frame"))


INDEX_SQL = f"""{NAMES_SQL}, run as (select distinct key, {FRAME_SQL} + 8 + strlen(key) as frame from names),
idx as (select key, row_number() over (order by key) as rn,
  cast(coalesce(sum(frame) over (order by key rows between unbounded preceding and 1 preceding), 0) as bigint) as data_offset,
  cast(coalesce(sum(12 + 8 + strlen(key) + 8) over (order by key rows between unbounded preceding and 1 preceding), 0) as bigint) as index_offset from run),
blk as (select (rn - 1) // 50 as block, min(key) as first_key, max(key) as last_key, min(index_offset) as "offset", count(*) as n from idx group by 1)"""
register("run_index_offsets", lambda s, d: blocks.index(_run_of_names(s, d)), f"with {INDEX_SQL} select * from idx")
register("run_summary_blocks", lambda s, d: blocks.summary(blocks.index(_run_of_names(s, d))), f"with {INDEX_SQL} select * from blk")
register("run_total_range", lambda s, d: blocks.total_range(_run_of_names(s, d)), f"with {INDEX_SQL} select min(key) as first_key, max(key) as last_key, count(*) as n from run")
register(
    "run_block_prune_prefix",
    lambda s, d: blocks.prune(blocks.summary(blocks.index(_run_of_names(s, d))), blocks.prefix_intersects("Customer#0000001")),
    f"with {INDEX_SQL} select * from blk where substr(first_key, 1, 16) <= 'Customer#0000001' and 'Customer#0000001' <= substr(last_key, 1, 16)",
)
register(
    "run_block_prune_range",
    lambda s, d: blocks.prune(blocks.summary(blocks.index(_run_of_names(s, d))), blocks.range_intersects("Customer#000000100", "Customer#000000200")),
    f"with {INDEX_SQL} select * from blk where first_key <= 'Customer#000000200' and 'Customer#000000100' <= last_key",
)
register(
    "pow2_modulo",
    lambda s, d: table(s, d, "part").select("p_partkey", bits.next_pow2_column(F.col("p_size").cast("bigint")).alias("pow2"), bits.mask(F.col("p_partkey"), bits.next_pow2_column(F.col("p_size").cast("bigint"))).alias("masked")),
    "select p_partkey, cast(pow(2, ceil(log2(p_size))) as bigint) as pow2, p_partkey % cast(pow(2, ceil(log2(p_size))) as bigint) as masked from part",
)

# --- sketches ----------------------------------------------------------------------------------------------------------

BLOOM = Bloom.sized(10_000, 0.01)
CMS = CountMin.sized()
HLL = HyperLogLog(10)
SMALL = Bloom.sized(100, 0.01)


def _buyers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").where("event_type = 'purchase'").select(F.col("user_id").cast("string").alias("item"))


def _users(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("user_id").cast("string").alias("item"))


def _parts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_partkey").cast("string").alias("item"))


def _bloom_sql(items: str, b: Bloom, name: str = "bits") -> str:
    return f"{name} as (select distinct {hash60_sql('i', 'item')} & {b.m - 1} as bit from ({items}) t, range(0, {b.k}) r(i))"


def _check_sql(items: str, b: Bloom) -> str:
    return f"(select item, bool_and(bit in (select bit from bits)) as present from (select item, {hash60_sql('i', 'item')} & {b.m - 1} as bit from (select distinct item from ({items})) t, range(0, {b.k}) r(i)) group by item)"


BUYERS_SQL = "select distinct cast(user_id as varchar) as item from events where event_type = 'purchase'"
USERS_SQL = "select cast(user_id as varchar) as item from events"
ABSENT_SQL = "select 'absent_' || p_partkey as item from part"
EMPTY_SQL = "select '' as item"
register(
    "bloom_params",
    lambda s, d: s.createDataFrame([(n, p, Bloom.sized(n, p).m, Bloom.sized(n, p).k) for n in (10, 100, 1000, 100_000) for p in (0.01, 0.02)], "n bigint, rate double, m bigint, k bigint"),
    """with p as (select n, rate, round(-n * ln(rate) / (ln(2) * ln(2))) as x from (values (10), (100), (1000), (100000)) a(n), (values (0.01::double), (0.02)) b(rate)),
q as (select n, rate, pow(2, ceil(log2(x))) as m from p)
select cast(n as bigint) as n, rate, cast(m as bigint) as m, cast(round(m / n * ln(2)) as bigint) as k from q""",
)
register("bloom_bits", lambda s, d: BLOOM.bits(_buyers(s, d), "item"), f"with {_bloom_sql(BUYERS_SQL, BLOOM)} select bit from bits")
register(
    "bloom_words",
    lambda s, d: BLOOM.words(BLOOM.bits(_buyers(s, d), "item")),
    f"with {_bloom_sql(BUYERS_SQL, BLOOM)} select bit >> 5 as word, bit_or(1::bigint << (bit & 31)) as value from bits group by 1",
)
register(
    "bloom_check",
    lambda s, d: SMALL.check(SMALL.bits(_buyers(s, d), "item"), _users(s, d), "item"),
    f"with {_bloom_sql(BUYERS_SQL, SMALL)} select * from {_check_sql(USERS_SQL, SMALL)}",
)


def _bloom_rate(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part").select(F.concat(F.lit("absent_"), F.col("p_partkey")).alias("item"))
    checked = SMALL.check(SMALL.bits(_buyers(spark, d), "item"), parts, "item")
    return checked.agg(F.count("*").alias("n"), F.count_if("present").alias("false_positives"))


register(
    "bloom_fp_rate",
    _bloom_rate,
    f"with {_bloom_sql(BUYERS_SQL, SMALL)} select count(*) as n, count(*) filter (present) as false_positives from {_check_sql(ABSENT_SQL, SMALL)}",
)
register(
    "bloom_merge",
    lambda s, d: BLOOM.bits(_buyers(s, d), "item").union(BLOOM.bits(_parts(s, d), "item")).distinct(),
    f"with {_bloom_sql(BUYERS_SQL + ' union select distinct cast(l_partkey as varchar) from lineitem', BLOOM)} select bit from bits",
)
register(
    "cms_params",
    lambda s, d: s.createDataFrame([(a, c, CountMin.sized(a, c).rows, CountMin.sized(a, c).columns) for a in (0.01, 0.1) for c in (0.01, 0.1)], "accuracy double, certainty double, rows_ bigint, columns_ bigint"),
    """select a as accuracy, c as certainty, cast(ceil(ln(1 / c)) as bigint) as rows_, cast(pow(2, ceil(log2(ceil(2.71828::double / a)))) as bigint) as columns_
from (values (0.01::double), (0.1)) x(a), (values (0.01::double), (0.1)) y(c)""",
)


def _cms_sql(items: str) -> str:
    return f"mat as (select cast(r as integer) as row, {hash60_sql('r', 'item')} & {CMS.columns - 1} as col, cast(sum(n) as bigint) as cnt from (select item, count(*) as n from ({items}) group by item) t, range(0, {CMS.rows}) g(r) group by 1, 2)"


def _estimate_sql(items: str) -> str:
    return f"select item, cast(min(coalesce(cnt, 0)) as bigint) as estimate from (select item, r, {hash60_sql('r', 'item')} & {CMS.columns - 1} as col from (select distinct item from ({items})) t, range(0, {CMS.rows}) g(r)) p left join mat on mat.row = p.r and mat.col = p.col group by item"


PARTS_SQL = "select cast(l_partkey as varchar) as item from lineitem"
register("cms_matrix", lambda s, d: CMS.matrix(_parts(s, d), "item"), f"with {_cms_sql(PARTS_SQL)} select * from mat")
register("cms_count", lambda s, d: CMS.count(CMS.matrix(_parts(s, d), "item"), _parts(s, d), "item"), f"with {_cms_sql(PARTS_SQL)} {_estimate_sql(PARTS_SQL)}")
register(
    "cms_count_empty",
    lambda s, d: CMS.count(CMS.matrix(_users(s, d), "item"), s.createDataFrame([("",)], "item string"), "item"),
    f"with {_cms_sql(USERS_SQL)} {_estimate_sql(EMPTY_SQL)}",
)
register(
    "cms_merge",
    lambda s, d: CMS.matrix(_parts(s, d), "item").union(CMS.matrix(_users(s, d), "item")).groupBy("row", "col").agg(F.sum("cnt").alias("cnt")),
    f"with {_cms_sql(PARTS_SQL + ' union all ' + USERS_SQL)} select * from mat",
)


def _hll_sql(items: str, by: str = "") -> str:
    h = hash60_sql("'hll'", "item")
    return f"""regs as (select {by} cast(h >> 50 as integer) as bucket, cast(max(bit_count(((h | (1::bigint << 50)) & -(h | (1::bigint << 50))) - 1) + 1) as integer) as rho
from (select {by} {h} as h from (select distinct {by} item from ({items}))) group by {by} bucket)"""


def _hll_count_sql(by: str = "") -> str:
    group = f"group by {by.rstrip(', ')}" if by else ""
    return f"""select {by} round(case when raw <= 2.5 * 1024 and zero > 0 then 1024 * ln(1024.0::double / zero) else raw end, 4) as estimate
from (select {by} 1024 - count(*) as zero, (0.7213::double / (1 + 1.079::double / 1024)) * 1024 * 1024 / (coalesce(sum(pow(2.0::double, -rho)), 0) + 1024 - count(*)) as raw from regs {group})"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("estimate", F.round("estimate", 4))


def _typed(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_type", F.col("user_id").cast("string").alias("item"))


TYPED_SQL = "select event_type, cast(user_id as varchar) as item from events"
register("hll_registers", lambda s, d: HLL.registers(_parts(s, d), "item"), f"with {_hll_sql(PARTS_SQL)} select * from regs")
register("hll_count", lambda s, d: _rounded(HLL.count(HLL.registers(_parts(s, d), "item"))), f"with {_hll_sql(PARTS_SQL)} {_hll_count_sql()}")
register(
    "hll_count_by_type",
    lambda s, d: _rounded(HLL.count(HLL.registers(_typed(s, d), "item", ("event_type",)), ("event_type",))),
    f"with {_hll_sql(TYPED_SQL, 'event_type,')} {_hll_count_sql('event_type,')}",
)
register(
    "hll_merge",
    lambda s, d: _rounded(HLL.count(HLL.merged(HLL.registers(_parts(s, d), "item"), HLL.registers(_users(s, d), "item")))),
    f"with {_hll_sql(PARTS_SQL + ' union all ' + USERS_SQL)} {_hll_count_sql()}",
)
register("hll_native", lambda s, d: _parts(s, d).agg(F.hll_sketch_estimate(F.hll_sketch_agg("item", 10)).alias("estimate"), F.approx_count_distinct("item").alias("approx"), F.count_distinct("item").alias("exact")))
register("cms_native", lambda s, d: _parts(s, d).agg(F.length(F.count_min_sketch("item", F.lit(0.01), F.lit(0.99), F.lit(42))).alias("bytes")))

# Each state goes through its binary form and back.
register(
    "bloom_codec",
    lambda s, d: codecs.decode(codecs.encode(BLOOM.bits(_buyers(s, d), "item"), "bloom", m=BLOOM.m, k=BLOOM.k), "bloom", "bit: bigint", m=BLOOM.m, k=BLOOM.k),
    f"with {_bloom_sql(BUYERS_SQL, BLOOM)} select bit from bits",
)
register(
    "cms_codec",
    lambda s, d: codecs.decode(codecs.encode(CMS.matrix(_parts(s, d), "item"), "count_min", rows=CMS.rows, columns=CMS.columns), "count_min", "row: int, col: bigint, cnt: bigint", rows=CMS.rows, columns=CMS.columns),
    f"with {_cms_sql(PARTS_SQL)} select * from mat",
)
register(
    "hll_codec",
    lambda s, d: codecs.decode(codecs.encode(HLL.registers(_parts(s, d), "item"), "hyperloglog", p=HLL.p), "hyperloglog", "bucket: int, rho: int", p=HLL.p),
    f"with {_hll_sql(PARTS_SQL)} select * from regs",
)

# --- texts -------------------------------------------------------------------------------------------------------------

_SPACE = r"[\x09-\x0D\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
TOKENS_SQL = f"""toks as (select doc_id, token from (select doc_id, unnest(list_transform(regexp_split_to_array(lower(coalesce(text, '')), '{_SPACE}'),
  lambda w: regexp_replace(w, '[^\\p{{L}}\\p{{N}}]', '', 'g'))) as token from documents)
  where token <> '' and token not in {simhash.STOPWORDS})"""
_half = lambda name, at: " + ".join(f"case when sum(case when ({name} >> {i}) & 1 = 1 then 1 else -1 end) > 0 then {1 << i}::bigint else 0 end" for i in range(32))
FP_SQL = f"""{TOKENS_SQL}, hashed as (select doc_id, cast('0x' || substr(m, 1, 8) as bigint) as hi, cast('0x' || substr(m, 9, 8) as bigint) as lo from (select doc_id, md5(token) as m from toks)),
sums as (select doc_id, {_half('hi', 1)} as hi, {_half('lo', 9)} as lo from hashed group by doc_id),
fp as (select d.doc_id, cast(coalesce(hi, 0) as bigint) as fp_hi, cast(coalesce(lo, 0) as bigint) as fp_lo from documents d left join sums using (doc_id))"""


def _fps(spark: SparkSession, d: str) -> DataFrame:
    return simhash.fingerprints(table(spark, d, "documents"), "doc_id")


def _with_first(spark: SparkSession, d: str) -> DataFrame:
    """Each document beside the first document of its language and source."""
    ordered.ensure_checkpoint_dir(spark)
    fps = _fps(spark, d).join(table(spark, d, "documents").select("doc_id", "lang", "source"), "doc_id").checkpoint()
    first = fps.groupBy("lang", "source").agg(F.min_by(F.struct("doc_id", "fp_hi", "fp_lo"), "doc_id").alias("f"))
    pairs = fps.join(first, ["lang", "source"])
    distance = simhash.hamming(F.col("fp_hi"), F.col("fp_lo"), F.col("f.fp_hi"), F.col("f.fp_lo"))
    return pairs.select("doc_id", F.col("f.doc_id").alias("first_id"), distance.alias("distance"))


FIRST_SQL = f"""{FP_SQL}, g as (select lang, source, min(doc_id) as first_id from documents group by lang, source),
pairs as (select d.doc_id, first_id, cast(bit_count(xor(a.fp_hi, b.fp_hi)) + bit_count(xor(a.fp_lo, b.fp_lo)) as integer) as distance
  from documents d join g on g.lang = d.lang and g.source = d.source join fp a on a.doc_id = d.doc_id join fp b on b.doc_id = first_id)"""
register("simhash_tokens", lambda s, d: simhash.weights(table(s, d, "documents"), "doc_id"), f"with {TOKENS_SQL} select doc_id, token, count(*) as n from toks group by doc_id, token")
register("simhash_fingerprint", _fps, f"with {FP_SQL} select * from fp")
register("simhash_hamming", _with_first, f"with {FIRST_SQL} select * from pairs")
register(
    "simhash_similarity",
    lambda s, d: _with_first(s, d).select("doc_id", "first_id", simhash.similarity(F.col("distance")).alias("similarity")),
    f"with {FIRST_SQL} select doc_id, first_id, 1.0::double - distance / 64.0::double as similarity from pairs",
)
register(
    "simhash_near_dups",
    lambda s, d: simhash.near(_fps(s, d), "doc_id"),
    f"""with {FP_SQL}, c as (select fp_hi, fp_lo, min(doc_id) as id from fp group by fp_hi, fp_lo),
p as (select x.id as a, y.id as b, cast(bit_count(xor(x.fp_hi, y.fp_hi)) + bit_count(xor(x.fp_lo, y.fp_lo)) as integer) as distance from c x join c y on x.id < y.id)
select * from p where distance <= 3""",
)

# --- integrity ---------------------------------------------------------------------------------------------------------


def _merkle_sql(leaves: str, depth: int = 24) -> str:
    parts = [f"l0 as materialized ({leaves})"]
    for i in range(depth):
        parts.append(
            f"""l{i + 1} as materialized (select i // 2 as i, case when (select count(*) from l{i}) = 1 then max(data)
  else md5(max(case when i % 2 = 0 then data end)) || md5(coalesce(max(case when i % 2 = 1 then data end), max(case when i % 2 = 0 then data end))) end as data from l{i} group by 1)"""
        )
    return ", ".join(parts) + f" select (select max(data) from l{depth}) as root, (select count(*) from l0) as leaves"


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("value"))


register("merkle_root", lambda s, d: merkle.root(_orders(s, d), ["o_orderkey"]), "with " + _merkle_sql("select row_number() over (order by o_orderkey) - 1 as i, o_orderstatus as data from orders"))
register(
    "merkle_root_tombstones",
    lambda s, d: merkle.root(versions.latest(event_log(s, d)).select("key", F.when(versions.is_live(), F.col("event_type")).alias("value")), ["key"]),
    f"with {LOG_SQL}, " + _merkle_sql("select row_number() over (order by key) - 1 as i, case when is_tombstone then '' else event_type end as data from ranked where rn = 1"),
)
register("merkle_root_empty", lambda s, d: merkle.root(_orders(s, d).where("value = 'none'"), ["o_orderkey"]), "select cast(null as varchar) as root, cast(0 as bigint) as leaves")
register(
    "merkle_root_single",
    lambda s, d: merkle.root(table(s, d, "region").where("r_name = 'ASIA'").select("r_regionkey", F.col("r_name").alias("value")), ["r_regionkey"]),
    "select max(r_name) as root, count(*) as leaves from region where r_name = 'ASIA'",
)
register(
    "merkle_levels",
    lambda s, d: merkle.levels(_orders(s, d)),
    """with recursive l(level, nodes) as (select cast(0 as integer), count(*) from orders union all select level + 1, (nodes + 1) // 2 from l where nodes > 1)
select * from l where nodes > 0""",
)
register(
    "entry_crc",
    lambda s, d: event_log(s, d).select("seq", F.crc32(F.col("event_type").cast("binary")).bitwiseXOR(F.lit(0xFFFFFFFF)).alias("crc")),
    # The checksum's register bit by bit; event types are ASCII.
    """with recursive st(k, n, s) as (select distinct event_type, 0, 4294967295::bigint from events
  union all select k, n + 1, case when x & 1 = 1 then xor(x >> 1, 3988292384::bigint) else x >> 1 end
  from (select k, n, case when n % 8 = 0 then xor(s, cast(ord(substr(k, n // 8 + 1, 1)) as bigint)) else s end as x from st where n < 8 * strlen(k)))
select event_id as seq, s as crc from events join st on k = event_type and n = 8 * strlen(k)""",
)

# --- folds -------------------------------------------------------------------------------------------------------------

HALF_DAY = 12 * 3600 * 1_000_000


def _bucket(spark: SparkSession, d: str) -> DataFrame:
    requests = event_log(spark, d).select("key", "ts", "seq")
    return folds.token_bucket(requests, "key", ["ts", "seq"], "ts", 5, HALF_DAY)


BUCKET_SQL = f"""{LOG_SQL}, o as (select key, ts, seq, row_number() over (partition by key order by ts, seq) as n from log),
fold as (select key, ts, seq, n, cast(4 as bigint) as tokens, ts as last, true as allowed from o where n = 1
  union all
  select o.key, o.ts, o.seq, o.n, cast(case when o.ts - last >= {HALF_DAY} then 4 when tokens >= 1 then tokens - 1 else tokens end as bigint),
    case when o.ts - last >= {HALF_DAY} then o.ts else last end, o.ts - last >= {HALF_DAY} or tokens >= 1
  from fold join o on o.key = fold.key and o.n = fold.n + 1)"""
register("token_bucket", _bucket, f"with recursive {BUCKET_SQL} select key, ts, seq, allowed, tokens from fold")
register(
    "token_bucket_rejected",
    lambda s, d: _bucket(s, d).groupBy("key").agg(F.count("*").alias("requests"), F.count_if(~F.col("allowed")).alias("rejected")),
    f"with recursive {BUCKET_SQL} select key, count(*) as requests, count(*) filter (not allowed) as rejected from fold group by key",
)
register(
    "lru_hits",
    lambda s, d: folds.lru(_sharded(event_log(s, d)).select("shard", "ts", "seq", "key"), "shard", ["ts", "seq"], "key", 4).select("seq", "hit", "evicted"),
    f"""with recursive {LOG_SQL}, a as (select {SHARD_SQL} as shard, seq, key, row_number() over (partition by {SHARD_SQL} order by ts, seq) as n from log),
fold as (select shard, seq, n, false as hit, cast(null as varchar) as evicted, [key] as held from a where n = 1
  union all
  select a.shard, a.seq, a.n, list_contains(held, a.key), case when not list_contains(held, a.key) and len(held) >= 4 then held[1] end,
    list_append(list_filter(case when not list_contains(held, a.key) and len(held) >= 4 then held[2:] else held end, lambda x: x <> a.key), a.key)
  from fold join a on a.shard = fold.shard and a.n = fold.n + 1)
select seq, hit, evicted from fold""",
)
register(
    "wal_segments",
    lambda s, d: folds.wal_segments(
        _sharded(event_log(s, d)).select("shard", "ts", "seq", blocks.frame_bytes(value="event_type").alias("frame")), "shard", ["ts", "seq"], "frame", 2_000
    ).select("seq", "segment", "used"),
    f"""with recursive {LOG_SQL}, f as (select {SHARD_SQL} as shard, seq, cast({FRAME_SQL} + case when is_tombstone then 0 else 8 + strlen(event_type) end as bigint) as frame,
  row_number() over (partition by {SHARD_SQL} order by ts, seq) as n from log),
fold as (select shard, seq, n, cast(0 as bigint) as segment, frame as used from f where n = 1
  union all select f.shard, f.seq, f.n, case when used + frame > 2000 then segment + 1 else segment end, case when used + frame > 2000 then frame else used + frame end
  from fold join f on f.shard = fold.shard and f.n = fold.n + 1)
select seq, segment, used from fold""",
)
register(
    "memtable_flush_runs",
    lambda s, d: folds.flush_runs(_sharded(event_log(s, d)).select("shard", "ts", "seq", "key"), "shard", ["ts", "seq"], "key", 5).groupBy("shard", "run").agg(F.count("*").alias("mutations"), F.max("held").alias("keys"), F.max("seq").alias("last_seq")),
    f"""with recursive {LOG_SQL}, o as (select {SHARD_SQL} as shard, seq, key, row_number() over (partition by {SHARD_SQL} order by ts, seq) as n from log),
fold as (select shard, seq, n, cast(0 as bigint) as run, [key] as held from o where n = 1
  union all select o.shard, o.seq, o.n, case when len(held) >= 5 then run + 1 else run end,
    case when len(held) >= 5 then [o.key] when list_contains(held, o.key) then held else list_append(held, o.key) end
  from fold join o on o.shard = fold.shard and o.n = fold.n + 1)
select shard, run, count(*) as mutations, cast(max(len(held)) as bigint) as keys, max(seq) as last_seq from fold group by shard, run""",
)

# --- commands ----------------------------------------------------------------------------------------------------------

SCRIPT = [
    "put user_a one", "put user_b two", "put user_a three", "delete user_b", "put user_c four", "bf new bf_x", "bf add bf_x apple", "bf check bf_x apple", "cms new cms_x", "cms add cms_x pear",
    "cms count cms_x pear", "hll new hll_x", "hll add hll_x plum", "sh hash sh_a text", "sh hash sh_b text", "sh similarity sh_a sh_b", "get user_a", "get user_b", "list user_ 1 10", "range-scan user_b user_d",
    "hll count hll_x", "bf check bf_x absent", "sh hash sh_c other", "sh similarity sh_a sh_c", "bf new bf_x", "bf check bf_x apple", "hll add hll_x fig", "hll count hll_x", "cms add cms_x pear", "cms count cms_x none",
]
register(
    "command_script",
    lambda s, d: commands.run_script(s, SCRIPT),
    """with fp(w, h) as (select w, cast('0x' || substr(md5(w), 1, 16) as ubigint) from (values ('text'), ('other')) t(w)),
est(n, e) as (select n, 1024 * ln(1024.0::double / (1024 - n)) from (values (1), (2)) t(n))
select * from (values (8, 'bf_x', 'present'), (10, 'cms_x', '1'), (11, 'cms_x', '1'), (16, 'sh_a', '1.0'), (17, 'user_a', 'three'), (18, 'user_b', 'Key not found'), (19, 'user_a', 'three'), (19, 'user_c', 'four'), (20, 'user_c', 'four'),
  (22, 'bf_x', 'not present'), (26, 'bf_x', 'not present'), (29, 'cms_x', '2'), (30, 'cms_x', '0')) t(line, key, value)
union all select case n when 1 then 21 else 28 end, 'hll_x', cast(round(e, 4) as varchar) from est
union all select 24, 'sh_a', cast(1 - bit_count(xor(a.h, b.h)) / 64.0::double as varchar) from fp a, fp b where a.w = 'text' and b.w = 'other'""",
)
