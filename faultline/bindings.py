"""Queries of the stability operators over the given tables, and the same in SQL.

The tables carry no crash data, so each query projects whole tables into an operator's columns; the SQL does the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from faultline.operators import evaluation, graphs, joins, leak, logs, retrieval, rules, stacks, timing
from faultline.plans.components import connected_components

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def r(c, n: int = 6):
    """Rounded, for comparison."""
    return F.round(c, n)


# --- allocations and memory ----------------------------------------------------------------------------------------------


def _hook(spark, d):
    li = _t(spark, d, "lineitem")
    return li.select(F.lit(0).alias("trace"), F.col("l_partkey").alias("callchain_id"), F.col("l_suppkey").alias("tid"), F.col("l_returnflag").alias("event_type"), F.col("l_quantity").cast("long").alias("heap_size"), F.when(F.col("l_linestatus") != "O", F.lit(1)).cast("long").alias("end_ts"))


@query("""
    with h as (select l_partkey as c, l_suppkey as tid, l_returnflag as event_type, l_quantity::bigint as s from lineitem where l_linestatus = 'O'),
    t as (select sum(s) as total_bytes from h),
    g as (select tid, event_type, p_type as signature, sum(s)::bigint as outstanding_bytes, count(*) as allocation_count, min(c) as callchain_id from h join part on c = p_partkey group by all),
    k as (select *, row_number() over (order by outstanding_bytes desc, tid, event_type, signature) as rank from g)
    select tid, event_type, signature, outstanding_bytes, allocation_count, callchain_id, total_bytes::bigint as total_bytes, rank::int as rank from k, t where rank <= 50
""")
def outstanding_allocations(spark: SparkSession, d: str) -> DataFrame:
    part = _t(spark, d, "part")
    frames = part.select(F.lit(0).alias("trace"), F.col("p_partkey").alias("callchain_id"), F.explode(F.array(F.struct(F.lit(0).alias("depth"), F.col("p_brand").alias("s")), F.struct(F.lit(1).alias("depth"), F.col("p_type").alias("s")))).alias("f")).select("trace", "callchain_id", "f.depth", F.col("f.s").alias("symbol_id"), F.lit(None).cast("string").alias("file_id"))
    names = part.select(F.lit(0).alias("trace"), F.explode(F.array("p_brand", "p_type")).alias("id")).distinct().withColumn("data", F.col("id"))
    rows = leak.outstanding_allocations(_hook(spark, d), frames, names, top=50)
    return rows.select("tid", "event_type", "signature", "outstanding_bytes", "allocation_count", "callchain_id", "total_bytes", "rank")


@query("""
    with s as (select l_partkey as callchain_id, l_returnflag as type, l_suppkey as ipid, sum(case when l_linestatus = 'O' then l_quantity else 0 end)::bigint as a, sum(case when l_linestatus <> 'O' then l_quantity else 0 end)::bigint as rel from lineitem group by all)
    select callchain_id, type, max(a - rel) as outstanding_bytes, -(max({'d': a - rel, 'p': -ipid})).p as pid from s where a > rel group by all
""")
def alloc_statistic_fallback(spark: SparkSession, d: str) -> DataFrame:
    live = F.col("l_linestatus") == "O"
    stat = _t(spark, d, "lineitem").groupBy(F.lit(0).alias("trace"), F.col("l_partkey").alias("callchain_id"), F.col("l_returnflag").alias("type"), F.col("l_suppkey").alias("ipid")).agg(F.sum(F.when(live, F.col("l_quantity")).otherwise(0)).cast("long").alias("apply_size"), F.sum(F.when(~live, F.col("l_quantity")).otherwise(0)).cast("long").alias("release_size"))
    return leak.outstanding_from_stats(stat).drop("trace")


@query("""
    with e as (select user_id, value as v, epoch_us(ts) / 1e6 as tm, row_number() over (partition by user_id order by ts, event_id) - 1 as pos from events),
    l as (select *, v - lag(v) over w as delta, tm - lag(tm) over w as gap from e window w as (partition by user_id order by pos)),
    a as (select user_id, count(*) as n, arg_min(v, pos) as start_value, arg_max(v, pos) as end_value, max(v) as peak_value, max(tm) - min(tm) as seconds, regr_r2(v, pos) as r2, var_pop(v) as spread, max(delta) as max_delta, count(*) filter (where delta >= 0) as rising from l group by user_id),
    b as (select *, end_value - start_value as growth, case when n < 3 or spread = 0 then 0.0 else greatest(0.0, least(1.0, coalesce(r2, 0.0))) end as r from a),
    s as (select l.user_id, count(*) filter (where abs(delta) <= greatest(1.0, 0.02 * abs(growth))) as still from l join b using (user_id) group by 1)
    select user_id, n, start_value, end_value, peak_value, round(growth, 6) as growth, round(r, 6) as r2, round(case when seconds > 0 then growth / seconds * 60 else 0 end, 6) as rate_per_min,
        case when n < 3 then 'insufficient' when growth <= 0 then 'flat_or_declining' when max_delta >= 0.6 * growth then 'sudden_jump' when still >= ceil((n - 1) / 2.0) then 'stepwise' when r >= 0.85 and rising >= 0.8 * (n - 1) then 'linear' else 'fluctuating' end as shape
    from b join s using (user_id)
""")
def mem_trend(spark: SparkSession, d: str) -> DataFrame:
    ev = _t(spark, d, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    rows = leak.metric_trend(ev, ["user_id"], ["ts", "event_id"], "at", "value")
    return rows.select("user_id", "n", "start_value", "end_value", "peak_value", r("growth").alias("growth"), r("r2").alias("r2"), r("rate_per_min").alias("rate_per_min"), "shape")


@query("""
    with g as (select user_id, event_type, arg_max(value, (ts, event_id)) - arg_min(value, (ts, event_id)) as growth from events group by all),
    s as (select *, growth / sum(growth) over (partition by user_id) as share, row_number() over (partition by user_id order by growth desc, event_type) as rank from g where growth > 0)
    select user_id, event_type, round(growth, 6) as growth, round(share, 6) as share, rank::int as rank from s where share >= 0.2 or rank = 1
""")
def leak_type_share(spark: SparkSession, d: str) -> DataFrame:
    at = F.struct("ts", "event_id")
    g = _t(spark, d, "events").groupBy("user_id", "event_type").agg((F.max_by("value", at) - F.min_by("value", at)).alias("growth"))
    return leak.leak_type_share(g, ["user_id"], "event_type", "growth").select("user_id", "event_type", r("growth").alias("growth"), r("share").alias("share"), "rank")


@query("""
    with b as (select p_brand, p_type, sum((p_retailprice * 100)::bigint)::bigint as size, count(*) as n from part group by all),
    s as (select *, size / sum(size) over (partition by p_brand) as share, row_number() over (partition by p_brand order by size desc, p_type) as rank from b)
    select p_brand, p_type, size, n, round(share, 6) as share, rank::int as rank, share >= 0.2 or (rank = 1 and max(share) over (partition by p_brand) < 0.2) as dominant from s
""")
def category_breakdown(spark: SparkSession, d: str) -> DataFrame:
    rows = leak.category_breakdown(_t(spark, d, "part"), ["p_brand"], "p_type", F.round(F.col("p_retailprice") * 100).cast("long"))
    return rows.withColumn("share", r("share"))


@query("""
    with m as (select l_suppkey, date_trunc('month', l_shipdate) as snap, l_partkey, sum(l_quantity) as size from lineitem group by all),
    a as (select *, dense_rank() over (partition by l_suppkey order by snap desc) as age from m)
    select x.l_suppkey, x.l_partkey, x.size as latest, coalesce(y.size, 0) as previous, x.size - coalesce(y.size, 0) as growth
    from a x left join (select * from a where age = 2) y on x.l_suppkey = y.l_suppkey and x.l_partkey = y.l_partkey where x.age = 1
""")
def snapshot_growth(spark: SparkSession, d: str) -> DataFrame:
    li = _t(spark, d, "lineitem").withColumn("snap", F.date_trunc("month", "l_shipdate"))
    return leak.snapshot_growth(li, ["l_suppkey"], "snap", "l_partkey", "l_quantity")


@query("""
    with o as (select l_orderkey, l_suppkey, l_quantity, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as k from lineitem),
    b as (select l_suppkey, sum(l_quantity) as dma_bytes, count(*) as buffers from o where k = 1 group by 1)
    select *, (row_number() over (order by dma_bytes desc, l_suppkey))::int as rank from b qualify rank <= 20
""")
def shared_buffer_owner(spark: SparkSession, d: str) -> DataFrame:
    li = _t(spark, d, "lineitem").withColumn("log", F.lit(0)).withColumn("magic", F.col("l_orderkey")).withColumn("ord", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    owned = leak.dma_ownership(li.drop("l_orderkey"), ["log"], "magic", "l_suppkey", "ord")
    return leak.dma_totals(owned, ["log"], ["l_suppkey"], "l_quantity", 20).drop("log")


@query("""
    with b as (select n_name as nation, c_mktsegment as item, sum((c_acctbal * 100)::bigint)::bigint as bytes from customer join nation on c_nationkey = n_nationkey group by all)
    select *, (row_number() over (partition by nation order by bytes desc, item))::int as rank from b qualify rank <= 3
""")
def kernel_memory_top(spark: SparkSession, d: str) -> DataFrame:
    c = _t(spark, d, "customer").join(_t(spark, d, "nation"), F.expr("c_nationkey = n_nationkey")).select(F.col("n_name").alias("nation"), F.col("c_mktsegment").alias("item"), F.round(F.col("c_acctbal") * 100).cast("long").alias("size"))
    return leak.kernel_memory_top(c, ["nation"], "item", "size", 3)


# --- timing --------------------------------------------------------------------------------------------------------------


def _frames(spark, d):
    return _t(spark, d, "events").select(F.col("user_id").alias("log_id"), F.col("event_id").cast("string").alias("frame_id"), F.col("value").alias("duration_ms"), F.col("event_type").alias("stage"), F.lit(None).cast("string").alias("jank"), F.col("event_type").alias("thread"))


@query("""
    select user_id as log_id, count(*) as frame_count, count(*) filter (where value > 16.67) as jank_count, max(value) as max_ms, round(count(*) filter (where value > 16.67) / count(*), 6) as jank_rate, least(count(*) filter (where value > 16.67), 20) as jank_count_capped from events group by 1
""")
def jank_summary(spark: SparkSession, d: str) -> DataFrame:
    return timing.jank_summary(_frames(spark, d)).withColumn("jank_rate", r("jank_rate"))


@query("""
    select user_id as log_id, event_id::varchar as frame_id, value as duration_ms, (row_number() over (partition by user_id order by value desc, event_id::varchar))::int as rank from events where value > 16.67 qualify rank <= 20
""")
def jank_events(spark: SparkSession, d: str) -> DataFrame:
    return timing.jank_events(_frames(spark, d)).select("log_id", "frame_id", "duration_ms", "rank")


@query("""
    select user_id as log_id, event_type as thread, count(*) as frame_count, count(*) filter (where value > 16.67) as jank_count, round(sum(value), 4) as total_ms, max(value) as max_ms from events group by all
""")
def jank_by_thread(spark: SparkSession, d: str) -> DataFrame:
    return timing.jank_by_thread(_frames(spark, d)).withColumn("total_ms", r("total_ms", 4))


@query("""
    select 0 as log_id, user_id::varchar as thread, round(coalesce(sum(value) filter (where event_type = 'error'), 0), 4) as blocked, 0.0 as io_wait, 0.0 as preempted, round(coalesce(sum(value) filter (where event_type = 'view'), 0), 4) as runnable, round(coalesce(sum(value) filter (where event_type = 'click'), 0), 4) as running, round(coalesce(sum(value) filter (where event_type = 'purchase'), 0), 4) as sleeping
    from events where event_type <> 'signup' group by user_id
""")
def cpu_state_pivot(spark: SparkSession, d: str) -> DataFrame:
    state = F.when(F.col("event_type") == "click", "Run").when(F.col("event_type") == "view", "READY").when(F.col("event_type") == "purchase", " sleep ").when(F.col("event_type") == "error", "block").otherwise("other")
    rows = _t(spark, d, "events").select(F.lit(0).alias("log_id"), F.col("user_id").cast("string").alias("thread"), state.alias("state"), F.col("value").alias("duration_ms"), F.lit(None).cast("double").alias("duration_ns"))
    out = timing.cpu_state_stats(rows)
    return out.select("log_id", "thread", *[r(c, 4).alias(c) for c in out.columns[2:]])


@query("""
    with f as (select user_id as log_id, min(event_id) filter (where event_type = 'click') as a, min(event_id) filter (where event_type = 'purchase') as b from events group by 1)
    select log_id, x.value as start_ts, y.value as end_ts, round(y.value - x.value, 6) as latency from f join events x on a = x.event_id join events y on b = y.event_id
""")
def completion_latency(spark: SparkSession, d: str) -> DataFrame:
    ev = _t(spark, d, "events").select(F.col("user_id").alias("log_id"), F.col("event_type").alias("event"), F.col("value").alias("ts"), F.col("event_id").alias("ord"))
    return timing.completion_latency(ev, ("click",), ("purchase",)).withColumn("latency", r("latency"))


def _ops(spark, d):
    return _t(spark, d, "events").select(F.col("user_id").alias("log_id"), F.col("event_id").alias("ord"), F.col("event_type").alias("category"), F.col("event_id").cast("string").alias("message"), F.when(F.col("event_type") == "error", "E").otherwise("I").alias("level"))


@query("""
    with l as (select *, lag(event_type) over (partition by user_id order by event_id) as before from events),
    c as (select *, row_number() over (partition by user_id order by event_id desc) as age from l where before is null or before <> event_type)
    select user_id as log_id, string_agg(event_type, ' -> ' order by event_id) as path from c where age <= 6 group by 1
""")
def business_path(spark: SparkSession, d: str) -> DataFrame:
    return timing.business_path(_ops(spark, d))


@query("""
    select user_id as log_id, (max(event_id) filter (where event_type = 'click'))::varchar as last_user_action, (max(event_id) filter (where event_type in ('view', 'signup')))::varchar as last_component, count(*) filter (where event_type = 'error') as suspicious from events group by 1
""")
def business_context(spark: SparkSession, d: str) -> DataFrame:
    return timing.business_context(_ops(spark, d), "click", ("view", "signup"))


# --- stacks: an order's lines are a stack of brands -----------------------------------------------------------------------


def _stack(spark, d):
    li = _t(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber", "l_partkey", "l_extendedprice").join(_t(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_type"), "l_partkey")
    pos = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")) - 1
    return li.select("l_orderkey", pos.alias("pos"), F.col("p_brand").alias("function"), F.col("p_type").alias("module"))


_STACK = "s as (select l_orderkey as o, p_brand as f, p_type as m, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 as pos from lineitem join part on l_partkey = p_partkey)"


@query(f"""
    with {_STACK}, x as (select m as log_id, f, o * 100 + pos as p, o from s),
    g as (select log_id, f as function, count(*) as n, min(p) as first_pos from x group by all), t as (select log_id, count(*) as frames from x group by 1)
    select log_id, function, n, first_pos, round(n / frames * 100, 6) as percent, (row_number() over (partition by log_id order by n desc, first_pos))::int as rank from g join t using (log_id) qualify rank <= 20
""")
def hot_functions(spark: SparkSession, d: str) -> DataFrame:
    frames = _stack(spark, d).select(F.col("module").alias("log_id"), (F.col("l_orderkey") * 100 + F.col("pos")).alias("pos"), "function", "module")
    return stacks.hot_functions(frames).select("log_id", "function", "n", "first_pos", r("percent").alias("percent"), "rank")


@query(f"""
    with {_STACK}, l as (select f, lead(f) over (partition by o order by pos) as caller from s),
    g as (select f as callee, caller, count(*) as n from l where caller is not null group by all having count(*) >= 2)
    select callee, caller, n, (row_number() over (order by n desc, callee, caller))::int as rank from g qualify rank <= 50
""")
def call_bigrams(spark: SparkSession, d: str) -> DataFrame:
    frames = _stack(spark, d).select(F.lit(0).alias("log_id"), F.col("l_orderkey").alias("thread"), "pos", "function")
    return stacks.call_bigrams(frames, 2, 50).drop("log_id")


def _samples(spark, d):
    stack = F.transform(F.sort_array(F.collect_list(F.struct("pos", "function"))), lambda x: x.function)
    return _stack(spark, d).groupBy(F.expr("l_orderkey % 10").alias("log_id"), F.col("l_orderkey").alias("sample_id")).agg(stack.alias("frames"))


@query(f"""
    with {_STACK}, a as (select o, list(f order by pos) as fs from s group by 1), t as (select o % 10 as log_id, count(*) as samples from a group by 1),
    g as (select o % 10 as log_id, array_to_string(fs[1:2], '|') as prefix, count(*) as n from a group by all)
    select log_id, prefix, n, samples, (row_number() over (partition by log_id order by n desc, prefix))::int as rank, round(n / samples, 3) as ratio, round(least(0.99, 0.55 + n / samples * 0.44), 3) as confidence from g join t using (log_id)
""")
def stack_clusters(spark: SparkSession, d: str) -> DataFrame:
    rows = stacks.cluster_stacks(_samples(spark, d), 2).withColumn("prefix", F.array_join("prefix", "|"))
    return rows.select("log_id", "prefix", "n", "samples", F.row_number().over(Window.partitionBy("log_id").orderBy(F.desc("n"), "prefix")).alias("rank"), "ratio", "confidence")


@query(f"""
    with {_STACK}, p as (select o % 10 as log_id, o, f, min(pos) as pos from s where pos < 15 group by all), t as (select o % 10 as log_id, count(distinct o) as samples from s group by 1)
    select log_id, f as function, count(*) as n, min(pos)::int as min_pos, max(pos)::int as max_pos, round(avg(pos), 6) as avg_pos, any_value(samples) as samples, round(count(*) / any_value(samples), 6) as ratio, count(*) / any_value(samples) >= 0.3 as dominant from p join t using (log_id) group by log_id, f
""")
def deep_hotspots(spark: SparkSession, d: str) -> DataFrame:
    rows = stacks.deep_hotspots(_samples(spark, d))
    return rows.withColumn("avg_pos", r("avg_pos")).withColumn("ratio", r("ratio"))


@query(f"""
    with {_STACK}, f as (select o % 10 as log_id, f from s where pos = 0), t as (select log_id, count(*) as samples from f group by 1)
    select log_id, f as function, count(*) as n, any_value(samples) as samples, round(count(*) / any_value(samples), 6) as ratio, count(*) / any_value(samples) >= 0.3 as busy from f join t using (log_id) group by log_id, f
""")
def sample_hotspots(spark: SparkSession, d: str) -> DataFrame:
    return stacks.sample_hotspots(_samples(spark, d)).withColumn("ratio", r("ratio"))


@query(f"""
    with {_STACK}, a as (select o, list(f order by pos) as fs from s group by 1),
    g as (select (o // 2) % 50 as log_id, case when o % 2 = 0 then '3s' else '6s' end as bucket, fs[1] as prefix, count(*) as n from a group by all),
    b as (select *, row_number() over (partition by log_id, bucket order by n desc, prefix) as k from g)
    select coalesce(x.log_id, y.log_id) as log_id, x.prefix as early, y.prefix as late, case when x.prefix is null or y.prefix is null then 'UNKNOWN' when x.prefix = y.prefix then 'BLOCKED' else 'BUSY' end as verdict
    from (select * from b where k = 1 and bucket = '3s') x full join (select * from b where k = 1 and bucket = '6s') y on x.log_id = y.log_id
""")
def block_vs_busy(spark: SparkSession, d: str) -> DataFrame:
    s = _samples(spark, d).select(F.expr("(sample_id div 2) % 50").alias("log_id"), F.when(F.expr("sample_id % 2 = 0"), "3s").otherwise("6s").alias("bucket"), "frames")
    return stacks.block_vs_busy(s, 1).select("log_id", F.get("early", F.lit(0)).alias("early"), F.get("late", F.lit(0)).alias("late"), "verdict")


@query(f"""
    with {_STACK} select o as log_id, f as function, count(*) as n from s where pos < 30 group by all having count(*) >= 2
""")
def recursive_functions(spark: SparkSession, d: str) -> DataFrame:
    return stacks.recursive_functions(_stack(spark, d).withColumnRenamed("l_orderkey", "log_id"), 30, 2)


@query(f"""
    with {_STACK}, a as (select o, array_to_string(list(f order by pos)[1:3], ' ') as top, list(m order by pos) as ms, count(*) as k from s group by 1)
    select o_orderpriority || ' ' || o_orderstatus || ' ' || top as signature, count(*) as n from a join orders on o = o_orderkey group by 1
""")
def crash_signatures(spark: SparkSession, d: str) -> DataFrame:
    frames = _stack(spark, d).select(F.col("l_orderkey").alias("log_id"), F.lit(0).alias("thread"), "pos", "function", "module")
    events = _t(spark, d, "orders").select(F.col("o_orderkey").alias("log_id"), F.col("o_orderpriority").alias("os_type"), F.col("o_orderstatus").alias("signal"), F.lit("").alias("category"))
    rows = stacks.crash_signature(stacks.extract_features(frames, events, 3).where("thread_count is not null"))
    return rows.groupBy("signature").agg(F.count("*").alias("n"))


# --- joins ---------------------------------------------------------------------------------------------------------------


@query("""
    with c as (select o_custkey as log_id, floor(min(o_totalprice))::bigint as lo, floor(max(o_totalprice))::bigint + 1 as hi from orders group by 1),
    p as (select o_custkey as log_id, o_orderkey as point_id, floor(o_totalprice)::bigint as va from orders)
    select p.log_id, p.point_id, p.va, (k * (hi - lo) // 4) + lo as start from p join c using (log_id), generate_series(0, 3) g(k) where va >= (k * (hi - lo) // 4) + lo and va < ((k + 1) * (hi - lo) // 4) + lo
""")
def range_lookup(spark: SparkSession, d: str) -> DataFrame:
    o = _t(spark, d, "orders").select(F.col("o_custkey").alias("log_id"), F.col("o_orderkey").alias("point_id"), F.floor("o_totalprice").cast("long").alias("va"))
    c = o.groupBy("log_id").agg(F.min("va").alias("lo"), (F.max("va") + 1).alias("hi"))
    part = F.explode(F.sequence(F.lit(0), F.lit(3)))
    spans = c.select("log_id", "lo", "hi", part.alias("ord")).select("log_id", "ord", F.expr("ord * (hi - lo) div 4 + lo").cast("decimal(20,0)").alias("start"), F.expr("(ord + 1) * (hi - lo) div 4 + lo").cast("decimal(20,0)").alias("end"))
    rows = joins.range_join(o.withColumn("va", F.col("va").cast("decimal(20,0)")), spans, ["log_id"], "va", "start", "end")
    return rows.select("log_id", "point_id", F.col("va").cast("long").alias("va"), F.col("start").cast("long").alias("start"))


@query("""
    with p as (select user_id, event_id, ts from events where event_type = 'click'), m as (select user_id, ts as mark, event_id as purchase from events where event_type = 'purchase')
    select p.user_id, p.event_id, m.purchase from p asof left join m on p.user_id = m.user_id and p.ts >= m.mark
""")
def asof_symbol(spark: SparkSession, d: str) -> DataFrame:
    ev = _t(spark, d, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    marks = ev.where("event_type = 'purchase'").select("user_id", F.col("at").alias("mark"), F.col("event_id").alias("purchase"))
    return joins.asof_join(ev.where("event_type = 'click'").select("user_id", "event_id", "at"), marks, ["user_id"], "at", "mark", ["purchase"]).select("user_id", "event_id", "purchase")


@query("""
    select min(doc_id) as first_id, count(*) as n from documents where text is not null group by sha256(text) having count(*) > 1
""")
def exact_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return joins.duplicate_groups(_t(spark, d, "documents").where("text is not null"), "text", "doc_id").select("first_id", "n")


@query("""
    with i as (select o_custkey % 100 as who, o_orderstatus as st, o_orderkey as seq, o_orderpriority as scope from orders where o_orderkey % 2 = 0),
    n as (select who, st, max(seq) as seq, arg_max(scope, seq) as scope from i group by all),
    q as (select o_orderkey as request_id, o_custkey % 100 as who, o_orderstatus as st from orders where o_orderkey % 2 = 1)
    select request_id, n.seq as hit_run, case when n.seq is null then 'miss' when n.scope = '1-URGENT' then 'conclusion' else 'evidence' end as hit_kind from q left join n using (who, st)
""")
def replay_lookup(spark: SparkSession, d: str) -> DataFrame:
    o = _t(spark, d, "orders").withColumn("who", F.expr("o_custkey % 100"))
    index = o.where("o_orderkey % 2 = 0").select("who", F.col("o_orderstatus").alias("st"), F.col("o_orderkey").alias("run_id"), F.when(F.col("o_orderpriority") == "1-URGENT", "full").otherwise("part").alias("scope"), F.lit("p").alias("prompt_params"), F.col("o_orderkey").alias("seq"))
    requests = o.where("o_orderkey % 2 = 1").select(F.col("o_orderkey").alias("request_id"), "who", F.col("o_orderstatus").alias("st"), F.lit("p").alias("prompt_params"))
    return joins.replay_lookup(requests, index, ["who", "st"]).select("request_id", "hit_run", "hit_kind")


# --- graphs --------------------------------------------------------------------------------------------------------------


@query("""
    with recursive c as (select c_custkey as n, (c_custkey * 7 + 3) % (select count(*) from customer) as m from customer where c_mktsegment <> 'BUILDING'),
    walk as (select n as start, n, [n] as path, false as done from c union all select start, coalesce(case when not list_contains(path, m) then m end, walk.n), case when m is null or list_contains(path, m) then path else list_append(path, m) end, m is null or list_contains(path, m) from walk left join c using (n) where not done),
    w as (select start, max(len(path)) - 1 as steps, arg_max(n, len(path)) as last_node from walk group by 1)
    select start, steps, last_node, coalesce(m, last_node) as blocker, m is not null as deadlocked from w left join c on c.n = last_node
""")
def root_blocker(spark: SparkSession, d: str) -> DataFrame:
    c = _t(spark, d, "customer")
    n = c.count()
    edges = c.where("c_mktsegment <> 'BUILDING'").select(F.lit(0).alias("log_id"), F.col("c_custkey").alias("src"), F.expr(f"(c_custkey * 7 + 3) % {n}").alias("dst"), F.lit(0).alias("ord"))
    return graphs.root_blocker(edges, edges.select("log_id", F.col("src").alias("start"))).select("start", "steps", "last_node", "blocker", "deadlocked")


def _next_customer(spark, d):
    c = _t(spark, d, "customer")
    return c.select(F.lit(0).alias("log_id"), F.col("c_custkey").alias("src"), F.expr(f"(c_custkey * 7 + 3) % {c.count()}").alias("dst"))


@query("""
    with recursive e as (select c_custkey as s, (c_custkey * 7 + 3) % (select count(*) from customer) as t from customer),
    p as (select s as start, t as node, [s] as path from e where t >= s union all select start, e.t, list_append(path, node) from p join e on e.s = p.node where node > start and not list_contains(path, node) and e.t >= start)
    select array_to_string(list_append(path, start), '>') as cycle, false as truncated from p where node = start
""")
def wait_cycles(spark: SparkSession, d: str) -> DataFrame:
    return graphs.dependency_cycles(_next_customer(spark, d), 20).select(F.array_join("cycle", ">").alias("cycle"), "truncated")


@query("""
    with recursive n as (select count(*) as n from supplier), e as (select s_suppkey as a, (s_suppkey * 3 + 1) % n as b from supplier, n union select s_suppkey, (s_suppkey * 2) % n from supplier, n where s_nationkey % 3 = 0),
    w as (select a, b from e union select w.a, e.b from w join e on e.a = w.b)
    select a as node, min(b) as component from w where exists (select 1 from w v where v.a = w.b and v.b = w.a) group by a
""")
def mutual_waits(spark: SparkSession, d: str) -> DataFrame:
    s = _t(spark, d, "supplier")
    n = s.count()
    edge = lambda to: F.struct(F.col("s_suppkey").alias("src"), F.expr(to).alias("dst"))
    edges = s.select(F.explode(F.array(edge(f"(s_suppkey * 3 + 1) % {n}"), edge(f"if(s_nationkey % 3 = 0, (s_suppkey * 2) % {n}, null)"))).alias("e")).select(F.lit(0).alias("log_id"), "e.src", "e.dst")
    return graphs.mutual_waits(edges).select("node", "component")


def _tree(spark, d):
    region, nation, customer, orders = (_t(spark, d, t) for t in ("region", "nation", "customer", "orders"))
    node = lambda k, c: F.concat(F.lit(k), F.col(c).cast("string"))
    nodes = region.select(node("r", "r_regionkey").alias("node"), F.lit(1).alias("self_size")).unionByName(nation.select(node("n", "n_nationkey").alias("node"), F.lit(1).alias("self_size"))).unionByName(customer.select(node("c", "c_custkey").alias("node"), F.lit(1).alias("self_size"))).unionByName(orders.select(node("o", "o_orderkey").alias("node"), F.lit(10).alias("self_size")))
    edges = nation.select(node("r", "n_regionkey").alias("src"), node("n", "n_nationkey").alias("dst")).unionByName(customer.select(node("n", "c_nationkey").alias("src"), node("c", "c_custkey").alias("dst"))).unionByName(orders.select(node("c", "o_custkey").alias("src"), node("o", "o_orderkey").alias("dst")))
    return nodes.withColumn("snapshot_id", F.lit(0)), edges.withColumn("snapshot_id", F.lit(0)).withColumn("ord", F.lit(0))


@query("""
    with c as (select c_nationkey, c_custkey, (select count(*) from orders where o_custkey = c_custkey) as k from customer),
    n as (select n_nationkey, n_regionkey, 1 + (select coalesce(sum(1 + 10 * k), 0) from c where c_nationkey = n_nationkey) as size from nation)
    select 'n' || n_nationkey as node, size::bigint as retained_size from n union all select 'r' || r_regionkey, (1 + (select coalesce(sum(size), 0) from n where n_regionkey = r_regionkey))::bigint from region
    union all select 'c' || c_custkey, (1 + 10 * k)::bigint from c union all select 'o' || o_orderkey, 10 from orders
""")
def subtree_size(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = _tree(spark, d)
    return graphs.heap_retained(nodes, edges).select("node", "retained_size")


@query("""
    with o as (select o_orderkey as k, o_custkey as c from orders), h as (select distinct k, c, l_partkey as p from o join lineitem on l_orderkey = k),
    s as (select p_partkey as p, p_size + 0 as size from part), ps as (select k, sum(coalesce(size, 0)) as size from h left join s using (p) group by k),
    cs as (select c, sum(coalesce(size, 0)) as size from (select distinct c, p from h) left join s using (p) group by c), n as (select c, count(*) as n from o group by c)
    select 'p' || p as node, size::bigint as retained_size from s where size > 0 union all select 'o' || k, (10 + coalesce(size, 0))::bigint from o left join ps using (k)
    union all select 'c' || c_custkey, (1 + 10 * coalesce(n, 0) + coalesce(size, 0))::bigint from customer left join n on n.c = c_custkey left join cs on cs.c = c_custkey
""")
def shared_retained(spark: SparkSession, d: str) -> DataFrame:
    orders, lineitem, customer, part = (_t(spark, d, t) for t in ("orders", "lineitem", "customer", "part"))
    node = lambda k, c: F.concat(F.lit(k), F.col(c).cast("string"))
    sized = lambda k, c, n: (node(k, c).alias("node"), n.cast("long").alias("self_size"))
    nodes = customer.select(*sized("c", "c_custkey", F.lit(1))).unionByName(orders.select(*sized("o", "o_orderkey", F.lit(10)))).unionByName(part.select(*sized("p", "p_partkey", F.col("p_size"))))
    edges = orders.select(node("c", "o_custkey").alias("src"), node("o", "o_orderkey").alias("dst")).unionByName(lineitem.select(node("o", "l_orderkey").alias("src"), node("p", "l_partkey").alias("dst")))
    return graphs.heap_retained(nodes.withColumn("snapshot_id", F.lit(0)), edges.withColumn("snapshot_id", F.lit(0))).select("node", "retained_size")


@query("""
    with r as (select distinct 'r' || r_regionkey as node, 0 as distance from region union all select 'n' || n_nationkey, 1 from nation union all select 'c' || c_custkey, 2 from customer union all select 'o' || o_orderkey, 3 from orders where o_custkey in (select c_custkey from customer)) select * from r
    union all select 'o' || o_orderkey, 0 from orders where false
""")
def heap_distance(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = _tree(spark, d)
    return graphs.heap_distance(nodes, edges).select("node", "distance")


@query("""
    with p as (select user_id, event_type, day(ts) <= 15 as early, max(value) as size from events group by all)
    select n.user_id, n.event_type, n.size, b.size as baseline_size, round(n.size - coalesce(b.size, 0), 6) as delta, case when b.size is null then 'new' else 'grown' end as change
    from (select * from p where not early) n left join (select * from p where early) b using (user_id, event_type) where b.size is null or n.size > b.size
""")
def heap_diff(spark: SparkSession, d: str) -> DataFrame:
    ev = _t(spark, d, "events").withColumn("early", F.dayofmonth("ts") <= 15)
    return graphs.diff_heap(ev.where("not early"), ev.where("early"), ("user_id", "event_type"), "value").withColumn("delta", r("delta"))


@query("""
    with recursive u as (select c_custkey as a, (c_custkey * 7 + 3) % (select count(*) from customer) as b from customer), w as (select a, b from u where a <> b union select b, a from u where a <> b),
    l as (select a as node, a as root from w union select w.b, l.root from l join w on w.a = l.node)
    select node, min(root) as component from l group by 1
""")
def incident_components(spark: SparkSession, d: str) -> DataFrame:
    return connected_components(_next_customer(spark, d))


@query("""
    with e as (select l_suppkey as s, l_partkey % 50 as t, count(*) as w from lineitem where l_suppkey <> l_partkey % 50 group by all),
    a as (select p_partkey % 50 as f, sum(p_size)::double as x from part group by 1),
    p1 as (select f, sum(x) as x from (select f, x from a union all select t, x * least(0.8, 0.1 * w) from a join e on f = s) group by f)
    select f as file, round(sum(x), 4) as score from (select f, x from p1 union all select t, x * least(0.8, 0.1 * w) from p1 join e on f = s) group by f
""")
def source_ranking(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), F.expr("l_partkey % 50").alias("dst")).where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("weight"))
    anchors = _t(spark, d, "part").select(F.expr("p_partkey % 50").alias("file"), F.col("p_size").alias("points"))
    return graphs.rank_source_files(anchors, e, 2).withColumn("score", r("score", 4))


# --- rules ---------------------------------------------------------------------------------------------------------------


@query("""
    with f as (select user_id, count(*) filter (where event_type = 'error') >= 14 as many, arg_max(event_type, event_id) as last, max(value)::int as top from events group by 1)
    select user_id as log_id, 'R1' as rule_id, 0.9 as confidence from f where (last = 'error' and many) or last like '%sign%'
    union all select user_id, 'R2', 0.5 from f where last <> 'error'
    union all select user_id, 'R3', 0.7 from f where many and regexp_matches(last, '^(click|view)$')
""")
def rule_match(spark: SparkSession, d: str) -> DataFrame:
    f = _t(spark, d, "events").groupBy(F.col("user_id").alias("log_id")).agg((F.count_if(F.col("event_type") == "error") >= 14).alias("many"), F.max_by("event_type", "event_id").alias("last"))
    dim = spark.createDataFrame([("R1", "last = ERROR AND many = true OR last ~ sign", 0.9, True, []), ("R2", "last != error", 0.5, True, []), ("R3", "last ~ ^(click|view)$", 0.7, True, ["many"]), ("R4", "last != error", 0.9, False, []), ("R5", "last = error OR ", 0.9, True, []), ("R6", "nonsense", 0.9, True, [])], "rule_id string, condition string, confidence double, enabled boolean, required array<string>")
    return rules.match_rules(f, dim).drop("high")


_MODES = [("lock", "a", "the "), ("lock", "a", "and "), ("lock", "b", "ing"), ("io", "a", "der "), ("io", "b", "que"), ("gc", "a", "license"), ("gc", "b", "apache"), ("gc", "b", "mit ")]
_MODES_SQL = ", ".join(f"('{m}', '{s}', '{k}')" for m, s, k in _MODES)


@query(f"""
    with m(mode, sub, keyword) as (values {_MODES_SQL}),
    h as (select doc_id as log_id, mode, sub, count(*) as hits from documents join m on contains(lower(text), keyword) group by all),
    b as (select *, row_number() over (partition by log_id, mode order by hits desc, sub) as k from h),
    s as (select log_id, mode, sub, hits, least(1.0, 0.35 + 0.2 * hits) as score from b where k = 1)
    select *, (row_number() over (partition by log_id order by score desc, mode))::int as rank from s qualify rank <= 5
""")
def keyword_modes(spark: SparkSession, d: str) -> DataFrame:
    modes = spark.createDataFrame(_MODES, "mode string, sub string, keyword string")
    return rules.keyword_fault_modes(_t(spark, d, "documents").select(F.col("doc_id").alias("log_id"), "text"), modes)


@query("""
    select doc_id, contains(lower(text), 'license') as license, contains(lower(text), 'token') or contains(lower(text), 'password') as secret, contains(text, '@') as mail from documents
""")
def text_flags(spark: SparkSession, d: str) -> DataFrame:
    return logs.text_flags(_t(spark, d, "documents"), {"license": ["license"], "secret": ["token", "password"], "mail": ["@"]}, "doc_id", "text")


@query("""
    with c as (select user_id as log_id, event_type as fault_mode, round(value / 400, 6) as confidence, event_id as ord from events),
    b as (select *, row_number() over (partition by log_id, fault_mode order by confidence desc, ord) as k from c)
    select log_id, max(confidence) as confidence, (max({'c': confidence, 'm': fault_mode})).m as root_cause, case when max(confidence) >= 0.85 then 'confirmed' else 'probable' end as status from b where k = 1 group by 1
""")
def diagnosis_status(spark: SparkSession, d: str) -> DataFrame:
    c = _t(spark, d, "events").select(F.col("user_id").alias("log_id"), F.col("event_type").alias("fault_mode"), F.round(F.col("value") / 400, 6).alias("confidence"), F.col("event_id").alias("ord"))
    return rules.diagnosis_status(rules.merge_modes(c))


# --- retrieval -----------------------------------------------------------------------------------------------------------


@query("""
    with q as (select vec_id as query_id, embedding as e from embeddings where vec_id % 20 = 0),
    s as (select query_id, vec_id as pattern_id, round(list_sum(list_transform(list_zip(e, embedding), lambda z: (z[1]::double - z[2]::double) * (z[1]::double - z[2]::double))), 6) as distance from embeddings, q)
    select *, (row_number() over (partition by query_id order by distance, pattern_id))::int as rank from s qualify rank <= 5
""")
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "embeddings")
    return retrieval.vector_topk(e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), e.select(F.col("vec_id").alias("pattern_id"), "embedding"))


@query("""
    with recursive q as (select vec_id as query_id, embedding as e from embeddings where vec_id % 20 = 0),
    s as (select query_id, vec_id as hit_id, label, round(list_sum(list_transform(list_zip(e, embedding), lambda z: (z[1]::double - z[2]::double) * (z[1]::double - z[2]::double))), 6) as distance from embeddings, q),
    k as (select *, row_number() over (partition by query_id order by distance, hit_id) as no from s qualify no <= 12),
    h as (select query_id, no, hit_id, ['code', 'crash', 'concept'][label % 3 + 1] as layer, label as fp, hit_id % 2000 as chars from k),
    f as (select distinct query_id, 0::bigint as no, 0 as n, 0::bigint as used, []::int[] as seen, []::varchar[] as layers, null::bigint as hit_id, null::varchar as reason, 0::bigint as chars from h
        union all select query_id, no, n + (reason = 'selected')::int, used + c, case when reason = 'selected' then list_append(seen, fp) else seen end, case when reason = 'selected' then list_append(layers, layer) else layers end, hit_id, reason, c
        from (select *, case when reason <> 'selected' then 0 when chars > 4500 - used then 4501 - used else chars end as c from (select h.query_id, h.no, f.n, f.used, f.seen, f.layers, h.hit_id, h.layer, h.fp, h.chars, case when f.n >= 6 then 'hit_budget' when list_contains(f.seen, h.fp) then 'duplicate' when len(list_filter(f.layers, lambda x: x = h.layer)) >= 2 then 'layer_budget' when f.used >= 4500 then 'character_budget' else 'selected' end as reason from f join h on h.query_id = f.query_id and h.no = f.no + 1)))
    select query_id, hit_id, no::int as hit_no, reason, chars::int as used_chars from f where no > 0
""")
def fuse_hits(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "embeddings")
    near = retrieval.vector_topk(e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), e.select(F.col("vec_id").alias("pattern_id"), "embedding"), 12)
    rows = near.join(e.select(F.col("vec_id").alias("pattern_id"), "label"), "pattern_id")
    layer = F.element_at(F.array(F.lit("code"), F.lit("crash"), F.lit("concept")), F.pmod(F.col("label"), F.lit(3)) + 1)
    text = lambda c: F.lit(c).cast("string")
    return retrieval.fuse_hits(rows.select("query_id", F.col("pattern_id").alias("hit_id"), F.lit("internal_case").alias("backend"), layer.alias("layer"), F.col("label").cast("string").alias("fingerprint"), F.repeat(F.lit("x"), (F.col("pattern_id") % 2000).cast("int")).alias("excerpt"), text("historical_case").alias("provenance"), text(None).alias("source_type"), text("medium").alias("confidence"), F.lit(None).cast("double").alias("confidence_score"), (-F.col("distance")).alias("score"), F.lit(0).alias("qualified")))


@query("""
    with c as (select doc_id, trim(text, ' ' || chr(9) || chr(10) || chr(13)) as t from documents),
    w as (select doc_id, t, unnest(range(0, (length(t) - 1) // 1800 + 1)) as window_no from c where t <> '')
    select doc_id, window_no::int as window_no, substring(t, window_no * 1800 + 1, 1800) as chunk from w
""")
def chunk_docs(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.chunk_docs(_t(spark, d, "documents")).select("doc_id", "window_no", "chunk")


@query("""
    select c_custkey, case when c_custkey % 7 = 0 then 'CHANGED' else c_mktsegment end as c_mktsegment, c_nationkey from customer union all select c_custkey + 10000000, 'CHANGED', c_nationkey from customer where c_custkey % 7 = 0 and c_custkey % 2 = 0
""")
def upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    c = _t(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    new = c.where("c_custkey % 7 = 0").withColumn("c_mktsegment", F.lit("CHANGED"))
    extra = new.where("c_custkey % 2 = 0").withColumn("c_custkey", F.col("c_custkey") + 10000000)
    return retrieval.upsert(c, new.withColumn("c_nationkey", F.lit(-1)).unionByName(extra), ["c_custkey"], ["c_nationkey"])


@query("""
    with f as (select l_partkey as p, count(*) filter (where l_returnflag = 'N') as a, count(*) filter (where l_returnflag <> 'N') as x from lineitem where l_linestatus = 'O' group by 1)
    select p_partkey as pattern_id, round(greatest(0.0, p_size / 50.0 - 0.01), 6) as confidence, coalesce(a, 0) as adopted_count, coalesce(x, 0) as rejected_count, greatest(0.0, p_size / 50.0 - 0.01) < 0.2 or coalesce(x, 0) >= 5 as deprecated from part left join f on p = p_partkey
""")
def decay_gc(spark: SparkSession, d: str) -> DataFrame:
    patterns = _t(spark, d, "part").select(F.col("p_partkey").alias("pattern_id"), (F.col("p_size") / 50.0).alias("confidence"), F.lit(0).cast("long").alias("adopted_count"), F.lit(0).cast("long").alias("rejected_count"))
    feedback = _t(spark, d, "lineitem").select(F.col("l_partkey").alias("pattern_id"), (F.col("l_returnflag") == "N").alias("adopted"), (F.col("l_linestatus") == "O").alias("terminal"))
    return retrieval.gc_patterns(retrieval.decay(retrieval.apply_feedback(patterns, feedback))).withColumn("confidence", r("confidence"))


# --- evaluation ----------------------------------------------------------------------------------------------------------


@query("""
    with c as (select lang as suite, (n_chars >= 600)::int as p, quality as q, toxic from labels join documents using (doc_id))
    select suite, count(*) as total_cases, count(*) filter (where p = q) as diagnosis_correct, count(*) filter (where p = 1) as repair_valid, round(avg((p = 1)::int), 6) as decide_accept_rate, round(count(*) filter (where toxic = 1 and p = q) / nullif(count(*) filter (where toxic = 1), 0), 6) as decision_match_rate from c group by 1
""")
def eval_matrix(spark: SparkSession, d: str) -> DataFrame:
    p = F.when(F.col("n_chars") >= 600, 1).otherwise(0)
    match = F.when(p == F.col("quality"), "correct").otherwise("incorrect")
    rows = _t(spark, d, "labels").join(_t(spark, d, "documents").select("doc_id", "lang", "n_chars"), "doc_id").select(F.col("lang").alias("suite"), match.alias("diagnosis"), (p == 1).alias("patch_valid"), F.lit(True).alias("runtime_clean"), F.lit(1).alias("evidence_items"), F.when(p == 1, "accept").otherwise("reject").alias("decide"), F.lit("accept").alias("judge"), F.when(F.col("toxic") == 1, match).otherwise("unknown").alias("decision_match"), F.lit("unknown").alias("judge_match"), F.lit(None).cast("double").alias("valid_rate"))
    out = evaluation.summarize_matrix(rows, ["suite"])
    return out.select("suite", "total_cases", "diagnosis_correct", "repair_valid", r("decide_accept_rate").alias("decide_accept_rate"), r("decision_match_rate").alias("decision_match_rate"))


@query("""
    select user_id as run_id, count(*) as event_count, count(*) filter (where event_type = 'click') as tool_successes, count(*) filter (where event_type = 'error') as tool_failures, round(count(*) filter (where event_type = 'click') / nullif(count(*) filter (where event_type in ('click', 'error')), 0), 6) as tool_success_rate, count(*) filter (where event_type = 'view') as policy_denials from events group by 1
""")
def trace_metrics(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("event_type")
    ev = _t(spark, d, "events").select(F.col("user_id").alias("run_id"), F.when(t.isin("click", "error"), "tool.run.finished").when(t == "view", "tool.policy").otherwise("other").alias("event"), F.lit("tool").alias("kind"), F.when(t == "click", "success").when(t == "error", "failed").when(t == "view", "denied").alias("status"), F.lit("").alias("stage"), F.lit("").alias("name"), F.lit(0).alias("request_count"), F.lit(0).alias("invalid_count"), F.lit(False).alias("malformed"))
    return evaluation.trace_metrics(ev).select("run_id", "event_count", "tool_successes", "tool_failures", r("tool_success_rate").alias("tool_success_rate"), "policy_denials")


@query("""
    with g as (select user_id as case_id, day(ts) <= 15 as early, count(*) as n, count(*) filter (where event_type = 'error') as c from events group by all)
    select b.case_id, round(b.c / b.n, 6) as rate_before, round(a.c / a.n, 6) as rate_after, round(a.c / a.n - b.c / b.n, 6) as rate_delta, case when b.c > 0 and a.c = 0 then 'native_verified' when b.c > 0 then 'contradicted' else 'not_triggered' end as status
    from (select * from g where early) b join (select * from g where not early) a using (case_id)
""")
def compare_runs(spark: SparkSession, d: str) -> DataFrame:
    ev = _t(spark, d, "events").groupBy(F.col("user_id").alias("case_id"), (F.dayofmonth("ts") <= 15).alias("early")).agg(F.count("*").alias("iterations"), F.count_if(F.col("event_type") == "error").alias("crash_count"))
    full = ev.withColumn("crash_rate", F.lit(None).cast("double")).withColumn("plan_fingerprint", F.lit("p")).withColumn("verification_level", F.lit("L3")).withColumn("target_path_reached", F.lit(True))
    rows = evaluation.compare_runs(full.where("early").drop("early"), full.where("not early").drop("early"))
    return rows.select("case_id", *[r(c).alias(c) for c in ("rate_before", "rate_after", "rate_delta")], "status")


@query("""
    select o_custkey as case_id, count(*) as trials, count(distinct regexp_replace(o_orderpriority, '\\s+', ' ', 'g')) as plans, count(distinct o_orderstatus) as outcomes, count(distinct o_orderpriority) = 1 and count(distinct o_orderstatus) = 1 as stable from orders group by 1
""")
def trial_stability(spark: SparkSession, d: str) -> DataFrame:
    o = _t(spark, d, "orders").select(F.col("o_custkey").alias("case_id"), F.col("o_orderkey").alias("trial"), F.col("o_orderpriority").alias("plan"), F.col("o_orderstatus").alias("success"))
    return evaluation.trial_stability(o)


from faultline import bindings_crash  # noqa: E402, F401  registers its queries here
