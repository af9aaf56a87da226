"""Queries of the log, crash and diagnosis operators, and the same in SQL.

Log text is composed of whole tables (a log for each order, user or customer), so that the operators parse what the SQL knows from
the columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from faultline.bindings import _t, query, r
from faultline.operators import diagnosis, evaluation, graphs, joins, knowledge, leak, logs, retrieval, rules, search, stacks, timing
from faultline.plans.runtime import by_size, fresh_path
from faultline.sources import harmony, jsonframes, readers, snapshots

S = SparkSession


def text(*parts: Column | str) -> Column:
    """Columns and literal texts joined; a text is a literal."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def padded(t: Column, digits: int) -> Column:
    """Zeros before a text up to a length; a longer text stays whole."""
    return F.lpad(t, F.greatest(F.length(t), F.lit(digits)), F.lit("0"))


def hexa(c: Column, digits: int) -> Column:
    return F.lower(padded(F.hex(c.cast("long")), digits))


def pick(key: Column, values: list[str | None]) -> Column:
    """The value at a number's remainder."""
    return F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), F.pmod(key, F.lit(len(values))).cast("int") + 1)


def sql_pick(key: str, values: list[str | None]) -> str:
    quoted = ["null" if v is None else "'" + v.replace("'", "''") + "'" for v in values]
    return f"([{', '.join(quoted)}])[({key}) % {len(values)} + 1]"


# --- an order's lines as the stack of a crash log --------------------------------------------------------------------------

_LINES = "li as (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 as pos from lineitem)"


def _lines(spark: S, d: str) -> DataFrame:
    at = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return by_size(_t(spark, d, "lineitem"), "l_orderkey").withColumn("pos", F.row_number().over(at) - 1)


def _crash_logs(spark: S, d: str) -> DataFrame:
    frame = text("    #", padded(F.col("pos").cast("string"), 2), " pc ", hexa(F.col("l_partkey") * 16, 16), "  /system/lib64/lib", F.col("l_suppkey"), ".so (fn", F.col("l_partkey"), "+", F.col("l_linenumber"), ")")
    stack = _lines(spark, d).groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", frame.alias("t")))), lambda x: x["t"]), "\n").alias("stack"))
    signal = F.when(F.col("o_orderstatus") == "F", "signal 11 (SIGSEGV), fault addr 0x10").when(F.col("o_orderstatus") == "O", "signal 6 (SIGABRT)").otherwise("stopped")
    maps = F.when(F.col("o_orderpriority") == "1-URGENT", "\nMaps:").otherwise("")
    return _t(spark, d, "orders").join(stack, "o_orderkey").select(F.col("o_orderkey").alias("log_id"), text("Process: app", F.col("o_custkey"), "\n", signal, "\nbacktrace:\n", F.col("stack"), maps).alias("content"))


@query(f"""
    with {_LINES}, n as (select l_orderkey, count(*) as frames from li group by 1)
    select o_orderkey as log_id, 3 + frames + (o_orderpriority = '1-URGENT')::int as n_lines, 'Process: app' || o_custkey as first_line from orders join n on l_orderkey = o_orderkey
""")
def log_lines(spark: S, d: str) -> DataFrame:
    rows = logs.explode_lines(_crash_logs(spark, d))
    return rows.groupBy("log_id").agg(F.count("*").alias("n_lines"), F.min_by("text", "line_no").alias("first_line"))


@query(f"""
    with {_LINES}, n as (select l_orderkey, count(*) as frames from li group by 1)
    select o_orderkey as log_id, 'backtrace' as section, 1::bigint as block, 1 + frames as n_lines from orders join n on l_orderkey = o_orderkey
    union all select o_orderkey, 'maps', 2, 1 from orders join n on l_orderkey = o_orderkey where o_orderpriority = '1-URGENT'
""")
def log_sections(spark: S, d: str) -> DataFrame:
    rows = logs.assign_sections(logs.explode_lines(_crash_logs(spark, d))).where("section is not null")
    return rows.groupBy("log_id", "section", "block").agg(F.count("*").alias("n_lines"))


@query("""
    select o_orderkey as log_id, concat_ws(' ', case when o_orderstatus <> 'P' then 'signal' end, 'backtrace', case when o_orderpriority = '1-URGENT' then 'maps' end) as sections from orders where o_orderkey in (select l_orderkey from lineitem)
""")
def sections_present(spark: S, d: str) -> DataFrame:
    return logs.detect_sections(_crash_logs(spark, d)).select("log_id", F.array_join("sections", " ").alias("sections"))


@query(f"""
    with {_LINES} select l_orderkey as log_id, pos::int as frame_number, l_partkey * 16 as address, '/system/lib64/lib' || l_suppkey || '.so' as module, 'fn' || l_partkey as function, l_linenumber::bigint as "offset" from li
""")
def log_frames(spark: S, d: str) -> DataFrame:
    rows = logs.parse_frames(logs.explode_lines(_crash_logs(spark, d)))
    return rows.select("log_id", "frame_number", joins.address(F.col("address")).cast("long").alias("address"), "module", "function", "offset")


def _frame_forms(pos: Column, hex_of, name: Column, n: Column, k: Column) -> list[Column]:
    """A line of each form with the same number, address, names and offset."""
    pad, a = padded(pos.cast("string"), 2), lambda digits: hex_of(digits)
    build = text("ab12cd34", a(8))
    return [
        text("#", pad, " pc ", a(16), "  /system/lib64/lib", name, ".so (fn<", name, ">(int, (x))+", n, ") (BuildId: ", build, ")"),
        text("native: #", pad, " pc ", a(16), "  /data/app/base.apk!lib", name, ".so (offset 0x1000) (fn", name, ")"),
        text("08-10 10:00:00.000  1  2 F DEBUG   :     #", pad, " pc ", a(16), "  /data/lib", name, ".so[", build, "]"),
        text("#", pad, " pc ", a(16), " lib", name, ".so [arm64-v8a::", build, "]"),
        text("#", pad, " pc ", a(16), " /memfd:jit-cache", name, " (deleted) (fn", name, "+", n, ")"),
        text("#", pos, " at run", name, " (entry|@pkg/m", name, "|1.0|src/main/a", name, ".ets:", n, ":", k, ")"),
        text("    at app.Main", name, ".run(Main", name, ".java:", n, ")"),
        text("    at app.Main", name, ".run(Native Method)"),
        text("    at work", name, " (src/a", name, ".js:", n, ":", k, ")"),
        text(pos, "   Core", name, "   0x", a(16), " -[View", name, " draw:] + ", n),
        text(pos, "   Core", name, "   0x", a(16), " 0x10000000 + ", n),
        text(pos, " ", pos, " Core", name, " 0x", a(16), " Draw::line", name, "(int) + ", n, " *(inlined)"),
        text("map_plugin", name, "  0x", a(16), "  Route::size", name),
        text("demo", name, ".dll!Crash::run", name, "+0x", a(2)),
        text("    #", pos, " 0x", a(12), " (/lib/lib", name, ".so+0x", a(4), ") (BuildId: ", build, ")"),
        text("    #", pos, " 0x", a(12), " in fn", name, " /src/a", name, ".cc:", n, ":", k),
    ]


@query("""
    with e as (select *, row_number() over (partition by user_id order by event_id) - 1 as pos, event_id % 1000 as nm, event_id % 50 + 1 as n, event_id % 7 as k, (event_id % 200 + 16) as ad, event_id % 16 as form from events)
    select user_id as log_id, pos + 1 as line_no, case when form in (6, 7, 8, 12, 13) then null else pos end::int as frame_number, case when form in (5, 6, 7, 8, 13) then null else ad end as address,
      ([ '/system/lib64/lib' || nm || '.so', '/data/app/base.apk!lib' || nm || '.so', '/data/lib' || nm || '.so', 'lib' || nm || '.so', '/memfd:jit-cache' || nm || ' (deleted)', '@pkg/m' || nm, null, null, 'a' || nm || '.js', 'Core' || nm, 'Core' || nm, 'Core' || nm, 'map_plugin' || nm, 'demo' || nm || '.dll', '/lib/lib' || nm || '.so', null])[form + 1] as module,
      (['fn<' || nm || '>(int, (x))', 'fn' || nm, null, null, 'fn' || nm, 'run' || nm, 'app.Main' || nm || '.run', 'app.Main' || nm || '.run', 'work' || nm, '-[View' || nm || ' draw:]', null, 'Draw::line' || nm || '(int)', 'Route::size' || nm, 'Crash::run' || nm, null, 'fn' || nm])[form + 1] as function,
      ([null, null, null, null, null, 'entry|@pkg/m' || nm || '|1.0|src/main/a' || nm || '.ets', 'Main' || nm || '.java', null, 'src/a' || nm || '.js', null, null, null, null, null, null, '/src/a' || nm || '.cc'])[form + 1] as file,
      case when form in (5, 6, 8, 15) then n end::int as line, case when form in (0, 4, 9, 10, 11) then n when form in (13, 14) then ad end::bigint as "offset", case when form in (0, 2, 3, 14) then 'ab12cd34' || lpad(lower(hex(ad)), 8, '0') end as build_id from e
""")
def frame_forms(spark: S, d: str) -> DataFrame:
    at = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    ev = _t(spark, d, "events").withColumn("pos", at).withColumn("ad", F.col("event_id") % 200 + 16)
    forms = _frame_forms(F.col("pos"), lambda digits: hexa(F.col("ad"), digits), F.col("event_id") % 1000, F.col("event_id") % 50 + 1, F.col("event_id") % 7)
    line = F.element_at(F.array(*forms), (F.col("event_id") % 16 + 1).cast("int"))
    content = ev.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("t")))), lambda x: x["t"]), "\n").alias("content"))
    rows = logs.parse_frames(logs.explode_lines(content.select(F.col("user_id").alias("log_id"), "content")))
    return rows.select("log_id", F.col("line_no").cast("long").alias("line_no"), "frame_number", joins.address(F.col("address")).cast("long").alias("address"), "module", "function", "file", "line", "offset", "build_id")


@query("""
    select o_orderkey as log_id, case when o_orderstatus = 'P' then 'partial_log' else 'ok' end as status from orders where o_orderkey in (select l_orderkey from lineitem)
    union all select -1, 'error'
""")
def log_status(spark: S, d: str) -> DataFrame:
    found = _crash_logs(spark, d)
    none = _t(spark, d, "region").where("r_regionkey = 0").select(F.lit(-1).cast("long").alias("log_id"), F.col("r_name").alias("content"))
    every = found.unionByName(none)
    return logs.parse_status(every, logs.parse_frames(logs.explode_lines(every)))


@query("""
    select o_orderkey as log_id, 'process' as field, 'app' || o_custkey as value from orders where o_orderkey in (select l_orderkey from lineitem)
    union all select o_orderkey, 'signal', case o_orderstatus when 'F' then 'SIGSEGV' else 'SIGABRT' end from orders where o_orderstatus <> 'P' and o_orderkey in (select l_orderkey from lineitem)
    union all select o_orderkey, 'fault_address', '0x10' from orders where o_orderstatus = 'F' and o_orderkey in (select l_orderkey from lineitem)
""")
def log_headers(spark: S, d: str) -> DataFrame:
    return logs.extract_headers(logs.explode_lines(_crash_logs(spark, d)), [h for h in logs.HEADERS if h[0] in ("process", "signal", "fault_address")])


_HEADER_LINES = [
    ("signal_code", "signal 11 (SIGSEGV), code 1 (SEGV_{}), fault addr 0x10", "SEGV_{}"), ("app_version", "Package: com.a v12 (1.{})", "1.{}"), ("device", "设备型号：phone {}", "phone {}"), ("device", "Hardware Model: m{}", "m{}"), ("process", "Cmdline: app{} --x", "app{}"),
    ("process_id", "pid: {}, tid: 7, name: main >>> app <<<", "{}"), ("process_id", "进程ID: {}", "{}"), ("thread_name", "pid: 1, tid: 2, name: t{} >>> app <<<", "t{}"), ("platform", "平台: p{}", "p{}"), ("timestamp", "Date/Time: 2024 {}", "2024 {}"),
    ("compiler", "clang version {}.1", "clang version {}.1"), ("os_version", "OS Version: iPhone OS 1{} (x)", "1{}"), ("os_version", "running linux 5.{} now", "5.{}"), ("arch", "Code Type: ARM-64 (Native {})", "arm64"), ("arch", "at /data/lib64/aarch64/l{}.so", "arm64"),
    ("symbol_path", "dSYM path: /s/{}", "/s/{}"), ("error_message", "Error message: e {}", "e {}"), ("fault_address", "Exception Codes: KERN_X at 0x{} for it", "0x{}"), ("exception_code", "Exception Code: c{}", "c{}"), ("main_base", "主程序基址: 0x{}", "0x{}"),
]


def _header_sql(key: str, form: int) -> str:
    parts = [f"when {i} then '" + line[form].replace("'", "''").replace("{}", f"' || {key} || '") + "'" for i, line in enumerate(_HEADER_LINES)]
    return f"case {key} % {len(_HEADER_LINES)} {' '.join(parts)} end"


@query(f"select c_custkey as log_id, {sql_pick('c_custkey', [h[0] for h in _HEADER_LINES])} as field, {_header_sql('c_custkey', 2)} as value from customer")
def header_fields(spark: S, d: str) -> DataFrame:
    """A log for each customer, its header in one of twenty forms; fields that a line tells besides are left out."""
    key = F.col("c_custkey")
    forms = [text(*[p for piece in zip(line.split("{}"), [key] * line.count("{}") + [""]) for p in piece]) for _, line, _ in _HEADER_LINES]
    line = F.element_at(F.array(*forms), (key % len(forms) + 1).cast("int"))
    rows = logs.extract_headers(logs.explode_lines(_t(spark, d, "customer").select(key.alias("log_id"), text("Header\n", line, "\nend").alias("content"))))
    return rows.where(F.col("field") == pick(F.col("log_id"), [h[0] for h in _HEADER_LINES]))


_OS_TEXTS = [("OS Version: iPhone OS 17.1 on ohos", "ios"), ("built for OpenHarmony", "harmonyos"), ("Build fingerprint: x", "android"), ("OS Version: macOS 14", "macos"), ("core dump of #0 main", "linux"), ("Windows, call stack: main", "windows"), ("connectToHost failed", "unknown"), ('crashdiag {"platform": "Harmony"}', "harmonyos"), ("Fatal signal 11, pid: 4, tid: 5, name: a", "android"), ("Report version: 1\nProcess: a\nException Type:  X\nCrashed Thread:  3", "ios"), ("Report version: 1\nProcess: a\nException Type:  X\nCrashed Thread:  3\nOS Version: Mac OS X 10", "macos")]


@query(f"select {sql_pick('c_custkey', [o for _, o in _OS_TEXTS])} as os, count(*) as n from customer group by 1")
def os_kinds(spark: S, d: str) -> DataFrame:
    rows = _t(spark, d, "customer").select(logs.detect_os(text(pick(F.col("c_custkey"), [t for t, _ in _OS_TEXTS]), "\n", F.col("c_name"))).alias("os"))
    return rows.groupBy("os").agg(F.count("*").alias("n"))


_KIND_TEXTS = [
    ("AppFreeze in main", "app_freeze", 0.95, "keyword:AppFreeze"),
    ("Watchdog, EXC_CRASH", "watchdog", 0.9, "keyword:watchdog sigkill_is_watchdog_termination"),
    ("ANR in app, SIGSEGV", "mixed_anr_crash", 0.95, "keyword:ANR crash_signal_with_anr_family"),
    ("am_anr: 1", "anr_trace", 0.92, "keyword:ANR"),
    ("OutOfMemoryError and SIGABRT", "oom_kill", 0.92, "keyword:oom_kill"),
    ("jetsam, SIGKILL after SIGBUS", "mixed_oom_crash", 0.9, "keyword:oom_kill crash_signal_with_oom"),
    ("memory warning", "memory_pressure", 0.75, "keyword:memory_pressure"),
    ("PSS: 12, SIGSEGV", "mixed_oom_crash", 0.8, "keyword:memory_pressure crash_signal_with_memory_pressure"),
    ("FATAL EXCEPTION: main", "java_crash", 0.88, "keyword:FATAL_EXCEPTION"),
    ("FATAL EXCEPTION, tombstone", "native_crash", 0.7, "java_fatal_with_native_signal"),
    ("崩溃类型：信号 SIGSEGV_x", "native_crash", 0.85, "crash_signal_or_tombstone"),
    ("Crashed Thread: 0", "native_crash", 0.65, "native_crash_layout_hint"),
    ("nothing said", "unknown", 0.3, "no_strong_markers"),
    (" \n ", "unknown", 0.0, "empty_content"),
    ('"main" prio=5 tid=1 Native\n  native: #00 pc 00ab libc.so\n  at android.os.Looper.loop', "anr_trace", 0.75, "android_traces_heuristic"),
    ('"main" prio=5 tid=1 Native\n  native: #00 pc 00ab libc.so\n  at android.os.Looper.loop\nFatal signal 6', "native_crash", 0.85, "crash_signal_or_tombstone"),
]


@query(f"select o_orderkey as log_id, {sql_pick('o_orderkey', [k[1] for k in _KIND_TEXTS])} as log_kind, {sql_pick('o_orderkey', [str(k[2]) for k in _KIND_TEXTS])}::double as confidence, {sql_pick('o_orderkey', [k[3] for k in _KIND_TEXTS])} as reasons from orders")
def log_kinds(spark: S, d: str) -> DataFrame:
    rows = logs.classify_log_kind(_t(spark, d, "orders").select(F.col("o_orderkey").alias("log_id"), pick(F.col("o_orderkey"), [k[0] for k in _KIND_TEXTS]).alias("content")))
    return rows.select("log_id", "log_kind", r("confidence").alias("confidence"), F.array_join("reasons", " ").alias("reasons"))


@query("""
    select p_partkey as log_id, case p_partkey % 3 when 0 then 'message ' || p_partkey end as abort_message, p_partkey % 5 = 1 as heap_abort, p_partkey % 5 = 2 as jetsam, p_partkey % 5 = 3 as destroyed_mutex from part
""")
def abort_messages(spark: S, d: str) -> DataFrame:
    k = F.col("p_partkey")
    content = text(F.when(k % 3 == 0, text("Abort message: 'message ", k, "'\n")).otherwise(""), pick(k, ["none", "Scudo ERROR", "jetsam event", "pthread_mutex_lock called on a destroyed mutex", "all well"]))
    return _t(spark, d, "part").select(k.alias("log_id"), logs.abort_flags(content).alias("a")).select("log_id", "a.abort_message", "a.heap_abort", "a.jetsam", "a.destroyed_mutex")


# --- maps, registers, build ids ----------------------------------------------------------------------------------------------


@query("""
    select s_suppkey as log_id, p_partkey * 65536 as start, p_partkey * 65536 + p_size * 4096 as "end", p_partkey % 2 = 0 as executable, (p_size * 4096)::bigint as file_offset, '/lib/p' || p_partkey || '.so' as path from supplier join part on p_partkey % 100 = s_suppkey
""")
def log_maps(spark: S, d: str) -> DataFrame:
    k, n = F.col("p_partkey") * 65536, F.col("p_size") * 4096
    line = text(hexa(k, 12), "-", hexa(k + n, 12), F.when(F.col("p_partkey") % 2 == 0, " r-xp ").otherwise(" r--p "), hexa(n, 8), " fd:00 77  /lib/p", F.col("p_partkey"), ".so")
    rows = _t(spark, d, "part").join(_t(spark, d, "supplier"), F.expr("p_partkey % 100 = s_suppkey")).select(F.col("s_suppkey").alias("log_id"), F.col("p_partkey").alias("line_no"), line.alias("text"))
    return logs.parse_maps(rows).select("log_id", *[F.col(c).cast("long").alias(c) for c in ("start", "end")], "executable", F.col("file_offset").cast("long").alias("file_offset"), "path")


@query("""
    select c_custkey as log_id, 'x0' as reg, c_custkey * 4096 as va, c_custkey = 0 as is_null, false as is_fill from customer
    union all select c_custkey, 'sp', c_nationkey + 65536, false, false from customer
    union all select c_custkey, 'x2', 7740398493674204011, false, true from customer where c_custkey % 5 = 0
""")
def log_registers(spark: S, d: str) -> DataFrame:
    k = F.col("c_custkey")
    content = text("    x0  ", hexa(k * 4096, 16), "  sp  ", hexa(F.col("c_nationkey") + 65536, 16), "\n", F.when(k % 5 == 0, "    x2 = 0x6b6b6b6b6b6b6b6b\n    x2 = 0x1111111111111111").otherwise(""))
    return logs.parse_registers(logs.explode_lines(_t(spark, d, "customer").select(k.alias("log_id"), content.alias("content")))).select("log_id", "reg", F.col("va").cast("long").alias("va"), "is_null", "is_fill")


@query("""
    select p_size as log_id, 'lib' || replace(p_brand, '#', '') || '.so' as module, arg_min(printf('%08x', p_partkey) || '00ff', p_partkey) as build_id from part group by all
""")
def build_ids(spark: S, d: str) -> DataFrame:
    line = text("#01 pc 00aa /data/lib", F.replace(F.col("p_brand"), F.lit("#"), F.lit("")), ".so (f+1) (BuildId: ", F.upper(hexa(F.col("p_partkey"), 8)), "00FF)")
    return logs.parse_build_ids(_t(spark, d, "part").select(F.col("p_size").alias("log_id"), F.col("p_partkey").alias("line_no"), line.alias("text")))


@query("""
    with m as (select p_size as log_id, p_brand as path, min(case when p_partkey % 3 = 0 then p_partkey * 4096 end) as zero, min(p_partkey * 4096 - case when p_partkey % 3 = 0 then 0 else 4096 end) as low from part group by all)
    select p_partkey as point_id, p_partkey * 4096 + 17 - coalesce(zero, low) as "offset" from part join m on p_size = log_id and p_brand = path
""")
def module_offsets(spark: S, d: str) -> DataFrame:
    maps = _t(spark, d, "part").select(F.col("p_size").alias("log_id"), F.col("p_brand").alias("path"), (F.col("p_partkey") * 4096).alias("start"), F.when(F.col("p_partkey") % 3 == 0, 0).otherwise(4096).alias("file_offset"), "p_partkey")
    hits = maps.select("log_id", "path", F.col("p_partkey").alias("point_id"), (F.col("start") + 17).alias("va"))
    return joins.module_offsets(hits, maps).select("point_id", "offset")


@query("""
    select c_custkey as log_id, reg, case when reg = 'pc' and c_custkey % 2 = 0 then 'lib.so' when reg = 'lr' and c_custkey % 2 = 0 and c_nationkey >= 3 then 'lib.so' when reg = 'x0' then 'own.so' end as module,
        case when reg = 'pc' and c_custkey % 2 = 0 then 100 when reg = 'lr' and c_custkey % 2 = 0 and c_nationkey >= 3 then 100 + (c_nationkey - 3) * 50 when reg = 'x0' then 5 end::bigint as "offset"
    from customer, (values ('pc'), ('lr'), ('x0')) v(reg)
""")
def frame0_registers(spark: S, d: str) -> DataFrame:
    c = _t(spark, d, "customer")
    reg = F.explode(F.array(*map(F.lit, ("pc", "lr", "x0"))))
    rows = c.select(F.col("c_custkey").alias("log_id"), "c_nationkey", reg.alias("reg"))
    va = F.when(F.col("reg") == "lr", 10_000 + (F.col("c_nationkey") - 3) * 50 - F.when(F.col("c_nationkey") < 3, 10_000).otherwise(0)).otherwise(10_000).cast("long")
    registers = rows.select("log_id", "reg", va.alias("va"), F.when(F.col("reg") == "x0", "own.so").alias("module"), F.when(F.col("reg") == "x0", F.lit(5)).cast("long").alias("offset"))
    frames = c.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("log_id"), F.lit(True).alias("is_crash_thread"), F.lit(0).alias("pos"), F.lit("lib.so").alias("module"), F.lit(100).cast("long").alias("offset"))
    return joins.fill_from_frame0(registers, frames).select("log_id", "reg", "module", "offset")


# --- timelines of a user's events --------------------------------------------------------------------------------------------

_SAID = {"click": ("tap here", "user_action"), "view": ("onCreate done", "lifecycle"), "purchase": ("http request", "network"), "error": ("sqlite commit", "database"), "signup": ("nothing", None)}


def _user_lines(spark: S, d: str) -> DataFrame:
    message = F.create_map(*[F.lit(x) for k, (m, _) in _SAID.items() for x in (k, m)])[F.col("event_type")]
    line = text(F.date_format("ts", "MM-dd HH:mm:ss.SSS"), "  100  101 I ", F.col("event_type"), ": ", message)
    return _t(spark, d, "events").select(F.col("user_id").alias("log_id"), F.col("event_id").alias("line_no"), line.alias("text"))


@query("""
    with n as (select *, row_number() over (partition by user_id order by event_id desc) as age, count(*) over (partition by user_id) as n from events)
    select user_id as log_id, event_id as line_no, 'android_logcat' as format, strftime(ts, '%m-%d %H:%M:%S.%g') as ts, event_type as tag from n where n >= 3 and age <= 50
""")
def log_timeline(spark: S, d: str) -> DataFrame:
    return logs.extract_timeline(_user_lines(spark, d)).select("log_id", "line_no", "format", "ts", "tag")


@query("""
    with n as (select *, row_number() over (partition by user_id order by event_id desc) as age, count(*) over (partition by user_id) as n from events)
    select user_id as log_id, case event_type when 'click' then 'user_action' when 'view' then 'lifecycle' when 'purchase' then 'network' else 'database' end as category, count(*) as n from n where n >= 3 and age <= 50 and event_type <> 'signup' group by all
""")
def operation_classes(spark: S, d: str) -> DataFrame:
    return logs.classify_ops(logs.extract_timeline(_user_lines(spark, d))).groupBy("log_id", "category").agg(F.count("*").alias("n"))


@query("""
    with u as (select user_id as k, count(*) filter (event_type = 'error') as errors, count(*) as n from events group by 1)
    select k as log_id from u where n >= 5 and (errors >= 3 or k % 5 = 0 or k % 7 = 0)
""")
def timeline_worth(spark: S, d: str) -> DataFrame:
    k = F.col("user_id")
    stamp = F.when(F.col("event_type") == "error", text("05-01 10:00:00.000  1  2 I Tag", k % 10, ": sqlite commit")).otherwise(text("note of event ", F.col("event_id")))
    by = _t(spark, d, "events").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_list(stamp)), "\n").alias("lines"), F.count(F.lit(1)).alias("n"))
    head = F.when(k % 5 == 0, "Console Log: kept\n").otherwise("")
    # texts of fewer than five lines stay short of what a timeline needs
    content = F.when(F.col("n") >= 5, text(head, F.col("lines"), F.repeat(F.lit("\nplain words"), 8))).otherwise(F.substring("lines", 1, 60))
    rows = by.select(k.alias("log_id"), content.alias("content"), F.when(k % 7 == 0, F.array(F.lit("maps"), F.lit("HiLog"))).otherwise(F.array(F.lit("maps"))).alias("sections"))
    return logs.timeline_gate(rows).select("log_id")


@query("""
    with p as (select p_partkey as k, p_size as s, p_partkey % 11 as f from part)
    select k as log_id, case when f = 9 then 'mixed_oom_with_crash' when f = 0 then 'java_oom' when f in (1, 2, 3) then 'system_oom_kill' when f = 4 then 'native_alloc_failure' when f = 8 then 'oom_kill' when f in (5, 6) then 'memory_pressure' when f = 10 then 'oom_category' else 'memory_related' end as memory_subtype,
      s::double as pss, (['M', null, 'K', 'G'])[s % 4 + 1] as pss_unit, (s::bigint * ([1048576, 1024, 1024, 1073741824])[s % 4 + 1])::bigint as pss_bytes, case when f % 2 = 0 then (k % 97)::double end as native_heap, s * 10 as fd_count, k as thread_count from p
""")
def memory_kinds(spark: S, d: str) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size")
    said = pick(key % 11, ["java.lang.OutOfMemoryError: Java", "killed by jetsam", "lowmemorykiller: kill", "EXC_RESOURCE RESOURCE_TYPE_MEMORY", "mmap: Cannot allocate memory", "a memory warning", "onTrimMemory 15", "all well", "all well", "OutOfMemoryError", "all well"])
    heap = F.when(key % 11 % 2 == 0, text("\nNative Heap: ", key % 97)).otherwise("")
    content = text(said, "\nPSS: ", size, pick(size % 4, [" MB", "", " K", " G"]), heap, "\nFDs: ", size * 10, "\nThreads: ", key)
    rows = _t(spark, d, "part").select(key.alias("log_id"), content.alias("content"), pick(key % 11, [*[None] * 8, "oom_kill", "mixed_oom_crash", None]).alias("log_kind"), pick(key % 11, [*[None] * 10, "OOM"]).alias("category"))
    found = logs.memory_subtype(logs.memory_indicators(rows), rows)
    return found.select("log_id", "memory_subtype", "pss", "pss_unit", "pss_bytes", "native_heap", F.col("fd_count").cast("int").alias("fd_count"), "thread_count")


_FREEZES = [("input_block here", "INPUT_BLOCK", 5000), ("Lifecycle timeout", "LIFECYCLE_TIMEOUT", 5000), ("render_service", "RENDER_SERVICE_TIMEOUT", 6000), ("thread_block_6s", "THREAD_BLOCK_6S", 6000), ("blocked 20s", "THREAD_BLOCK_20S", 20000), ("app freeze", "APPFREEZE", 6000), ("calm", "UNKNOWN", None)]


@query(f"select p_partkey as log_id, {sql_pick('p_partkey', [k for _, k, _ in _FREEZES])} as freeze_type, {sql_pick('p_partkey', [None if m is None else str(m) for _, _, m in _FREEZES])}::int as timeout_ms from part")
def freeze_kinds(spark: S, d: str) -> DataFrame:
    return _t(spark, d, "part").select(F.col("p_partkey").alias("log_id"), timing.classify_freeze(pick(F.col("p_partkey"), [t for t, _, _ in _FREEZES])).alias("f")).select("log_id", "f.*")


@query("select p_partkey as log_id, (p_size * 2)::double as cpu_percent, floor(p_retailprice) as available_mb, p_size * 2 >= 85 or floor(p_retailprice) < 800 as stressed from part")
def system_loads(spark: S, d: str) -> DataFrame:
    content = text("cpu usage: ", F.col("p_size") * 2, "%\nMemAvailable: ", F.floor("p_retailprice"), " MB")
    return _t(spark, d, "part").select(F.col("p_partkey").alias("log_id"), timing.system_load(content).alias("l")).select("log_id", "l.cpu_percent", "l.available_mb", "l.stressed")


_QUEUE = "q as (select user_id as log_id, count(*) as events, count(distinct case when value * 20 > 3000 then event_type end) as long_events, round(max(value * 20), 4) as longest_ms from events group by 1), st as (select user_id as log_id, case when user_id % 2 = 0 then 'task' || user_id end as running_task, case when user_id % 2 = 0 then (user_id % 50) * 100.0 end as running_ms, (user_id % 7)::int as pending_total from (select distinct user_id from events))"


def _queue_dumps(spark: S, d: str) -> DataFrame:
    k = F.col("log_id")
    stamp = lambda ms: text("2024-05-01 10:00:0", F.floor(ms / 1000), ".", F.lpad((ms % 1000).cast("string"), 3, "0"))
    running = F.when(k % 2 == 0, text("Current Running: start at 2024-05-01 10:00:00.000, Event { send thread = 1, task name = task", k, ", caller = c }\n")).otherwise("")
    pending = text("Total size of High events : ", F.floor(k % 7 / 2), "\nTotal size of Low events : ", k % 7 - F.floor(k % 7 / 2))
    return _t(spark, d, "events").select(F.col("user_id").alias("log_id")).distinct().select("log_id", text("EventHandler dump begin curTime: ", stamp((k % 50) * 100), "\n", running, pending).alias("content"))


@query(f"with {_QUEUE} select log_id, running_task, running_ms::double as running_ms, pending_total, ((log_id % 7) // 2)::int as high from st")
def queue_state(spark: S, d: str) -> DataFrame:
    return logs.parse_queue_state(_queue_dumps(spark, d)).select("log_id", "running_task", r("running_ms").alias("running_ms"), "pending_total", F.col("pending")["High"].alias("high"))


@query(f"""
    with {_QUEUE}, c as (select *, case when running_ms > 3000 then 'running_task' when long_events > 0 then 'long_events' when running_task is not null and pending_total >= 5 then 'pending' end as cause from q join st using (log_id))
    select log_id, events, long_events, longest_ms, case when pending_total > 0 then pending_total else events end::bigint as queue_depth, cause, case when cause is null then 'normal' else 'blocked' end as verdict from c
""")
def queue_verdicts(spark: S, d: str) -> DataFrame:
    queue = _t(spark, d, "events").select(F.col("user_id").alias("log_id"), F.col("event_type").alias("name"), (F.col("value") * 20).alias("duration_ms"))
    rows = timing.queue_summary(queue, logs.parse_queue_state(_queue_dumps(spark, d)))
    return rows.select("log_id", "events", "long_events", r("longest_ms", 4).alias("longest_ms"), "queue_depth", "cause", "verdict")


@query(f"""
    with {_LINES} select l_orderkey as log_id, l_suppkey || ':' || l_linenumber as src, l_partkey || ':' || (l_linenumber % 2) as dst, l_quantity::bigint / 10.0 as wait_seconds, l_linenumber % 2 = 0 as ipc_full, (pos + 1)::int as ord from li
""")
def wait_edges(spark: S, d: str) -> DataFrame:
    line = text(F.col("l_suppkey"), ":", F.col("l_linenumber"), " to ", F.col("l_partkey"), ":", F.col("l_linenumber") % 2, " code 9 wait:", F.format_string("%.1f", F.col("l_quantity") / 10), " s")
    rows = _lines(spark, d).groupBy(F.col("l_orderkey").alias("log_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("t")))), lambda x: x["t"]), "\n").alias("content"))
    return logs.parse_wait_edges(rows).select("log_id", "src", "dst", r("wait_seconds").alias("wait_seconds"), "ipc_full", "ord")


# --- memory files ------------------------------------------------------------------------------------------------------------


@query("""
    select user_id as log_id, (event_id + 1) as line_no, m as metric, case m when 'RSS(KB)' then (event_id * 10)::double else (event_id % 1000)::double end as value, event_type = 'error' as is_trigger from events, (values ('RSS(KB)'), ('PSS(KB)')) v(m)
""")
def memory_samples(spark: S, d: str) -> DataFrame:
    k = F.col("event_id")
    ev = _t(spark, d, "events")
    rows = ev.select(F.col("user_id").alias("log_id"), (k + 1).alias("line_no"), text(F.format_number(k * 10, 0), "   ", k % 1000, F.when(F.col("event_type") == "error", "*").otherwise("")).alias("text"))
    heads = ev.select(F.col("user_id").alias("log_id")).distinct().select("log_id", F.lit(0).cast("long").alias("line_no"), F.lit("RSS(KB)   PSS(KB)").alias("text"))
    return logs.parse_mem_samples(rows.unionByName(heads)).select("log_id", "line_no", "metric", "value", "is_trigger")


@query("""
    select p_size as log_id, '/lib/' || p_brand as name, count(*) as blocks, sum(p_partkey * 4)::double as size_kb, sum(p_partkey)::double as pss_kb, sum(case when p_partkey % 2 = 0 then 3 else 0 end)::double as swap_pss_kb from part group by all
""")
def smaps_blocks(spark: S, d: str) -> DataFrame:
    k = F.col("p_partkey")
    parts = F.array(text(hexa(k * 4096, 8), "-", hexa(k * 4096 + 4096, 8), " r-xp 00000000 fd:00 5   /lib/", F.col("p_brand")), text("Size:   ", k * 4, " kB"), text("Rss:   ", k, " kB"), text("Pss:   ", k, " kB"), F.when(k % 2 == 0, "SwapPss:  3 kB").otherwise("VmFlags: rd"))
    rows = _t(spark, d, "part").select(F.col("p_size").alias("log_id"), k, F.posexplode(parts).alias("p", "text")).select("log_id", (k * 10 + F.col("p")).alias("line_no"), "text")
    return logs.parse_smaps(rows).groupBy("log_id", "name").agg(F.count("*").alias("blocks"), F.sum("size_kb").alias("size_kb"), F.sum("pss_kb").alias("pss_kb"), F.sum("swap_pss_kb").alias("swap_pss_kb"))


@query("""
    select p_size as log_id, 'gpu' as kind, p_brand as item, sum(p_partkey * 100)::bigint as bytes from part group by all
    union all select p_size, 'slab', 'cache_' || replace(p_brand, '#', ''), sum(p_partkey * 64)::bigint from part group by all
    union all select p_size, 'ashmem', 'proc' || p_partkey, p_partkey * 1024 from part
""")
def kernel_files(spark: S, d: str) -> DataFrame:
    k, brand = F.col("p_partkey"), F.col("p_brand")
    part = _t(spark, d, "part").select(F.col("p_size").alias("log_id"), k, brand)
    forms = [(0, text("  C:", brand, ": ", k * 100)), (1, text("cache_", F.replace(brand, F.lit("#"), F.lit("")), "  ", k, " ", k + 5, " 64 51 1 : tunables")), (2, text("proc", k, " ", k * 2, " ", k))]
    heads = [(0, "memoryName: gpu"), (1, "slabinfo - version: 2.1"), (2, "Process_name Virtual_size Physical_size")]
    at = lambda f, n: (F.lit(f) * 10_000_000 + n).cast("long").alias("line_no")
    rows = None
    for f, line in forms:
        some = part.select("log_id", at(f, k + 1), line.alias("text")).unionByName(part.select("log_id").distinct().select("log_id", at(f, 0), F.lit(heads[f][1]).alias("text")))
        rows = some if rows is None else rows.unionByName(some)
    return logs.parse_kernel_memory(rows).groupBy("log_id", "kind", "item").agg(F.sum("bytes").alias("bytes"))


@query("""
    select p_size as log_id, 'proc ' || p_brand as process_name, (p_partkey + 7)::varchar as pid, p_partkey * 512 as size_bytes, 'm' || p_partkey as magic, p_type as leak_type from part where p_partkey > 0
""")
def dma_buffers(spark: S, d: str) -> DataFrame:
    k = F.col("p_partkey")
    rows = _t(spark, d, "part").select(F.col("p_size").alias("log_id"), k.alias("line_no"), text("proc ", F.col("p_brand"), "\t", k + 7, "\t", k * 512, "\tm", k, "\tb", k, "\t", F.col("p_type")).alias("text"))
    heads = rows.select("log_id").distinct().select("log_id", F.lit(-1).cast("long").alias("line_no"), F.lit("Process\tpid\tsize_bytes\tmagic\tbuf_name\tleak_type").alias("text"))
    return logs.parse_dma(rows.unionByName(heads)).select("log_id", "process_name", "pid", "size_bytes", "magic", "leak_type")


@query("""
    select c_custkey as log_id, (c_nationkey % 3 + 1)::bigint as snapshot_no, (c_custkey % 64 * 8)::bigint as size_bytes, c_custkey * 100 as allocated_bytes from customer
""")
def allocator_snapshots(spark: S, d: str) -> DataFrame:
    k, n = F.col("c_custkey"), F.col("c_nationkey") % 3
    lines = F.concat(F.array_repeat(F.lit("snapshot"), (n + 1).cast("int")), F.array(text("bin: ", k % 64 * 8, " allocated: ", k * 100)))
    rows = _t(spark, d, "customer").select(k.alias("log_id"), F.posexplode(lines).alias("line_no", "text"))
    return logs.parse_nmd(rows).select("log_id", "snapshot_no", "size_bytes", "allocated_bytes")


# --- script and interface errors ---------------------------------------------------------------------------------------------


@query("""
    select p_partkey as log_id, case p_partkey % 3 when 0 then p_partkey::varchar when 1 then (p_partkey + 1)::varchar else '0x' end as code_norm from part
""")
def api_codes(spark: S, d: str) -> DataFrame:
    k = F.col("p_partkey")
    rows = _t(spark, d, "part").select(k.alias("log_id"), F.when(k % 3 == 0, text("0x", hexa(k, 4))).when(k % 3 == 2, "0x").alias("code"), text("failed\nerror code: ", k + 1).alias("text"))
    return logs.normalize_api_errors(rows).select("log_id", "code_norm")


_ERRORS = [("TypeError", "x is not a function", "JSC-FM-02", 0.92), ("Strange", "y is not defined", "JSC-FM-03", 0.8), ("RangeError", "odd", "JSC-FM-05", 0.55), ("Nameless", "odd", "JSC-FM-Unknown", 0.2)]


@query(f"select p_partkey as log_id, {sql_pick('p_partkey', [e[0] for e in _ERRORS])} as name, {sql_pick('p_partkey', [e[2] for e in _ERRORS])} as fault_mode, {sql_pick('p_partkey', [str(e[3]) for e in _ERRORS])}::double as confidence from part")
def script_errors(spark: S, d: str) -> DataFrame:
    k = F.col("p_partkey")
    content = text("Reason: Error\nError name: ", pick(k, [e[0] for e in _ERRORS]), "\n Error message: ", pick(k, [e[1] for e in _ERRORS]), "\nError code: ", k)
    errors = logs.extract_js_errors(_t(spark, d, "part").select(k.alias("log_id"), content.alias("content")))
    dim = spark.createDataFrame([(1, "JSC-FM-02", "TypeError", "is not a function"), (2, "JSC-FM-03", "ReferenceError", "is not defined"), (3, "JSC-FM-05", "RangeError", "maximum call stack"), (4, "JSC-FM-10", "Error", "detached")], "ord int, mode string, expected string, message_pattern string")
    return rules.js_fault_mode(errors, dim).join(errors.select("log_id", "name"), "log_id").select("log_id", "name", "fault_mode", "confidence")


@query("""
    with k as (select doc_id as log_id, lower(text) as t from documents where text is not null),
    s as (select log_id, 'net' as module, 0.35 * contains(t, 'th')::int + 0.3 * contains(t, 'ing')::int as score, contains(t, 'ing')::int as e from k union all select log_id, 'disk', 0.4 * contains(t, 'der')::int + 0.3 * contains(t, 'and')::int, contains(t, 'der')::int + contains(t, 'and')::int from k)
    select log_id, module, round(score, 6)::double as score, round(0.5 + 0.15 * e, 6)::double as confidence, (row_number() over (partition by log_id order by score desc, module))::int as rank from s where score > 0
""")
def api_faults(spark: S, d: str) -> DataFrame:
    dim = spark.createDataFrame([("net", "module", "TH"), ("net", "pattern", "ing"), ("disk", "api", "der"), ("disk", "pattern", "and"), ("disk", "code", "9")], "module string, kind string, term string")
    errors = _t(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("log_id"), "text", F.lit(None).cast("string").alias("code"))
    return rules.api_fault(errors, dim).select("log_id", "module", r("score").alias("score"), r("confidence").alias("confidence"), "rank")


@query("""
    with c as (select c_custkey as log_id, (c_custkey % 4)::int as play, (c_nationkey % 3)::int as stop, (c_custkey % 6)::int as reset, (c_nationkey % 8)::int as prepare from customer)
    select *, reset >= 3 as repeated_reset, play > 0 and prepare > 2 * play as prepared_in_vain, reset >= 3 or (play > 0 and prepare > 2 * play) as escalate_to_app from c
""")
def api_states(spark: S, d: str) -> DataFrame:
    said = lambda word, n: F.repeat(F.lit(word), n.cast("int"))
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    content = text(said("x.play( ) ", key % 4), said("stop() ", nation % 3), said("Reset; ", key % 6), said("prepare ", nation % 8), F.lit("display() resetting"))
    return _t(spark, d, "customer").select(key.alias("log_id"), logs.api_state_counts(content).alias("s")).select("log_id", "s.play", "s.stop", "s.reset", "s.prepare", "s.repeated_reset", "s.prepared_in_vain", "s.escalate_to_app")


@query(f"""
    with {_LINES}, f as (select l_orderkey as log_id, pos, 'fn' || l_partkey as function, case l_suppkey % 3 when 0 then 'a.ets' when 1 then 'node_modules/b.js' else 'c.cpp' end as file from li),
    g as (select log_id, min(pos) filter (where file = 'a.ets') as p, bool_or(file <> 'c.cpp') as js, bool_or(file = 'c.cpp') as native from f group by 1)
    select g.log_id, f.function as app_function, js and native as hybrid, case when js then 1.0 else 0.75 end::double as factor from g left join f on f.log_id = g.log_id and f.pos = g.p
""")
def script_stacks(spark: S, d: str) -> DataFrame:
    frames = _lines(spark, d).select(F.col("l_orderkey").alias("log_id"), "pos", text("fn", F.col("l_partkey")).alias("function"), pick(F.col("l_suppkey"), ["a.ets", "node_modules/b.js", "c.cpp"]).alias("file"), F.col("l_linenumber").alias("line"))
    return rules.js_stack(frames).select("log_id", F.col("app_frame.function").alias("app_function"), "hybrid", "factor")


# --- frames ------------------------------------------------------------------------------------------------------------------

_FRAMES = f"{_LINES}, fr as (select l_orderkey as log_id, l_suppkey % 6 as thread, l_suppkey % 6 = 1 as crash, row_number() over (partition by l_orderkey, l_suppkey % 6 order by pos) - 1 as pos, 'fn' || l_partkey as function, case l_partkey % 4 when 0 then 'libc.so' when 1 then 'libart.so' when 2 then 'libapp' || l_suppkey || '.so' else 'com.google.x' end as module from li)"


def _frames(spark: S, d: str) -> DataFrame:
    thread = F.col("l_suppkey") % 6
    own = Window.partitionBy("l_orderkey", thread).orderBy("pos")
    module = F.when(F.col("l_partkey") % 4 == 0, "libc.so").when(F.col("l_partkey") % 4 == 1, "libart.so").when(F.col("l_partkey") % 4 == 2, text("libapp", F.col("l_suppkey"), ".so")).otherwise("com.google.x")
    return _lines(spark, d).select(F.col("l_orderkey").alias("log_id"), thread.alias("thread"), (thread == 1).alias("is_crash_thread"), (F.row_number().over(own) - 1).alias("pos"), text("fn", F.col("l_partkey")).alias("function"), module.alias("module"), F.lit(None).cast("string").alias("file"), F.lit(None).cast("int").alias("line"))


@query(f"""
    with {_FRAMES}, k as (select *, dense_rank() over (partition by log_id order by crash desc, thread) as tr from fr) select log_id, count(*) as frames, count(distinct thread) as threads from k where tr <= 2 and pos < case when crash then 2 else 1 end group by 1
""")
def frame_limits(spark: S, d: str) -> DataFrame:
    return stacks.limit_frames(_frames(spark, d), 2, 2, 1).groupBy("log_id").agg(F.count("*").alias("frames"), F.countDistinct("thread").alias("threads"))


@query(f"""
    with {_FRAMES} select log_id, thread, function, (row_number() over (partition by log_id, thread order by pos) - 1)::int as pos from fr where crash or module in (select 'libapp' || s_suppkey || '.so' from supplier)
""")
def library_frames(spark: S, d: str) -> DataFrame:
    libs = _t(spark, d, "supplier").select(text("libapp", F.col("s_suppkey"), ".so").alias("module"))
    return stacks.filter_library_frames(_frames(spark, d), libs).select("log_id", "thread", "function", "pos")


@query(f"""
    with {_FRAMES}, l as (select *, case when pos = 0 then 'crash_frame' when module = 'libart.so' then 'runtime' when module = 'libc.so' then 'system' else 'app' end as layer from fr where thread = 1)
    select log_id, arg_min(layer, pos) filter (where pos > 0 and layer <> 'runtime') as first_non_runtime, arg_min(function, pos) filter (where layer = 'app') as first_app from l group by 1
""")
def frame_layers(spark: S, d: str) -> DataFrame:
    return stacks.layer_summary(_frames(spark, d).where("thread = 1")).select("log_id", F.col("first_non_runtime.layer").alias("first_non_runtime"), F.col("first_app.function").alias("first_app"))


@query(f"""
    with {_FRAMES}, o as (select *, case when module in ('libc.so', 'libart.so') then 'system' when pos % 3 = 1 then 'vendor' when module = 'com.google.x' then 'undetermined' when pos % 3 = 2 then 'application' else 'undetermined' end as owner from fr where thread = 1),
    g as (select log_id, arg_min(owner, pos) as crash_owner, bool_or(owner = 'application' and pos > 0) as app from o group by 1)
    select log_id, crash_owner, case crash_owner when 'system' then 0.95 when 'vendor' then 0.8 when 'application' then 0.8 else 0.0 end::double as confidence, case when app then 'application' else crash_owner end as verdict from g
""")
def responsibility(spark: S, d: str) -> DataFrame:
    path = F.when(F.col("pos") % 3 == 1, "/vendor/lib64/x").when((F.col("pos") % 3 == 2) & (F.col("module") != "com.google.x"), "/data/app/y/").otherwise("/elsewhere")
    rows = stacks.attribute_responsibility(_frames(spark, d).where("thread = 1").withColumn("path", path).withColumn("platform", F.lit("android")), ["libc.so", "libart.so"])
    return rows.select("log_id", "crash_owner", "confidence", "verdict")


_WAITS = ["pthread_mutex_lock", "epoll_wait", "Monitor::Wait", "work", "nanosleep"]


@query(f"""
    with {_LINES}, f as (select distinct l_orderkey as log_id, {sql_pick('l_partkey', _WAITS)} as function from li)
    select log_id, function, reason from f join (values ('pthread_mutex_lock', 'mutex wait'), ('pthread_mutex_lock', 'blocking I/O'), ('epoll_wait', 'I/O multiplexing wait'), ('nanosleep', 'explicit sleep')) w(name, reason) on name = function
""")
def blocking_frames(spark: S, d: str) -> DataFrame:
    return stacks.blocking_indicators(_lines(spark, d).select(F.col("l_orderkey").alias("log_id"), pick(F.col("l_partkey"), _WAITS).alias("function")))


def _samples(spark: S, d: str) -> DataFrame:
    name = pick(F.col("l_partkey"), _WAITS)
    stack = F.transform(F.array_sort(F.collect_list(F.struct("pos", name.alias("f")))), lambda x: x["f"])
    return _lines(spark, d).groupBy(F.expr("l_orderkey % 200").alias("log_id"), F.col("l_orderkey").alias("sample_id")).agg(stack.alias("frames"))


@query(f"""
    with {_LINES}, f as (select l_orderkey % 200 as log_id, {sql_pick('l_partkey', _WAITS)} as f, min({{'s': l_orderkey, 'p': pos}}) as first_at from li group by all)
    select log_id, string_agg(f, ' ' order by first_at) as locks from f where f in ('pthread_mutex_lock', 'Monitor::Wait') group by 1
""")
def lock_waits(spark: S, d: str) -> DataFrame:
    return stacks.lock_frames(_samples(spark, d)).select("log_id", F.array_join("locks", " ").alias("locks"))


@query(f"""
    with {_LINES}, f as (select l_orderkey % 200 as log_id, l_orderkey as s, pos, {sql_pick('l_partkey', _WAITS)} as f from li), b as (select * from f where pos < 15 and f <> 'pthread_mutex_lock'),
    c as (select log_id, s, list(f order by pos) as chain from b group by all), p as (select log_id, chain[-1] as parent, count(*) as n from c group by all),
    k as (select *, row_number() over (partition by log_id order by n desc, parent) as k from p), m as (select log_id, arg_max(chain, {{'n': len(chain), 's': -s}}) as longest from c group by 1)
    select log_id, parent, n, len(longest)::int as depth, longest[1] as outermost from k join m using (log_id) where k = 1
""")
def deep_parents(spark: S, d: str) -> DataFrame:
    return stacks.parent_nodes(_samples(spark, d)).select("log_id", "parent", "n", F.size("longest_chain").alias("depth"), F.get("longest_chain", F.lit(0)).alias("outermost"))


@query("""
    select l_orderkey as log_id, l_suppkey % 6 as thread, count(*) as frames, count(*) filter (where l_partkey % 4 = 0) as addr2line, count(*) filter (where l_partkey % 4 = 1) as log_symbol, count(*) filter (where l_partkey % 4 = 2) as offset_estimate, count(*) filter (where l_partkey % 4 = 3) as unresolved from lineitem group by all
""")
def resolutions(spark: S, d: str) -> DataFrame:
    k = F.col("l_partkey") % 4
    rows = _lines(spark, d).select(F.col("l_orderkey").alias("log_id"), (F.col("l_suppkey") % 6).alias("thread"), F.when(k == 0, "r").alias("resolved_function"), F.when(k < 2, "f").otherwise("").alias("function"), F.when(k < 3, "s").alias("symbol"))
    return joins.resolution_stats(rows)


@query(f"""
    with {_FRAMES} select log_id, thread, pos::int as pos, case when pos % 2 = 0 then 'real_' || function else function end as function, case when pos % 2 = 0 then 'f.cpp' end as file from fr
""")
def merged_views(spark: S, d: str) -> DataFrame:
    frames = _frames(spark, d)
    resolved = frames.where("pos % 2 = 0").select("log_id", "thread", "pos", text("real_", F.col("function")).alias("function"), F.lit("f.cpp").alias("file"), F.lit(3).alias("line"))
    return joins.merge_views(frames, resolved).select("log_id", "thread", "pos", "function", "file")


@query(f"""
    with {_FRAMES} select log_id, thread, pos::int as pos, d::int as inline_depth, case when pos % 2 = 0 then 'in' || d else function end as function from fr, generate_series(0, 1) g(d) where pos % 2 = 0 or d = 0
""")
def inlined_frames(spark: S, d: str) -> DataFrame:
    rows = _frames(spark, d).withColumn("inline_frames", F.when(F.col("pos") % 2 == 0, F.array(F.lit("in0"), F.lit("in1"))))
    return joins.expand_inlines(rows).select("log_id", "thread", "pos", "inline_depth", "function")


@query("""
    select o_orderkey as log_id, case when o_orderstatus = 'F' and o_custkey % 2 = 1 then 'mapped' when o_orderstatus = 'F' then 'fault' when o_orderstatus = 'O' then 'abort' end as meaning from orders
""")
def signal_meanings(spark: S, d: str) -> DataFrame:
    dim = spark.createDataFrame([("F", "", "fault"), ("F", "1", "mapped"), ("O", "", "abort")], "signal string, sub_code string, meaning string")
    rows = _t(spark, d, "orders").select(F.col("o_orderkey").alias("log_id"), F.col("o_orderstatus").alias("signal"), (F.col("o_custkey") % 2).cast("string").alias("sub_code"))
    return joins.signal_semantics(rows, dim).select("log_id", "meaning")


@query(f"""
    with {_FRAMES}, t as (select * from fr where crash and pos = 0)
    select o_orderkey as log_id, coalesce(case when o_custkey % 2 = 0 then o_orderpriority end, o_orderstatus) as error_type, t.function as location, t.thread from orders left join t on log_id = o_orderkey
""")
def crash_summaries(spark: S, d: str) -> DataFrame:
    events = _t(spark, d, "orders").select(F.col("o_orderkey").alias("log_id"), F.when(F.col("o_custkey") % 2 == 0, F.col("o_orderpriority")).alias("exception_type"), F.col("o_orderstatus").alias("signal"))
    return joins.crash_summary(events, _frames(spark, d)).select("log_id", "error_type", "location", "thread")


# --- verdicts ----------------------------------------------------------------------------------------------------------------


@query("""
    select p_partkey as log_id, case when p_partkey = 0 then 'null' when p_partkey < 40 then 'null_offset' when p_partkey < 600 then 'low' when p_partkey % 3 = 0 then 'uaf_fill' when p_partkey % 3 = 1 then 'debug_poison' else 'normal' end as pattern from part
""")
def address_patterns(spark: S, d: str) -> DataFrame:
    k = F.col("p_partkey")
    va = F.when(k == 0, "0").when(k < 40, k * 100).when(k < 600, 0x1000 + k * 10).when(k % 3 == 0, F.lit("7740398493674204011")).when(k % 3 == 1, F.lit(str(0xDEADBEEF))).otherwise(0x1234500000 + k)
    return _t(spark, d, "part").select(k.alias("log_id"), rules.address_pattern(va.cast("decimal(20,0)")).alias("pattern"))


@query("""
    select c_custkey as log_id, case when c_custkey % 4 = 3 then '' when c_nationkey = 0 then 'x0 x9' else 'x9' end as null_registers, case when c_custkey % 4 = 3 then null when c_custkey % 4 = 0 then case when c_nationkey = 0 then 'x0' else 'x9' end when c_nationkey = 0 then null else 'x0' end as source_register from customer
""")
def register_sources(spark: S, d: str) -> DataFrame:
    dec = lambda c: c.cast("decimal(20,0)")
    c = _t(spark, d, "customer")
    n = F.col("c_nationkey")
    fault = F.when(F.col("c_custkey") % 4 == 0, 0).when(F.col("c_custkey") % 4 == 3, None).when(n == 0, 7).otherwise(n * 8 + (F.lit(1 << 52) * (F.col("c_custkey") % 2)))
    events = c.select(F.col("c_custkey").alias("log_id"), dec(fault).alias("fault"))
    regs = c.select(F.col("c_custkey").alias("log_id"), F.explode(F.array(F.struct(F.lit("x0").alias("reg"), dec(n * 8).alias("va")), F.struct(F.lit("x9").alias("reg"), dec(F.lit(0)).alias("va")), F.struct(F.lit("x7").alias("reg"), dec(F.lit(3)).alias("va")))).alias("r")).select("log_id", "r.*")
    rows = rules.register_correlation(events, regs)
    return rows.select("log_id", F.array_join("null_registers", " ").alias("null_registers"), "source_register")


_CLASS = [
    ("signal = 'SIGABRT'", dict(signal="SIGABRT"), "explicit_abort", 0.85, ""),
    ("", dict(fault_pattern="null_deref", sp_aligned=False, fp_in_stack=False), "null_pointer_dereference", 0.98, "stack_corruption stack_corruption"),
    ("", dict(fill_registers=3, pc_in_code=False), "use_after_free", 0.9, "code_corruption"),
    ("", dict(fill_registers=1, stack_overflow_risk="high"), "stack_overflow", 0.85, "use_after_free"),
    ("", dict(heap_abort=True, signal="SIGABRT"), "heap_corruption", 0.97, ""),
    ("", dict(pc_in_code=False, pc_in_jit=True, fault_pattern="unmapped_access"), "jit_failure", 0.7, "wild_pointer"),
    ("", {}, "unknown", 0.0, ""),
]


@query(f"select p_partkey as log_id, {sql_pick('p_partkey', [c[2] for c in _CLASS])} as crash_class, {sql_pick('p_partkey', [str(c[3]) for c in _CLASS])}::double as confidence, {sql_pick('p_partkey', [c[4] for c in _CLASS])} as secondary from part")
def crash_classes(spark: S, d: str) -> DataFrame:
    kinds = {"stack_overflow_risk": "string", "sp_aligned": "boolean", "fp_in_stack": "boolean", "fp_above_sp": "boolean", "fill_registers": "int", "pc_in_code": "boolean", "pc_in_jit": "boolean", "fault_pattern": "string", "heap_abort": "boolean", "signal": "string", "reason": "string"}
    value = lambda n: pick(F.col("p_partkey"), [None if n not in c[1] else str(c[1][n]) for c in _CLASS]).cast(kinds[n]).alias(n)
    rows = rules.classify_crash(_t(spark, d, "part").select(F.col("p_partkey").alias("log_id"), *map(value, kinds)))
    return rows.select("log_id", "crash_class", "confidence", F.array_join("secondary", " ").alias("secondary"))


@query("""
    with g as (select *, case when p_size % 7 = 0 then 1 when p_size % 2 = 0 and p_size % 3 = 0 then 2 when p_size % 3 = 0 and (p_size % 5 = 0 or p_partkey % 4 > 0) then 3 when p_size % 3 = 0 or p_partkey % 5 > 0 then 4 else 5 end as tier from part)
    select p_partkey as log_id, tier, case tier when 1 then 'confirmed' when 2 then 'strong' when 3 then 'moderate' when 4 then 'weak' else 'insufficient' end as tier_label from g
""")
def evidence_tiers(spark: S, d: str) -> DataFrame:
    s, k = F.col("p_size"), F.col("p_partkey")
    rows = _t(spark, d, "part").select(k.alias("log_id"), (s % 7 == 0).alias("has_detector"), (s % 2 == 0).alias("has_source"), (s % 3 == 0).alias("has_symbols"), (s % 5 == 0).alias("has_registers"), (k % 4).alias("rule_hits"), (k % 5).alias("vector_hits"))
    return rules.grade_evidence(rows).select("log_id", "tier", "tier_label")


@query("""
    with r as (select l_partkey as k, count(*) as rules, count(distinct l_returnflag) as patterns from lineitem where l_linenumber = 1 group by 1), h as (select distinct l_partkey as k from lineitem where l_linenumber = 2),
    f as (select p_partkey as k, p_size % 13 = 0 as detector, p_size % 2 = 0 as segv, p_size % 3 = 0 as regs, p_partkey < 256 as low, p_size % 5 = 0 as conc, p_size % 7 = 0 as mem, coalesce(rules, 0) as rules, coalesce(rules >= 2 and patterns = 1, false) as agree, h.k is not null as hit from part left join r on r.k = p_partkey left join h on h.k = p_partkey),
    g as (select *, segv::int + regs::int + low::int as n2, agree::int + conc::int + mem::int as n3 from f),
    t as (select *, case when detector then 1 when n2 >= 2 then 2 when n3 >= 2 then 3 when rules > 0 or hit then 4 else 5 end as tier from g)
    select k as log_id, tier, case when tier <= 2 then 'high' when tier = 3 then 'medium' else 'low' end as confidence_label,
      case when tier = 1 then 'ASan' else concat_ws(' ', case when segv then 'signal' end, case when regs then 'registers' end, case when low then 'near_null' end, case when tier > 2 and agree then 'rules_agree' end, case when tier > 2 and conc then 'concurrency_symbols' end, case when tier > 2 and mem then 'memory_symbols' end, case when tier = 4 then 'single_feature' end) end as evidence from t
""")
def raw_evidence_tiers(spark: S, d: str) -> DataFrame:
    s, k, li = F.col("p_size"), F.col("p_partkey"), _t(spark, d, "lineitem")
    functions = text(F.when(s % 5 == 0, "pthread_mutex_lock ").otherwise("draw "), F.when(s % 7 == 0, "malloc free").otherwise("paint"))
    content = text(F.repeat(F.lit("prose "), 100), F.when(s % 3 == 0, "\nRegisters: none").otherwise(""))
    rows = _t(spark, d, "part").select(k.alias("log_id"), content.alias("content"), F.when(s % 2 == 0, "SIGSEGV (11)").otherwise("SIGABRT").alias("signal"), F.when(k % 2 == 0, text("0x", F.lower(F.hex(k * 16)))).otherwise((k * 16).cast("string")).alias("crash_address"), F.when(s % 13 == 0, "found by hwasan").otherwise("none").alias("crash_reason"), functions.alias("stack_functions"))
    hits = lambda n, *more: li.where(F.col("l_linenumber") == n).select(F.col("l_partkey").alias("log_id"), *more)
    found = rules.grade_raw_evidence(rows, hits(1, F.col("l_returnflag").alias("pattern")), hits(2))
    return found.select("log_id", "tier", "confidence_label", F.array_join("evidence", " ").alias("evidence"))


@query(r"""
    with l as (select doc_id as file, unnest(string_split_regex(text, '\r?\n')) as t, unnest(range(1, len(string_split_regex(text, '\r?\n')) + 1)) as line from documents where text is not null),
    p(pattern_id, pattern) as (values ('secret', 'token\s*=\s*"[0-9a-f]+"'), ('pair', '(the|and) that\b.*\bthat the'), ('start', '^Th[ae]'), ('license', 'License|licence'), ('rare', 'zz9')),
    h as (select pattern_id, file, line, t, row_number() over (partition by pattern_id order by file, line) as r from l join p on regexp_matches(t, pattern))
    select pattern_id, file, line::int as line, t as text, max(r) over (partition by pattern_id) >= 50 as truncated from h where r <= 50
""")
def source_search(spark: S, d: str) -> DataFrame:
    files = _t(spark, d, "documents").select(F.col("doc_id").alias("file"), "text")
    patterns = {"secret": r'token\s*=\s*"[0-9a-f]+"', "pair": r"(the|and) that\b.*\bthat the", "start": "^Th[ae]", "license": "License|licence", "rare": "zz9"}
    return search.search_source(files, patterns)


@query("""
    with t as (select user_id as k, event_type as name, floor(value)::bigint * 20 as ms, event_id % 4 = 0 as open from events), d as (select k, 100000 + k % 7 as dump from (select distinct k from t))
    select t.k as log_id, name, max(ms)::double as duration_ms, count(*) as n from t where ms > 3000 group by all
""")
def long_queue_events(spark: S, d: str) -> DataFrame:
    k, ms, dump = F.col("user_id"), (F.col("value").cast("long") * 20), 100_000 + F.col("user_id") % 7
    line = text("task name = ", F.col("event_type"), ", trigger time = ", dump - ms, F.when(F.col("event_id") % 4 == 0, "").otherwise(text(", complete time = ", dump)))
    dumps = _t(spark, d, "events").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("lines"))
    rows = logs.parse_queue_events(dumps.select(k.alias("log_id"), text("curTime: ", dump, "\n", F.col("lines")).alias("content")))
    n = rows.where("duration_ms > 3000").groupBy("log_id", "name").agg(F.count(F.lit(1)).alias("n"))
    return timing.long_queue_events(rows).join(n, ["log_id", "name"]).select("log_id", "name", "duration_ms", "n")


@query("""
    with v as (select vec_id as query_id, 'case' || vec_id as pattern_id, label, vec_id % 3 as k from embeddings), p as (select distinct l_suppkey as query_id from lineitem where l_linenumber = 1)
    select v.query_id, pattern_id from v left join p using (query_id) where p.query_id is null or not (label % 2 = 0 or k = 0)
""")
def related_hits(spark: S, d: str) -> DataFrame:
    e = _t(spark, d, "embeddings")
    hits = e.select(F.col("vec_id").alias("query_id"), text("case", F.col("vec_id")).alias("pattern_id"), F.when(F.col("label") % 2 == 0, "Arithmetic").otherwise("memory").alias("crash_category"), F.when(F.col("vec_id") % 3 == 0, "a SIGFPE b").otherwise("none").alias("crash_signature"))
    packs = _t(spark, d, "lineitem").where("l_linenumber = 1").select(F.col("l_suppkey").alias("query_id"))
    return retrieval.drop_unrelated(hits, packs).select("query_id", "pattern_id")


@query("""
    with m as (select user_id as log_id, event_type as fault_mode, round(max(value) / 1000, 6) as confidence from events group by all), e as (select user_id as log_id, event_type as fault_mode, min(event_id % 4 + 1) as tier from events where event_type <> 'view' group by all)
    select log_id, fault_mode, confidence, coalesce(tier, 5)::bigint as tier, (row_number() over (partition by log_id order by coalesce(tier, 5), confidence desc, fault_mode))::int as rank from m left join e using (log_id, fault_mode)
""")
def mode_conflicts(spark: S, d: str) -> DataFrame:
    ev = _t(spark, d, "events").withColumnRenamed("user_id", "log_id").withColumnRenamed("event_type", "fault_mode")
    modes = ev.groupBy("log_id", "fault_mode").agg(r(F.max("value") / 1000).alias("confidence"))
    evidence = ev.where("fault_mode <> 'view'").select("log_id", "fault_mode", (F.col("event_id") % 4 + 1).alias("tier"))
    return rules.resolve_conflicts(modes, evidence).select("log_id", "fault_mode", "confidence", F.col("tier").cast("long").alias("tier"), "rank")


@query("""
    with c as (select c_custkey as log_id, case when c_nationkey % 2 = 1 then 'symbols' end as a, case when c_custkey % 3 > 0 then 'registers' end as b, c_nationkey / 25.0 as conf from customer),
    x as (select log_id, concat_ws(' ', a, b) as missing, round(least(conf, case when a is not null then 0.6 else 1 end, case when b is not null then 0.8 else 1 end), 6) as confidence from c)
    select *, confidence >= 0.85 as may_repair from x
""")
def confidence_ceilings(spark: S, d: str) -> DataFrame:
    rows = _t(spark, d, "customer").select(F.col("c_custkey").alias("log_id"), (F.col("c_nationkey") % 2 == 0).alias("symbols"), (F.col("c_custkey") % 3 == 0).alias("registers"), (F.col("c_nationkey") / 25.0).alias("confidence"))
    capped = rules.evidence_ceiling(rows, {"symbols": 0.6, "registers": 0.8}).withColumn("status", F.when(F.col("confidence") >= 0.85, "confirmed").otherwise("probable"))
    return rules.repair_gate(capped).select("log_id", F.array_join("missing", " ").alias("missing"), r("confidence").alias("confidence"), "may_repair")


@query("""
    with m as (select user_id as log_id, max(value) / 400 as c, arg_max(event_type, {'v': value, 'e': event_type}) as m from events where value > 60 group by 1)
    select c_custkey as log_id, m as root_cause, case when c >= 0.85 then 'confirmed' when m is not null then 'probable' else 'preliminary' end as status from customer left join m on log_id = c_custkey
""")
def preliminary_status(spark: S, d: str) -> DataFrame:
    modes = _t(spark, d, "events").where("value > 60").select(F.col("user_id").alias("log_id"), F.col("event_type").alias("fault_mode"), (F.col("value") / 400).alias("confidence"))
    every = _t(spark, d, "customer").select(F.col("c_custkey").alias("log_id"))
    return rules.diagnosis_status(modes, every).select("log_id", "root_cause", "status")


@query("""
    with f as (select user_id as log_id, max(value) as top, count(*) as n, bool_or(event_type = 'error') as err from events group by 1),
    m as (select log_id, 'FREEZE-FM-11' as fault_mode, 0.85 as confidence from f where top > 100 union all select log_id, 'FREEZE-FM-06', 0.9 from f where n % 5 = 0 union all select log_id, 'FREEZE-FM-07', 0.7 from f where n > 2 union all select log_id, 'FREEZE-FM-03', case when n % 2 = 0 then 0.85 else 0.78 end from f where err)
    select log_id, fault_mode, confidence::double as confidence from m
""")
def freeze_modes(spark: S, d: str) -> DataFrame:
    f = _t(spark, d, "events").groupBy(F.col("user_id").alias("log_id")).agg(F.max("value").alias("top"), F.count("*").alias("n"), F.bool_or(F.col("event_type") == "error").alias("err"))
    no = F.lit(False)
    signals = f.select("log_id", (F.col("top") > 100).alias("stressed"), (F.col("n") % 5 == 0).alias("has_cycle"), no.alias("binder_cycle"), no.alias("ipc_full"), F.lit(None).cast("string").alias("running_task"), F.when(F.col("n") > 2, 1).otherwise(0).alias("queue_depth"), no.alias("has_locks"), F.when(F.col("err"), "BUSY").alias("verdict"), no.alias("busy"), no.alias("gc"), F.when(F.col("n") % 2 == 0, "f").alias("deep_dominant"))
    return timing.freeze_fault_modes(signals).select("log_id", "fault_mode", "confidence")


@query("""
    with d as (select user_id as log_id, 'M' || event_type as fault_mode, event_type as rule_id, 0.5 + (case event_type when 'error' then 0.4 when 'click' then 0.3 else 0.1 end) as confidence from events group by all)
    select log_id, rule_id, (row_number() over (partition by log_id order by confidence desc, rule_id))::int as rank from d where rule_id <> 'view' qualify rank <= 2
""")
def rule_modes(spark: S, d: str) -> DataFrame:
    hits = _t(spark, d, "events").select(F.col("user_id").alias("log_id"), F.col("event_type").alias("rule_id")).distinct().withColumn("confidence", 0.5 + F.when(F.col("rule_id") == "error", 0.4).when(F.col("rule_id") == "click", 0.3).otherwise(0.1))
    dim = spark.createDataFrame([(t, "note" if t == "view" else "fault_mode", "M" + t) for t in ("click", "view", "error", "signup", "purchase")], "rule_id string, conclusion_type string, fault_mode string")
    return rules.match_fault_modes(hits, dim, 2).select("log_id", "rule_id", "rank")


@query(f"""
    with {_LINES}, m as (select distinct l_orderkey as log_id, l_suppkey % 5 as m from li), x as (select distinct log_id, unnest(case m when 0 then ['media'] when 1 then ['net', 'web'] else []::varchar[] end) as domain from m)
    select log_id, string_agg(domain, ' ' order by domain) as domains from x group by 1
""")
def module_domains(spark: S, d: str) -> DataFrame:
    rows = _lines(spark, d).groupBy(F.col("l_orderkey").alias("log_id")).agg(F.collect_set(text("lib", F.col("l_suppkey") % 5, ".so")).alias("modules"))
    dim = spark.createDataFrame([("media", r"^lib0\."), ("net", r"^lib1\."), ("web", r"lib[1]")], "domain string, pattern string")
    return rules.route_modules(rows, dim).select("log_id", F.array_join("domains", " ").alias("domains"))


@query("select doc_id as log_id, 'lang' as domain, f as feature from (select doc_id, unnest([case when regexp_matches(text, '\\bthe\\b') then 'english' end, case when regexp_matches(text, '\\bder\\b') then 'german' end]) as f from documents) where f is not null")
def content_features(spark: S, d: str) -> DataFrame:
    dim = spark.createDataFrame([("lang", "english", r"\bthe\b"), ("lang", "german", r"\bder\b")], "domain string, feature string, pattern string")
    return diagnosis.detect_features(_t(spark, d, "documents").select(F.col("doc_id").alias("log_id"), F.col("text").alias("content")), dim)


_VERIFIED = [None, "passed", "issue_verified", "failed", "unavailable", "pending", "verified"]


@query(f"""
    with r as (select o_orderkey as run_id, o_custkey % 3 > 0 as patch, {sql_pick('o_orderkey', _VERIFIED)} as v, o_orderstatus as s, o_custkey % 11 = 5 as skipped, o_custkey % 13 = 4 as regressed, o_custkey % 7 = 2 as exact from orders),
    k as (select *, patch and coalesce(v, '') in ('', 'unavailable') as idle from r)
    select run_id, case when not patch and v is null and not skipped and s <> 'P' then 'accept' when skipped then 'partial' when v = 'pending' then 'pending' when s = 'P' or not patch or regressed or (idle and not exact) or v = 'failed' or (not idle and v = 'unavailable') then 'reject' when v = 'issue_verified' then 'partial' else 'accept' end as decision from k
""")
def run_decisions(spark: S, d: str) -> DataFrame:
    k, patch = F.col("o_custkey"), F.col("o_custkey") % 3 > 0
    runs = _t(spark, d, "orders").select(F.col("o_orderkey").alias("run_id"), F.when(F.col("o_orderstatus") == "P", "failed").otherwise("done").alias("run_status"), (k % 11 == 5).alias("pipeline_skipped"), patch.alias("has_patch"), patch.alias("patch_success"), F.lit(1).alias("applied_count"), F.lit(False).alias("schema_violation"), (k % 7 == 2).alias("exact_only"), F.lit("passed").alias("diff_status"), pick(F.col("o_orderkey"), _VERIFIED).alias("verification"), (k % 13 == 4).alias("regression"), F.lit("").alias("post_fix_status"))
    return evaluation.score_decisions(runs).select("run_id", "decision")


@query("""
    select o_orderkey as run_id, concat_ws(' ', case when o_custkey % 3 = 0 then 'patch_gate' end, case when o_custkey % 7 = 0 then 'safety_gate' end) as failed, case when o_custkey % 3 = 0 or o_custkey % 7 = 0 then 'reject' when o_custkey % 5 = 0 then 'pending' else 'accept' end as verdict from orders
""")
def run_judgements(spark: S, d: str) -> DataFrame:
    k, yes = F.col("o_custkey"), F.lit(True)
    runs = _t(spark, d, "orders").select(F.col("o_orderkey").alias("run_id"), yes.alias("evidence_gate"), (k % 3 != 0).alias("patch_gate"), F.when(k % 5 != 0, yes).alias("build_gate"), yes.alias("verification_gate"), (k % 7 != 0).alias("safety_gate"))
    return evaluation.judge_runs(runs).select("run_id", F.array_join("failed_gates", " ").alias("failed"), "verdict")


@query("""
    select l_orderkey as run_id, string_agg(distinct l_suppkey::varchar, ' ' order by l_suppkey::varchar) filter (where l_suppkey % 3 > 0) as unauthorised from lineitem group by 1
""")
def foreign_changes(spark: S, d: str) -> DataFrame:
    s = F.col("l_suppkey").cast("string")
    runs = _t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("run_id")).agg(F.array_sort(F.collect_set(s)).alias("changed_files"), F.collect_set(F.when(F.col("l_suppkey") % 3 == 0, s)).alias("allowed_files"))
    return evaluation.unauthorised_files(runs).select("run_id", F.nullif(F.array_join("unauthorised", " "), F.lit("")).alias("unauthorised"))


@query("select c_custkey as sub_id, concat_ws(' ', case when c_custkey % 2 = 1 then 'plan' end, 'tests') as missing from customer")
def missing_fields(spark: S, d: str) -> DataFrame:
    fields = F.map_from_arrays(F.when(F.col("c_custkey") % 2 == 0, F.array(F.lit("plan"), F.lit("x"))).otherwise(F.array(F.lit("x"), F.lit("y"))), F.array(F.lit(1), F.lit(2)))
    rows = evaluation.validate_submissions(_t(spark, d, "customer").select(F.col("c_custkey").alias("sub_id"), fields.alias("fields")), ["plan", "tests"])
    return rows.select("sub_id", F.array_join("missing_fields", " ").alias("missing"))


# --- knowledge ---------------------------------------------------------------------------------------------------------------


@query("""
    with q as (select doc_id as query_id, lower(text) as t from documents where text is not null),
    s as (select query_id, 'a' as pack_id, 4 * contains(t, 'lib')::int + 5 * contains(t, 'ion')::int as score from q union all select query_id, 'b', 3 * contains(t, 'con')::int + 2 * contains(t, 'que')::int from q)
    select query_id, arg_max(pack_id, {'s': score, 'p': case pack_id when 'a' then 1 else 0 end}) as pack_id, max(score)::bigint as score from s where score > 0 group by 1
""")
def pack_routes(spark: S, d: str) -> DataFrame:
    hints = spark.createDataFrame([("a", "so_names", "LIB*"), ("a", "stack_hints", "ion"), ("b", "package_prefixes", "con"), ("b", "path_hints", "que"), ("b", "other", "e")], "pack_id string, kind string, hint string")
    rows = retrieval.route_packs(_t(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("query_id"), "text"), hints)
    return rows.select("query_id", "pack_id", F.col("score").cast("long").alias("score"))


@query("""
    with d as (select user_id as query_id, event_id as doc_id, round(value, 4) as score, (event_id % 1500)::bigint as length from events), k as (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from d),
    u as (select *, sum(length) over (partition by query_id order by rank) as running from k where rank <= 4)
    select query_id, doc_id, rank::int as rank, running::bigint as running from u where running <= 3000
""")
def selected_docs(spark: S, d: str) -> DataFrame:
    hits = _t(spark, d, "events").select(F.col("user_id").alias("query_id"), F.col("event_id").alias("doc_id"), r("value", 4).alias("score"), (F.col("event_id") % 1500).alias("length"))
    return retrieval.select_docs(hits, 4, 3000).select("query_id", "doc_id", "rank", "running")


@query("""
    with p as (select doc_id, text, case when position('th' in lower(text)) > 0 then position('th' in lower(text)) end as a, case when position('ein' in lower(text)) > 0 then position('ein' in lower(text)) end as b from documents where text is not null)
    select doc_id, substring(text, greatest(1, coalesce(least(a, b), 1) - 180)::int, 600) as excerpt from p
""")
def text_excerpts(spark: S, d: str) -> DataFrame:
    return _t(spark, d, "documents").where("text is not null").select("doc_id", retrieval.excerpt(F.col("text"), F.array(F.lit("th"), F.lit("ein"))).alias("excerpt"))


@query("""
    with e as (select user_id as log_id, event_type, floor(value) as v, max(value) as relevance from events group by all), k as (select *, row_number() over (partition by log_id order by relevance desc, event_type, v) as rank from e)
    select log_id, event_type, v::bigint as v, round(relevance, 4) as relevance from k where rank <= 3
""")
def evidence_once(spark: S, d: str) -> DataFrame:
    rows = _t(spark, d, "events").select(F.col("user_id").alias("log_id"), "event_type", F.floor("value").cast("long").alias("v"), F.col("value").alias("relevance"), F.lit(0.5).alias("confidence"))
    return retrieval.dedup_evidence(rows, ["event_type", "v"], 3).select("log_id", "event_type", "v", r("relevance", 4).alias("relevance"))


@query("""
    with h as (select distinct o_custkey as log_id, o_orderpriority as pattern_id from orders) select distinct log_id, s.strategy_id from h join (values ('retry', '1-URGENT'), ('retry', '2-HIGH'), ('wait', '5-LOW')) s(strategy_id, p) on p = pattern_id
""")
def strategy_hits(spark: S, d: str) -> DataFrame:
    dim = spark.createDataFrame([("retry", ["1-URGENT", "2-HIGH"]), ("wait", ["5-LOW"])], "strategy_id string, applicable_pattern_ids array<string>")
    return retrieval.attach_strategies(_t(spark, d, "orders").select(F.col("o_custkey").alias("log_id"), F.col("o_orderpriority").alias("pattern_id")), dim)


@query("""
    with h as (select o_custkey as log_id, o_orderstatus as rule_id, o_orderpriority as pattern_id from orders),
    b as (select distinct log_id, 'base' as block_id, 0 as tier, 5 as priority from h union all select distinct log_id, 'rule', 1, 2 from h where rule_id = 'F' union all select distinct log_id, 'pat', 2, 1 from h where pattern_id = '5-LOW')
    select log_id, block_id, (row_number() over (partition by log_id order by tier, priority, block_id))::int as position from b
""")
def guidance_blocks(spark: S, d: str) -> DataFrame:
    blocks = spark.createDataFrame([("base", None, None, 5, "t"), ("rule", "F", None, 2, "t"), ("pat", None, "5-LOW", 1, "t")], "block_id string, rule_id string, pattern_id string, priority int, type string")
    hits = _t(spark, d, "orders").select(F.col("o_custkey").alias("log_id"), F.col("o_orderstatus").alias("rule_id"), F.col("o_orderpriority").alias("pattern_id"))
    return retrieval.guidance_for(hits, blocks).select("log_id", "block_id", "position")


@query("select 'orders' as table_name, count(*) as rows from orders union all select 'events', count(*) from events union all select 'documents', count(*) from documents")
def knowledge_stats(spark: S, d: str) -> DataFrame:
    return retrieval.store_stats({t: _t(spark, d, t) for t in ("orders", "events", "documents")})


@query("""
    with c as (select month(ts) as m, event_type as name, event_type as type, value as size from events), s as (select count(distinct m) as n, min(m) as lo, max(m) as hi from c),
    a as (select name, count(distinct m) as occurrence_count, max(size) filter (where m = (select lo from s)) as f, max(size) filter (where m = (select hi from s)) as l from c group by 1)
    select name, occurrence_count, case when coalesce(l, 0) > coalesce(f, 0) * 1.2 then 'growing' when coalesce(l, 0) < coalesce(f, 0) * 0.8 then 'shrinking' else 'stable' end as growth_trend from a
""")
def heap_trends(spark: S, d: str) -> DataFrame:
    rows = _t(spark, d, "events").select(F.month("ts").alias("snapshot_no"), F.col("event_type").alias("name"), F.col("event_type").alias("type"), F.col("value").alias("retained_size"))
    return graphs.heap_series(rows).select("name", "occurrence_count", "growth_trend")


@query("""
    with s as (select distinct p_brand as file, 'sym' || p_size as name from part), w as (select name from s group by 1 having count(distinct file) <= 20), rf as (select p_type as file, 'sym' || (p_partkey % 50 + 1) as token from part),
    e as (select rf.file as src, s.file as dst, count(*) as weight from rf join s on token = s.name where s.name in (select name from w) and rf.file <> s.file group by all)
    select src, dst, weight from e qualify row_number() over (partition by src order by weight desc, dst) <= 3
""")
def source_edges(spark: S, d: str) -> DataFrame:
    p = _t(spark, d, "part")
    refs = p.select(F.col("p_type").alias("file"), text("sym", F.col("p_partkey") % 50 + 1).alias("token"))
    return graphs.build_source_edges(refs, p.select(F.col("p_brand").alias("file"), text("sym", F.col("p_size")).alias("name")), 20, 3)


@query("select 'node' as kind, count(distinct sha256(n_name)) as n from nation union all select 'edge', count(*) from (select distinct n_name, r_name from nation join region on n_regionkey = r_regionkey)")
def evidence_edges(spark: S, d: str) -> DataFrame:
    nation, region = _t(spark, d, "nation"), _t(spark, d, "region")
    items = nation.select(F.lit("n").alias("kind"), F.col("n_name").alias("content")).unionByName(region.select(F.lit("r").alias("kind"), F.col("r_name").alias("content")))
    links = nation.join(region, F.expr("n_regionkey = r_regionkey")).select(F.col("n_name").alias("src_content"), F.lit("in").alias("label"), F.col("r_name").alias("dst_content"))
    nodes, edges = graphs.evidence_graph(items, links)
    return nodes.where("kind = 'n'").agg(F.count("*").alias("n")).select(F.lit("node").alias("kind"), "n").unionByName(edges.agg(F.count("*").alias("n")).select(F.lit("edge").alias("kind"), "n"))


@query("select event_id, case when event_id % 7 = 0 then event_id::double else round((epoch_us(ts) - epoch_us(first_value(ts) over (partition by user_id order by ts, event_id))) / 1e6, 3) end as seconds from events")
def elapsed(spark: S, d: str) -> DataFrame:
    rows = _t(spark, d, "events").withColumn("running", F.when(F.col("event_id") % 7 == 0, F.col("event_id")))
    return leak.elapsed_seconds(rows, ["user_id"], ["ts", "event_id"], "running", "ts").select("event_id", F.round("elapsed_s", 3).alias("seconds"))


@query("""
    with m as (select user_id, coalesce(arg_max({'e': event_id, 'v': value}, event_id) filter (where event_type = 'error'), arg_max({'e': event_id, 'v': value}, event_id)) as m from events group by 1),
    k as (select user_id, 'pss' as kind, m.v as growth from m union all select user_id, 'gpu', (m.e % 60)::double from m union all select user_id, 'ion', (m.e % 50 - 25)::double from m),
    s as (select *, growth / sum(growth) over (partition by user_id) as share, row_number() over (partition by user_id order by growth desc, kind) as rank from k where growth > 0)
    select user_id, kind, round(share, 6) as share, rank::int as rank from s where share >= 0.2 or rank = 1
""")
def trigger_shares(spark: S, d: str) -> DataFrame:
    k = F.col("event_id")
    rows = _t(spark, d, "events").select("user_id", k, (F.col("event_type") == "error").alias("is_trigger"), F.col("value").alias("pss"), (k % 60).alias("gpu"), (k % 50 - 25).alias("ion"))
    return leak.leak_types_at_trigger(rows, ["user_id"], "event_id", "is_trigger", ["pss", "gpu", "ion"]).select("user_id", "kind", r("share").alias("share"), "rank")


@query("""
    select c_custkey as log_id, ['native_heap_leak', 'dma_buffer_leak', 'gpu_memory_leak', 'unknown_leak'][c_custkey % 4 + 1] as fault_mode, case when c_acctbal > 0 and c_nationkey % 2 = 0 then 'high' when c_acctbal > 0 or c_nationkey % 2 = 0 then 'medium' else 'low' end as confidence from customer
""")
def leak_modes(spark: S, d: str) -> DataFrame:
    rows = _t(spark, d, "customer").select(F.col("c_custkey").alias("log_id"), pick(F.col("c_custkey"), ["pss", "dma", "gpu", "x"]).alias("kind"), F.lit(0.5).alias("share"), F.col("c_acctbal").alias("growth"), (F.col("c_nationkey") % 2 == 0).alias("has_trace"))
    return leak.leak_fault_modes(rows).select("log_id", "fault_mode", "confidence")


_MODULES = ["libace.z.so", "libwebview.so", "libPthread.so", "libscudo.so", "libsqlite3.so", "app.so", "libssl.so", "libcurl.so", "libmediacodec.so", "libskia.so", "hermes.so", ""]
_DOMAINS = ["ui_framework", "webview", "concurrency", "memory_allocator", "database", None, "crypto_security", "networking", "media", "graphics", "js_runtime", None]


@query(f"""
    with {_LINES}, m as (select distinct l_orderkey as log_id, l_suppkey % 12 as k from li), x as (select log_id, {sql_pick('k', _MODULES)} as module, {sql_pick('k', _DOMAINS)} as domain from m),
    c as (select *, case domain when 'concurrency' then 'concurrency' when 'ui_framework' then 'logic' when 'webview' then 'logic' when 'database' then 'logic' when 'networking' then 'logic' else case when domain is not null then 'memory' end end as category from x)
    select log_id, coalesce(string_agg(distinct domain, ' ' order by domain), '') as domains, coalesce(string_agg(distinct category, ' ' order by category), '') as categories, count(distinct domain) * 3 - (count(distinct domain) filter (domain in ('ui_framework', 'webview')) = 2)::int - greatest((count(distinct domain) filter (domain in ('crypto_security', 'networking', 'media'))) - 1, 0) - (count(distinct domain) filter (domain in ('concurrency', 'media')) = 2)::int as tags,
      coalesce(string_agg(case when domain is not null then module || '=' || domain end, ' ' order by module), '') as matched from c group by 1
""")
def knowledge_routes(spark: S, d: str) -> DataFrame:
    rows = _lines(spark, d).groupBy(F.col("l_orderkey").alias("log_id")).agg(F.collect_list(pick(F.col("l_suppkey"), _MODULES)).alias("modules"))
    got = knowledge.route_knowledge(rows)
    matched = F.array_join(F.array_sort(F.transform(F.map_entries("matched"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), " ")
    return got.select("log_id", F.array_join("domains", " ").alias("domains"), F.array_join("categories", " ").alias("categories"), F.size("tags").cast("long").alias("tags"), matched.alias("matched"))


_SHELF = [("lang", "english", 0, "common.yaml"), ("lang", "english", 1, "en.yaml"), ("lang", "german", 0, "de.yaml"), ("lang", "german", 1, "common.yaml")]


@query("""
    with f as (select doc_id as log_id, regexp_matches(text, '\\bthe\\b') as en, regexp_matches(text, '\\bder\\b') as de from documents),
    x as (select log_id, unnest(case when en and de then ['common.yaml', 'en.yaml', 'de.yaml'] when en then ['common.yaml', 'en.yaml'] when de then ['de.yaml', 'common.yaml'] else []::varchar[] end) as file, unnest(case when en and de then [1, 2, 3] when en or de then [1, 2] else []::int[] end) as file_rank from f)
    select log_id, file_rank, file, n_name as mode_id from x join nation on n_regionkey = case file when 'common.yaml' then 0 when 'en.yaml' then 1 else 2 end
""")
def knowledge_selected(spark: S, d: str) -> DataFrame:
    shelf = spark.createDataFrame(_SHELF, "domain string, feature string, pos int, file string")
    modes = _t(spark, d, "nation").where("n_regionkey < 3").select(pick(F.col("n_regionkey"), ["common.yaml", "en.yaml", "de.yaml"]).alias("file"), F.col("n_name").alias("mode_id"), F.col("n_nationkey").alias("ord"))
    return knowledge.select_knowledge(content_features(spark, d), shelf, modes).select("log_id", "file_rank", "file", "mode_id")


def _case_runs(spark: S, d: str) -> DataFrame:
    """A run for each order: its lines are the frames, its customer's number decides what was verified and fixed."""
    name = lambda c, n: F.when(F.col("l_linenumber") % 2 == n, text("fn", F.col(c))).alias
    frame = F.struct(name("l_partkey", 0)("function"), name("l_partkey", 1)("resolved_function"), text("lib", F.col("l_suppkey"), ".so").alias("module"))
    frames = _lines(spark, d).groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", frame.alias("f")))), lambda x: x["f"]).alias("frames"))
    k, none = F.col("o_custkey"), F.lit(None).cast("string")
    fix = lambda file, done: F.struct(file.alias("file"), done.alias("status"))
    return _t(spark, d, "orders").join(frames, F.expr("o_orderkey = l_orderkey"), "left").select(
        F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("ts"), (k % 7 != 0).alias("fixed"), text("sig", k % 500).alias("signature"), F.when(k % 3 == 0, text("crash of ", k)).otherwise("").alias("summary"), F.when(k % 4 == 0, "AI分析失败: none").when(k % 4 == 1, text("  first ", k, "\nsecond")).alias("analysis"), text("q", k).alias("query_text"),
        F.when(F.col("o_orderstatus") == "F", "11 (SIGSEGV)").alias("signal"), F.when(F.col("o_orderstatus") == "O", "Deadlock found").alias("crash_reason"), F.lit("android").alias("os_type"), none.alias("platform"), (k % 2 == 0).alias("has_code"), F.lit(True).alias("has_log"),
        F.array(fix(text("b", k % 2, ".c"), F.lit("applied")), fix(F.lit("a.c"), F.when(k % 5 == 0, "failed").otherwise("applied"))).alias("fixes"), "frames", text("cause ", k).alias("root_cause"), F.when(k % 3 == 1, 0.9).alias("confidence"),
        pick(k, ["passed", "compile_verified", "PASSED ", "native_verified", "failed"]).alias("status"), pick(k, ["", "L2", None, "L3", "L4", "L1"]).alias("level"), pick(k, ["p", None]).alias("provenance"), none.alias("command"), none.alias("checks"), F.lit("plan").alias("plan_fingerprint"), pick(k, ["x", "x", "x", ""]).alias("changed_files"), (k % 2 == 0).alias("applied"), pick(k, [None, "passed", "passed", "rejected", "failed"]).alias("diff_status"), pick(k, ["", "L3", None]).alias("claim_level"), none.alias("session_level"))


_RUNS = f"""{_LINES}, r as (select o_orderkey as run_id, o_custkey as k, o_orderdate as ts, o_orderstatus as s, lower(trim({sql_pick('o_custkey', ['passed', 'compile_verified', 'PASSED ', 'native_verified', 'failed'])})) as status, coalesce({sql_pick('o_custkey', ['', 'L2', None, 'L3', 'L4', 'L1'])}, '') as lv, coalesce({sql_pick('o_custkey', [None, 'passed', 'passed', 'rejected', 'failed'])}, 'passed') as diff from orders),
    g as (select *, (status = 'passed' and lv = '' or status in ('passed', 'compile_verified', 'native_verified') and lv in ('L2', 'L3', 'L4') and lv >= case when k % 3 = 1 then 'L3' else 'L1' end and k % 2 = 0 and k % 4 <> 3) and (k % 2 = 1 or diff = 'passed') as ok from r),
    c as (select *, 'pattern_' || md5('{{"codebase":"default","fix_files":[' || case when k % 5 = 0 then '' else '"a.c",' end || '"b' || k % 2 || '.c"],"signature":"sig' || k % 500 || '"}}') as pattern_id from g where ok and k % 7 <> 0 and run_id in (select l_orderkey from lineitem) qualify row_number() over (partition by pattern_id order by ts desc, run_id desc) = 1)"""


@query(f"""
    with {_RUNS}
    select pattern_id, run_id, case when k % 3 = 0 then 'crash of ' || k when k % 4 = 1 then 'first ' || k else 'sig' || k % 500 end as pattern_summary, case s when 'F' then 'memory' when 'O' then 'concurrency' else 'unknown' end as crash_category, case when k % 2 = 0 then 4 else 3 end::int as needs, case when k % 3 = 1 then 0.9 else 0.6 end::double as root_cause_confidence,
      (select string_agg(distinct 'fn' || l_partkey, ' ' order by 'fn' || l_partkey) from li where l_orderkey = run_id) as symbols from c
""")
def case_patterns(spark: S, d: str) -> DataFrame:
    rows = knowledge.commit_cases(_case_runs(spark, d))[0]
    return rows.select("pattern_id", "run_id", "pattern_summary", "crash_category", F.size("evidence_requirements").alias("needs"), "root_cause_confidence", F.array_join("symbols", " ").alias("symbols"))


@query(f"""
    with {_RUNS}, f as (select distinct pattern_id, '{{' || case when l_linenumber % 2 = 0 then '"function"' else '"resolved_function"' end || ':"fn' || l_partkey || '","module":"lib' || l_suppkey || '.so"}}' as ident from c join li on l_orderkey = run_id where pos < 5)
    select 'evidence_' || md5(pattern_id || ident) as evidence_id, pattern_id, 'stack_trace' as evidence_type, 0.7::double as reliability_score from f
    union all select 'evidence_' || md5(pattern_id || 'apply_fix'), pattern_id, 'fix_applied', 0.8 from c union all select 'evidence_' || md5(pattern_id || 'analysis_summary'), pattern_id, 'analysis_summary', case when k % 3 = 1 then 0.9 else 0.6 end from c
""")
def case_evidence(spark: S, d: str) -> DataFrame:
    return knowledge.commit_cases(_case_runs(spark, d))[1].select("evidence_id", "pattern_id", "evidence_type", "reliability_score")


# --- evidence and cases ------------------------------------------------------------------------------------------------------


@query("""
    with e as (select p_type as pattern_id, p_partkey as evidence_id, row_number() over (partition by p_type order by p_retailprice desc, p_partkey) as rank from part), h as (select distinct l_orderkey as log_id, p_type as pattern_id from lineitem join part on l_partkey = p_partkey)
    select log_id, pattern_id, evidence_id, rank::int as rank from h join e using (pattern_id) where rank <= 2
""")
def hit_evidence(spark: S, d: str) -> DataFrame:
    part = _t(spark, d, "part")
    evidence = part.select(F.col("p_type").alias("pattern_id"), F.col("p_partkey").alias("evidence_id"), F.col("p_retailprice").alias("reliability_score"))
    hits = _t(spark, d, "lineitem").join(part, F.expr("l_partkey = p_partkey")).select(F.col("l_orderkey").alias("log_id"), F.col("p_type").alias("pattern_id")).distinct()
    return diagnosis.attach_evidence(hits, evidence, 2).select("log_id", "pattern_id", "evidence_id", "rank")


@query("select event_id, case event_type when 'error' then 0.9 when 'click' then 0.4 else 0.5 end::double as relevance from events")
def stage_evidence(spark: S, d: str) -> DataFrame:
    rows = _t(spark, d, "events").select("event_id", F.col("event_type").alias("kind"), F.col("props").alias("content"))
    return diagnosis.ingest_evidence(rows, {"error": 0.9, "click": 0.4}).select("event_id", "relevance")


@query("select p_brand, p_type, count(distinct p_size) as cases from part group by all")
def knowledge_cases(spark: S, d: str) -> DataFrame:
    cases = diagnosis.build_cases(_t(spark, d, "part").select("p_brand", "p_type", "p_size"), ["p_brand", "p_type", "p_size"])
    return cases.groupBy("p_brand", "p_type").agg(F.count("*").alias("cases"))


@query("""
    with q as (select vec_id as query_id, embedding as e from embeddings where vec_id % 20 = 0),
    s as (select query_id, vec_id as pattern_id, label, round(list_sum(list_transform(list_zip(e, embedding), lambda z: (z[1]::double - z[2]::double) * (z[1]::double - z[2]::double))), 6) as distance from embeddings, q),
    k as (select *, row_number() over (partition by query_id order by distance, pattern_id) as rank from s qualify rank <= 5), m as (select *, case when distance <= 1 then 1 - distance else 1 / (1 + distance) end as sim from k where label % 3 > 0)
    select query_id, pattern_id, round(sim, 6) as similarity, round(sim + 0.5 + least(0.2, 0.02 * (pattern_id % 30)), 6) as score from m
""")
def pattern_hits(spark: S, d: str) -> DataFrame:
    e = _t(spark, d, "embeddings")
    meta = e.select(F.col("vec_id").alias("pattern_id"), F.lit(0.5).alias("confidence"), (F.col("vec_id") % 30).alias("adopted"), (F.col("label") % 3 == 0).alias("deprecated"))
    rows = retrieval.retrieve_patterns(e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), e.select(F.col("vec_id").alias("pattern_id"), "embedding"), meta)
    return rows.select("query_id", "pattern_id", r("similarity").alias("similarity"), r("score").alias("score"))


@query("""
    select 'o' || o_orderkey as node, 'region' || '>' || 'nation' || n_nationkey || '>' || 'customer' || '>' || 'order' as chain from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
""")
def reference_chains(spark: S, d: str) -> DataFrame:
    region, nation, customer, orders = (_t(spark, d, t) for t in ("region", "nation", "customer", "orders"))
    node = lambda k, c, name: [F.lit(0).alias("snapshot_id"), text(k, F.col(c)).alias("node"), name.alias("name"), F.lit("t").alias("type")]
    nodes = region.select(*node("r", "r_regionkey", F.lit("region"))).unionByName(nation.select(*node("n", "n_nationkey", text("nation", F.col("n_nationkey"))))).unionByName(customer.select(*node("c", "c_custkey", F.lit("customer")))).unionByName(orders.select(*node("o", "o_orderkey", F.lit("order"))))
    edge = lambda a, x, b, y: [F.lit(0).alias("snapshot_id"), text(a, F.col(x)).alias("src"), text(b, F.col(y)).alias("dst"), F.lit(0).alias("ord")]
    edges = nation.select(*edge("r", "n_regionkey", "n", "n_nationkey")).unionByName(customer.select(*edge("n", "c_nationkey", "c", "c_custkey"))).unionByName(orders.select(*edge("c", "o_custkey", "o", "o_orderkey")))
    return graphs.heap_chain(nodes, edges).where("node like 'o%'").select("node", F.array_join("chain", ">").alias("chain"))


@query("""
    with m as (select o_orderkey as log_id, o_orderstatus as s, o_custkey % 3 as k from orders) select log_id, case when s = 'F' then 'detector' when k = 0 then 'register' when k = 1 then 'address' when s = 'O' then 'pattern' else 'insufficient' end as grade from m
""")
def native_grades(spark: S, d: str) -> DataFrame:
    k = F.col("o_custkey") % 3
    o = _t(spark, d, "orders").withColumnRenamed("o_orderkey", "log_id")
    events = o.select("log_id", F.when(k == 0, F.lit(16)).cast("decimal(20,0)").alias("fault"))
    level = F.array_compact(F.array(F.when(F.col("o_orderstatus") == "F", "detector"), F.when(k == 1, "address"), F.when(F.col("o_orderstatus") == "O", "hint")))
    modes = o.select("log_id", F.explode(level).alias("level"))
    return diagnosis.cpp_evidence_grade(events, modes, o.where(k != 2).select("log_id"))


# --- sources -----------------------------------------------------------------------------------------------------------------


def _paths(spark: S, d: str) -> DataFrame:
    k = F.col("p_partkey")
    name = F.when(k % 6 == 0, text("memleak-native-app-", k % 40, "-sample.txt")).when(k % 6 == 1, text("memleak-native-app-", k % 40, "-", k, ".db")).when(k % 6 == 2, text("memleak-kernel-app-0-", k, ".txt")).when(k % 6 == 3, text("t", k, ".HTRACE")).when(k % 6 == 4, text("r", k, ".json")).otherwise(text("h", k, ".rawheap"))
    return _t(spark, d, "part").select(text("/data/", F.col("p_size"), "/", name).alias("path"), "p_size")


@query("""
    with f as (select '/data/' || p_size as directory, count(*) filter (where p_partkey % 6 = 3) as t, count(*) filter (where p_partkey % 6 = 4) as j, count(*) filter (where p_partkey % 6 = 5) as w from part group by 1)
    select directory, case when t > 0 then 'trace' when j > 0 then 'analysis_report' else 'directory' end as trace_kind, case when j > 1 then 'heap_snapshot_series' when j = 1 then 'heapsnapshot' when w > 0 then 'rawheap' else 'directory' end as heap_kind from f
""")
def artifact_kinds(spark: S, d: str) -> DataFrame:
    return readers.classify_artifacts(_paths(spark, d)).select("directory", "trace_kind", "heap_kind")


@query("""
    with f as (select 'app' as process, (p_partkey % 40)::varchar as pid, count(*) filter (where p_partkey % 6 = 0) as s, count(*) filter (where p_partkey % 6 = 1) as p from part where p_partkey % 6 < 2 group by 1, 2)
    select process, pid, s::int as samples, p::int as profiles, (row_number() over (order by (s > 0)::int + (p > 0)::int desc, p desc, pid))::int as rank from f
""")
def leak_bundles(spark: S, d: str) -> DataFrame:
    return readers.discover_bundles(_paths(spark, d)).select("process", "pid", F.size("sample").alias("samples"), F.size("profile").alias("profiles"), "rank")


@query("""
    select lang as directory, count(*)::int as n_files, sha256(string_agg(sha256(text), chr(10) order by '/x/' || lang || '/' || lpad(doc_id::varchar, 8, '0'))) as sha256 from documents where text is not null and lang is not null group by 1
""")
def directory_hashes(spark: S, d: str) -> DataFrame:
    rows = _t(spark, d, "documents").where("text is not null and lang is not null").select(text("/x/", F.col("lang"), "/", F.lpad(F.col("doc_id").cast("string"), 8, "0")).alias("path"), F.sha2("text", 256).alias("sha256"))
    return readers.directory_hash(rows).select(F.regexp_replace("directory", "^/x/", "").alias("directory"), "n_files", "sha256")


@query(f"""
    with {_LINES}, n as (select l_orderkey, count(*) as n from li group by 1)
    select li.l_orderkey as log_id, case li.l_orderkey % 2 when 0 then 'sentry' else 'generic' end as vendor, (case li.l_orderkey % 2 when 0 then n - 1 - pos else pos end)::int as pos, 'fn' || l_partkey as function, 'lib' || l_suppkey as module, l_linenumber::bigint as line from li join n using (l_orderkey)
""")
def vendor_frames(spark: S, d: str) -> DataFrame:
    frame = text('{"function": "fn', F.col("l_partkey"), '", "module": "lib', F.col("l_suppkey"), '", "lineno": ', F.col("l_linenumber"), "}")
    rows = _lines(spark, d).groupBy(F.col("l_orderkey").alias("log_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", frame.alias("t")))), lambda x: x["t"]), ", ").alias("fs"))
    content = F.when(F.col("log_id") % 2 == 0, text('{"exception": {"values": [{"type": "X", "stacktrace": {"frames": [', F.col("fs"), "]}}]}}")).otherwise(text('{"frames": [', F.col("fs"), "]}"))
    return readers.vendor_json_to_frames(rows.select("log_id", content.alias("content"))).select("log_id", "vendor", "pos", "function", "module", "line")


_NESTS = [("", "", 0, ""), ('{"stack_frames": ', "}", 1, "/stack_frames"), ('{"data": {"id": 7, "report": ', "}}", 2, "/data/report"), ('{"events": [{"meta": 1, "thread": {"frames": ', "}}]}", 4, "/events/0/thread/frames"), ('{"a": {"b": {"c": {"d": {"e": {"f": ', "}}}}}}", 6, "/a/b/c/d/e/f"), ('{"list": [1, 2, {"zzz": 1}], "z": {"list": [{"id": 5}], "stack": ', "}}", 2, "/z/stack"), ('{"deep": {"more": {"frames": [{"file": "x"}]}}, "near": ', "}", 1, "/near")]


@query(f"""
    with {_LINES} select l_orderkey as log_id, {sql_pick('l_orderkey', [str(n[2]) for n in _NESTS])}::int as depth, {sql_pick('l_orderkey', [n[3] for n in _NESTS])} as path, pos::int as pos, 'fn' || l_partkey as function, 'lib' || l_suppkey || '.so' as library, l_linenumber::int as line, l_linenumber % 2 = 0 as in_app from li
""")
def nested_frames(spark: S, d: str) -> DataFrame:
    frame = text('{"symbol": "fn', F.col("l_partkey"), '", "image": "/data/lib', F.col("l_suppkey"), '.so", "lineNumber": ', F.col("l_linenumber"), ', "inApp": ', F.when(F.col("l_linenumber") % 2 == 0, "true").otherwise("false"), "}")
    rows = _lines(spark, d).groupBy(F.col("l_orderkey").alias("log_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", frame.alias("t")))), lambda x: x["t"]), ", ").alias("fs"))
    content = text(pick(F.col("log_id"), [n[0] for n in _NESTS]), "[", F.col("fs"), "]", pick(F.col("log_id"), [n[1] for n in _NESTS]))
    return jsonframes.json_frames(rows.select("log_id", content.alias("content"))).select("log_id", "depth", "path", "pos", "function", "library", "line", "in_app")


def _harmony_documents(spark: S, d: str) -> DataFrame:
    """A document for each order: its lines as the crash thread's objects and, of application libraries, as a listed stack; odd orders
    have a second stack with a frame of its own."""
    n, a, lib, fn = padded(F.col("pos").cast("string"), 2), hexa(F.col("l_partkey") * 16, 16), F.col("l_suppkey"), F.col("l_partkey")
    entry = text('{"image": "/system/lib64/lib', lib, '.so", "frame_addr": "', a, '", "local_symbol": "fn', fn, '", "type": "', F.when(F.col("l_linenumber") % 2 == 0, "ets").otherwise("native"), '", "arch": "aarch64"}')
    line = text("#", n, " pc ", a, " /data/storage/el1/bundle/libs/arm64/libapp_", lib, ".so (fn", fn, "+", F.col("l_linenumber"), ") [::ab12]")
    joined = lambda c, by: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", c.alias("t")))), lambda x: x["t"]), by)
    rows = _lines(spark, d).groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(joined(entry, ", ").alias("entries"), joined(line, "\\n").alias("text"))
    second = F.when(F.col("o_orderkey") % 2 == 1, text(', {"thread_id": "pool", "thread_name": "', F.col("o_custkey"), '", "call_stack": "#00 pc ', hexa(F.col("o_orderkey"), 8), ' /data/storage/el1/bundle/libs/arm64/libapp_pool.so (work)"}')).otherwise("")
    signal = F.when(F.col("o_orderstatus") == "F", "SIGSEGV(11)").when(F.col("o_orderstatus") == "O", "SIGABRT").otherwise("JsError")
    content = text('crashDiagnosis: {"platform": "harmony", "app_version": "', F.col("o_orderpriority"), '", "bundle_id": "app', F.col("o_custkey"), '", "attributes": {"exp_info": {"name": "', signal, '", "message": "m', F.col("o_custkey"), '"}}, "body": {"attributed_stack": {"thread_id": ', F.col("o_custkey"), ', "thread_name": "main", "stack_frames": [', F.col("entries"), ']}, "stacks": [{"thread_id": 1, "thread_name": "fault", "call_stack": "', F.col("text"), '"}', second, "]}}")
    return _t(spark, d, "orders").join(rows, "o_orderkey").select(F.col("o_orderkey").alias("log_id"), content.alias("content"))


@query("""
    select o_orderkey as log_id, 'ok' as status, case o_orderstatus when 'F' then '11 (SIGSEGV)' when 'O' then 'SIGABRT' end as signal, case o_orderstatus when 'F' then 'segmentation fault' when 'O' then 'abort' else 'JsError' end as crash_reason,
      case when o_orderstatus = 'P' then 'JsError: ' else '' end || 'm' || o_custkey as exception_type, 'harmonyos' as os_type, o_orderpriority as app_version, 'app' || o_custkey as process_name, o_custkey::varchar as crash_tid, 'aarch64' as arch, 1 + (o_orderkey % 2)::int as threads_total, 1 + (o_orderkey % 2)::int as distinct_stacks
    from orders where o_orderkey in (select l_orderkey from lineitem)
""")
def harmony_events(spark: S, d: str) -> DataFrame:
    rows = harmony.crash_events(_harmony_documents(spark, d))
    return rows.select("log_id", "status", "signal", "crash_reason", "exception_type", "os_type", "app_version", "process_name", "crash_tid", "arch", "threads_total", "distinct_stacks")


@query(f"""
    with {_LINES}, o as (select o_orderkey, o_custkey::varchar as cust from orders), f as (select l_orderkey as log_id, cust, pos, '0x' || lpad(lower(hex(l_partkey * 16)), 16, '0') as address, l_suppkey as lib, 'fn' || l_partkey as function, l_linenumber % 2 = 0 as ets from li join o on o_orderkey = l_orderkey),
    x as (select distinct log_id, cust, '0x' || lpad(lower(hex(log_id)), 8, '0') as address from f where log_id % 2 = 1),
    u as (select log_id, address, lib::varchar as lib, function, min(pos) as pos from f where log_id % 2 = 1 group by all union all select log_id, address, 'pool', 'work', 1000 from x)
    select log_id, 'crash' as thread, null::int as thread_index, cust as tid, 'main' as name, pos::int as frame_number, address, 'lib' || lib || '.so' as library, function, 'system' as library_type, case when ets then 'arkts' else 'cpp' end as language from f
    union all select log_id, 'primary', 0, '1', 'fault', pos::int, address, 'libapp_' || lib || '.so', function, 'app', 'cpp' from f
    union all select log_id, 'background', 1, cust, 'pool', 0, address, 'libapp_pool.so', 'work', 'app', 'cpp' from x
    union all select log_id, 'aggregated', 10000, null, 'aggregated_app_libs', (row_number() over (partition by log_id order by pos) - 1)::int, address, 'libapp_' || lib || '.so', function, 'app', 'cpp' from u
""")
def harmony_threads(spark: S, d: str) -> DataFrame:
    rows = harmony.crash_threads(_harmony_documents(spark, d))
    return rows.select("log_id", "thread", "thread_index", "tid", "name", "frame_number", "address", "library", "function", "library_type", "language")


@query("""
    with c as (select *, row_number() over (partition by c_nationkey order by c_custkey) - 1 as node, count(*) over (partition by c_nationkey) as n from customer), e as (select *, unnest(range(c_custkey % 3)) as j from c),
    o as (select *, row_number() over (partition by c_nationkey order by node, j) - 1 as ord, (node + j + 1) % n as dst from e)
    select o.c_nationkey as nation, ord::bigint as ord, o.c_name || ', "' || o.c_custkey || '"' as src_name, d.c_name || ', "' || d.c_custkey || '"' as dst_name, o.c_custkey % 97 as self_size from o join c d on d.c_nationkey = o.c_nationkey and d.node = o.dst
""")
def snapshot_edges(spark: S, d: str) -> DataFrame:
    """A snapshot file for each nation: its customers are the nodes, each holds up to two of those after it."""
    key = Window.partitionBy("c_nationkey")
    c = _t(spark, d, "customer").withColumn("node", F.row_number().over(key.orderBy("c_custkey")) - 1).withColumn("n", F.count(F.lit(1)).over(key)).withColumn("held", (F.col("c_custkey") % 3).cast("int"))
    numbers = text("1,", F.col("node"), ",", F.col("c_custkey"), ",", F.col("c_custkey") % 97, ",", F.col("held"))
    links = F.when(F.col("held") > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest("held", F.lit(1))), lambda j: F.concat(F.lit("0,0,"), ((F.col("node") + j) % F.col("n") * 5).cast("string"))), ","))
    string = text('"', F.col("c_name"), ', \\"', F.col("c_custkey"), '\\""')
    joined = lambda x: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", x.alias("t")))), lambda r: r["t"]), ",")
    head = '{"snapshot": {"meta": {"node_fields": ["type", "name", "id", "self_size", "edge_count"], "node_types": [["hidden", "object"], "string"], "edge_fields": ["type", "name_or_index", "to_node"]}}, "nodes": ['
    made = c.groupBy("c_nationkey").agg(text(head, joined(numbers), '], "edges": [', joined(links), '], "strings": [', joined(string), "]}").alias("value"))
    path = fresh_path(spark, "snapshot-files")
    made.write.partitionBy("c_nationkey").text(path)
    nodes, edges = snapshots.read_graph(spark, path)
    src, dst = nodes.select("snapshot_id", F.col("node").alias("src"), F.col("name").alias("src_name"), "self_size"), nodes.select("snapshot_id", F.col("node").alias("dst"), F.col("name").alias("dst_name"))
    rows = edges.join(src, ["snapshot_id", "src"]).join(dst, ["snapshot_id", "dst"])
    return rows.select(F.regexp_extract("snapshot_id", r"c_nationkey=(\d+)", 1).cast(_t(spark, d, "customer").schema["c_nationkey"].dataType).alias("nation"), F.col("ord").cast("long").alias("ord"), "src_name", "dst_name", "self_size")


# --- crash diagnosis ---------------------------------------------------------------------------------------------------------


@query("""
    with e as (select o_orderkey as log_id, case o_orderstatus when 'F' then 'SIGSEGV' when 'O' then 'SIGABRT' else 'SIGKILL' end as signal, o_custkey % 4 as k from orders),
    c as (select log_id, case signal when 'SIGSEGV' then 'CPP-FM-02' when 'SIGABRT' then 'CPP-FM-08' end as m, 0.65 as c from e union all select log_id, 'CPP-FM-03', 0.72 from e where k = 1 union all select log_id, 'CPP-FM-01', 0.9 from e where k = 2 union all select log_id, 'CPP-FM-16', 0.9 from e where signal = 'SIGKILL' and k = 3 union all select log_id, 'CPP-FM-08', 0.88 from e where k = 3 union all select log_id, 'CPP-FM-14', 0.7 from e where k = 0)
    select log_id, m as fault_mode, max(c)::double as confidence from c where m is not null group by all
""")
def native_modes(spark: S, d: str) -> DataFrame:
    k = F.col("o_custkey") % 4
    signal = F.when(F.col("o_orderstatus") == "F", "SIGSEGV").when(F.col("o_orderstatus") == "O", "SIGABRT").otherwise("SIGKILL")
    events = _t(spark, d, "orders").select(F.col("o_orderkey").alias("log_id"), signal.alias("signal"), F.when(k == 1, "segv_accerr").alias("signal_code"), F.when(k == 2, F.lit(16)).otherwise(1 << 40).cast("decimal(20,0)").alias("fault"), F.when(k == 3, "my_assert_fail").alias("frames_text"), F.when(k == 3, "Watchdog").alias("fatal_message"), F.lit(None).cast("string").alias("content"), F.when(k == 0, F.array(F.lit("js_oom"))).alias("hints"))
    return diagnosis.cpp_fault_modes(events).select("log_id", "fault_mode", "confidence")


@query("""
    select c_custkey as log_id, case c_custkey % 5 when 0 then 'null_deref' when 1 then 'null_base_plus_offset' when 2 then 'base_plus_offset' when 3 then 'unmapped_access' else 'no_address' end as pattern, case c_custkey % 5 when 0 then 'x5' when 1 then 'x5' when 2 then 'x1' end as register, case c_custkey % 5 when 1 then c_nationkey + 1 when 2 then c_nationkey * 8 + 8 end::bigint as member_offset from customer
""")
def fault_registers(spark: S, d: str) -> DataFrame:
    dec = lambda c: c.cast("decimal(20,0)")
    k, n, base = F.col("c_custkey") % 5, F.col("c_nationkey"), F.lit(1 << 33)
    fault = F.when(k == 0, F.lit(0)).when(k == 1, n + 1).when(k == 2, base + n * 8 + 8).when(k == 3, F.lit(1 << 45))
    c = by_size(_t(spark, d, "customer"), "c_custkey", task_rows=80_000)  # each has three registers
    events = c.select(F.col("c_custkey").alias("log_id"), dec(fault).alias("fault"))
    regs = c.select(F.col("c_custkey").alias("log_id"), F.explode(F.array(F.struct(F.lit("x5").alias("reg"), dec(F.lit(0)).alias("va")), F.struct(F.lit("x1").alias("reg"), dec(base).alias("va")), F.struct(F.lit("x3").alias("reg"), dec(base).alias("va")))).alias("r")).select("log_id", "r.*")
    return diagnosis.fault_register(events, regs)


@query("""
    select c_custkey as log_id, c_custkey % 3 > 0 as sp_aligned, case when c_nationkey % 4 = 0 then 'outside' when c_nationkey % 4 = 1 then 'high' when c_nationkey % 4 = 2 then 'low' else 'none' end as stack_overflow_risk, c_custkey % 2 = 0 as fp_above_sp, c_nationkey % 2 = 0 as pc_in_code from customer
""")
def pointer_states(spark: S, d: str) -> DataFrame:
    dec = lambda c: c.cast("decimal(20,0)").alias
    k, n = F.col("c_custkey"), F.col("c_nationkey") % 4
    start, size = F.lit(1 << 30), F.lit(1 << 20)
    sp = start + F.when(n == 1, F.lit(1024)).when(n == 2, F.lit(8192)).otherwise(F.lit(1 << 19)) + F.when(k % 3 == 0, 8).otherwise(0)
    row = lambda reg, va, path, code: F.struct(F.lit(reg).alias("reg"), dec(va)("va"), dec(start)("start"), dec(start + size)("end"), path.alias("path"), code.alias("executable"))
    rows = F.array(row("sp", sp, F.when(n == 0, "/lib/x.so").otherwise("[stack]"), F.lit(False)), row("fp", F.when(k % 2 == 0, sp + 16).otherwise(sp - 16), F.lit("[stack]"), F.lit(False)), row("pc", F.lit(77), F.lit("/lib/y.so"), n % 2 == 0))
    pointers = _t(spark, d, "customer").select(k.alias("log_id"), F.explode(rows).alias("r")).select("log_id", "r.*")
    return diagnosis.pointer_checks(pointers).select("log_id", "sp_aligned", "stack_overflow_risk", "fp_above_sp", "pc_in_code")


@query("""
    with e as (select o_orderkey as log_id, o_custkey % 6 as k, o_orderstatus as s from orders)
    select log_id, 'null_pointer' as fact, case when s = 'F' then 0.95 else 0.8 end::double as confidence from e where s = 'F' or k = 0
    union all select log_id, 'stack_overflow', 0.9 from e where k = 1 union all select log_id, 'assertion', 0.9 from e where k = 2 and s = 'O' union all select log_id, 'heap_corruption', 0.95 from e where k = 3 union all select log_id, 'divide_by_zero', 0.9 from e where k = 4 union all select log_id, 'uncaught_exception', 0.85 from e where k = 5
""")
def crash_facts(spark: S, d: str) -> DataFrame:
    k = F.col("o_custkey") % 6
    events = _t(spark, d, "orders").select(F.col("o_orderkey").alias("log_id"), F.when(F.col("o_orderstatus") == "O", "SIGABRT").otherwise("SIGSEGV").alias("signal"), F.when(F.col("o_orderstatus") == "F", F.lit(8)).cast("decimal(20,0)").alias("fault"), pick(F.col("o_custkey"), ["read_nullptr", "f", "Assert(x)", "double free", "divide_by_zero", "terminate called"]).alias("frames_text"), F.lit(None).cast("string").alias("fatal_message"), (k == 1).alias("recursion"))
    return diagnosis.deterministic_facts(events)


@query("""
    select p_partkey as log_id, case p_partkey % 5 when 0 then 'abort' when 1 then 'null_pointer_dereference' when 2 then 'segmentation_fault' when 3 then 'stack_symbol_hint' else 'unknown' end as new_class, case p_partkey % 5 when 0 then 0.9 when 1 then 0.72 when 2 then 0.55 when 3 then 0.45 else 0.3 end::double as new_confidence from part
""")
def stack_classes(spark: S, d: str) -> DataFrame:
    k = F.col("p_partkey") % 5
    rows = _t(spark, d, "part").select(F.col("p_partkey").alias("log_id"), F.when(k == 0, "abort").otherwise("unknown").alias("crash_class"), F.when(k == 0, 0.9).otherwise(0.3).alias("confidence"), F.when(k.isin(1, 2), "SIGSEGV").alias("signal"), F.lit(None).cast("string").alias("reason"), F.when(k == 1, "null_deref()").otherwise("f").alias("functions"), F.when(k == 3, "f").alias("crash_function"))
    return diagnosis.classify_from_stack(rows).select("log_id", "new_class", "new_confidence")


@query("""
    select event_id as frame_id, m as fault_mode from events join (values ('click', 'JANK-FM-01'), ('click', 'JANK-FM-08'), ('view', 'JANK-FM-03'), ('purchase', 'JANK-FM-04'), ('error', 'JANK-FM-06')) v(e, m) on e = event_type
""")
def jank_modes(spark: S, d: str) -> DataFrame:
    stage = F.create_map(*[F.lit(x) for kv in {"click": "main CPU", "view": "Layout", "purchase": "repaint", "error": "GC", "signup": "none"}.items() for x in kv])[F.col("event_type")]
    frames = _t(spark, d, "events").select(F.col("user_id").alias("log_id"), F.col("event_id").alias("frame_id"), stage.alias("stage"))
    return timing.jank_fault_modes(frames).select("frame_id", "fault_mode")


@query("""
    with o as (select distinct user_id, event_type, floor(value / 10)::int as v, case when event_type in ('click', 'view') then 'runtime_event' when event_type = 'error' then 'tool_error' else 'tool_result' end as kind from events)
    select kind, count(*) as n from (select distinct kind, user_id, v from o) group by 1
""")
def observations_once(spark: S, d: str) -> DataFrame:
    t = F.col("event_type")
    rows = _t(spark, d, "events").select(F.when(t == "click", "odd").when(t == "view", "runtime_event").when(t == "error", "tool_error").otherwise("tool_result").alias("kind"), F.lit("s").alias("source"), F.lit("ok").alias("status"), text("  user ", F.col("user_id"), " ").alias("summary"), F.lit(-1).alias("round"), F.floor(F.col("value") / 10).cast("int").alias("details"))
    return diagnosis.dedup_observations(rows).groupBy("kind").agg(F.count("*").alias("n"))


# --- documents and symbols ---------------------------------------------------------------------------------------------------


@query("""
    with t as (select item_id as query_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-zA-Z0-9_:.]{4,}'))) as term from benchmark),
    b as (select doc_id, lower(text) as body from documents where text is not null)
    select query_id, doc_id, sum(case when starts_with(term, 'lib') or contains(term, '::') then 1.5 else 0.5 end)::double as score from t join b on contains(body, term) group by all
""")
def document_scores(spark: S, d: str) -> DataFrame:
    docs = _t(spark, d, "documents").where("text is not null").select("doc_id", F.array().cast("array<string>").alias("symbols"), F.col("text").alias("body"))
    queries = _t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return retrieval.score_docs(queries, docs)


@query(f"""
    with {_LINES}, w as (select distinct l_orderkey as log_id, l_partkey % 500 as s from li), dc as (select distinct s_suppkey as doc, s_suppkey * 5 + g as s from supplier, generate_series(0, 2) x(g)),
    h as (select distinct log_id, doc from w join dc using (s)), e as (select distinct log_id, 'Sym' || s as symbol from h join dc using (doc))
    select log_id, symbol, (row_number() over (partition by log_id order by symbol))::int as rank from e qualify rank <= 5
""")
def seeded_symbols(spark: S, d: str) -> DataFrame:
    stacks_ = _lines(spark, d).groupBy(F.col("l_orderkey").alias("log_id")).agg(F.concat_ws(" at ", F.collect_list(text("Sym", F.col("l_partkey") % 500))).alias("text"))
    docs = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("doc_id"), F.transform(F.sequence(F.lit(0), F.lit(2)), lambda g: text("Sym", F.col("s_suppkey") * 5 + g)).alias("symbols"))
    return retrieval.seed_symbols(stacks_, docs, 5)


@query("""
    select p_brand as file, count(*) filter (where p_size % 2 = 0) as functions, count(*) filter (where p_size % 2 = 1) as types from (select distinct p_brand, p_size, p_partkey from part) group by 1
""")
def source_symbols(spark: S, d: str) -> DataFrame:
    k = F.col("p_partkey")
    line = F.when(F.col("p_size") % 2 == 0, text("int fn_", k, "(int a) {\n}")).otherwise(text("class Type", k, " {\n};"))
    files = _t(spark, d, "part").groupBy(F.col("p_brand").alias("file")).agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("text"))
    symbols, _ = diagnosis.extract_source_symbols(files)
    return symbols.groupBy("file").agg(F.count_if(F.col("kind") == "function").alias("functions"), F.count_if(F.col("kind") == "type").alias("types"))


@query("select doc_id, lang, source, sha256(coalesce(text, '')) as body_hash from documents where lang is not null")
def document_heads(spark: S, d: str) -> DataFrame:
    whole = text("---\nlang: ", F.col("lang"), "\n# note: x\nsource: old\nsource: '", F.col("source"), "'\n---\n", F.coalesce("text", F.lit("")))
    rows = retrieval.front_matter(_t(spark, d, "documents").where("lang is not null").select("doc_id", whole.alias("text")))
    return rows.select("doc_id", F.col("metadata")["lang"].alias("lang"), F.col("metadata")["source"].alias("source"), F.sha2("body", 256).alias("body_hash"))


@query("select p_size as log_id, p_partkey as line_no, '/lib/' || p_brand as name, (p_partkey * 1000)::double as size_kb, p_size::double as pss_kb, 3.0::double as swap_pss_kb from part where p_partkey > 0")
def smaps_tables(spark: S, d: str) -> DataFrame:
    k = F.col("p_partkey")
    part = _t(spark, d, "part").where("p_partkey > 0")
    rows = part.select(F.col("p_size").alias("log_id"), k.alias("line_no"), text(F.format_number(k * 1000, 0), "   7   ", F.col("p_size"), "   3   /lib/", F.col("p_brand")).alias("text"))
    heads = part.select(F.col("p_size").alias("log_id")).distinct().select("log_id", F.lit(0).cast("long").alias("line_no"), F.lit("Size  Rss  Pss  SwapPss  Name").alias("text"))
    return logs.parse_smaps_table(rows.unionByName(heads))
