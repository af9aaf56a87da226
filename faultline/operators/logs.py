"""Log text to tables: lines, sections, frames, maps, registers, kinds, timelines, samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.operators.frames import parse_frames  # noqa: F401
from faultline.operators.joins import address
from faultline.operators.leak import any_of
from faultline.operators.timing import lenient_number

#: Fixed value: characters of a log that kinds are told from.
HEAD = 12_000
#: Words that tell a log's kind.
CRASH_SIGNAL = r"(?i)(?:(?<![A-Za-z0-9])SIG(?:SEGV|ABRT|BUS|ILL|FPE|TRAP)(?![A-Za-z0-9])|Fatal\s+signal|EXC_BAD_ACCESS|EXC_CRASH|tombstone|Segmentation\s+fault|Abort\s+message|崩溃类型\s*[:：].*SIG(?:SEGV|ABRT|BUS|ILL|FPE|TRAP))"
JAVA_FATAL = r"(?i)FATAL\s+EXCEPTION"
APP_FREEZE = r"(?i)appfreeze"
WATCHDOG = r"(?i)\bwatchdog\b|WatchdogEvent\s*:|Failed to terminate gracefully|RBSAssertionReliability|Namespace\s+FRONTBOARD"
FAULTING = r"(?i)SIG(?:SEGV|ABRT|BUS|ILL|FPE|TRAP)|EXC_BAD_ACCESS|Fatal\s+signal"
ANR = r"(?i)\bANR\b|am_anr(?:_info)?\b"
OOM_KILL = r"(?i)(?:OutOfMemoryError|out\s+of\s+memory|lowmemorykiller|Low\s+Memory\s+Killer|\bjetsam\b|EXC_RESOURCE[^\n]*MEMORY|killed\s+due\s+to\s+memory|Cannot\s+allocate\s+memory|ENOMEM|oom[_ -]?killer|Memory\s+pressure\s+event.*kill)"
MEMORY_PRESSURE = r"(?i)(?:memory\s+pressure|low[_ ]?memory|memory\s+warning|didReceiveMemoryWarning|onTrimMemory|GC[_\s]?ALLOC|Allocations?\s+failed|heap\s+(?:limit|full|exhausted)|PSS\s*[:=]|RSS\s*[:=]|Java\s+heap\s*[:=]|native\s+heap\s*[:=])"
NATIVE_HINT = r"(?i)(?:\*\*\*\s*\*\*\*\s*Fatal\s+signal|Build\s+fingerprint:|Crash\s+reason:|Exception\s+Type:|Crashed\s+Thread:|#00\s+pc\s+)"
#: Sections of a log and what shows each.
SECTIONS = [
    ("signal", r"(?im)^(?:signal\s+\d+|Reason:\s*Signal:|Exception Type:)"),
    ("registers", r"(?m)^Registers:|^\s+x0\s+[0-9a-fA-F]{8,}|^\s*x0\s*:\s*[0-9a-fA-F]"),
    ("backtrace", r"(?i)backtrace:|(?m)^Fault thread info:|^#\d+\s+pc\s+|^Thread\s+\d+\s+Crashed:"),
    ("termination", r'(?im)termination reason:|^"termination"\s*:'),
    ("build_id", r"(?i)build id:|buildid:"),
    ("submitter_stack", r"(?i)submitter\s*stack\s*trace"),
    ("stepped_registers", r"(?i)stepped registers:"),
    ("stack_dump", r"(?m)^stack:|(?i)fault\s*stack\s*:"),
    ("memory_near", r"(?i)memory near"),
    ("other_threads", r"(?i)other thread info:"),
    ("maps", r"(?m)^Maps:|(?i)memory map"),
    ("open_files", r"(?i)open\s*files\s*:"),
    ("hilog", r"(?m)^HiLog:"),
    ("metrics", r"(?m)^metrics:"),
]
#: Operation classes, the first that a line's tag and message show.
OPERATIONS = [
    (r"onCreate|onStart|onResume|onPause|onStop|onDestroy|viewDidLoad|viewWillAppear|viewDidDisappear", "lifecycle"),
    (r"Activity|Fragment|ViewController|UIViewController", "ui_navigation"),
    (r"request|response|HTTP|API|fetch|download|upload|connect|socket", "network"),
    (r"query|insert|update|delete|transaction|commit|rollback|sqlite|realm|coredata", "database"),
    (r"read|write|open|close|file|stream|path|directory|mkdir", "file_io"),
    (r"click|tap|touch|gesture|button|press|scroll|swipe|input", "user_action"),
    (r"alloc|dealloc|release|retain|free|new|delete|dispose|GC|finalize", "memory_mgmt"),
    (r"thread|dispatch|async|sync|queue|handler|executor|pool|task|runnable", "threading"),
    (r"play|pause|stop|record|camera|video|audio|media|codec", "media"),
    (r"service|broadcast|receiver|provider|intent|notification|alarm", "service"),
]
#: Header fields, the patterns of their lines and the order in which these count.
HEADERS = [
    ("signal", r"(?i)^(?:Reason:\s*)?signal\s*:?\s*\d*\s*\(?(SIG[A-Z]+)", 1),
    ("signal", r"(?i)Exception Type:.*\((SIG[A-Z]+)\)", 2),
    ("signal", r"(?i)\bsignal\s+\d+\s*\((SIG[A-Z0-9]+)\)", 3),
    ("signal", r"(?i)^\*\s*(SIG[A-Z0-9_]+):\s*0x[0-9a-f]+", 4),
    ("signal_number", r"(?i)\bsignal\s+(\d+)", 1),
    ("signal_code", r"(?i)\bcode\s+-?\d+\s*\((\w+)\)", 1),
    ("reason", r"(?i)^Reason:\s*(.+)$", 1),
    ("fault_address", r"(?i)fault addr(?:ess)?\s*:?\s*(0x[0-9a-f]+|[0-9a-f]{8,16})", 1),
    ("fault_address", r"(?i)\bat\s+(0x[0-9a-f]+)$", 2),
    ("fault_address", r"(?i)KERN_[A-Z_]+\s+at\s+(0x[0-9a-f]{1,16})\b", 3),
    ("fault_address", r"(?i)(?:garbage\s+pointer|dereference[^0x]*)\s+(0x[0-9a-f]{1,16})\b", 4),
    ("fault_address", r"(?i)^Reason:.*@(0x[0-9a-f]+)", 5),
    ("fault_address", r"(?i)^\*\s*SIG[A-Z0-9_]+:\s*(0x[0-9a-f]+)", 6),
    ("exception_type", r"(?i)^Exception Type:\s*(\S+)", 1),
    ("exception_code", r"(?i)^Exception Codes?:\s*(\S+)", 1),
    ("error_name", r"(?i)^Error name:\s*(.+)$", 1),
    ("error_message", r"(?i)^Error message:\s*(.+)$", 1),
    ("app_version", r"(?i)^Version:\s*([0-9]+(?:\.[0-9]+)*(?:\s*\([^)]+\))?)\s*$", 1),
    ("app_version", r"(?i)^(?:App\s*)?Version:\s*(\S+)", 2),
    ("app_version", r"(?i)^ver[:\s]+([0-9.]+)$", 3),
    ("app_version", r"(?i)^build[:\s]+([0-9.]+)$", 4),
    ("app_version", r"(?i)^app[:\s]+([0-9.]+)$", 5),
    ("app_version", r"(?i)^\s*Package:\s+\S+\s+v\d+\s+\(([^)]+)\)", 6),
    ("device", r"(?i)^Device info:\s*(.+)$", 1),
    ("device", r"(?i)^Device:\s*(.+)$", 2),
    ("device", r"^设备(?:信息|型号)?[:：]\s*(.+)$", 3),
    ("device", r"(?i)^Model:\s*(.+)$", 4),
    ("device", r"(?i)^Hardware:\s*(.+)$", 5),
    ("device", r"(?i)^Hardware Model:\s*(.+)$", 6),
    ("process", r"(?i)^(?:Process|Process name|Module name):\s*(\S+)", 1),
    ("process", r"(?i)Cmdline:\s*(\S+)", 2),
    ("process_id", r"(?i)^(?:进程ID|Pid):\s*(\d+)$", 1),
    ("process_id", r"(?i)\bpid:\s*(\d+),\s*tid:\s*\d+", 2),
    ("process_id", r"(?i)^Process:\s*[^\[]+\[(\d+)\]", 3),
    ("thread_id", r"(?i)\bpid:\s*\d+,\s*tid:\s*(\d+)", 1),
    ("thread_name", r"(?i)\btid:\s*\d+,\s*name:\s*([^\s>]+)\s*>>>", 1),
    ("platform", r"^平台:\s*(.+)$", 1),
    ("timestamp", r"(?i)^(?:时间|Timestamp|Date/Time):\s*(.+)$", 1),
    ("compiler", r"(?i)^(?:编译器|Compiler):\s*(.+)$", 1),
    ("compiler", r"(?i)^(Apple LLVM version.+)$", 2),
    ("compiler", r"(?i)^((?:clang|gcc|g\+\+) version.+)$", 3),
    ("os_version", r"(?i)^\s*OS Version:\s*[A-Za-z ]*?\s+([0-9.]+)", 1),
    ("os_version", r"(?i)\b(?:android|iPhone\s+OS|iPadOS|ios|linux|kernel|ubuntu|macos|os\s+x|darwin|windows)\s+([0-9.]+)", 2),
    ("os_version", r"(?i)\b(?:API\s+level|SDK)\s+([0-9.]+)", 3),
    ("arch", r"(?i)^(?:architecture|arch|架构)[:：]\s*([A-Za-z0-9._-]+)$", 1),
    ("arch", r"(?i)\b(arm64-v8a|armeabi-v7a|armeabi)\b", 2),
    ("arch", r"(?i)^\s*ABI:\s*['\"]?([a-z0-9_-]+)['\"]?\s*$", 3),
    ("arch", r"(?i)^Code Type:\s*([a-z0-9._-]+)", 4),
    ("arch", r"(?i)/libs?(?:64)?/(arm64|aarch64|x86_64|armv7|armv8|i386|i686|x86)", 5),
    ("symbol_path", r"(?i)(?:symbol|dsym)[_\s]?(?:path|file)[:\s]+(.+)$", 1),
    ("ability", r"(EntryAbility)", 1),
    ("main_base", r"主程序基址:\s*([0-9a-fA-Fx]+)", 1),
    ("abort_message", r"(?i)Abort message:\s*'?(.+?)'?\s*$", 1),
]
ARCH_NAMES = {"arm-64": "arm64", "arm64": "arm64", "aarch64": "arm64", "x86-64": "x86_64", "x86_64": "x86_64", "amd64": "x86_64", "armeabi-v7a": "armv7", "armv7": "armv7"}
#: Timeline line formats in the order in which they are tried.
LOGCAT = r"^(\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}\.\d{3})\s+\d+\s+\d+\s+([VDIWEF])\s+(\S+)\s*:\s*(.*)$"
SYSLOG = r"^(\w{3}\s+\d+\s+\d{2}:\d{2}:\d{2})\s+\S+\s+(\S+)\[?\d*\]?\s*:\s*(.*)$"
HILOG = r"^(\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}\.\d{3})\s+\d+\s+\d+\s+([VDIWEF])\s+(\S+)/(\S+)\s*:\s*(.*)$"
GENERIC = r"^[\[\(]?(\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}|\d{2}:\d{2}:\d{2}(?:\.\d+)?)"
#: What makes a timeline worth while.
TIMELINE_SECTIONS = ("hilog", "logcat", "application_specific", "asi", "syslog", "console", "console_log", "app_log")
TIMELINE_BANNERS = "hilog:|logcat|application specific information|console log|standard error:"
TIMELINE_LOGCAT = r"(?m)^\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}\.\d{3}\s+\d+\s+\d+\s+[VDIWEF]\s+\S+"
TIMELINE_HILOG = r"(?m)^\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}\.\d{3}\s+\d+\s+\d+\s+[VDIWEF]\s+\S+/\S+\s*:"
TIMELINE_IOS = r"(?m)^(?:Application Specific Information:|Console Log:|Standard Error:)"
#: Memory words, values with their units, and counts.
MEMORY_FLAGS = {
    "oom": r"(?i)OutOfMemoryError",
    "jetsam": r"(?i)\bjetsam\b",
    "lmk": r"(?i)lowmemorykiller|Low\s+Memory\s+Killer",
    "resource": r"(?i)EXC_RESOURCE[^\n]*MEMORY",
    "enomem": r"(?i)\bENOMEM\b|Cannot\s+allocate\s+memory",
    "pressure": r"(?i)memory\s+pressure|low[_ ]?memory|memory\s+warning",
    "trim": r"(?i)onTrimMemory|didReceiveMemoryWarning",
}
MEMORY_VALUES = {
    "pss": r"(?i)PSS\s*[:=]?\s*([\d.]+)\s*(K|KB|M|MB|G|GB)?",
    "rss": r"(?i)(?:RSS|VmRSS)\s*[:=]?\s*([\d.]+)\s*(K|KB|M|MB|G|GB)?",
    "java_heap": r"(?i)(?:Java\s+heap|Dalvik\s+Heap|Heap:\s*size)\s*[:=]?\s*([\d.]+)\s*(K|KB|M|MB|G|GB)?",
    "native_heap": r"(?i)Native\s+Heap\s*[:=]?\s*([\d.]+)\s*(K|KB|M|MB|G|GB)?",
}
MEMORY_COUNTS = {"fd_count": r"(?i)(?:FDs?|file\s+descriptors?)\s*[:=]?\s*(\d+)", "thread_count": r"(?i)(?:Threads?|thread\s+count)\s*[:=]?\s*(\d+)"}


def explode_lines(logs: DataFrame) -> DataFrame:
    """``logs(log_id, content)`` to ``(log_id, line_no, text)``, lines counted from 1."""
    return logs.select("log_id", F.posexplode(F.split("content", r"\r?\n")).alias("p", "text")).select("log_id", (F.col("p") + 1).alias("line_no"), "text")


def assign_sections(lines: DataFrame, markers: Sequence[tuple[str, str]] = (("registers", r"^Registers:"), ("maps", r"^Maps:|^Binary Images:"), ("hilog", r"^HiLog:"), ("crash_thread", r"^Thread\s+\d+\s+Crashed:"), ("thread", r"^(?:Thread\s+\d+|Tid:\s*\d+|\"[^\"]+\".*tid=)"), ("backtrace", r"^backtrace:"))) -> DataFrame:
    """Adds ``section`` and ``block``: the last marker line's name, and how many marker lines came so far."""
    kind = None
    for name, pattern in markers:
        cond = F.col("text").rlike(pattern)
        kind = F.when(cond, name) if kind is None else kind.when(cond, name)
    w = Window.partitionBy("log_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("_m", kind)
    return rows.withColumn("section", F.last("_m", ignorenulls=True).over(w)).withColumn("block", F.count("_m").over(w)).withColumn("is_header", F.col("_m").isNotNull()).drop("_m")


def detect_sections(logs: DataFrame) -> DataFrame:
    """The sections that each log contains, in their order."""
    found = F.array(*[F.when(F.col("content").rlike(p), F.lit(n)) for n, p in SECTIONS])
    return logs.select("log_id", F.filter(found, lambda x: x.isNotNull()).alias("sections"))


def parse_maps(lines: DataFrame) -> DataFrame:
    """Linux mappings and Apple binary images (whose end is inclusive) to ``(log_id, ord, start, end, executable, file_offset,
    path)``; placeholders and images over all addresses are left out."""
    t = F.col("text")
    linux, apple = r"^\s*([0-9a-fA-F]+)-([0-9a-fA-F]+)\s+([r-][w-][x-][ps-]?)\s+([0-9a-fA-F]+)\s+\S+\s+\d+\s*(.*)$", r"^\s*0x([0-9a-fA-F]+)\s*-\s*0x([0-9a-fA-F]+)\s+\+?(\S+)\s+(\S+).*?(/\S.*)?$"
    g = lambda p, i: F.regexp_extract(t, p, i)
    as_linux = F.struct(address(g(linux, 1)).alias("start"), address(g(linux, 2)).alias("end"), g(linux, 3).contains("x").alias("executable"), address(g(linux, 4)).alias("file_offset"), F.trim(g(linux, 5)).alias("path"), F.lit("").alias("arch"))
    as_apple = F.struct(address(g(apple, 1)).alias("start"), (address(g(apple, 2)) + 1).cast("decimal(20,0)").alias("end"), F.lit(True).alias("executable"), F.lit(0).cast("decimal(20,0)").alias("file_offset"), F.coalesce(F.nullif(g(apple, 5), F.lit("")), g(apple, 3)).alias("path"), F.lower(g(apple, 4)).alias("arch"))
    rows = lines.select("log_id", F.col("line_no").alias("ord"), F.when(t.rlike(linux), as_linux).when(t.rlike(apple), as_apple).alias("m")).where("m is not null").select("log_id", "ord", "m.*")
    return rows.where("end > start and path not in ('???', '??') and arch not in ('unknown-arch', 'unknown') and not (start = 0 and end >= 18446744073709551615)").drop("arch")


def parse_registers(lines: DataFrame) -> DataFrame:
    """Register lines to ``(log_id, reg, va, is_null, is_fill)``, the first value of each register."""
    pairs = F.explode(F.arrays_zip(F.expr(r"regexp_extract_all(text, '(?i)\\b([xr]\\d{1,2}|sp|pc|lr|fp|cpsr|r[abcd]x|r[sd]i|rbp|rsp|rip)\\s*[:= ]\\s*(?:0x)?([0-9a-fA-F]{8,16})\\b', 1)").alias("reg"), F.expr(r"regexp_extract_all(text, '(?i)\\b([xr]\\d{1,2}|sp|pc|lr|fp|cpsr|r[abcd]x|r[sd]i|rbp|rsp|rip)\\s*[:= ]\\s*(?:0x)?([0-9a-fA-F]{8,16})\\b', 2)").alias("hex")))
    rows = lines.select("log_id", "line_no", pairs.alias("p")).select("log_id", F.lower("p.reg").alias("reg"), F.struct("line_no", F.col("p.hex").alias("hex")).alias("at"))
    first = rows.groupBy("log_id", "reg").agg(F.min("at").alias("at")).select("log_id", "reg", address(F.col("at.hex")).alias("va"), F.lower(F.col("at.hex")).alias("hex"))
    return first.withColumn("is_null", F.col("va") == 0).withColumn("is_fill", F.col("hex").rlike("(6b){4,}")).drop("hex")


def parse_build_ids(lines: DataFrame) -> DataFrame:
    """Build id of each module's base name, the first seen, in lower case."""
    p = r"(?i)([^\s/(]+\.(?:so|dylib|hap|z\.so))[^\n]*?(?:build\s?id)\s*[:=]\s*([0-9a-f]{8,40})"
    rows = lines.where(F.col("text").rlike(p)).select("log_id", "line_no", F.regexp_extract("text", p, 1).alias("module"), F.lower(F.regexp_extract("text", p, 2)).alias("build_id"))
    return rows.groupBy("log_id", "module").agg(F.min_by("build_id", "line_no").alias("build_id"))


def detect_os(content: Column) -> Column:
    """Operating system by ordered signs in the text; those of iOS come before those of Harmony, whose name is part of words."""
    has = lambda p: content.rlike(p)
    fatal = has(r"(?i)\bfatal signal\b") & (has(r"(?im)^\s*Cmdline:\s*com\.") | has(r"(?i)\bpid:\s*\d+,\s*tid:\s*\d+,\s*name:") | has(r"(?i)base\.apk!"))
    mac = has(r"(?im)^\s*OS Version:\s*(?:macOS|Mac OS X)\b")
    apple = has(r"(?m)^\s*Crashed Thread:\s*\d+\s*$") & has(r"(?m)^\s*Exception Type:\s*") & has(r"(?i)report version:") & has(r"(?i)identifier:|process:")
    return (
        F.when(has(r"(?i)^\s*crashdiag") & (has(r'(?i)"platform"\s*:\s*"(?:Harmony|HarmonyOS|OpenHarmony)"') | (content.contains('"attributed_stack"') & content.contains('"stack_frames"'))), "harmonyos")
        .when(content.contains("平台: mac"), "macos")
        .when(has(r"(?im)^\s*OS Version:\s*(?:iPhone OS|iPadOS|iOS)\b|^\s*Hardware Model:\s*(?:iPhone|iPad|iPod)"), "ios")
        .when(has(r"(?i)harmonyos|openharmony|build info:mro|com\.ohos\.|\bohos\b"), "harmonyos")
        .when(has(r"(?i)build fingerprint|dalvik|android") | fatal, "android")
        .when(apple & ~mac, "ios")
        .when(mac | has(r"(?i)apple llvm"), "macos")
        .when(has(r"(?i)gdb|core dump|segmentation fault") & content.contains("#"), "linux")
        .when(has(r"(?i)exception code:|faulting module:|windows") & has(r"(?i)call stack:"), "windows")
        .otherwise("unknown")
    )


def android_traces(content: Column) -> Column:
    """Whether a text without the word looks like thread traces of a stuck Android process: native and Java frames under a thread's
    head, and no sign of a fatal signal."""
    has = lambda p: content.rlike(p)
    frames = has(r"(?:native:\s*)?#\d+\s+pc\s+[0-9a-fA-Fx]+") & has(r"(?m)^\s*at\s+\S")
    head = has(r"(?m)^\s*native:\s*#") | F.regexp_extract(content, r"^([^\r\n]*)", 1).rlike(r'(?i)^\s*"[^"]+"\s+prio=\d+\s+tid=\d+\s+')
    fatal = has(r"(?i)fatal signal") | has(r"(?im)^\s*signal\s+\d+\s+\(") | content.contains("*** *** *** *** *** *** *** *** *** *** *** *** *** *** *** ***")
    return (detect_os(content) == "android") & frames & head & ~fatal


def classify_log_kind(logs: DataFrame) -> DataFrame:
    """``logs(log_id, content)`` to ``(log_id, log_kind, confidence, reasons)``; freeze before memory before Java before native."""
    return logs.select("log_id", log_kind(F.coalesce("content", F.lit(""))).alias("r")).select("log_id", "r.*")


def log_kind(content: Column) -> Column:
    """Struct of a log's kind, the confidence, and the reasons in the order in which they were found."""
    head = F.substring(content, 1, HEAD)
    has = lambda p: head.rlike(p)
    freeze, dog, anr, sig = has(APP_FREEZE), has(WATCHDOG), has(ANR), has(CRASH_SIGNAL)
    traces = android_traces(content)
    family = freeze | dog | anr | traces
    kind = F.when(freeze, "app_freeze").when(dog, "watchdog").otherwise("anr_trace")
    conf = F.when(freeze, 0.95).when(dog, 0.9).when(anr, 0.92).otherwise(0.75)
    why = F.when(freeze, "keyword:AppFreeze").when(dog, "keyword:watchdog").when(anr, "keyword:ANR").otherwise("android_traces_heuristic")
    as_col = lambda x: F.lit(x) if isinstance(x, (str, float)) else x
    out = lambda k, c, *reasons: F.struct(as_col(k).alias("log_kind"), as_col(c).alias("confidence"), F.array(*map(as_col, reasons)).alias("reasons"))
    oom, pressure, java = has(OOM_KILL), has(MEMORY_PRESSURE), has(JAVA_FATAL)
    return (
        F.when(~content.rlike(r"\S"), out("unknown", 0.0, "empty_content"))
        .when(family & sig & (kind == "watchdog") & ~has(FAULTING), out("watchdog", conf, why, "sigkill_is_watchdog_termination"))
        .when(family & sig, out("mixed_anr_crash", F.least(F.lit(0.95), conf + 0.05), why, "crash_signal_with_anr_family"))
        .when(family, out(kind, conf, why))
        .when(oom & sig & ~has("(?i)OutOfMemoryError"), out("mixed_oom_crash", 0.9, "keyword:oom_kill", "crash_signal_with_oom"))
        .when(oom, out("oom_kill", 0.92, "keyword:oom_kill"))
        .when(pressure & sig, out("mixed_oom_crash", 0.8, "keyword:memory_pressure", "crash_signal_with_memory_pressure"))
        .when(pressure, out("memory_pressure", 0.75, "keyword:memory_pressure"))
        .when(java & ~sig, out("java_crash", 0.88, "keyword:FATAL_EXCEPTION"))
        .when(java, out("native_crash", 0.7, "java_fatal_with_native_signal"))
        .when(sig, out("native_crash", 0.85, "crash_signal_or_tombstone"))
        .when(has(NATIVE_HINT), out("native_crash", 0.65, "native_crash_layout_hint"))
        .otherwise(out("unknown", 0.3, "no_strong_markers"))
    )


def extract_headers(lines: DataFrame, table: Sequence[tuple[str, str, int]] = HEADERS) -> DataFrame:
    """Header fields ``(log_id, field, value)`` by a table of (field, pattern, priority): the best priority, then the first line, wins.

    A value is its pattern's first group without outer spaces; empty values say nothing. ``arch`` comes in one spelling a machine.
    Lines are matched each by itself and fields are aggregated per log; a null line has none.
    """
    found = [F.when(F.col("text").rlike(p), F.struct(F.lit(f).alias("field"), F.lit(pr).alias("priority"), F.trim(F.regexp_extract("text", p, 1)).alias("value"))) for f, p, pr in table]
    rows = lines.select("log_id", "line_no", F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("h")).select("log_id", "line_no", "h.*").where("value <> ''")
    best = rows.groupBy("log_id", "field").agg(F.min_by("value", F.struct("priority", "line_no")).alias("value"))
    spelt = F.try_element_at(F.create_map(*[F.lit(x) for kv in ARCH_NAMES.items() for x in kv]), F.lower("value"))
    return best.withColumn("value", F.when(F.col("field") == "arch", F.coalesce(spelt, F.col("value"))).otherwise(F.col("value")))


def parse_status(logs: DataFrame, frames: DataFrame) -> DataFrame:
    """ok; partial_log for frames without a header marker; error without frames."""
    n = frames.groupBy("log_id").agg(F.count("*").alias("frames"))
    header = F.col("content").rlike(r"(?i)signal|Exception Type:|FATAL EXCEPTION|Reason:")
    return logs.join(n, "log_id", "left").select("log_id", F.when(F.col("frames").isNull(), "error").when(header, "ok").otherwise("partial_log").alias("status"))


def abort_flags(content: Column) -> Column:
    """Abort message and the predicates heap abort, watchdog, jetsam, destroyed mutex."""
    return F.struct(F.nullif(F.regexp_extract(content, r"(?im)Abort message:\s*'?([^'\n]+)", 1), F.lit("")).alias("abort_message"), content.rlike(r"(?i)heap corruption|double free|invalid pointer|malloc.*(?:corrupt|abort)|scudo").alias("heap_abort"), content.rlike(WATCHDOG).alias("watchdog"), content.rlike(r"(?i)\bjetsam\b").alias("jetsam"), content.rlike(r"(?i)pthread_mutex_(?:lock|destroy) called on a destroyed mutex").alias("destroyed_mutex"))


def extract_timeline(lines: DataFrame, least: int = 3, last: int = 50, prefer_hilog: bool = False) -> DataFrame:
    """Timeline entries ``(log_id, line_no, format, ts, level, tag, message)`` of the first format with ``least`` lines, the last
    ``last`` of them. Lines of the third format also fit the first, which is tried before; ``prefer_hilog`` swaps the two."""
    t = F.col("text")
    g = lambda p, i: F.regexp_extract(t, p, i)
    entry = lambda rank, name, ts, level, tag, msg: F.struct(F.lit(rank).alias("rank"), F.lit(name).alias("format"), ts.alias("ts"), level.alias("level"), tag.alias("tag"), msg.alias("message"))
    a, b = (2, 0) if prefer_hilog else (0, 2)
    formats = F.array(F.when(t.rlike(LOGCAT), entry(a, "android_logcat", g(LOGCAT, 1), g(LOGCAT, 2), g(LOGCAT, 3), g(LOGCAT, 4))), F.when(t.rlike(SYSLOG), entry(1, "ios_syslog", g(SYSLOG, 1), F.lit("I"), g(SYSLOG, 2), g(SYSLOG, 3))), F.when(t.rlike(HILOG), entry(b, "harmony_hilog", g(HILOG, 1), g(HILOG, 2), g(HILOG, 4), g(HILOG, 5))), F.when(t.rlike(GENERIC), entry(3, "generic", g(GENERIC, 1), F.lit("I"), F.lit(""), t)))
    rows = lines.select("log_id", "line_no", F.inline(F.filter(formats, lambda x: x.isNotNull())))
    chosen = rows.groupBy("log_id", "rank").agg(F.count("*").alias("n")).where(F.col("n") >= least).groupBy("log_id").agg(F.min("rank").alias("rank"))
    kept = rows.join(chosen, ["log_id", "rank"])
    return kept.withColumn("_a", F.row_number().over(Window.partitionBy("log_id").orderBy(F.desc("line_no")))).where(F.col("_a") <= last).drop("_a", "rank")


def classify_ops(timeline: DataFrame) -> DataFrame:
    """Adds ``category``: the first operation class that tag and message show; lines of none are dropped."""
    text, category = F.concat_ws(" ", "tag", "message"), None
    for p, name in OPERATIONS:
        category = F.when(text.rlike("(?i)" + p), name) if category is None else category.when(text.rlike("(?i)" + p), name)
    return timeline.withColumn("category", category).where("category is not null")


def timeline_gate(logs: DataFrame, strong: int = 3, preview: int = 200_000, force: bool = False) -> DataFrame:
    """Logs worth a timeline: of 80 characters without outer spaces, and with a log section (where ``logs`` has an array ``sections``),
    a banner in the first ``preview`` characters, ``strong`` lines of one strong format, or an iOS heading; all with ``force``."""
    if force:
        return logs
    head = F.substring(F.trim("content"), 1, preview)
    lines = lambda p: F.regexp_count(head, F.lit(p))
    worth = F.lower(head).rlike(TIMELINE_BANNERS) | (lines(TIMELINE_LOGCAT) >= strong) | (lines(TIMELINE_HILOG) >= strong) | head.rlike(TIMELINE_IOS)
    if "sections" in logs.columns:
        worth = worth | F.exists(F.coalesce("sections", F.array().cast("array<string>")), lambda x: F.lower(F.trim(x)).isin(*TIMELINE_SECTIONS) | F.lower(x).contains("log"))
    return logs.where((F.length(F.trim("content")) >= 80) & F.coalesce(worth, F.lit(False)))


def memory_indicators(logs: DataFrame, head: int = 20_000) -> DataFrame:
    """Flags and values of memory evidence in the first characters of each log: ``has_<flag>``, and of each metric its number, its
    unit's first letter in capitals (null where none is said) and the bytes that both make, a number without a unit being kilobytes."""
    t = F.substring("content", 1, head)
    part = lambda p, i: F.nullif(F.regexp_extract(t, p, i), F.lit(""))
    scale = lambda u: F.when(u.startswith("G"), 1 << 30).when(u.startswith("M"), 1 << 20).otherwise(1 << 10)
    values = []
    for name, pattern in MEMORY_VALUES.items():
        number, unit = part(pattern, 1).try_cast("double"), F.upper(part(pattern, 2))
        values += [number.alias(name), unit.alias(f"{name}_unit"), F.when(number.isNotNull(), number * scale(F.coalesce(unit, F.lit("K")))).cast("long").alias(f"{name}_bytes")]
    counts = [part(p, 1).try_cast("long").alias(n) for n, p in MEMORY_COUNTS.items()]
    return logs.select("log_id", *[F.coalesce(t.rlike(p), F.lit(False)).alias(f"has_{k}") for k, p in MEMORY_FLAGS.items()], *values, *counts)


def memory_subtype(indicators: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """Adds ``memory_subtype`` to :func:`memory_indicators` from the flags and, where ``facts(log_id, log_kind, category)`` are known, from
    the log's kind and the crash's category; eight classes in order, the last where nothing else is said."""
    rows = indicators.join(facts.select("log_id", "log_kind", F.lower("category").alias("category")), "log_id", "left") if facts is not None else indicators.withColumns({"log_kind": F.lit(None).cast("string"), "category": F.lit(None).cast("string")})
    c, said = F.col, lambda *flags: F.greatest(*[F.col(f"has_{f}") for f in flags], F.lit(False))
    kind = lambda k: F.coalesce(c("log_kind") == k, F.lit(False))
    subtype = (
        F.when(kind("mixed_oom_crash"), "mixed_oom_with_crash")
        .when(said("oom"), "java_oom")
        .when(said("jetsam", "lmk", "resource"), "system_oom_kill")
        .when(said("enomem"), "native_alloc_failure")
        .when(kind("oom_kill"), "oom_kill")
        .when(kind("memory_pressure") | said("pressure", "trim"), "memory_pressure")
        .when(c("category") == "oom", "oom_category")
        .otherwise("memory_related")
    )
    return rows.withColumn("memory_subtype", subtype).drop("log_kind", "category")


def api_state_counts(content: Column) -> Column:
    """How often player state calls are named, whether resets repeat, whether it is prepared far more often than played, and whether
    either sends the case on to the application."""
    count = {c: F.regexp_count(F.coalesce(content, F.lit("")), F.lit(rf"(?i)\b{c}\b")) for c in ("reset", "stop", "prepare", "play", "release")}
    resets = count["reset"] >= 3
    unready = (count["play"] > 0) & (count["prepare"] > 2 * count["play"])
    return F.struct(*[n.alias(c) for c, n in count.items()], resets.alias("repeated_reset"), unready.alias("prepared_in_vain"), (resets | unready).alias("escalate_to_app"))


def normalize_api_errors(rows: DataFrame) -> DataFrame:
    """Adds ``code_norm``: the code field, else ``code: value`` in the text; hex codes become decimal."""
    raw = F.coalesce(F.nullif(F.trim(F.col("code").cast("string")), F.lit("")), F.nullif(F.regexp_extract("text", r"(?im)^\s*(?:error\s*)?code\s*[:=]\s*(\S+)", 1), F.lit("")))
    return rows.withColumn("code_norm", F.when(raw.rlike("(?i)^0x[0-9a-f]+$"), F.conv(F.substring(raw, 3, 16), 16, 10)).otherwise(raw))


def extract_js_errors(logs: DataFrame) -> DataFrame:
    """Reason, name, message and code of script errors, from ``label: value`` lines."""
    field = lambda p: F.nullif(F.trim(F.regexp_extract("content", p, 1)), F.lit("")).alias
    return logs.select("log_id", field(r"(?im)^\s*Reason\s*:\s*(.+)$")("reason"), field(r"(?im)^\s*Error name\s*:\s*(.+)$")("name"), field(r"(?im)^\s*Error message\s*:\s*(.+)$")("message"), field(r"(?im)^\s*Error code\s*:\s*(.+)$")("code"))


def parse_queue_events(logs: DataFrame) -> DataFrame:
    """Event-queue dump lines ``name, trigger = ms, complete = ms`` to rows; open events last until the dump time."""
    p = r"(?i)task name\s*=\s*([^,\n]+),\s*trigger time\s*=\s*(\d+)(?:,\s*complet\w* time\s*=\s*(\d+))?"
    rows = explode_lines(logs).where(F.col("text").rlike(p))
    dump = F.nullif(F.regexp_extract("content", r"(?i)curTime\s*[:=]\s*(\d+)", 1), F.lit("")).try_cast("double")
    end = F.nullif(F.regexp_extract("text", p, 3), F.lit("")).try_cast("double")
    return rows.join(logs.select("log_id", dump.alias("dump_ms")), "log_id").select("log_id", "line_no", F.trim(F.regexp_extract("text", p, 1)).alias("name"), (F.coalesce(end, "dump_ms") - F.regexp_extract("text", p, 2).try_cast("double")).alias("duration_ms"), end.isNull().alias("open"))


def parse_queue_state(logs: DataFrame) -> DataFrame:
    """Of each log's last queue dump the running task, how long it has run at the dump, and events waiting by priority:
    ``(log_id, running_task, running_ms, pending map, pending_total)``."""
    stamp = r"(\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}\.\d+)"
    last = lambda p, i: F.element_at(F.concat(F.array(F.lit("")), F.regexp_extract_all("content", F.lit(p), F.lit(i))), -1)
    run = rf"(?i)Current Running:\s*start\s+at\s+{stamp}\s*,\s*Event\s*\{{([^}}]*)\}}"
    size = r"(?i)Total\s+size\s+of\s+(\w+)\s+events\s*:\s*(\d+)"
    micros = lambda c: F.unix_micros(c.try_cast("timestamp"))
    name = F.coalesce(F.nullif(F.trim(F.regexp_extract(last(run, 2), r"(?i)task\s*name\s*=\s*([^,}]+)", 1)), F.lit("")), F.when(last(run, 2) != "", F.lit("unknown_event")))
    ms = (micros(last(rf"(?i)EventHandler\s+dump\s+begin\s+curTime:\s*{stamp}", 1)) - micros(last(run, 1))) / 1000
    entries = F.arrays_zip(F.regexp_extract_all("content", F.lit(size), F.lit(1)).alias("k"), F.transform(F.regexp_extract_all("content", F.lit(size), F.lit(2)), lambda x: x.cast("int")).alias("v"))
    pending = F.aggregate(entries, F.create_map().cast("map<string,int>"), lambda m, e: F.map_concat(F.map_filter(m, lambda k, _: k != e["k"]), F.create_map(e["k"], e["v"])))
    rows = logs.select("log_id", name.alias("running_task"), ms.alias("running_ms"), pending.alias("pending"))
    return rows.withColumn("pending_total", F.aggregate(F.map_values("pending"), F.lit(0), lambda a, x: a + x))


def parse_wait_edges(logs: DataFrame) -> DataFrame:
    """Binder transactions and ``waiting on`` phrases to ``(log_id, src, dst, code, wait_seconds, ipc_full, ord)``."""
    binder = r"(\d+:\d+) to (\d+:\d+) code (\S+) wait:([\d.]+) s"
    generic = r"(?i)(\S+)\s+(?:waiting on|waiting for|blocked on|held by)\s+(\S+)"
    g = lambda p, i: F.regexp_extract("text", p, i)
    edge = lambda src, dst, code, wait, full: F.struct(src.alias("src"), dst.alias("dst"), code.cast("string").alias("code"), wait.cast("double").alias("wait_seconds"), full.alias("ipc_full"))
    a = edge(g(binder, 1), g(binder, 2), g(binder, 3), g(binder, 4).try_cast("double"), g(binder, 2).endswith(":0"))
    b = edge(g(generic, 1), g(generic, 2), F.lit(None), F.lit(None), F.lit(False))
    found = F.when(F.col("text").rlike(binder), a).when(F.col("text").rlike(generic), b)
    # a generator tries each line once
    rows = explode_lines(logs).select("log_id", F.col("line_no").alias("ord"), F.inline(F.filter(F.array(found), lambda e: e.isNotNull())))
    return rows.select("log_id", "src", "dst", "code", "wait_seconds", "ipc_full", "ord")


def parse_mem_samples(lines: DataFrame) -> DataFrame:
    """Sample tables to ``(log_id, line_no, metric, value, is_trigger)``: columns by the header line, ``*`` marks the trigger row."""
    w = Window.partitionBy("log_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    cells = F.split(F.trim("text"), r"\s{2,}|\t|,(?!\d{3}\b)\s*")
    rows = lines.withColumn("_h", F.when(F.col("text").contains("RSS(KB)"), cells)).withColumn("head", F.last("_h", ignorenulls=True).over(w)).where("head is not null and _h is null").withColumn("cells", cells).where(F.size("cells") == F.size("head"))
    long = rows.select("log_id", "line_no", F.col("text").contains("*").alias("is_trigger"), F.explode(F.arrays_zip("head", "cells")).alias("c"))
    return long.select("log_id", "line_no", F.col("c.head").alias("metric"), lenient_number(F.col("c.cells")).alias("value"), "is_trigger")


def parse_smaps(lines: DataFrame) -> DataFrame:
    """``/proc`` mapping blocks to ``(log_id, block, name, size_kb, rss_kb, pss_kb, swap_pss_kb)``."""
    head = r"^[0-9a-fA-F]+-[0-9a-fA-F]+\s+\S+\s+\S+\s+\S+\s+\d+\s*(.*)$"
    w = Window.partitionBy("log_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("_n", F.when(F.col("text").rlike(head), F.trim(F.regexp_extract("text", head, 1)))).withColumn("block", F.count("_n").over(w)).where("block > 0")
    value = lambda k: F.max(F.regexp_extract("text", rf"^{k}:\s+(\d+)\s*kB", 1).try_cast("double"))
    return rows.groupBy("log_id", "block").agg(F.max("_n").alias("name"), value("Size").alias("size_kb"), value("Rss").alias("rss_kb"), value("Pss").alias("pss_kb"), F.coalesce(value("SwapPss"), F.lit(0.0)).alias("swap_pss_kb"))


def parse_smaps_table(lines: DataFrame) -> DataFrame:
    """A vendor's table of mappings to ``(log_id, line_no, name, size_kb, pss_kb, swap_pss_kb)``: columns by the head line with ``Size
    Rss Pss`` and ``Name``, cells two spaces apart, rows that begin with a number."""
    w = Window.partitionBy("log_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    cells = F.split(F.trim("text"), r"\s{2,}")
    head = F.col("text").rlike(r"\bSize\s+Rss\s+Pss\b") & F.col("text").contains("Name")
    rows = lines.withColumn("_h", F.when(head, F.transform(cells, lambda x: F.lower(x)))).withColumn("_names", F.first("_h", ignorenulls=True).over(w)).where("_names is not null and _h is null")
    rows = rows.withColumn("_c", cells).where((F.size("_c") >= 3) & F.get("_c", F.lit(0)).rlike(r"^[\d,]+$"))
    at = lambda n: F.when(F.array_position("_names", F.lit(n)) > 0, F.get("_c", F.array_position("_names", F.lit(n)).cast("int") - 1))
    number = lambda *names: F.coalesce(*[F.regexp_replace(at(n), ",", "").try_cast("double") for n in names], F.lit(0.0))
    return rows.select("log_id", "line_no", F.coalesce(at("name"), F.element_at("_c", -1)).alias("name"), number("size").alias("size_kb"), number("pss").alias("pss_kb"), number("swappss", "swap pss").alias("swap_pss_kb"))


def parse_nmd(lines: DataFrame) -> DataFrame:
    """Allocator snapshots to ``(log_id, snapshot_no, size_bytes, allocated_bytes)``; a ``snapshot`` line starts each."""
    w = Window.partitionBy("log_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    p = r"^\s*(?:bin|size)\s*[:=]?\s*(\d+)\D+allocated\s*[:=]?\s*(\d+)"
    rows = lines.withColumn("snapshot_no", F.sum(F.col("text").rlike(r"(?i)^\s*snapshot\b").cast("int")).over(w))
    return rows.where(F.col("text").rlike("(?i)" + p)).select("log_id", "snapshot_no", F.regexp_extract("text", "(?i)" + p, 1).cast("long").alias("size_bytes"), F.regexp_extract("text", "(?i)" + p, 2).cast("long").alias("allocated_bytes"))


def parse_kernel_memory(lines: DataFrame) -> DataFrame:
    """GPU totals and categories, slab caches (active objects times their size) and shared memory to ``(log_id, kind, item, bytes)``.

    Slab rows follow a ``slabinfo`` head, shared memory rows the head of its process table; DMA rows are :func:`parse_dma`'s.
    """
    w = Window.partitionBy("log_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    table = F.when(F.col("text").rlike(r"slabinfo - version|^\s*# name"), "slab").when(F.col("text").contains("Process_name Virtual_size Physical_size"), "ashmem").when(F.col("text").rlike(r"^\s*[*=-]{3,}"), "")
    rows = lines.withColumn("_t", table).withColumn("_in", F.last("_t", ignorenulls=True).over(w)).where("_t is null")
    g = lambda p, i: F.regexp_extract("text", p, i)
    total, category, slab, shared = r"(?i)^\s*Total\s+\S+\s*\(device\)\s*:\s*(\d+)", r"C:([^:]+):\s*(\d+)", r"^\s*(\S+)\s+(\d+)\s+(\d+)\s+(\d+)(?:\s|$)", r"^\s*(\S+)\s+(\d+)\s+(\d+)(?:\s|$)"
    row = lambda kind, item, size: F.struct(F.lit(kind).alias("kind"), item.alias("item"), size.alias("bytes"))
    found = (
        F.when(F.col("text").rlike(total), row("gpu_total", F.lit("total"), g(total, 1).try_cast("long")))
        .when(F.col("text").rlike(category), row("gpu", F.trim(g(category, 1)), g(category, 2).try_cast("long")))
        .when((F.col("_in") == "slab") & F.col("text").rlike(slab), row("slab", g(slab, 1), g(slab, 2).try_cast("long") * g(slab, 4).try_cast("long")))
        .when((F.col("_in") == "ashmem") & F.col("text").rlike(shared), row("ashmem", g(shared, 1), g(shared, 3).try_cast("long") * 1024))
    )
    return rows.select("log_id", found.alias("f")).where("f is not null").select("log_id", "f.*")


def parse_dma(lines: DataFrame) -> DataFrame:
    """Rows of a DMA buffer table to ``(log_id, line_no, process_name, pid, size_bytes, magic, buf_name, buf_type, leak_type)``, by the
    names in its head line; rows without bytes and totals are left out, a rule of signs ends the table."""
    names = {"process": "process_name", "process name": "process_name", "pid": "pid", "process id": "pid", "size_bytes": "size_bytes", "size": "size_bytes", "ino": "magic", "magic": "magic", "buf_name": "buf_name", "buf_type": "buf_type", "leak_type": "leak_type"}
    wide = lambda c: F.when(F.size(F.split(c, r"\t|\s{2,}")) >= 3, F.split(c, r"\t|\s{2,}")).otherwise(F.split(c, r"\s+"))
    w = Window.partitionBy("log_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    head = F.col("text").rlike(r"\b[Pp]rocess\b.*\bpid\b.*\b(?:size_bytes|size)\b")
    mark = F.when(head, F.transform(wide(F.trim("text")), lambda x: F.lower(x))).when(F.col("text").rlike(r"^\s*[*=-]{5,}"), F.array().cast("array<string>"))
    rows = lines.withColumn("_m", mark).withColumn("_h", F.last("_m", ignorenulls=True).over(w)).where("_m is null and size(_h) > 0").withColumn("_c", wide(F.trim("text")))
    value = lambda target: F.coalesce(*[F.get("_c", F.when(F.array_position("_h", F.lit(n)) > 0, F.array_position("_h", F.lit(n)).cast("int") - 1)) for n, t in names.items() if t == target])
    size = F.regexp_replace(value("size_bytes"), ",", "").try_cast("long")
    out = rows.where(~F.array_contains("_c", "Total")).select("log_id", "line_no", value("process_name").alias("process_name"), value("pid").alias("pid"), size.alias("size_bytes"), *[value(c).alias(c) for c in ("magic", "buf_name", "buf_type", "leak_type")])
    return out.where("size_bytes > 0")


def text_flags(docs: DataFrame, words: dict[str, Sequence[str]], id_col: str, text_col: str) -> DataFrame:
    """A boolean column for each group of words, true where the lower-cased text contains one."""
    low = F.lower(F.coalesce(text_col, F.lit("")))
    return docs.select(id_col, *[any_of(low, w).alias(k) for k, w in words.items()])
