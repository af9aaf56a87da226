"""Jank frames, CPU states, event queues, freezes and operation sequences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.operators.leak import any_of

#: Hints of what made a frame late, contained anywhere in its description.
JANK_HINTS = [
    ("JANK-FM-01", ("main", "ui", "business", "handler"), "Application"),
    ("JANK-FM-02", ("build", "component"), "ArkUI"),
    ("JANK-FM-03", ("layout", "measure"), "ArkUI"),
    ("JANK-FM-04", ("render", "draw", "paint"), "Render"),
    ("JANK-FM-05", ("fence", "display", "vsync"), "System"),
    ("JANK-FM-06", ("gc", "garbage collection"), "Runtime"),
    ("JANK-FM-07", ("io", "i/o", "disk", "file"), "Application"),
    ("JANK-FM-08", ("sched", "preempt", "runnable", "cpu"), "System"),
]
#: Names of thread states.
CPU_STATES = {"running": "running", "run": "running", "runnable": "runnable", "ready": "runnable", "sleeping": "sleeping", "sleep": "sleeping", "blocked": "blocked", "block": "blocked", "io_wait": "io_wait", "i/o wait": "io_wait", "iowait": "io_wait", "preempted": "preempted", "preempt": "preempted"}
#: Freeze kinds by the first hint in the text, and their limits in ms.
FREEZE_KINDS = [
    ("INPUT_BLOCK", 5000, ("INPUT_BLOCK", "INPUT BLOCK")),
    ("LIFECYCLE_TIMEOUT", 5000, ("LIFECYCLE_TIMEOUT", "LIFECYCLE TIMEOUT")),
    ("RENDER_SERVICE_TIMEOUT", 6000, ("RENDER_SERVICE", "RENDER SERVICE")),
    ("FFRT_TIMEOUT", 6000, ("FFRT", "FFRT_TIMEOUT")),
    ("THREAD_BLOCK_20S", 20000, ("THREAD_BLOCK_20S", "20S")),
    ("THREAD_BLOCK_6S", 6000, ("THREAD_BLOCK_6S", "6S")),
    ("THREAD_BLOCK_3S", 3000, ("THREAD_BLOCK_3S", "3S")),
    ("APPFREEZE", 6000, ("APPFREEZE", "APP FREEZE", "ANR")),
]


def lenient_bool(text: Column) -> Column:
    """True for 1, true, yes, y, jank and dropped in any case; false for all else, null too."""
    return F.coalesce(F.lower(F.trim(text.cast("string"))).isin("1", "true", "yes", "y", "jank", "dropped"), F.lit(False))


def lenient_number(text: Column) -> Column:
    """A number without stars and thousands commas; ``~``, ``-``, ``N/A`` and the like are null."""
    return F.regexp_replace(F.trim(text.cast("string")), r"[*,]", "").try_cast("double")


def coalesce_aliases(df: DataFrame, spec: dict[str, Sequence[str]]) -> DataFrame:
    """Adds each column of ``spec`` as the first non-empty of its aliases; names match in any case, spaces as underscores."""
    have = {c.lower().replace(" ", "_"): c for c in reversed(df.columns)}
    cols = []
    for target, aliases in spec.items():
        found = [F.nullif(F.trim(F.col(f"`{have[a.lower().replace(' ', '_')]}`").cast("string")), F.lit("")) for a in aliases if a.lower().replace(" ", "_") in have]
        cols.append((F.coalesce(*found) if found else F.lit(None).cast("string")).alias(target))
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in spec], *cols)


def mark_jank(frames: DataFrame, deadline: float = 16.67) -> DataFrame:
    """Adds ``dropped``: the flag says so, or the duration exceeds the deadline."""
    return frames.withColumn("dropped", lenient_bool(F.col("jank")) | F.coalesce(F.col("duration_ms") > deadline, F.lit(False)))


def jank_summary(frames: DataFrame, deadline: float = 16.67, top: int = 20) -> DataFrame:
    """Frames, janky ones, rate and the capped count per log."""
    by = mark_jank(frames, deadline).groupBy("log_id").agg(F.count("*").alias("frame_count"), F.count_if("dropped").alias("jank_count"), F.max("duration_ms").alias("max_ms"))
    return by.withColumn("jank_rate", F.col("jank_count") / F.col("frame_count")).withColumn("jank_count_capped", F.least("jank_count", F.lit(top)))


def jank_by_thread(frames: DataFrame, deadline: float = 16.67) -> DataFrame:
    """Frames, janky ones, total and longest duration per thread."""
    thread = F.coalesce("thread", F.lit("unknown")).alias("thread")
    return mark_jank(frames, deadline).groupBy("log_id", thread).agg(F.count("*").alias("frame_count"), F.count_if("dropped").alias("jank_count"), F.sum("duration_ms").alias("total_ms"), F.max("duration_ms").alias("max_ms"))


def jank_events(frames: DataFrame, deadline: float = 16.67, top: int = 20) -> DataFrame:
    """The longest janky frames of each log, ties by id."""
    rows = mark_jank(frames, deadline).where("dropped")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("log_id").orderBy(F.desc("duration_ms"), "frame_id"))).where(F.col("rank") <= top)


def jank_fault_modes(frames: DataFrame, fields: Sequence[str] = ("stage", "function", "category", "reason", "name")) -> DataFrame:
    """Fault modes whose hints a frame's description contains."""
    have = [F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields if f in frames.columns]
    text = F.lower(F.concat_ws(" ", *have))
    hits = F.filter(F.array(*[F.when(any_of(text, hints), F.struct(F.lit(i).alias("fault_mode"), F.lit(o).alias("owner"))) for i, hints, o in JANK_HINTS]), lambda x: x.isNotNull())
    return frames.select("log_id", "frame_id", F.inline(hits))


def cpu_state_stats(rows: DataFrame) -> DataFrame:
    """``rows(log_id, thread, state, duration_ms, duration_ns)``: time per thread in each known state, in ms."""
    names = F.create_map(*[F.lit(x) for kv in CPU_STATES.items() for x in kv])
    ms = F.coalesce(F.col("duration_ms"), F.col("duration_ns") / 1e6)
    known = rows.withColumn("known", F.try_element_at(names, F.lower(F.trim("state")))).where("known is not null")
    states = sorted(set(CPU_STATES.values()))
    return known.groupBy("log_id", F.coalesce("thread", F.lit("unknown")).alias("thread")).agg(*[F.coalesce(F.sum(F.when(F.col("known") == s, ms)), F.lit(0.0)).alias(s) for s in states])


def completion_latency(events: DataFrame, starts: Sequence[str] = ("touch", "input", "start"), ends: Sequence[str] = ("complete", "completed", "end")) -> DataFrame:
    """``events(log_id, event, ts, ord)``: first end minus first start, as ``ts`` counts."""
    name = F.lower("event")
    first = lambda names: F.min_by("ts", F.when(name.isin(*names), F.col("ord")))
    return events.groupBy("log_id").agg(first(starts).alias("start_ts"), first(ends).alias("end_ts")).where("start_ts is not null and end_ts is not null").withColumn("latency", F.col("end_ts") - F.col("start_ts"))


def queue_summary(queue: DataFrame, state: DataFrame, long_ms: float = 3000, waiting: int = 5) -> DataFrame:
    """``queue(log_id, name, duration_ms)`` and ``state(log_id, running_task, running_ms, pending_total)`` to depth and verdict.

    A log is blocked where its running task takes longer than ``long_ms``, else where an event did (``long_events`` counts such
    tasks by name), else where a task runs while ``waiting`` events or more are pending; ``cause`` says which.
    """
    late = F.col("duration_ms") > long_ms
    by = queue.groupBy("log_id").agg(F.count("*").alias("events"), F.countDistinct(F.when(late, F.col("name"))).alias("long_events"), F.max_by("name", F.struct("duration_ms", "name")).alias("longest_task"), F.max("duration_ms").alias("longest_ms"))
    rows = by.join(state.select("log_id", "running_task", "running_ms", "pending_total"), "log_id", "full").fillna(0, ["events", "long_events", "pending_total"])
    rows = rows.withColumn("queue_depth", F.when(F.col("pending_total") > 0, F.col("pending_total")).otherwise(F.col("events")).cast("long"))
    running = F.col("running_task").isNotNull()
    cause = F.when(running & (F.col("running_ms") > long_ms), "running_task").when(F.col("long_events") > 0, "long_events").when(running & (F.col("pending_total") >= waiting), "pending")
    return rows.withColumn("cause", cause).withColumn("verdict", F.when(F.col("cause").isNotNull(), "blocked").otherwise("normal"))


def long_queue_events(queue: DataFrame, long_ms: float = 3000) -> DataFrame:
    """Longest duration of each task name that exceeds ``long_ms``."""
    return queue.where(F.col("duration_ms") > long_ms).groupBy("log_id", "name").agg(F.max("duration_ms").alias("duration_ms"))


def classify_freeze(text: Column) -> Column:
    """Struct of freeze kind and limit by the first hint in the upper-cased text."""
    up = F.upper(F.coalesce(text, F.lit("")))
    out = F.struct(F.lit("UNKNOWN").alias("freeze_type"), F.lit(None).cast("int").alias("timeout_ms"))
    for kind, ms, hints in reversed(FREEZE_KINDS):
        out = F.when(any_of(up, hints), F.struct(F.lit(kind).alias("freeze_type"), F.lit(ms).alias("timeout_ms"))).otherwise(out)
    return out


def system_load(text: Column) -> Column:
    """Struct of CPU percent, free memory in MB, thermal flag and ``stressed``."""
    t = F.coalesce(text, F.lit(""))
    cpu = F.regexp_extract(t, r"(?i)cpu[^0-9%\n]{0,20}?([0-9]+(?:\.[0-9]+)?)\s*%", 1).try_cast("double")
    mem = F.regexp_extract(t, r"(?i)(?:mem(?:ory)?\s*available|available\s*mem(?:ory)?|memavailable)[^0-9\n]{0,10}([0-9]+)\s*(kb|mb)?", 1).try_cast("double")
    unit = F.lower(F.regexp_extract(t, r"(?i)(?:mem(?:ory)?\s*available|available\s*mem(?:ory)?|memavailable)[^0-9\n]{0,10}([0-9]+)\s*(kb|mb)?", 2))
    mb = F.when(unit == "kb", mem / 1024).otherwise(mem)
    hot = t.rlike(r"(?i)thermal throttling|low memory")
    return F.struct(cpu.alias("cpu_percent"), mb.alias("available_mb"), hot.alias("thermal"), (F.coalesce(cpu >= 85, F.lit(False)) | F.coalesce(mb < 800, F.lit(False)) | hot).alias("stressed"))


def freeze_fault_modes(signals: DataFrame) -> DataFrame:
    """``signals`` with one row a log of flags (stressed, has_cycle, binder_cycle, ipc_full, running_task, queue_depth, has_locks,
    verdict, busy, gc, and deep_dominant where known) to candidate modes, the best confidence for each id.

    A function that dominates the deep samples lifts FREEZE-FM-03, where it is found at all, to 0.85.
    """
    #: Ids, owners and confidences.
    modes = [
        ("stressed", "FREEZE-FM-11", "System", 0.85),
        ("has_cycle", "FREEZE-FM-06", "Application", 0.9),
        ("binder_cycle", "FREEZE-FM-05", "Application/System boundary", 0.88),
        ("ipc_full", "FREEZE-FM-12", "System boundary", 0.8),
        ("running_task is not null and running_task <> ''", "FREEZE-FM-01", "Application", 0.72),
        ("queue_depth > 0", "FREEZE-FM-07", "Application", 0.7),
        ("has_locks", "FREEZE-FM-04", "Application", 0.76),
        ("verdict = 'BLOCKED'", "FREEZE-FM-02", "Application", 0.8),
        ("verdict = 'BUSY'", "FREEZE-FM-03", "Application", 0.78),
        ("busy", "FREEZE-FM-03", "Application", 0.77),
        ("gc", "FREEZE-FM-08", "Runtime", 0.65),
    ]
    rows = F.filter(F.array(*[F.when(F.expr(cond), F.struct(F.lit(i).alias("fault_mode"), F.lit(o).alias("owner"), F.lit(c).alias("confidence"))) for cond, i, o, c in modes]), lambda x: x.isNotNull())
    deep = F.col("deep_dominant").isNotNull() if "deep_dominant" in signals.columns else F.lit(False)
    by = signals.select("log_id", deep.alias("_deep"), F.inline(rows)).groupBy("log_id", "fault_mode").agg(F.max("confidence").alias("confidence"), F.max_by("owner", "confidence").alias("owner"), F.bool_or("_deep").alias("_deep"))
    return by.withColumn("confidence", F.when(F.col("_deep") & (F.col("fault_mode") == "FREEZE-FM-03"), F.greatest("confidence", F.lit(0.85))).otherwise(F.col("confidence"))).drop("_deep")


def business_path(ops: DataFrame, last: int = 6) -> DataFrame:
    """``ops(log_id, ord, category)``: runs of one category collapsed, the last few joined by arrows."""
    w = Window.partitionBy("log_id").orderBy("ord")
    changes = ops.withColumn("before", F.lag("category").over(w)).where("before is null or before <> category")
    recent = changes.withColumn("age", F.row_number().over(Window.partitionBy("log_id").orderBy(F.desc("ord")))).where(F.col("age") <= last)
    return recent.groupBy("log_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "category"))), lambda x: x.category), " -> ").alias("path"))


def business_context(ops: DataFrame, action: str = "user_action", components: Sequence[str] = ("ui_navigation", "service", "lifecycle")) -> DataFrame:
    """Last user action, last active component, and the number of suspicious operations (levels E, F, W, or memory work)."""
    last = lambda cond: F.max_by("message", F.when(cond, F.col("ord")))
    return ops.groupBy("log_id").agg(last(F.col("category") == action).alias("last_user_action"), last(F.col("category").isin(*components)).alias("last_component"), F.count_if(F.col("level").isin("E", "F", "W") | (F.col("category") == "memory_mgmt")).alias("suspicious"))
