"""Memory leak evidence: outstanding allocations, memory trends, snapshots, mappings and shared buffers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: symbols and files of managed runtimes.
MANAGED = r"(?i)ark|js|hermes|dart|flutter|v8"
#: Fixed value: processes that hold buffers for others.
SYSTEM_PROCESSES = ("render_service", "surfaceflinger", "allocator_host", "composer_host", "camera_service", "media_service")
#: Buffer label rules, the first whose needle is contained.
DMA_RULES = [
    ("pixelmap", ("pixelmap", "resource://", "file://", "http://", "https://"), "Image / PixelMap"),
    ("xcomponent", ("xc-s-", "xc-t-", "xcomponent"), "ArkUI XComponent"),
    ("web", ("web-surface", "web-texture", "web-"), "ArkWeb rendering / media"),
    ("hardware_video", ("hw-video-encoder", "hw-video-decoder"), "Hardware video codec"),
    ("software_video", ("sw-video-encoder", "sw-video-decoder"), "Software video codec"),
    ("image_decode", ("srcimagesize-", "pixelmapsize-", "mimetype-"), "Image decoder"),
    ("native_surface", ("external", "nativewindow", "nativebuffer"), "NativeWindow / NativeBuffer"),
]
#: Mapping categories, the first whose token is contained.
SMAPS_TOKENS = [
    ("jemalloc", ("jemalloc", "native_heap", "[heap]")),
    ("arkts", ("arkts", "jsvm", "flutter", "dart", "hermes", "v8", "kmp")),
    ("ashmem", ("ashmem",)),
]
SMAPS_ANON = ("[anon]", "anon", "anonymous", "")
SMAPS_FILES = (".so", ".hap", ".db", ".sqlite", ".ttf", ".otf", "/data/", "/system/")


def any_of(text: Column, needles: Sequence[str]) -> Column:
    """Whether ``text`` contains one of ``needles``."""
    found = F.lit(False)
    for n in needles:
        found |= text.contains(n)
    return found


def outstanding_allocations(hook: DataFrame, frames: DataFrame, names: DataFrame, sizes: Sequence[int] = (), event_type: str | None = None, min_percent: float = 0.0, top: int = 20, runtime: str = r"^(lib|__)?(c|c\+\+|pthread|malloc|operator new)\b") -> DataFrame:
    """Live allocations grouped by caller, per trace.

    ``hook(trace, callchain_id, tid, event_type, heap_size, end_ts)`` with end_ts null or 0 for live ones,
    ``frames(trace, callchain_id, depth, symbol_id, file_id)``, ``names(trace, id, data)``. The group key is thread, event type and
    the frames after the first (the frame itself if it is alone, the call chain's id if there is none). The percentage is of
    the trace's total before the size filter. Equal allocations are summed before the frames join them, so a hot call chain
    is a handful of rows. Ties in bytes go to the smaller key.
    """
    live = hook.where("end_ts is null or end_ts = 0")
    if event_type:
        live = live.where(F.col("event_type") == event_type)
    summed = live.groupBy("trace", "callchain_id", "tid", "event_type", "heap_size").agg(F.sum(F.greatest("heap_size", F.lit(0))).alias("bytes"), F.count("*").alias("n"))
    total = summed.groupBy("trace").agg(F.sum("bytes").alias("total_bytes"), F.sum("n").alias("total_count"))
    if sizes:
        summed = summed.where(F.col("heap_size").isin(list(sizes)))
    decoded = frames.join(names.select("trace", F.col("id").alias("symbol_id"), F.col("data").alias("symbol")), ["trace", "symbol_id"], "left").join(names.select("trace", F.col("id").alias("file_id"), F.col("data").alias("file")), ["trace", "file_id"], "left")
    chains = decoded.groupBy("trace", "callchain_id").agg(F.sort_array(F.collect_list(F.struct("depth", "symbol_id", "file_id", F.coalesce("symbol", F.lit("")).alias("symbol"), F.coalesce("file", F.lit("")).alias("file")))).alias("stack"))
    full = summed.join(chains, ["trace", "callchain_id"], "left")
    stack = F.coalesce("stack", F.array().cast(chains.schema["stack"].dataType))
    tail = F.transform(F.when(F.size(stack) > 1, F.slice(stack, 2, F.size(stack))).otherwise(stack), lambda f: F.concat_ws(":", f.symbol_id.cast("string"), f.file_id.cast("string")))
    signature = F.when(F.size(tail) > 0, F.concat_ws("|", tail)).otherwise(F.concat(F.lit("chain:"), F.col("callchain_id").cast("string")))
    managed = F.exists(F.slice(stack, 1, 3), lambda f: F.concat_ws(" ", f.symbol, f.file).rlike(MANAGED))
    suspect = F.get(F.filter(stack, lambda f: (f.symbol != "") & ~f.symbol.rlike(runtime)), F.lit(0))["symbol"]
    rows = full.select("trace", "tid", "event_type", signature.alias("signature"), "callchain_id", "heap_size", "bytes", "n", F.when(managed, "managed").otherwise("native").alias("stack_type"), suspect.alias("suspected_symbol"))
    grouped = rows.groupBy("trace", "tid", "event_type", "signature").agg(F.min("callchain_id").alias("callchain_id"), F.sum("bytes").alias("outstanding_bytes"), F.sum("n").alias("allocation_count"), F.sort_array(F.collect_set("heap_size")).alias("block_sizes"), F.min_by("stack_type", "callchain_id").alias("stack_type"), F.min_by("suspected_symbol", "callchain_id").alias("suspected_symbol"))
    shared = grouped.join(total, "trace").withColumn("percentage", F.bround(F.when(F.col("total_bytes") > 0, F.col("outstanding_bytes") / F.col("total_bytes") * 100).otherwise(0.0), 2)).where(F.col("percentage") >= min_percent)
    rank = F.row_number().over(Window.partitionBy("trace").orderBy(F.desc("outstanding_bytes"), "tid", "event_type", "signature"))
    return shared.withColumn("rank", rank).where(F.col("rank") <= top)


def outstanding_from_stats(stat: DataFrame) -> DataFrame:
    """``stat(trace, callchain_id, ipid, type, apply_size, release_size)``: the largest surplus per call chain and type."""
    delta = F.col("apply_size") - F.col("release_size")
    rows = stat.where("apply_size > release_size").withColumn("delta", delta)
    return rows.groupBy("trace", "callchain_id", "type").agg(F.max("delta").alias("outstanding_bytes"), F.max_by("ipid", F.struct("delta", -F.col("ipid"))).alias("pid"))


def metric_trend(samples: DataFrame, key: Sequence[str], order: Sequence[str], elapsed: str, value: str) -> DataFrame:
    """Trend of a series per key over its non-null points, in ``order``; ``elapsed`` in seconds.

    start, end, peak, growth, growth %, rate per minute, fastest step (first on ties), R squared against the position (0 for
    under three points or no variance), and a shape: insufficient, flat_or_declining, sudden_jump, stepwise, linear,
    fluctuating, in that order.
    """
    w = Window.partitionBy(*key).orderBy(*order)
    rows = samples.where(F.col(value).isNotNull()).select(*key, F.col(value).cast("double").alias("v"), F.col(elapsed).cast("double").alias("at"), (F.row_number().over(w) - 1).alias("pos"))
    w = Window.partitionBy(*key).orderBy("pos")
    rows = rows.withColumn("delta", F.col("v") - F.lag("v").over(w)).withColumn("gap", F.col("at") - F.lag("at").over(w))
    ends = rows.groupBy(*key).agg(F.count("*").alias("n"), F.min_by("v", "pos").alias("start_value"), F.max_by("v", "pos").alias("end_value"), F.max("v").alias("peak_value"), (F.max("at") - F.min("at")).alias("seconds"), F.regr_r2("v", "pos").alias("r2"), F.var_pop("v").alias("spread"), F.max("delta").alias("max_delta"), F.count_if(F.col("delta") >= 0).alias("rising"), F.max_by("pos", F.struct(F.when(F.col("gap") > 0, F.col("delta") / F.col("gap")), -F.col("pos"))).alias("fastest_pos"))
    growth = F.col("end_value") - F.col("start_value")
    ends = ends.withColumn("growth", growth).withColumn("r2", F.when((F.col("n") < 3) | (F.col("spread") == 0), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("r2", F.lit(0.0))))))
    near = rows.join(ends.select(*key, "growth"), list(key)).groupBy(*key).agg(F.count_if(F.abs("delta") <= F.greatest(F.lit(1.0), 0.02 * F.abs("growth"))).alias("still"))
    steps = F.col("n") - 1
    shape = (
        F.when(F.col("n") < 3, "insufficient")
        .when(F.col("growth") <= 0, "flat_or_declining")
        .when(F.col("max_delta") >= 0.6 * F.col("growth"), "sudden_jump")
        .when(F.col("still") >= F.ceil(steps / 2), "stepwise")
        .when((F.col("r2") >= 0.85) & (F.col("rising") >= 0.8 * steps), "linear")
        .otherwise("fluctuating")
    )
    return ends.join(near, list(key)).select(*key, "n", "start_value", "end_value", "peak_value", "growth", F.when(F.col("start_value") != 0, F.col("growth") / F.col("start_value") * 100).otherwise(0.0).alias("growth_percent"), F.when(F.col("seconds") > 0, F.col("growth") / F.col("seconds") * 60).otherwise(0.0).alias("rate_per_min"), "fastest_pos", "r2", shape.alias("shape"))


def sample_time(text: Column) -> Column:
    """A sample's time of day in one of four forms: ``2024-01-31 10:20:30``, with slashes, ``2024-01-31_10-20-30``, or ``01-31
    10:20:30.5`` (in 1900, as no year is said). Stars and outer spaces count for nothing; other texts and impossible dates are null."""
    t = F.trim(F.regexp_replace(text, r"\*", ""))
    clock = F.regexp_replace(F.regexp_replace(t, r"^(\d{4})/(\d{1,2})/(\d{1,2}) ", "$1-$2-$3 "), r"^(\d{4}-\d{1,2}-\d{1,2})_(\d{1,2})-(\d{1,2})-(\d{1,2})$", "$1 $2:$3:$4")
    whole = F.when(clock.rlike(r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$"), clock).when(t.rlike(r"^\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}\.\d{1,6}$"), F.concat(F.lit("1900-"), t))
    return whole.try_cast("timestamp_ntz")


def elapsed_seconds(samples: DataFrame, key: Sequence[str], order: Sequence[str], running: str, realtime: str) -> DataFrame:
    """Adds ``elapsed_s``: the running time, else the real time since the key's first row."""
    first = F.first(realtime, ignorenulls=True).over(Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return samples.withColumn("elapsed_s", F.coalesce(F.col(running).cast("double"), (F.unix_micros(F.col(realtime).cast("timestamp")) - F.unix_micros(first.cast("timestamp"))) / 1e6))


def leak_type_share(growths: DataFrame, key: Sequence[str], kind: str, growth: str, least: float = 0.2) -> DataFrame:
    """Shares of positive growth per kind, kept from ``least`` on, and always the first."""
    rows = growths.where(F.col(growth) > 0)
    share = F.col(growth) / F.sum(growth).over(Window.partitionBy(*key))
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(growth), kind))
    return rows.withColumn("share", share).withColumn("rank", rank).where((F.col("share") >= least) | (F.col("rank") == 1))


def leak_types_at_trigger(samples: DataFrame, key: Sequence[str], order: str, trigger: str, metrics: Sequence[str]) -> DataFrame:
    """Shares of the metrics in the last trigger row, else in the last row."""
    row = F.coalesce(F.max_by(F.struct(*metrics), F.when(F.col(trigger), F.col(order))), F.max_by(F.struct(*metrics), order))
    one = samples.groupBy(*key).agg(row.alias("m"))
    long = one.select(*key, F.explode(F.array(*[F.struct(F.lit(m).alias("kind"), F.col(f"m.{m}").cast("double").alias("growth")) for m in metrics])).alias("x")).select(*key, "x.kind", "x.growth")
    return leak_type_share(long, key, "kind", "growth")


def smaps_category(name: Column) -> Column:
    """Category of a mapping by its name, in order."""
    low = F.lower(F.coalesce(name, F.lit("")))
    out = None
    for category, tokens in SMAPS_TOKENS:
        out = F.when(any_of(low, tokens), category) if out is None else out.when(any_of(low, tokens), category)
    return out.when(low.isin(*SMAPS_ANON) | low.contains("anon:"), "anon").when(any_of(low, SMAPS_FILES), "file_mapping").otherwise("other")


def category_breakdown(rows: DataFrame, key: Sequence[str], category: str, size: Column, dominant: float = 0.2) -> DataFrame:
    """Size, count and share by category; dominant from ``dominant`` on, or the first where none is."""
    by = rows.groupBy(*key, category).agg(F.sum(size).alias("size"), F.count("*").alias("n"))
    w = Window.partitionBy(*key)
    share = F.when(F.sum("size").over(w) > 0, F.col("size") / F.sum("size").over(w)).otherwise(0.0)
    rank = F.row_number().over(w.orderBy(F.desc("size"), category))
    return by.withColumn("share", share).withColumn("rank", rank).withColumn("dominant", (F.col("share") >= dominant) | ((F.col("rank") == 1) & (F.max("share").over(w) < dominant)))


def smaps_breakdown(smaps: DataFrame, key: Sequence[str] = ("log_id",)) -> DataFrame:
    """``smaps(log_id, name, pss_kb, swap_pss_kb)`` by category."""
    size = F.coalesce("pss_kb", F.lit(0.0)) + F.coalesce("swap_pss_kb", F.lit(0.0))
    return category_breakdown(smaps.withColumn("category", smaps_category(F.col("name"))), key, "category", size)


def snapshot_growth(rows: DataFrame, key: Sequence[str], snapshot: str, item: str, size: str) -> DataFrame:
    """Latest snapshot minus the one before, per item; what the earlier one lacks counts as 0 there."""
    w = Window.partitionBy(*key).orderBy(F.desc(snapshot))
    ranked = rows.groupBy(*key, snapshot, item).agg(F.sum(size).alias("size")).withColumn("age", F.dense_rank().over(w)).where("age <= 2")
    latest, before = ranked.where("age = 1").select(*key, item, F.col("size").alias("latest")), ranked.where("age = 2").select(*key, item, F.col("size").alias("previous"))
    return latest.join(before, [*key, item], "left").select(*key, item, "latest", F.coalesce("previous", F.lit(0)).cast("double").alias("previous")).withColumn("growth", F.col("latest") - F.col("previous"))


def dma_ownership(dma: DataFrame, key: Sequence[str], magic: str, process: str, order: str) -> DataFrame:
    """One owner per buffer: the first process that is no system process, else the first row; rows without magic stand alone."""
    buffer = F.coalesce(F.col(magic).cast("string"), F.concat(F.lit("row-"), F.col(order).cast("string")))
    is_system = F.col(process).cast("string").isin(*SYSTEM_PROCESSES).cast("int")
    first = F.row_number().over(Window.partitionBy(*key, "buffer").orderBy(is_system, order))
    return dma.withColumn("buffer", buffer).withColumn("first", first).where("first = 1").drop("first")


def dma_totals(owned: DataFrame, key: Sequence[str], process: Sequence[str], size: str, top: int = 5) -> DataFrame:
    """Bytes per owning process, the largest first."""
    by = owned.groupBy(*key, *process).agg(F.sum(size).alias("dma_bytes"), F.count("*").alias("buffers"))
    return by.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("dma_bytes"), *process))).where(F.col("rank") <= top)


def classify_dma(dma: DataFrame) -> DataFrame:
    """Adds ``rule_id`` and ``component`` from ``buf_name``, ``leak_type`` and ``buf_type``."""
    text = F.lower(F.concat_ws(" ", F.coalesce("buf_name", F.lit("")), F.coalesce("leak_type", F.lit("")), F.coalesce("buf_type", F.lit(""))))
    rule, component = F.lit("unknown_dma"), F.lit("DMA buffer owner")
    for ident, needles, what in reversed(DMA_RULES):
        rule, component = F.when(any_of(text, needles), ident).otherwise(rule), F.when(any_of(text, needles), what).otherwise(component)
    return dma.withColumn("rule_id", rule).withColumn("component", component)


def kernel_memory_top(rows: DataFrame, key: Sequence[str], item: str, size: str, top: int = 10) -> DataFrame:
    """Sums per item, such as GPU categories, slab caches or shared-memory processes, the largest ``top``."""
    by = rows.groupBy(*key, item).agg(F.sum(size).alias("bytes"))
    return by.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("bytes"), item))).where(F.col("rank") <= top)


def leak_fault_modes(leaks: DataFrame) -> DataFrame:
    """``leaks(log_id, kind, share, growth, has_trace)``: a mode per leak kind; high confidence needs growth and a trace."""
    mode = F.when(F.col("kind") == "pss", "native_heap_leak").when(F.col("kind") == "dma", "dma_buffer_leak").when(F.col("kind") == "gpu", "gpu_memory_leak").otherwise("unknown_leak")
    sure = F.when((F.col("growth") > 0) & F.col("has_trace"), "high").when((F.col("growth") > 0) | F.col("has_trace"), "medium").otherwise("low")
    return leaks.withColumn("fault_mode", mode).withColumn("confidence", sure)
