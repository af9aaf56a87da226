"""Stack statistics: hot functions, call pairs, clusters, hotspots, layers, features and signatures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: modules of the system.
SYSTEM_MODULE = (
    r"(?i)^(libc\.|libsystem_|libdispatch|libobjc|libstdc\+\+|libc\+\+|libpthread|CoreFoundation|Foundation|UIKit|AppKit|"
    r"libart\.so|libandroid_runtime|libbinder|libutils\.so|libcutils\.so|liblog\.so|linker|libace|libark|libdyld|libxpc|GraphicsServices)"
)
#: Fixed value: frames of the system in freeze samples.
SYSTEM_FRAME = r"(?i)libc\.|libutils|libeventhandler|EventHandler::|libace|libark|libuv|pthread_|__libc|libbinder|android::|system_server|libhwbinder"
#: Fixed value: frames that wait for a lock.
LOCK_FRAME = r"(?i)pthread_mutex|futex|std::mutex|Monitor::Wait|__psynch_mutex|os_unfair_lock"
#: What blocks, by the functions that say so.
BLOCKING = [
    (r"pthread_mutex_lock|pthread_mutex_timedlock", "mutex wait"),
    (r"pthread_cond_wait|pthread_cond_timedwait", "condition wait"),
    (r"__psynch_mutexwait|__psynch_cvwait", "kernel lock wait"),
    (r"futex|SYS_futex", "futex wait"),
    (r"dispatch_sync|dispatch_barrier_sync", "dispatch sync wait"),
    (r"objc_msgSend.*wait|.*Wait.*Sync", "synchronous call"),
    (r"sleep|usleep|nanosleep", "explicit sleep"),
    (r"epoll_wait|poll|select|kevent", "I/O multiplexing wait"),
    (r"read|write|recv|send|connect", "blocking I/O"),
    (r"binder.*transact|ioctl.*binder", "binder IPC wait"),
]


def top_k(df: DataFrame, by: Sequence[str], order: Sequence[str | Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group, with their ``rank``."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def hot_functions(frames: DataFrame, top: int = 20) -> DataFrame:
    """``frames(log_id, pos, function, module)``: counts per function, percent of all frames, named or not.

    Ties in count go to the function seen first; its module is the one at that place.
    """
    total = frames.groupBy("log_id").agg(F.count("*").alias("frames"))
    by = frames.where("function is not null and function <> ''").groupBy("log_id", "function").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"), F.min_by("module", "pos").alias("module"))
    rows = by.join(total, "log_id").withColumn("percent", F.col("n") / F.col("frames") * 100).withColumn("is_system", F.coalesce(F.col("module").rlike(SYSTEM_MODULE), F.lit(False)))
    return top_k(rows, ["log_id"], [F.desc("n"), "first_pos"], top)


def call_bigrams(frames: DataFrame, least: int = 2, top: int = 10) -> DataFrame:
    """``frames(log_id, thread, pos, function)``: adjacent named callers within a thread, from ``least`` occurrences on."""
    w = Window.partitionBy("log_id", "thread").orderBy("pos")
    pairs = frames.where("function is not null and function <> ''").withColumn("caller", F.lead("function").over(w)).where("caller is not null")
    by = pairs.groupBy("log_id", F.col("function").alias("callee"), "caller").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return top_k(by, ["log_id"], [F.desc("n"), "callee", "caller"], top)


def blocking_indicators(frames: DataFrame) -> DataFrame:
    """Distinct ``reason: function`` over the blocking patterns."""
    reasons = F.filter(F.array(*[F.when(F.col("function").rlike("(?i)" + p), F.lit(r)) for p, r in BLOCKING]), lambda x: x.isNotNull())
    return frames.where("function is not null").select("log_id", "function", F.explode(reasons).alias("reason")).distinct()


def cluster_stacks(samples: DataFrame, depth: int = 5) -> DataFrame:
    """``samples(log_id, frames array)`` by their first ``depth`` frames; ratios count samples without frames too."""
    total = samples.groupBy("log_id").agg(F.count("*").alias("samples"))
    by = samples.where(F.size("frames") > 0).groupBy("log_id", F.slice("frames", 1, depth).alias("prefix")).agg(F.count("*").alias("n"))
    ratio = F.col("n") / F.col("samples")
    rows = by.join(total, "log_id").withColumn("ratio", F.bround(ratio, 3)).withColumn("confidence", F.bround(F.least(F.lit(0.99), 0.55 + ratio * 0.44), 3))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("log_id").orderBy(F.desc("n"), "prefix")))


def business_frames(frames: Column) -> Column:
    """The frames that are not the system's."""
    return F.filter(frames, lambda f: ~f.rlike(SYSTEM_FRAME))


def sample_hotspots(samples: DataFrame, busy: float = 0.3) -> DataFrame:
    """First business frame of each sample, with the share of all samples and ``busy`` from that share on."""
    total = samples.groupBy("log_id").agg(F.count("*").alias("samples"))
    by = samples.select("log_id", F.get(business_frames(F.col("frames")), F.lit(0)).alias("function")).where("function is not null").groupBy("log_id", "function").agg(F.count("*").alias("n"))
    return by.join(total, "log_id").withColumn("ratio", F.col("n") / F.col("samples")).withColumn("busy", F.col("ratio") >= busy)


def deep_hotspots(samples: DataFrame, depth: int = 15, dominant: float = 0.3) -> DataFrame:
    """``samples(log_id, sample_id, frames)``: in how many samples a business frame is among the first ``depth``, and where first."""
    total = samples.groupBy("log_id").agg(F.count("*").alias("samples"))
    places = samples.select("log_id", "sample_id", F.posexplode(F.slice("frames", 1, depth)).alias("pos", "function")).where(~F.col("function").rlike(SYSTEM_FRAME))
    first = places.groupBy("log_id", "sample_id", "function").agg(F.min("pos").alias("pos"))
    by = first.groupBy("log_id", "function").agg(F.count("*").alias("n"), F.min("pos").alias("min_pos"), F.max("pos").alias("max_pos"), F.avg("pos").alias("avg_pos"))
    return by.join(total, "log_id").withColumn("ratio", F.col("n") / F.col("samples")).withColumn("dominant", F.col("ratio") >= dominant)


def parent_nodes(samples: DataFrame, depth: int = 15) -> DataFrame:
    """The deepest business frame and the longest business chain of each log."""
    chain = business_frames(F.slice("frames", 1, depth))
    rows = samples.select("log_id", "sample_id", chain.alias("chain")).where(F.size("chain") > 0)
    parents = rows.groupBy("log_id", F.element_at("chain", -1).alias("parent")).agg(F.count("*").alias("n"))
    longest = rows.groupBy("log_id").agg(F.max_by("chain", F.struct(F.size("chain"), -F.col("sample_id"))).alias("longest_chain"))
    return top_k(parents, ["log_id"], [F.desc("n"), "parent"], 1).drop("rank").join(longest, "log_id")


def lock_frames(samples: DataFrame) -> DataFrame:
    """Distinct lock-wait frames of a log, the first seen first."""
    rows = samples.select("log_id", F.struct(F.col("sample_id"), F.filter("frames", lambda f: f.rlike(LOCK_FRAME)).alias("locks")).alias("s")).where(F.size("s.locks") > 0)
    return rows.groupBy("log_id").agg(F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list("s")), lambda x: x.locks))).alias("locks"))


def block_vs_busy(samples: DataFrame, depth: int = 3) -> DataFrame:
    """``samples(log_id, bucket '3s' or '6s', frames)``: equal most frequent prefixes mean blocked, different ones busy."""
    by = samples.where(F.size("frames") > 0).groupBy("log_id", "bucket", F.slice("frames", 1, depth).alias("prefix")).agg(F.count("*").alias("n"))
    best = top_k(by, ["log_id", "bucket"], [F.desc("n"), "prefix"], 1)
    early, late = best.where("bucket = '3s'").select("log_id", F.col("prefix").alias("early")), best.where("bucket = '6s'").select("log_id", F.col("prefix").alias("late"))
    return early.join(late, "log_id", "full").withColumn("verdict", F.when(F.col("early").isNull() | F.col("late").isNull(), "UNKNOWN").when(F.col("early") == F.col("late"), "BLOCKED").otherwise("BUSY"))


def recursive_functions(frames: DataFrame, within: int = 30, least: int = 3) -> DataFrame:
    """Functions seen ``least`` times or more in the first ``within`` frames of the crash thread."""
    return frames.where((F.col("pos") < within) & F.col("function").isNotNull()).groupBy("log_id", "function").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def limit_frames(frames: DataFrame, threads: int = 4, crash: int = 50, background: int = 20) -> DataFrame:
    """``frames(log_id, thread, is_crash_thread, pos)``: the crash thread and the first others, each cut to its limit."""
    order = Window.partitionBy("log_id").orderBy(F.desc("is_crash_thread"), "thread")
    within = Window.partitionBy("log_id", "thread").orderBy("pos")
    rows = frames.withColumn("thread_rank", F.dense_rank().over(order)).withColumn("frame_rank", F.row_number().over(within))
    return rows.where((F.col("thread_rank") <= threads) & (F.col("frame_rank") <= F.when(F.col("is_crash_thread"), crash).otherwise(background))).drop("thread_rank", "frame_rank")


def filter_library_frames(frames: DataFrame, libs: DataFrame) -> DataFrame:
    """The crash thread's frames, and others' whose module is in ``libs(module)``; frames are numbered anew."""
    known = libs.select(F.col("module").alias("known")).distinct()
    kept = frames.join(known, F.col("module") == F.col("known"), "left").where(F.col("is_crash_thread") | F.col("known").isNotNull()).drop("known")
    return kept.withColumn("pos", F.row_number().over(Window.partitionBy("log_id", "thread").orderBy("pos")) - 1)


def stack_layers(frames: DataFrame, runtime: str = r"(?i)libark|libart|libjsc|libv8|libhermes|libflutter|libmono|java\.|kotlin\.", system: str = SYSTEM_MODULE) -> DataFrame:
    """Layer of each frame: the first is the crash frame, then runtime, system or app by module."""
    module = F.coalesce("module", F.lit(""))
    return frames.withColumn("layer", F.when(F.col("pos") == 0, "crash_frame").when(module.rlike(runtime), "runtime").when(module.rlike(system), "system").otherwise("app"))


def layer_summary(frames: DataFrame) -> DataFrame:
    """First frame beyond the first that is not runtime, and first app frame, from ``stack_layers``."""
    frame = F.struct("pos", "function", "module", "layer")
    return stack_layers(frames).groupBy("log_id").agg(F.min_by(frame, F.when((F.col("pos") > 0) & (F.col("layer") != "runtime"), F.col("pos"))).alias("first_non_runtime"), F.min_by(frame, F.when(F.col("layer") == "app", F.col("pos"))).alias("first_app"))


#: Who owns what lies where, by platform, in order.
OWNER_PATHS = [
    ("android", r"/data/app/[^/]+/|/data/data/[^/]+/", "application"),
    ("android", r"/system/lib|/system/framework|/apex/", "system"),
    ("android", r"/vendor/lib|/odm/lib|/product/lib", "vendor"),
    ("harmonyos", r"/data/storage/el\d/bundle/|/data/app/", "application"),
    ("harmonyos", r"/system/lib|/system/app", "system"),
    ("harmonyos", r"/chipset/lib|/vendor/", "vendor"),
    ("ios", r"/var/containers/Bundle/Application/|/private/var/containers/", "application"),
    ("ios", r"/System/Library/Frameworks/|/System/Library/PrivateFrameworks/|/usr/lib/", "system"),
    ("macos", r"/Applications/|/Users/[^/]+/", "application"),
    ("macos", r"/System/Library/|/usr/lib/", "system"),
    ("macos", r"/Library/Frameworks/", "third_party"),
    ("linux", r"/usr/lib/|/lib/x86_64-linux-gnu/|/lib/aarch64-linux-gnu/", "system"),
    ("linux", r"/opt/", "third_party"),
    ("linux", r"/home/", "application"),
]


def attribute_responsibility(frames: DataFrame, system_modules: Sequence[str], third_party: str = r"(?i)libReact|libhermes|libfb|libfolly|libsentry|libbugly|libunity|libUE4|Firebase|Sentry") -> DataFrame:
    """``frames(log_id, pos, function, module, path, platform)``: who owns the crash frame, how sure that is, the first application
    frame after it, and a verdict.

    A known system module comes first (0.95), then patterns of third parties (0.85), the path by platform (0.8), and a
    library named like an application's (0.5). The verdict is the application's where a later frame is, else the crash frame's.
    """
    module, path = F.coalesce("module", F.lit("")), F.coalesce("path", F.lit(""))
    by_path = F.lit(None).cast("string")
    for platform, pattern, owner in reversed(OWNER_PATHS):
        by_path = F.when((F.col("platform") == platform) & path.rlike("(?i)" + pattern), owner).otherwise(by_path)
    said = lambda who, sure: F.struct((F.lit(who) if isinstance(who, str) else who).alias("owner"), F.lit(sure).alias("confidence"))
    owner = F.when(module.isin(*system_modules), said("system", 0.95)).when(module.rlike(third_party), said("third_party", 0.85)).when(by_path.isNotNull(), said(by_path, 0.8)).when(module.rlike("^lib[A-Z]"), said("application", 0.5)).otherwise(said("undetermined", 0.0))
    rows = frames.withColumn("_o", owner)
    one = rows.groupBy("log_id").agg(F.min_by("_o", "pos").alias("_c"), F.min_by(F.struct("pos", "function", "module"), F.when((F.col("_o.owner") == "application") & (F.col("pos") > 0), F.col("pos"))).alias("first_app_frame"))
    return one.select("log_id", F.col("_c.owner").alias("crash_owner"), F.col("_c.confidence").alias("confidence"), "first_app_frame", F.when(F.col("first_app_frame").isNotNull(), "application").otherwise(F.col("_c.owner")).alias("verdict"))


def extract_features(frames: DataFrame, events: DataFrame, first: int = 10) -> DataFrame:
    """A feature row per log: modules in order of use, thread count, and the first functions, beside ``events``' columns."""
    by = frames.groupBy("log_id").agg(F.array_sort(F.collect_list(F.struct("pos", "function", "module"))).alias("stack"), F.countDistinct("thread").alias("thread_count"))
    functions = F.slice(F.filter(F.transform("stack", lambda f: f.function), lambda x: F.coalesce(x != "", F.lit(False))), 1, first)
    modules = F.array_distinct(F.filter(F.transform("stack", lambda f: f.module), lambda x: F.coalesce(x != "", F.lit(False))))
    return events.join(by.select("log_id", modules.alias("modules"), "thread_count", F.concat_ws(" ", functions).alias("top_functions")), "log_id", "left")


def crash_signature(features: DataFrame, parts: Sequence[str] = ("os_type", "signal", "category", "top_functions")) -> DataFrame:
    """Adds ``signature``: the non-empty parts, spaces between."""
    return features.withColumn("signature", F.concat_ws(" ", *[F.nullif(F.trim(F.col(p).cast("string")), F.lit("")) for p in parts]))
