"""Address, symbol and replay joins that need a plan of their own, and per-log merges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bits of the pages by which intervals and points meet, the finest first; each interval takes the finest that gives it few.
LEVELS = (12, 20, 28, 36, 44, 52, 60)
PAGES = 16


def address(hex_text: Column) -> Column:
    """An unsigned 64-bit address from hex text, with or without 0x, as decimal(20,0)."""
    return F.conv(F.regexp_replace(F.lower(hex_text), "^0x", ""), 16, 10).cast("decimal(20,0)")


def _page(va: Column, bits: int) -> Column:
    return F.floor(va / F.lit(1 << bits).cast("decimal(20,0)")).cast("decimal(20,0)")


def range_join(points: DataFrame, spans: DataFrame, keys: Sequence[str], at: str, start: str, end: str) -> DataFrame:
    """Points with each span [start, end) of the same keys that holds them: inner join, all columns of both.

    Spans go by the pages they touch, at a page size that leaves at most PAGES + 1 of them; points by their page at each size
    that is in use among their keys' spans. The equality on keys, level and page keeps this a hash or merge join, never a nested loop.
    """
    size = F.col(end) - F.col(start)
    level = F.lit(len(LEVELS) - 1)
    for i in reversed(range(len(LEVELS) - 1)):
        level = F.when(size <= F.lit(PAGES << LEVELS[i]).cast("decimal(20,0)"), F.lit(i)).otherwise(level)
    page = lambda c: F.element_at(F.array(*[_page(c, b) for b in LEVELS]), F.col("_level") + 1)
    cut = spans.where(F.col(end) > F.col(start)).withColumn("_level", level)
    lo, hi = page(F.col(start)), page(F.col(end) - 1)
    cut = cut.withColumn("_n", (hi - lo).cast("int")).withColumn("_page", F.explode(F.transform(F.sequence(F.lit(0), F.col("_n")), lambda k: lo + k))).withColumn("_page", F.col("_page").cast("decimal(20,0)")).drop("_n")
    used = cut.groupBy(*keys).agg(F.sort_array(F.collect_set("_level")).alias("_used"))
    spread = points.join(used, list(keys)).withColumn("_level", F.explode("_used")).withColumn("_page", page(F.col(at))).drop("_used")
    return spread.join(cut, [*keys, "_level", "_page"]).where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("_level", "_page")


def map_addresses(points: DataFrame, maps: DataFrame, keys: Sequence[str] = ("log_id",), point_id: str = "point_id") -> DataFrame:
    """``points(log_id, point_id, va)`` with the mapping ``maps(log_id, ord, start, end, executable, file_offset, path)`` that
    holds each: executable ones first, then the first in file order. Points without a mapping keep nulls."""
    hits = range_join(points, maps, keys, "va", "start", "end")
    best = hits.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, point_id).orderBy(F.desc("executable"), "ord"))).where("_r = 1").select(*keys, point_id, *[c for c in maps.columns if c not in keys])
    return points.join(best, [*keys, point_id], "left")


def module_offsets(hits: DataFrame, maps: DataFrame) -> DataFrame:
    """Adds ``base`` (smallest start at file offset 0 of the path, else start minus offset) and ``offset`` within the module."""
    base = maps.groupBy("log_id", "path").agg(F.coalesce(F.min(F.when(F.col("file_offset") == 0, F.col("start"))), F.min(F.col("start") - F.col("file_offset"))).alias("base"))
    return hits.join(base, ["log_id", "path"], "left").withColumn("offset", F.col("va") - F.col("base"))


def fill_from_frame0(registers: DataFrame, frames: DataFrame) -> DataFrame:
    """Module and offset of pc and lr from the crash thread's first frame where no mapping was found."""
    top = frames.where("is_crash_thread and pos = 0").groupBy("log_id").agg(F.first("module").alias("m0"), F.first("offset").alias("o0"))
    pc = registers.where("reg = 'pc'").groupBy("log_id").agg(F.first("va").alias("pc"))
    rows = registers.join(top, "log_id", "left").join(pc, "log_id", "left")
    fill = F.col("module").isNull() & F.col("reg").isin("pc", "lr") & F.col("m0").isNotNull()
    offset = F.col("va") - (F.col("pc") - F.col("o0"))
    return rows.withColumn("offset", F.when(fill & (offset >= 0), offset).otherwise(F.col("offset"))).withColumn("module", F.when(fill & (offset >= 0), F.col("m0")).otherwise(F.col("module"))).drop("m0", "o0", "pc")


#: Ranges of places that a key is cut into by :func:`asof_join`.
RANGES = 32


def asof_join(points: DataFrame, marks: DataFrame, keys: Sequence[str], at: str, mark: str, values: Sequence[str], tolerance: Column | int | None = None, nearest: bool = False) -> DataFrame:
    """Each point with the last mark at or before it (ties: the mark last in order of its values), or with the ``nearest``.

    Both sides are one stream in a window per key and range of places, so a key that holds most rows is many tasks' work; the
    ranges part all places evenly. What a range needs from those before (or after) it is one mark for each key and range,
    carried over. Marks beyond ``tolerance`` give nulls, and so do null keys.
    """
    own = [c for c in points.columns if c not in (*keys, at)]
    kind = points.schema[at].dataType
    held = F.struct(F.col(mark).cast(kind).alias(mark), *values)
    left = points.select(*keys, F.col(at).alias("_at"), F.lit(1).alias("_side"), F.struct(*own, F.col(at)).alias("_own"), F.lit(None).cast(marks.select(held.alias("h")).schema["h"].dataType).alias("_mark"))
    right = marks.dropna(subset=list(keys)).select(*keys, F.col(mark).cast(kind).alias("_at"), F.lit(0).alias("_side"), F.lit(None).cast(left.schema["_own"].dataType).alias("_own"), held.alias("_mark"))
    number = F.col("_at").cast("double")
    cuts = sorted(set(left.select(number.alias("x")).approxQuantile("x", [i / RANGES for i in range(1, RANGES)], 0.01)))
    part = sum((F.coalesce((number >= c).cast("int"), F.lit(0)) for c in cuts), F.lit(0))
    left, right = left.withColumn("_range", part), right.withColumn("_range", part)
    # one row a key and range: its last mark, and of the marks at its first place the last
    ends = right.groupBy(*keys, "_range").agg(F.max(F.struct("_at", "_mark"))["_mark"].alias("_last"), F.min("_at").alias("_low"))
    if nearest:
        low = [F.col(f"m.{k}").eqNullSafe(F.col(f"e.{k}")) for k in (*keys, "_range")]
        first = right.alias("m").join(ends.alias("e"), [*low, F.expr("m._at = e._low")]).groupBy(*[F.col(f"e.{k}") for k in (*keys, "_range")], "e._last").agg(F.max("m._mark").alias("_first"))
    else:
        first = ends.withColumn("_first", F.col("_last"))
    used = left.select(*keys, "_range").distinct().join(first.select(*keys, "_range", "_last", "_first"), [*keys, "_range"], "full")
    w = Window.partitionBy(*keys)
    carried = used.select(*keys, "_range", F.last("_last", ignorenulls=True).over(w.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"), F.first("_first", ignorenulls=True).over(w.orderBy("_range").rowsBetween(1, Window.unboundedFollowing)).alias("_after"))
    over = lambda c: carried.where(f"{c} is not null").select(*keys, F.col(f"{c}.{mark}").alias("_at"), F.lit(0).alias("_side"), F.lit(None).cast(left.schema["_own"].dataType).alias("_own"), F.col(c).alias("_mark"), "_range")
    rows = left.unionByName(right).unionByName(over("_before"))
    if nearest:
        rows = rows.unionByName(over("_after"))
    w = Window.partitionBy(*keys, "_range")
    found = F.last("_mark", ignorenulls=True).over(w.orderBy("_at", "_side", "_mark").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_before", found)
    pick = F.col("_before")
    if nearest:
        rows = rows.withColumn("_after", F.last("_mark", ignorenulls=True).over(w.orderBy(F.desc("_at"), "_side", "_mark").rowsBetween(Window.unboundedPreceding, 0)))
        closer = F.col(f"_after.{mark}") - F.col("_at") < F.col("_at") - F.col(f"_before.{mark}")
        pick = F.when(F.col("_before").isNull() | closer, F.col("_after")).otherwise(F.col("_before"))
    rows = rows.where("_side = 1").withColumn("_pick", pick)
    if tolerance is not None:
        rows = rows.withColumn("_pick", F.when(F.abs(F.col("_at") - F.col(f"_pick.{mark}")) <= tolerance, F.col("_pick")))
    return rows.select(*keys, *[F.col(f"_own.{c}").alias(c) for c in (*own, at)], F.col(f"_pick.{mark}").alias(mark), *[F.col(f"_pick.{v}").alias(v) for v in values])


def symbolize(frames: DataFrame, symbols: DataFrame, tolerance: int = 0x1000, nearest: bool = False) -> DataFrame:
    """``frames(build_id, ..., offset)`` with ``symbols(build_id, symbol_start, symbol)``: the symbol that begins at or before the
    offset, within the tolerance; ``nearest`` also looks ahead."""
    return asof_join(frames, symbols, ["build_id"], "offset", "symbol_start", ["symbol"], tolerance, nearest)


def resolution_kind(frames: DataFrame) -> DataFrame:
    """Adds ``resolution_kind`` from ``resolved_function``, ``function`` and ``symbol``."""
    return frames.withColumn("resolution_kind", F.when(F.col("resolved_function").isNotNull(), "addr2line").when(F.coalesce("function", F.lit("")) != "", "log_symbol").when(F.col("symbol").isNotNull(), "offset_estimate").otherwise("unresolved"))


def resolution_stats(frames: DataFrame, keys: Sequence[str] = ("log_id", "thread")) -> DataFrame:
    """Frames by kind of resolution."""
    kinds = ("addr2line", "log_symbol", "offset_estimate", "unresolved")
    return resolution_kind(frames).groupBy(*keys).agg(F.count("*").alias("frames"), *[F.count_if(F.col("resolution_kind") == k).alias(k) for k in kinds])


def merge_views(frames: DataFrame, resolved: DataFrame) -> DataFrame:
    """The parse view with the resolved function, file and line where there are such."""
    right = resolved.select("log_id", "thread", "pos", F.col("function").alias("rf"), F.col("file").alias("rfile"), F.col("line").alias("rline"))
    rows = frames.join(right, ["log_id", "thread", "pos"], "left")
    return rows.withColumn("function", F.coalesce("rf", "function")).withColumn("file", F.coalesce("rfile", "file")).withColumn("line", F.coalesce("rline", "line")).drop("rf", "rfile", "rline")


def expand_inlines(frames: DataFrame) -> DataFrame:
    """A row per inlined frame, innermost first; frames without such stay as they are, at depth 0."""
    rows = frames.select("*", F.posexplode_outer("inline_frames").alias("inline_depth", "inline_function")).drop("inline_frames")
    return rows.withColumn("inline_depth", F.coalesce("inline_depth", F.lit(0))).withColumn("function", F.coalesce("inline_function", "function")).drop("inline_function")


def signal_semantics(events: DataFrame, dim: DataFrame) -> DataFrame:
    """``dim(signal, sub_code, meaning)`` by signal and code, else by signal and the empty code."""
    exact = dim.select("signal", "sub_code", F.col("meaning").alias("m1"))
    general = dim.where("sub_code = ''").select("signal", F.col("meaning").alias("m2"))
    rows = events.join(exact, ["signal", "sub_code"], "left").join(general, "signal", "left")
    return rows.withColumn("meaning", F.coalesce("m1", "m2")).drop("m1", "m2")


def replay_lookup(requests: DataFrame, index: DataFrame, identity: Sequence[str], order: str = "seq") -> DataFrame:
    """Each request with the newest indexed run of equal identity, nulls being equal; full-scope runs with equal prompt
    parameters are hits of kind ``conclusion``, others of kind ``evidence``."""
    newest = index.groupBy(*[F.col(c).alias(f"_{c}") for c in identity]).agg(F.max_by(F.struct("run_id", "scope", "prompt_params", order), order).alias("hit"))
    cond = F.lit(True)
    for c in identity:
        cond &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    rows = requests.join(newest, cond, "left").drop(*[f"_{c}" for c in identity])
    kind = F.when(F.col("hit").isNull(), "miss").when((F.col("hit.scope") == "full") & F.col("hit.prompt_params").eqNullSafe(F.col("prompt_params")), "conclusion").otherwise("evidence")
    return rows.withColumn("hit_kind", kind).withColumn("hit_run", F.col("hit.run_id")).drop("hit")


def duplicate_groups(rows: DataFrame, content: str, order: str) -> DataFrame:
    """Equal contents: the first of each group, its size, by the content's hash."""
    return rows.groupBy(F.sha2(content, 256).alias("content_hash")).agg(F.min(order).alias("first_id"), F.count("*").alias("n")).where("n > 1")


def crash_summary(events: DataFrame, frames: DataFrame) -> DataFrame:
    """Error type, place and thread of each log, the place from the crash frame or what stands in for it."""
    crash = frames.where("is_crash_thread")
    best = crash.groupBy("log_id").agg(F.min_by(F.struct("function", "file", "line", "module", "thread"), "pos").alias("top"), F.min_by(F.struct("function", "file", "line", "module", "thread"), F.when(F.col("file").isNotNull(), F.col("pos"))).alias("located"))
    rows = events.join(best, "log_id", "left")
    return rows.select("log_id", F.coalesce("exception_type", "signal", F.lit("unknown")).alias("error_type"), F.coalesce("located.function", "top.function", "top.module").alias("location"), F.col("located.file").alias("file"), F.col("located.line").alias("line"), F.col("top.thread").alias("thread"))
