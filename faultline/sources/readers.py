"""Sources and sinks: log directories, bundles, frame reports, vendor crash JSON, heap snapshots, suites, knowledge exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: File names of leak bundles.
BUNDLE_FILES = [
    ("sample", r"memleak-native-([0-9A-Za-z_.-]+)-(\d+)-sample\.txt$"),
    ("smaps", r"memleak-native-([0-9A-Za-z_.-]+)-(\d+)-smaps\.txt$"),
    ("profile", r"memleak-native-([0-9A-Za-z_.-]+)-(\d+)-\d+\.(?:txt|db)$"),
    ("kernel", r"memleak-kernel-([0-9A-Za-z_.-]+)-(0)-\d+\.txt$"),
]
#: A record of a CSV file (line breaks only within quotes), and a cell with the comma before it.
CSV_RECORD = r'(?:[^"\r\n]++|"(?:[^"]++|"")*+"|")++'
CSV_CELL = r',([ \t]*+"(?:[^"]++|"")*+"[ \t]*+(?=,|$)|[^,]*)'
VENDOR_FRAME = "array<struct<function: string, method: string, symbol: string, filename: string, file: string, module: string, package: string, lineno: long, lineNumber: long, line: long, instruction_addr: string>>"


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """A row for each file: ``(log_id, path, content, sha256)``."""
    rows = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    return rows.select(F.sha2("path", 256).alias("log_id"), "path", "content", F.sha2("content", 256).alias("sha256"))


def directory_hash(logs: DataFrame) -> DataFrame:
    """The hash of each directory: its files' hashes in order of path, a line each."""
    by = logs.groupBy(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("directory")).agg(F.array_sort(F.collect_list(F.struct("path", "sha256"))).alias("files"))
    return by.select("directory", F.size("files").alias("n_files"), F.sha2(F.array_join(F.transform("files", lambda f: f.sha256), "\n"), 256).alias("sha256"))


def discover_bundles(files: DataFrame) -> DataFrame:
    """``files(path)`` to leak bundles per process and pid; within a process ``rank`` puts those with most kinds of files first."""
    kind, process, pid = None, None, None
    for name, p in BUNDLE_FILES:
        hit = F.col("path").rlike(p)
        kind = F.when(hit, name) if kind is None else kind.when(hit, name)
        process = F.when(hit, F.regexp_extract("path", p, 1)) if process is None else process.when(hit, F.regexp_extract("path", p, 1))
        pid = F.when(hit, F.regexp_extract("path", p, 2)) if pid is None else pid.when(hit, F.regexp_extract("path", p, 2))
    rows = files.select("path", kind.alias("kind"), process.alias("process"), pid.alias("pid")).where("kind is not null")
    listed = lambda k: F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.col("path")))).alias(k)
    own = rows.where("kind <> 'kernel'").groupBy("process", "pid").agg(listed("sample"), listed("smaps"), listed("profile"))
    kernel = rows.where("kind = 'kernel'").groupBy("process").agg(listed("kernel"))
    full = own.join(kernel, "process", "left").withColumn("kernel", F.coalesce("kernel", F.array().cast("array<string>")))
    kinds = sum(((F.size(k) > 0).cast("int") for k in ("sample", "smaps", "profile", "kernel")), F.lit(0))
    return full.withColumn("kinds", kinds).withColumn("rank", F.row_number().over(Window.partitionBy("process").orderBy(F.desc("kinds"), F.desc(F.size("profile")), "pid")))


def classify_artifacts(files: DataFrame) -> DataFrame:
    """``files(path)`` to each directory's counts by suffix and what it is: for traces, ``trace_kind`` (traces before reports), and for
    heaps, ``heap_kind`` (JSON files count as snapshots)."""
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    n = lambda *s: F.count_if(suffix.isin(*s))
    by = files.groupBy(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("directory")).agg(n("htrace", "trace", "ftrace", "pb").alias("traces"), n("json", "csv").alias("reports"), n("heapsnapshot", "json").alias("snapshots"), n("rawheap").alias("rawheaps"))
    trace = F.when(F.col("traces") > 0, "trace").when(F.col("reports") > 0, "analysis_report").otherwise("directory")
    heap = F.when(F.col("snapshots") > 1, "heap_snapshot_series").when(F.col("snapshots") == 1, "heapsnapshot").when(F.col("rawheaps") > 0, "rawheap").otherwise("directory")
    return by.withColumn("trace_kind", trace).withColumn("heap_kind", heap)


def read_perf_rows(spark: SparkSession, path: str) -> DataFrame:
    """Frame reports: CSV with a header, or JSON as a list or under frames, jank_events, events, rows or data (the first list).

    CSV cells in quotes may hold commas, line breaks and doubled quotes; a quote that none closes stands for itself. Short rows are
    filled with empty cells, cells beyond the header are left out, and of columns with one name the last counts.
    """
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "^﻿", "").alias("content"))
    v = F.try_parse_json("content")
    lists = [F.try_variant_get(v, p, "array<map<string,string>>") for p in ("$", "$.frames", "$.jank_events", "$.events", "$.rows", "$.data")]
    json = files.where("path like '%.json'").select("path", F.posexplode(F.coalesce(*lists)).alias("ord", "row"))
    records = F.filter(F.regexp_extract_all("content", F.lit(CSV_RECORD), F.lit(0)), lambda x: F.trim(x) != "")
    cells = lambda record: F.transform(F.regexp_extract_all(F.concat(F.lit(","), record), F.lit(CSV_CELL), F.lit(1)), lambda c: F.when(c.startswith('"') & c.endswith('"') & (F.length(c) > 1), F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))).otherwise(c))
    lines = files.where("path like '%.csv'").select("path", records.alias("l"))
    head = F.transform(cells(F.get("l", F.lit(0))), lambda x: F.trim(x))
    csv = lines.select("path", head.alias("head"), F.posexplode(F.slice("l", 2, 1 << 30)).alias("ord", "line"))
    # of columns with one name the last counts
    named = F.filter(F.arrays_zip(F.col("head").alias("k"), F.slice(F.concat(cells(F.col("line")), F.array_repeat(F.lit(""), F.size("head"))), F.lit(1), F.size("head")).alias("v"), F.sequence(F.lit(1), F.size("head")).alias("i")), lambda z: z["i"] == F.size("head") + 1 - F.array_position(F.reverse("head"), z["k"]))
    csv = csv.select("path", "ord", F.map_from_entries(F.transform(named, lambda z: F.struct(z["k"], z["v"]))).alias("row"))
    return json.unionByName(csv)


def vendor_json_to_frames(logs: DataFrame) -> DataFrame:
    """Vendor crash JSON ``logs(log_id, content)`` to ``(log_id, vendor, pos, function, file, module, line)``; the first layout that
    has frames wins. In the first layout frames come outermost first and are turned around."""
    v = F.try_parse_json("content")
    get = lambda p: F.try_variant_get(v, p, VENDOR_FRAME)
    exceptions = F.try_variant_get(v, "$.exception.values", f"array<struct<type: string, stacktrace: struct<frames: {VENDOR_FRAME}>>>")
    last = F.try_element_at(exceptions, F.lit(-1))["stacktrace"]["frames"]
    layouts = [("sentry", F.reverse(last)), ("sentry", F.reverse(get("$.threads.values[0].stacktrace.frames"))), ("sentry", F.reverse(get("$.stacktrace.frames"))), ("crashlytics", get("$.exceptions[0].frames")), ("crashlytics", get("$.threads[0].frames")), ("bugsnag", get("$.events[0].exceptions[0].stacktrace")), ("bugsnag", get("$.exceptions[0].stacktrace")), ("harmony", get("$.crashDiagnosis.threads[0].frames")), ("generic", get("$.frames")), ("generic", get("$.stack"))]
    chosen = F.coalesce(*[F.when(F.size(f) > 0, F.struct(F.lit(n).alias("vendor"), f.alias("frames"))) for n, f in layouts])
    rows = logs.select("log_id", chosen.alias("c")).where("c is not null").select("log_id", "c.vendor", F.posexplode("c.frames").alias("pos", "f"))
    return rows.select("log_id", "vendor", "pos", F.coalesce("f.function", "f.method", "f.symbol").alias("function"), F.coalesce("f.filename", "f.file").alias("file"), F.coalesce("f.module", "f.package").alias("module"), F.coalesce("f.lineno", "f.lineNumber", "f.line").alias("line"))


def heap_snapshot_to_graph(snapshots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``snapshots(snapshot_id, content)`` to nodes ``(snapshot_id, node, type, name, self_size, edge_count)`` and edges
    ``(snapshot_id, src, dst, ord)``. The flat arrays are cut by the field lists that the file carries; an edge belongs to the node
    whose running edge count reaches its position; targets are offsets, or indexes where smaller than a node's width."""
    v = F.try_parse_json("content")
    get = lambda p, t: F.try_variant_get(v, p, t)
    raw = snapshots.select("snapshot_id", get("$.snapshot.meta.node_fields", "array<string>").alias("nf"), get("$.snapshot.meta.edge_fields", "array<string>").alias("ef"), get("$.snapshot.meta.node_types[0]", "array<string>").alias("types"), get("$.nodes", "array<bigint>").alias("n"), get("$.edges", "array<bigint>").alias("e"), get("$.strings", "array<string>").alias("strings"))
    width, field = F.size("nf"), lambda name: F.get("row", F.array_position("nf", F.lit(name)).cast("int") - 1)
    rows = raw.select("snapshot_id", "nf", "types", "strings", F.posexplode(F.transform(F.sequence(F.lit(0), (F.size("n") / width).cast("int") - 1), lambda i: F.slice(F.col("n"), i * width + 1, width))).alias("node", "row"))
    nodes = rows.select("snapshot_id", "node", F.coalesce(F.get("types", field("type").cast("int")), field("type").cast("string")).alias("type"), F.get("strings", field("name").cast("int")).alias("name"), field("self_size").alias("self_size"), field("edge_count").alias("edge_count"))
    w = Window.partitionBy("snapshot_id").orderBy("node")
    begin = F.sum("edge_count").over(w) - F.col("edge_count")
    owners = nodes.withColumn("begin", begin).where("edge_count > 0")
    owners = owners.select("snapshot_id", F.col("node").alias("src"), F.explode(F.sequence("begin", F.col("begin") + F.col("edge_count") - 1)).alias("ord"))
    ew = F.size("ef")
    targets = raw.select("snapshot_id", width.alias("width"), (F.size("n") / width).cast("int").alias("node_count"), F.posexplode(F.transform(F.sequence(F.lit(0), (F.size("e") / ew).cast("int") - 1), lambda i: F.get(F.col("e"), i * ew + F.array_position("ef", F.lit("to_node")).cast("int") - 1))).alias("ord", "to"))
    dst = F.when(F.col("to") >= F.col("width"), F.floor(F.col("to") / F.col("width"))).otherwise(F.col("to"))
    edges = owners.join(targets.select("snapshot_id", F.col("ord").cast("long").alias("ord"), dst.cast("int").alias("dst"), "node_count").where("dst >= 0 and dst < node_count"), ["snapshot_id", "ord"]).select("snapshot_id", "src", "dst", "ord")
    return nodes, edges


def read_suite(spark: SparkSession, manifest: str, reports: str) -> DataFrame:
    """The cases of a manifest (JSON list under ``cases``) with the report directories of the same name; missing ones say so."""
    m = spark.read.option("multiLine", True).json(manifest)
    cases = m.select(F.explode("cases").alias("c")).select("c.*").withColumnRenamed("id", "case_id")
    found = spark.read.option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "00_run_summary.json").json(reports).select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1).alias("case_id"), F.struct("*").alias("summary"))
    return cases.join(found, "case_id", "left").withColumn("status", F.when(F.col("summary").isNull(), "missing_report").otherwise("ok"))


def read_trace(spark: SparkSession, directory: str, tables: tuple[str, ...] = ("native_hook", "native_hook_statistic", "native_hook_frame", "data_dict")) -> dict[str, DataFrame]:
    """Exported trace tables; columns that a version lacks come as 0 or null."""
    needed = {"native_hook": ("ipid", "itid", "end_ts"), "native_hook_frame": ("symbol_id", "file_id", "ip")}
    out = {}
    for t in tables:
        df = spark.read.parquet(f"{directory}/{t}.parquet")
        for c in needed.get(t, ()):
            if c not in df.columns:
                df = df.withColumn(c, F.lit(None if c == "end_ts" else 0).cast("long"))
        out[t] = df
    return out


def export_snapshot(tables: dict[str, DataFrame], directory: str) -> dict[str, int]:
    """Writes one Parquet dataset a table, with the rows counted as they are written."""
    from pyspark.sql import Observation

    counts = {}
    for name, df in tables.items():
        seen = Observation(name)
        df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(f"{directory}/{name}")
        counts[name] = seen.get["rows"]
    return counts


def import_snapshot(spark: SparkSession, directory: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{directory}/{n}") for n in names}
