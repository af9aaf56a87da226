"""What a case needs to know, and what it leaves to be known: routes from modules and texts to knowledge, cases from verified runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What a module's name says of the domain, and the tags of that domain.
ROUTES = [
    ("libace|arkui|librender|libflutter", "ui_framework", ["lifecycle", "rendering", "layout"]),
    ("libweb|webkit|chromium|libcef", "webview", ["js_bridge", "rendering", "memory"]),
    ("pthread|dispatch|std::thread|libconcurrency", "concurrency", ["deadlock", "race_condition", "sync"]),
    ("malloc|jemalloc|tcmalloc|scudo|libmemory|free", "memory_allocator", ["heap_corruption", "double_free", "overflow"]),
    ("sqlite|leveldb|rocksdb|realm", "database", ["corruption", "locking", "io"]),
    (r"libssl|libcrypto|Security\.framework", "crypto_security", ["cert", "handshake", "buffer"]),
    ("libnetwork|CFNetwork|libcurl|okhttp", "networking", ["timeout", "buffer", "protocol"]),
    ("AVFoundation|libavcodec|MediaCodec|libmedia", "media", ["codec", "buffer", "sync"]),
    ("CoreGraphics|libskia|libhwui|libGPU", "graphics", ["gpu", "texture", "render_pipeline"]),
    ("JavaScriptCore|libv8|hermes|libark_js", "js_runtime", ["gc", "jit", "binding"]),
]
#: The crash category of a domain.
CATEGORIES = {"concurrency": "concurrency", "memory_allocator": "memory", "ui_framework": "logic", "webview": "logic", "database": "logic", "crypto_security": "memory", "networking": "logic", "media": "memory", "graphics": "memory", "js_runtime": "memory"}
#: States of a verification that counts, in words and levels, and phrases of an analysis that is none.
VERIFIED = ("passed", "compile_verified", "native_verified", "integration_verified")
LEVELS = ("L0", "L1", "L2", "L3", "L4")
NO_ANALYSIS = ("AI分析跳过", "跳过AI分析", "AI分析失败", "分析失败", "未配置密钥", "只运行了前三个工具")


def _filled(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(F.trim(c), F.lit(""))


def route_knowledge(features: DataFrame, routes: Sequence[tuple[str, str, Sequence[str]]] = ROUTES) -> DataFrame:
    """``features(log_id, modules array)`` to ``(log_id, domains, tags, matched map, categories)``, a row for each log.

    A route holds where a module's name fits its pattern in any case. Domains, tags and the crash ``categories`` of the domains are
    sorted and different; ``matched`` gives each module its last route's domain. Logs whose modules fit no route, or that have none,
    get empty lists: their search is not narrowed. One pass over the rows, without an exchange; repeated rows are judged each.
    """
    names = F.filter(F.coalesce("modules", F.array().cast("array<string>")), lambda m: m != "")

    def fit(pattern: str, domain: str, tags: Sequence[str]) -> Column:
        told = F.struct(F.lit(domain).alias("domain"), F.array(*[F.lit(t) for t in tags]).cast("array<string>").alias("tags"))
        return F.when(F.exists("_names", lambda m: m.rlike("(?i)" + pattern)), told)

    fits = F.array(*[fit(*route) for route in routes])
    last = lambda m: F.coalesce(*[F.when(m.rlike("(?i)" + pattern), F.lit(domain)) for pattern, domain, _ in reversed(routes)])
    rows = features.select("log_id", names.alias("_names")).withColumn("_fits", F.filter(fits, lambda x: x.isNotNull()))
    category = F.create_map(*[F.lit(x) for kv in CATEGORIES.items() for x in kv])
    domains = F.array_sort(F.array_distinct(F.transform("_fits", lambda x: x["domain"])))
    known = F.array_distinct(F.filter("_names", lambda m: last(m).isNotNull()))
    return rows.select("log_id", domains.alias("domains"), F.array_sort(F.array_distinct(F.flatten(F.transform("_fits", lambda x: x["tags"])))).alias("tags"), F.map_from_arrays(known, F.transform(known, last)).alias("matched"), F.array_sort(F.array_distinct(F.filter(F.transform(domains, lambda d: F.try_element_at(category, d)), lambda c: c.isNotNull()))).alias("categories"))


def narrow_hits(hits: DataFrame, routes: DataFrame, patterns: DataFrame) -> DataFrame:
    """``hits(log_id, pattern_id, ...)`` of patterns ``(pattern_id, crash_category)`` in a category of the log's route; logs without a
    category keep all hits, hits of unknown patterns go where there is one."""
    rows = hits.join(patterns.select("pattern_id", "crash_category"), "pattern_id", "left").join(routes.select("log_id", "categories"), "log_id", "left")
    open_ = F.col("categories").isNull() | (F.size("categories") == 0)
    return rows.where(open_ | F.coalesce(F.array_contains("categories", F.coalesce("crash_category", F.lit(""))), F.lit(False))).drop("categories")


def select_knowledge(features: DataFrame, shelf: DataFrame, modes: DataFrame) -> DataFrame:
    """``features(log_id, domain, feature)`` over ``shelf(domain, feature, pos, file)`` to the fault modes of ``modes(file, mode_id, ord)``
    that each log's features select: ``(log_id, file_rank, file, mode_id, ord)``.

    Files come in the order of features and, within one, of ``pos``; a file that several features name comes once, where it came
    first. Features without a file, and files without modes, give no row. Shelf and modes are dimension tables, which Spark
    broadcasts where it finds them small.
    """
    named = features.distinct().join(shelf, ["domain", "feature"])
    once = named.groupBy("log_id", "file").agg(F.min(F.struct("feature", "pos")).alias("place"))
    ranked = once.withColumn("file_rank", F.row_number().over(Window.partitionBy("log_id").orderBy("place", "file")))
    return ranked.join(modes, "file").select("log_id", "file_rank", "file", "mode_id", "ord")


def commit_gate(runs: DataFrame) -> DataFrame:
    """Adds ``may_commit``: a run's verification allows its case to be kept.

    Reads ``status, level, provenance, command, checks, plan_fingerprint, changed_files, applied, diff_status, claim_level,
    session_level`` (texts; ``applied`` boolean; null and empty texts say nothing). Passed without a level is enough for old runs. Others
    need a verified state of level L2 or more and of the level claimed (L1 unless said), a plan's fingerprint, provenance and changed
    files. Applied fixes need a review that passed or none. Never null.
    """
    status, level = F.lower(F.coalesce(_filled("status"), F.lit(""))), F.upper(F.coalesce("level", F.lit("")))
    old = (status == "passed") & (level == "")
    rank = lambda c, unknown: F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, LEVELS)), c) - 1, F.lit(-1)), F.lit(unknown))
    least = F.upper(F.coalesce(F.nullif("claim_level", F.lit("")), F.nullif("session_level", F.lit("")), F.lit("L1")))
    said = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    sure = status.isin(*VERIFIED) & level.isin(*LEVELS[2:]) & (rank(level, 0) >= rank(least, 1)) & said("plan_fingerprint") & said("provenance") & said("changed_files")
    reviewed = ~F.coalesce("applied", F.lit(False)) | (F.coalesce(F.nullif("diff_status", F.lit("")), F.lit("passed")) == "passed")
    return runs.withColumn("may_commit", (old | sure) & reviewed)


def case_records(runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Runs that applied a fix as patterns and their evidence, ready for ``upsert``.

    ``runs(run_id, ts, fixed, signature, summary, analysis, query_text, signal, crash_reason, os_type, platform, has_code, has_log, fixes
    array<struct<file, status>>, frames array<struct<function, resolved_function, module>>, root_cause, confidence)``. Runs that
    fixed nothing or have no frame give no case. A pattern's id is the hash of its signature and its applied files, so a run
    that comes again gives the same rows, and of runs with one id the last (by ``ts``, then ``run_id``) stands. Evidence are the first five
    frames, equal ones once (0.7), the fix (0.8) and the analysis (the run's own confidence, 0.6 unless said).
    """
    applied = F.array_sort(F.transform(F.filter("fixes", lambda f: (f["status"] == "applied") & (f["file"] != "")), lambda f: f["file"]))
    rows = runs.where(F.coalesce("fixed", F.lit(False)) & (F.coalesce(F.size("frames"), F.lit(0)) > 0)).withColumn("fix_files", F.coalesce(applied, F.array().cast("array<string>"))).withColumn("signature", F.coalesce("signature", F.lit("")))
    rows = rows.withColumn("pattern_id", F.concat(F.lit("pattern_"), F.md5(F.to_json(F.struct(F.lit("default").alias("codebase"), "fix_files", "signature")))))
    columns = [c for c in rows.columns if c != "pattern_id"]
    rows = rows.groupBy("pattern_id").agg(F.max_by(F.struct(*columns), F.struct("ts", "run_id")).alias("r")).select("pattern_id", "r.*")
    analysis = F.when(~F.rlike("analysis", F.lit("|".join(NO_ANALYSIS))), F.regexp_replace("analysis", r"^\s+|\s+$", ""))
    summary = F.trim(F.coalesce(F.nullif("summary", F.lit("")), F.nullif(F.substring_index(analysis, "\n", 1), F.lit("")), F.nullif("signature", F.lit("")), F.substring("query_text", 1, 200), F.lit("")))
    reason = F.lower(F.coalesce("crash_reason", F.lit("")))
    category = F.when(F.coalesce(F.contains("signal", F.lit("SIGSEGV")), F.lit(False)) | reason.contains("segmentation"), "memory").when(reason.contains("lock"), "concurrency").otherwise("unknown")
    needs = F.filter(F.array(F.lit("stack_trace"), F.when(F.col("has_code"), "code_snippet"), F.when(F.col("has_log"), "log_fragment"), F.lit("fix_applied")), lambda x: x.isNotNull())
    called = lambda f: F.coalesce(_filled(f["function"]), _filled(f["resolved_function"]))
    symbols = F.array_sort(F.array_distinct(F.filter(F.transform(F.slice("frames", 1, 20), called), lambda x: x.isNotNull())))
    confidence = F.coalesce(F.nullif(F.col("confidence").cast("double"), F.lit(0.0)), F.lit(0.6))
    patterns = rows.select("pattern_id", "run_id", summary.alias("pattern_summary"), F.col("signature").alias("crash_signature"), F.coalesce("os_type", F.lit("unknown")).alias("os_type"), "platform", category.alias("crash_category"), needs.alias("evidence_requirements"), F.lit(0.6).alias("confidence_score"), F.lit("draft").alias("validation_state"), symbols.alias("symbols"), confidence.alias("root_cause_confidence"), "fix_files", "root_cause", F.col("ts").alias("created_at"))
    row = lambda kind, ident, raw, score: F.struct(F.lit(kind).alias("evidence_type"), ident.alias("ident"), raw.alias("raw_content"), score.alias("reliability_score"))
    stack = F.transform(F.array_distinct(F.slice("frames", 1, 5)), lambda f: row("stack_trace", F.to_json(f), F.to_json(f), F.lit(0.7)))
    told = F.to_json(F.struct("root_cause", symbols.alias("symbols")))
    every = F.concat(stack, F.array(row("fix_applied", F.lit("apply_fix"), F.substring(F.to_json(F.struct("fixes")), 1, 8000), F.lit(0.8)), row("analysis_summary", F.lit("analysis_summary"), F.substring(told, 1, 12000), confidence)))
    found = rows.select("pattern_id", F.col("ts").alias("created_at"), F.explode(every).alias("e"))
    evidence = found.select(F.concat(F.lit("evidence_"), F.md5(F.concat("pattern_id", "e.ident"))).alias("evidence_id"), "pattern_id", "e.evidence_type", "e.raw_content", "e.reliability_score", "created_at")
    return patterns, evidence


def commit_cases(runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """:func:`case_records` of the runs that pass :func:`commit_gate`."""
    return case_records(commit_gate(runs).where("may_commit").drop("may_commit"))
