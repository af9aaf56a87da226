"""Crash diagnosis: native fault modes, fault registers, pointer checks, facts, evidence rows, source text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.operators.rules import address_pattern, one_row

#: Signals, signal codes and hints that point to a native fault mode.
SIGNAL_MODES = {"SIGSEGV": "CPP-FM-02", "SIGBUS": "CPP-FM-13", "SIGABRT": "CPP-FM-08", "SIGFPE": "CPP-FM-09", "SIGILL": "CPP-FM-10"}
SI_CODE_MODES = {"SEGV_MAPERR": "CPP-FM-02", "SEGV_ACCERR": "CPP-FM-03", "BUS_ADRALN": "CPP-FM-13", "BUS_ADRERR": "CPP-FM-13", "FPE_INTDIV": "CPP-FM-09"}
HINT_MODES = {"uncaught_exception": ("CPP-FM-08", 0.86), "allocator_heap_abort": ("CPP-FM-15", 0.94), "js_oom": ("CPP-FM-14", 0.7), "sqlite_bus": ("CPP-FM-13", 0.82), "gc_delayed_corruption": ("CPP-FM-02", 0.74)}
#: Fixed value: registers in the order in which a base is looked for.
BASE_REGISTERS = tuple(f"x{i}" for i in range(29)) + ("r0", "r1", "r2", "r3", "rdi", "rsi", "rax", "rbx", "rcx", "rdx")
OBSERVATION_KINDS = ("tool_result", "tool_error", "policy_decision", "runtime_event", "verification", "judge_feedback", "memory_feedback")
ALIGNMENT = {"arm64": 16, "aarch64": 16, "x86_64": 8}


def _pick(values: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def _rows(*candidates: Column) -> Column:
    return F.inline(F.filter(F.array(*candidates), lambda x: x.isNotNull()))


def cpp_fault_modes(events: DataFrame) -> DataFrame:
    """``events(log_id, signal, signal_code, fault, frames_text, fatal_message, content, hints array)`` to ``(log_id, fault_mode, level,
    confidence)``: candidates of all levels, the most confident of each mode."""
    pattern = address_pattern(F.col("fault"))
    frames, fatal = F.lower(F.coalesce("frames_text", F.lit(""))), F.lower(F.coalesce("fatal_message", F.lit("")))
    mode = lambda ident, level, conf: F.struct((F.lit(ident) if isinstance(ident, str) else ident).alias("fault_mode"), F.lit(level).alias("level"), F.lit(conf).alias("confidence"))
    signal, code = _pick(SIGNAL_MODES, F.coalesce("signal", F.lit(""))), _pick(SI_CODE_MODES, F.upper(F.coalesce("signal_code", F.lit(""))))
    hints = [F.when(F.array_contains(F.coalesce("hints", F.array().cast("array<string>")), h), mode(i, "hint", c)) for h, (i, c) in HINT_MODES.items()]
    rows = events.select(
        "log_id",
        _rows(
            F.when(signal.isNotNull(), mode(signal, "signal", 0.65)),
            F.when(code.isNotNull(), mode(code, "si_code", 0.72)),
            F.when(pattern.isin("null", "null_offset"), mode("CPP-FM-01", "address", 0.9)),
            F.when(pattern.isin("uaf_fill", "uaf_partial", "debug_poison", "low"), mode("CPP-FM-02", "address", 0.7)),
            F.when((F.col("signal") == "SIGKILL") & fatal.contains("watchdog"), mode("CPP-FM-16", "termination", 0.9)),
            F.when(F.concat(frames, fatal, F.lower(F.coalesce("content", F.lit("")))).rlike("scudo|jemalloc.*abort|invalid chunk|heap corruption|double free"), mode("CPP-FM-15", "detector", 0.96)),
            F.when(frames.contains("assert"), mode("CPP-FM-08", "stack", 0.88)),
            F.when(frames.rlike("napi_|napi::|arkruntime"), mode("CPP-FM-11", "stack", 0.55)),
            F.when(F.concat(frames, F.lower(F.coalesce("content", F.lit("")))).rlike("gwp[-_ ]?asan"), mode("CPP-FM-12", "detector", 0.95)),
            *hints,
        ),
    )
    return rows.groupBy("log_id", "fault_mode").agg(F.max("confidence").alias("confidence"), F.max_by("level", "confidence").alias("level"))


def cpp_evidence_grade(events: DataFrame, modes: DataFrame, registers: DataFrame) -> DataFrame:
    """Grade of a native crash's evidence: detector, register, address, pattern or insufficient."""
    m = modes.groupBy("log_id").agg(F.bool_or(F.col("level") == "detector").alias("detector"), F.bool_or(F.col("level").isin("address", "si_code")).alias("address"), F.bool_or(F.col("level") == "hint").alias("hint"))
    have = registers.select("log_id").distinct().withColumn("regs", F.lit(True))
    rows = events.select("log_id", "fault").join(m, "log_id", "left").join(have, "log_id", "left")
    return rows.select("log_id", F.when(F.col("detector"), "detector").when(F.col("regs") & F.col("fault").isNotNull(), "register").when(F.col("address"), "address").when(F.col("hint"), "pattern").otherwise("insufficient").alias("grade"))


def fault_register(events: DataFrame, registers: DataFrame) -> DataFrame:
    """``events(log_id, fault)`` and ``registers(log_id, reg, va)``: null dereference, null base plus member offset, base plus
    offset within 64 KB (by register order), or unmapped; with the register and the offset."""
    order = F.array_position(F.array(*map(F.lit, BASE_REGISTERS)), F.col("reg"))
    rank = F.when(order > 0, order).otherwise(F.lit(999))
    rows = events.select("log_id", "fault").join(registers, "log_id", "left").withColumn("rank", rank).withColumn("delta", F.col("fault") - F.col("va"))
    first = lambda cond: F.min_by("reg", F.when(cond, F.struct("rank", "reg")))
    base = (F.col("va") != 0) & (F.col("delta") > 0) & (F.col("delta") < 0x10000) & (F.col("rank") < 999)
    by = rows.groupBy("log_id").agg(F.first("fault").alias("fault"), first(F.col("va") == 0).alias("null_reg"), first(base).alias("base_reg"), F.min_by("delta", F.when(base, F.struct("rank", "reg"))).alias("base_delta"))
    kind = F.when(F.col("fault").isNull(), "no_address").when(F.col("fault") == 0, "null_deref").when(F.col("fault") < 0x10000, "null_base_plus_offset").when(F.col("base_reg").isNotNull(), "base_plus_offset").otherwise("unmapped_access")
    rows = by.withColumn("pattern", kind)
    null = F.col("pattern").isin("null_deref", "null_base_plus_offset")
    return rows.select("log_id", "pattern", F.when(null, F.col("null_reg")).when(F.col("pattern") == "base_plus_offset", F.col("base_reg")).alias("register"), F.when(F.col("pattern") == "null_base_plus_offset", F.col("fault")).when(F.col("pattern") == "base_plus_offset", F.col("base_delta")).cast("long").alias("member_offset"))


def pointer_checks(pointers: DataFrame, arch: str = "arm64") -> DataFrame:
    """``pointers(log_id, reg, va, start, end, path, executable)`` as ``map_addresses`` gives them: stack pointer alignment and risk,
    frame pointer against it, program counter in code."""
    align = ALIGNMENT.get(arch, 4)
    of = lambda reg, c: F.max(F.when(F.col("reg") == reg, c))
    stack = F.coalesce(F.col("path").contains("[stack"), F.lit(False))
    by = pointers.groupBy("log_id").agg(of("sp", F.col("va")).alias("sp"), of("fp", F.col("va")).alias("fp"), of("sp", stack).alias("sp_in_stack"), of("sp", F.col("start")).alias("start"), of("sp", F.col("end")).alias("end"), of("pc", F.coalesce("executable", F.lit(False))).alias("pc_in_code"), of("pc", F.coalesce(F.col("path").rlike(r"(?i)jit|dalvik-jit|\[anon:.*code"), F.lit(False))).alias("pc_in_jit"))
    room = F.col("sp") - F.col("start")
    risk = F.when(F.col("sp").isNull(), "unknown").when(~F.col("sp_in_stack"), "outside").when(room < 4096, "high").when(room < 0.1 * (F.col("end") - F.col("start")), "low").otherwise("none")
    return by.select("log_id", (F.col("sp") % align == 0).alias("sp_aligned"), risk.alias("stack_overflow_risk"), (F.col("fp") >= F.col("sp")).alias("fp_above_sp"), "pc_in_code", "pc_in_jit")


def deterministic_facts(events: DataFrame) -> DataFrame:
    """``events(log_id, signal, fault, frames_text, fatal_message, recursion)`` to ``(log_id, fact, confidence)``."""
    text = F.lower(F.concat_ws(" ", F.coalesce("frames_text", F.lit("")), F.coalesce("fatal_message", F.lit(""))))
    fact = lambda n, c: F.struct(F.lit(n).alias("fact"), F.lit(c).alias("confidence"))
    rows = events.select("log_id", _rows(F.when((F.col("fault") >= 0) & (F.col("fault") < 0x1000), fact("null_pointer", 0.95)).when(text.rlike("nullptr|null_ptr|nullpointer|null_deref"), fact("null_pointer", 0.8)), F.when(F.coalesce("recursion", F.lit(False)), fact("stack_overflow", 0.9)), F.when((F.col("signal") == "SIGABRT") & text.rlike("assert"), fact("assertion", 0.9)), F.when(text.rlike("double free|heap corruption|scudo"), fact("heap_corruption", 0.95)), F.when(text.rlike("asan|gwp-asan|hwasan"), fact("detector_report", 0.97)), F.when((F.col("signal") == "SIGFPE") | text.contains("divide_by_zero"), fact("divide_by_zero", 0.9)), F.when(text.rlike("uncaught|terminate called"), fact("uncaught_exception", 0.85))))
    return rows.dropDuplicates(["log_id", "fact"])


def classify_from_stack(rows: DataFrame) -> DataFrame:
    """``rows(log_id, crash_class, confidence, signal, reason, functions, crash_function)``: classes of weak evidence replaced by what
    signal and symbols say; surer ones stay."""
    weak = F.col("crash_class").isin("unknown", "wild_pointer", "")
    keep = (~weak & (F.col("confidence") >= 0.7)) | F.coalesce((F.col("confidence") >= 0.8) & ~weak, F.lit(False))
    signal, reason, text = F.upper(F.coalesce("signal", F.lit(""))), F.lower(F.coalesce("reason", F.lit(""))), F.lower(F.coalesce("functions", F.lit("")))
    null = text.rlike("nullptr|null_ptr|nullpointer|null_deref|null deref") & (signal.rlike("SIGSEGV|SIGBUS") | reason.contains("segfault"))
    segv = signal.contains("SIGSEGV") | reason.rlike("segfault|segmentation")
    hint = F.col("crash_function").isNotNull() & (weak | (F.col("confidence") < 0.5))
    floor = lambda v: F.greatest("confidence", F.lit(v))
    return rows.withColumn("new_class", F.when(keep, F.col("crash_class")).when(null, "null_pointer_dereference").when(segv, "segmentation_fault").when(hint, "stack_symbol_hint").otherwise(F.col("crash_class"))).withColumn("new_confidence", F.when(keep, F.col("confidence")).when(null, floor(0.72)).when(segv, floor(0.55)).when(hint, floor(0.45)).otherwise(F.col("confidence")))


def detect_features(logs: DataFrame, dim: DataFrame) -> DataFrame:
    """``logs(log_id, content)`` against ``dim(domain, feature, pattern)``: the features each text shows."""
    rows = logs.join(one_row(dim.select("domain", "feature", "pattern"), "dims"), F.lit(True))
    return rows.select("log_id", F.explode(F.array_distinct(F.transform(F.filter("dims", lambda d: F.rlike(F.col("content"), d["pattern"])), lambda d: F.struct(d["domain"].alias("domain"), d["feature"].alias("feature")))))).select("log_id", "col.*")


def ingest_evidence(stages: DataFrame, relevance: dict[str, float]) -> DataFrame:
    """``stages(log_id, kind, content)`` to evidence rows with the fixed relevance of their kind."""
    return stages.withColumn("relevance", F.coalesce(_pick(relevance, F.col("kind")), F.lit(0.5))).withColumn("confidence", F.col("relevance"))


def dedup_observations(rows: DataFrame) -> DataFrame:
    """``rows(kind, source, status, summary, round, details)``: unknown kinds become runtime events; equal content counts once."""
    kind = F.when(F.col("kind").isin(*OBSERVATION_KINDS), F.col("kind")).otherwise("runtime_event")
    clean = rows.withColumn("kind", kind).withColumn("summary", F.trim(F.coalesce("summary", F.lit("")))).withColumn("round", F.greatest(F.coalesce("round", F.lit(0)), F.lit(0)))
    ident = F.concat(F.lit("obs_"), F.substring(F.sha2(F.to_json(F.struct("kind", "source", "status", "summary", "round", "details")), 256), 1, 16))
    return clean.withColumn("observation_id", ident).dropDuplicates(["observation_id"])


def attach_evidence(hits: DataFrame, evidence: DataFrame, limit: int = 3) -> DataFrame:
    """The most reliable evidence of each hit's pattern."""
    top = evidence.withColumn("rank", F.row_number().over(Window.partitionBy("pattern_id").orderBy(F.desc("reliability_score"), "evidence_id"))).where(F.col("rank") <= limit)
    return hits.join(top, "pattern_id")


def ingest_packs(chunks: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Chunks ``(chunk_id, title, chunk, confidence, symbols)`` as patterns and evidence, ready for ``upsert``; the same chunks give
    the same keys, so a second ingest changes nothing."""
    score = F.coalesce(_pick({"high": 0.9, "medium": 0.7, "low": 0.4}, F.lower(F.coalesce("confidence", F.lit("medium")))), F.lit(0.6))
    patterns = chunks.select(F.col("chunk_id").alias("pattern_id"), F.concat_ws("\n", "title", "chunk").alias("pattern_summary"), F.array_join("symbols", " ").alias("crash_signature"), score.alias("confidence_score"), F.when(F.lower("confidence") == "high", "verified").otherwise("draft").alias("validation_state"), now.alias("created_at"))
    evidence = chunks.select(F.col("chunk_id").alias("pattern_id"), F.md5(F.concat_ws("\u0000", "chunk_id", "chunk")).alias("evidence_id"), F.col("chunk").alias("raw_content"), score.alias("reliability_score"))
    return patterns, evidence


def build_cases(runs: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Runs as patterns with ids from the hash of their fields."""
    return runs.withColumn("pattern_id", F.concat(F.lit("case_"), F.md5(F.to_json(F.struct(*fields))))).dropDuplicates(["pattern_id"])


def extract_source_symbols(files: DataFrame, most: int = 400) -> tuple[DataFrame, DataFrame]:
    """``files(file, text)`` to definitions ``(file, name, kind, line)`` and references ``(file, token)``: identifiers of eight letters
    or more, qualified, or ``m_`` members, that the file does not define, the first ``most`` of each file."""
    lines = files.select("file", F.posexplode(F.split("text", r"\r?\n")).alias("p", "t")).withColumn("line", F.col("p") + 1)
    forms = [("function", r"^\s*(?:[\w:<>*&~]+\s+)+\**&?((?:\w+::)*~?\w+)\s*\([^;]*\)\s*(?:const)?\s*(?:noexcept)?\s*\{"), ("type", r"^\s*(?:class|struct|enum(?:\s+class)?|union)\s+(\w+)"), ("field", r"^\s+[\w:<>*& ]+\s+(m_\w+)\s*(?:=[^;]*|\{[^}]*\})?;")]
    found = [F.when(F.col("t").rlike(p), F.struct(F.regexp_extract("t", p, 1).alias("name"), F.lit(k).alias("kind"))) for k, p in forms]
    symbols = lines.select("file", "line", _rows(*found)).distinct()
    tokens = F.array_distinct(F.regexp_extract_all("text", F.lit(r"((?:[A-Za-z_]\w*::)*[A-Za-z_]\w*)"), F.lit(1)))
    refs = files.select("file", F.posexplode(F.filter(tokens, lambda x: F.contains(x, F.lit("::")) | x.startswith("m_") | (F.length(x) >= 8))).alias("ord", "token"))
    refs = refs.join(symbols.select("file", F.col("name").alias("token")), ["file", "token"], "left_anti")
    return symbols, refs.withColumn("r", F.row_number().over(Window.partitionBy("file").orderBy("ord"))).where(F.col("r") <= most).select("file", "token")


def search_source(lines: DataFrame, pattern: str, limit: int = 50) -> DataFrame:
    """The first ``limit`` lines ``(file, line, text)`` that match."""
    return lines.where(F.col("text").rlike(pattern)).orderBy("file", "line").limit(limit)
