"""Rules and fault modes as data: a rule language over feature rows, keyword modes, crash patterns, tiers and verdicts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.operators.terms import contained_terms

#: Rows of a table that users write by hand (rules, patterns, hints) at most; it goes to every task as one row.
MOST_ROWS = 10_000


def one_row(dim: DataFrame, name: str = "dim", most: int = MOST_ROWS) -> DataFrame:
    """A hand-written table as one array of its rows, for broadcast; more than ``most`` rows are an error."""
    if dim.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows in a table that is broadcast")
    return F.broadcast(dim.agg(F.collect_list(F.struct(*[F.col(c) for c in dim.columns])).alias(name)))


def parse_rules(rules: DataFrame) -> DataFrame:
    """``rules(rule_id, condition, confidence, enabled, required)`` to clauses ``(rule_id, or_idx, and_idx, key, op, value)``.

    A condition is an OR of ANDs of ``key op value``, op being = != ~ ~=. Rules with a blank branch are rejected whole, for such
    a branch would always hold. A clause that does not parse has a null op and never holds.
    """
    live = rules.where("enabled").select("rule_id", F.split("condition", r"(?i)\s+OR\s+").alias("ors")).where(~F.exists("ors", lambda x: F.trim(x) == ""))
    ors = live.select("rule_id", F.posexplode("ors").alias("or_idx", "branch"))
    ands = ors.select("rule_id", "or_idx", F.posexplode(F.split("branch", r"(?i)\s+AND\s+")).alias("and_idx", "clause"))
    part = lambda i: F.regexp_extract("clause", r"^\s*([\w.]+)\s*(~=|!=|=|~)\s*(.*?)\s*$", i)
    return ands.select("rule_id", "or_idx", "and_idx", part(1).alias("key"), F.nullif(part(2), F.lit("")).alias("op"), F.regexp_replace(part(3), r"^['\"]|['\"]$", "").alias("value"))


def match_rules(features: DataFrame, rules: DataFrame, min_confidence: float = 0.0, key: str = "log_id") -> DataFrame:
    """Rules that hold for each feature row: ``(log_id, rule_id, confidence, high)``.

    A missing or null feature compares as the empty string, so != holds for it. = and != ignore case, ~ and ~= look for a
    Java pattern, or for the text where the pattern is invalid. Required features must be neither empty nor false.
    All rules come to a row as one array and are folded there: features are not shuffled.
    """
    branches = parse_rules(rules).groupBy("rule_id", "or_idx").agg(F.collect_list(F.struct("key", "op", "value")).alias("clauses")).groupBy("rule_id").agg(F.collect_list("clauses").alias("branches"))
    dims = rules.where("enabled").select("rule_id", "confidence", F.coalesce("required", F.array().cast("array<string>")).alias("required")).join(branches, "rule_id")
    names = [c for c in features.columns if c != key]
    long = features.select(key, F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in names])).alias("f"))
    text = lambda k: F.coalesce(F.try_element_at(F.col("f"), k), F.lit(""))

    def holds(c: Column) -> Column:
        actual, value = text(c["key"]), c["value"]
        # unclosed groups and leading repeats are no patterns; they never reach the matcher
        valid = ~value.rlike(r"^[*+?]|\\$|\([^)]*$|\[[^\]]*$")
        like = F.when(valid, F.rlike(actual, F.concat(F.lit("(?i)"), F.when(valid, value).otherwise("")))).otherwise(F.contains(F.lower(actual), F.lower(value)))
        return F.when(c["op"] == "=", F.lower(actual) == F.lower(value)).when(c["op"] == "!=", F.lower(actual) != F.lower(value)).when(c["op"].isin("~", "~="), like).otherwise(F.lit(False))

    def fits(r: Column) -> Column:
        truthy = F.forall(r["required"], lambda x: ~F.lower(text(x)).isin("", "false", "0"))
        return (r["confidence"] >= min_confidence) & truthy & F.exists(r["branches"], lambda b: F.forall(b, holds))

    rows = long.join(one_row(dims, "rules"), F.lit(True)).select(key, F.inline(F.filter("rules", fits)))
    return rows.select(key, "rule_id", "confidence", (F.col("confidence") >= 0.8).alias("high"))


def match_fault_modes(hits: DataFrame, rules: DataFrame, top: int = 3) -> DataFrame:
    """The best ``top`` fault-mode conclusions of each log among its rule hits."""
    modes = hits.join(rules.where("conclusion_type = 'fault_mode'").select("rule_id", "fault_mode"), "rule_id")
    return modes.withColumn("rank", F.row_number().over(Window.partitionBy("log_id").orderBy(F.desc("confidence"), "rule_id"))).where(F.col("rank") <= top)


def keyword_fault_modes(texts: DataFrame, modes: DataFrame, base: float = 0.35, top: int = 5) -> DataFrame:
    """``texts(log_id, text)`` and ``modes(mode, sub, keyword)``: per mode its best sub-cause by keywords contained.

    The score is min(1, base + 0.2 * hits). One automaton of all keywords, however many, reads each text once; only hits are
    shuffled.
    """
    words = modes.select("mode", "sub", F.lower("keyword").alias("term")).distinct()
    hits = contained_terms(texts.select("log_id", F.lower("text").alias("text")), words, "log_id").join(words, "term")
    by = hits.groupBy("log_id", "mode", "sub").agg(F.count("*").alias("hits"))
    best = by.withColumn("_r", F.row_number().over(Window.partitionBy("log_id", "mode").orderBy(F.desc("hits"), "sub"))).where("_r = 1").drop("_r")
    best = best.withColumn("score", F.least(F.lit(1.0), base + 0.2 * F.col("hits")))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("log_id").orderBy(F.desc("score"), "mode"))).where(F.col("rank") <= top)


def merge_modes(candidates: DataFrame, key: Sequence[str] = ("log_id",), ident: str = "fault_mode", order: str = "ord") -> DataFrame:
    """The most confident candidate for each id, the first on ties."""
    w = Window.partitionBy(*key, ident).orderBy(F.desc("confidence"), order)
    return candidates.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def address_pattern(va: Column) -> Column:
    """Pattern of a crash address (decimal), in order: null, null_offset, low, uaf_fill, uaf_partial, debug_poison, repeating,
    stack_like, normal; unknown where null."""
    h = F.lpad(F.conv(va.cast("string"), 10, 16), 16, "0")
    h = F.lower(h)
    return (
        F.when(va.isNull(), "unknown")
        .when(va == 0, "null")
        .when(va < 0x1000, "null_offset")
        .when(va < 0x10000, "low")
        .when(h.rlike("^(6b){4,8}$|^0{8}(6b){4}$|^0{4}(6b){6}$"), "uaf_fill")
        .when(h.rlike("(6b){3}"), "uaf_partial")
        .when(h.rlike("deadbeef|baadf00d|feedface|cdcdcdcd|abababab|dddddddd"), "debug_poison")
        .when(h.rlike(r"^(..)\1{7}$|^0{8}(..)\2{3}$"), "repeating")
        .when(h.rlike("^00007f[ef]|^0000007f"), "stack_like")
        .otherwise("normal")
    )


def register_correlation(events: DataFrame, registers: DataFrame, priority: Sequence[str] = ("x0", "r0", "rax", "rdi", "x1", "r1")) -> DataFrame:
    """``events(log_id, fault)`` and ``registers(log_id, reg, va)``: null, fill-pattern and matching registers of each log.

    A register matches on all bits, or on the low 48 where neither is 0. The source is the first matching one by ``priority``,
    else by name. Without a fault address null registers are no evidence.
    """
    low = lambda c: c % F.lit(1 << 48).cast("decimal(20,0)")
    rank = F.array_position(F.array(*map(F.lit, priority)), F.col("reg"))
    rows = registers.join(events.select("log_id", "fault"), "log_id")
    match = (F.col("va") == F.col("fault")) | ((F.col("va") != 0) & (F.col("fault") != 0) & (low(F.col("va")) == low(F.col("fault"))))
    rows = rows.withColumn("match", F.coalesce(match, F.lit(False))).withColumn("null_reg", (F.col("va") == 0) & F.col("fault").isNotNull()).withColumn("fill", address_pattern(F.col("va")) == "uaf_fill")
    listed = lambda c: F.sort_array(F.collect_list(F.when(F.col(c), F.col("reg"))))
    return rows.groupBy("log_id").agg(listed("null_reg").alias("null_registers"), listed("fill").alias("fill_registers"), listed("match").alias("matching_registers"), F.min_by("reg", F.when(F.col("match"), F.struct(F.when(rank > 0, rank).otherwise(99), F.col("reg")))).alias("source_register"))


def js_fault_mode(errors: DataFrame, patterns: DataFrame) -> DataFrame:
    """``errors(log_id, name, message)`` and ``patterns(ord, mode, expected, message_pattern)``, ``expected`` being an error's name.

    The first pattern whose name is contained and whose message matches gives 0.92; else the first of general errors whose
    message matches 0.8; else the first of a name, ``Error`` aside, 0.55; else the mode is unknown at 0.2.
    """
    rows = errors.join(one_row(patterns.select("ord", "mode", "expected", "message_pattern"), "patterns"), F.lit(True))
    name, message = F.lower(F.coalesce("name", F.lit(""))), F.coalesce("message", F.lit(""))
    said = lambda p: F.rlike(message, F.concat(F.lit("(?i)"), p["message_pattern"]))
    named = lambda p: F.contains(name, F.lower(p["expected"]))
    first = lambda cond: F.get(F.filter(F.array_sort("patterns"), cond), F.lit(0))["mode"]
    both, general, only = first(lambda p: named(p) & said(p)), first(lambda p: said(p) & F.lower(p["expected"]).isin("error", "typeerror", "referenceerror") & (message != "")), first(lambda p: named(p) & (p["expected"] != "Error"))
    conf = F.when(both.isNotNull(), 0.92).when(general.isNotNull(), 0.8).when(only.isNotNull(), 0.55).otherwise(0.2)
    return rows.select("log_id", F.coalesce(both, general, only, F.lit("JSC-FM-Unknown")).alias("fault_mode"), conf.alias("confidence"))


def js_stack(frames: DataFrame, framework: str = r"(?i)node_modules|@ohos|ark_framework|react-native") -> DataFrame:
    """First application frame of a script stack, whether native frames are mixed in, and a factor for the confidence."""
    is_js = F.col("file").rlike(r"\.(js|ts|ets|jsx|tsx)")
    app = is_js & ~F.col("file").rlike(framework)
    by = frames.groupBy("log_id").agg(F.min_by(F.struct("function", "file", "line"), F.when(app, F.col("pos"))).alias("app_frame"), F.bool_or(is_js).alias("has_js"), F.bool_or(~is_js).alias("has_native"))
    return by.select("log_id", "app_frame", (F.col("has_js") & F.col("has_native")).alias("hybrid"), F.when(F.col("has_js"), 1.0).otherwise(0.75).alias("factor"))


def api_fault(errors: DataFrame, knowledge: DataFrame, top: int = 2) -> DataFrame:
    """``errors(log_id, text, code)`` and ``knowledge(module, kind 'module'|'api'|'code'|'pattern', term)``: the modules that fit.

    0.35 for the module's name, 0.4 for each api, 0.55 for the code, 0.3 for each pattern, at most 0.99. The confidence grows by
    0.15 with each api, code and pattern.
    """
    terms = knowledge.select("module", "kind", F.lower("term").alias("term")).distinct()
    said, codes = terms.where("kind <> 'code'"), terms.where("kind = 'code'")
    in_text = contained_terms(errors.select("log_id", F.lower("text").alias("text")), said, "log_id").join(said, "term")
    by_code = errors.select("log_id", F.lower(F.col("code").cast("string")).alias("term")).join(codes, "term")
    hits = in_text.select("log_id", "module", "kind").unionByName(by_code.select("log_id", "module", "kind"))
    weight = F.when(F.col("kind") == "module", 0.35).when(F.col("kind") == "api", 0.4).when(F.col("kind") == "code", 0.55).otherwise(0.3)
    by = hits.groupBy("log_id", "module").agg(F.least(F.lit(0.99), F.sum(weight)).alias("score"), F.count_if(F.col("kind") != "module").alias("evidence"))
    by = by.withColumn("confidence", F.least(F.lit(0.98), 0.5 + 0.15 * F.col("evidence")))
    return by.withColumn("rank", F.row_number().over(Window.partitionBy("log_id").orderBy(F.desc("score"), "module"))).where(F.col("rank") <= top)


def route_modules(features: DataFrame, domains: DataFrame) -> DataFrame:
    """``features(log_id, modules array)`` and ``domains(domain, pattern)``: the knowledge domains of each log's modules."""
    rows = features.select("log_id", F.explode("modules").alias("module")).join(one_row(domains.select("domain", "pattern"), "domains"), F.lit(True))
    rows = rows.select("log_id", F.inline(F.filter("domains", lambda d: F.rlike(F.col("module"), d["pattern"]))))
    return rows.groupBy("log_id").agg(F.sort_array(F.collect_set("domain")).alias("domains"))


def classify_crash(events: DataFrame) -> DataFrame:
    """``events(log_id, stack_overflow_risk, sp_aligned, fp_in_stack, fp_above_sp, fill_registers int, pc_in_code, pc_in_jit, fault_pattern,
    heap_abort, signal, reason)``: the class of most confidence, the first on ties, and up to three others above 0.5."""
    #: Conditions, classes and confidences, in order.
    cand = [
        ("stack_overflow_risk = 'overflow'", "stack_overflow", "0.95"),
        ("stack_overflow_risk = 'high'", "stack_overflow", "0.85"),
        ("not sp_aligned", "stack_corruption", "0.8"),
        ("not fp_in_stack", "stack_corruption", "0.85"),
        ("not fp_above_sp", "stack_corruption", "0.8"),
        ("fill_registers > 0", "use_after_free", "least(0.9, round(0.7 + 0.1 * fill_registers, 2))"),
        ("not pc_in_code and not coalesce(pc_in_jit, false)", "code_corruption", "0.85"),
        ("pc_in_jit", "jit_failure", "0.7"),
        ("fault_pattern = 'null_deref'", "null_pointer_dereference", "0.98"),
        ("fault_pattern = 'null_base_plus_offset'", "null_pointer_member_access", "0.95"),
        ("fault_pattern = 'base_plus_offset'", "invalid_object_access", "0.7"),
        ("fault_pattern = 'unmapped_access'", "wild_pointer", "0.6"),
        ("heap_abort", "heap_corruption", "0.97"),
        ("not coalesce(heap_abort, false) and (upper(signal) like '%SIGABRT%' or lower(reason) like '%abort%')", "explicit_abort", "0.85"),
    ]
    rows = F.filter(F.array(*[F.when(F.expr(c), F.struct((-F.expr(p)).cast("double").alias("neg"), F.lit(i).alias("ord"), F.lit(n).alias("class"))) for i, (c, n, p) in enumerate(cand)]), lambda x: x.isNotNull())
    best = events.select("log_id", F.array_sort(rows).alias("c"))
    others = F.transform(F.filter(F.slice("c", 2, 3), lambda x: x["neg"] < -0.5), lambda x: x["class"])
    return best.select("log_id", F.coalesce(F.get("c", F.lit(0))["class"], F.lit("unknown")).alias("crash_class"), F.coalesce(-F.get("c", F.lit(0))["neg"], F.lit(0.0)).alias("confidence"), others.alias("secondary"))


def grade_evidence(features: DataFrame) -> DataFrame:
    """``features(log_id, has_detector, has_source, has_symbols, has_registers, rule_hits, vector_hits)`` to tier 1 to 5."""
    tier = F.when(F.col("has_detector"), 1).when(F.col("has_source") & F.col("has_symbols"), 2).when(F.col("has_symbols") & (F.col("has_registers") | (F.col("rule_hits") > 0)), 3).when(F.col("has_symbols") | (F.col("vector_hits") > 0), 4).otherwise(5)
    label = F.element_at(F.array(*map(F.lit, ("confirmed", "strong", "moderate", "weak", "insufficient"))), F.col("tier"))
    return features.withColumn("tier", tier).withColumn("tier_label", label)


#: Names of detectors, signs of registers, and symbols of two families.
DETECTORS = ("AddressSanitizer", "ASan", "ThreadSanitizer", "TSan", "MemorySanitizer", "MSan", "UBSan", "LeakSanitizer", "GWP-ASan", "Valgrind", "MallocStackLogging", "guard_malloc", "scudo", "HWASan")
REGISTER_SIGNS = ("fault_addr", "fault address", "registers:", "pc=", "lr=", "sp=", "x0=", "x1=", "r0=", "r1=", "rip=", "rbp=")
SYMBOL_FAMILIES = {"concurrency": ("mutex", "lock", "thread", "pthread", "dispatch", "async"), "memory": ("malloc", "free", "delete", "new", "alloc", "dealloc", "release")}


def grade_raw_evidence(logs: DataFrame, rule_hits: DataFrame, pattern_hits: DataFrame) -> DataFrame:
    """``logs(log_id, content, signal, crash_address, crash_reason, stack_functions)`` with ``rule_hits(log_id, pattern)`` and
    ``pattern_hits(log_id)`` to ``(log_id, tier, confidence_label, evidence)``.

    Tier 1: a detector is named in the reason, the functions or the first 5000 characters. 2: two of a segmentation fault, signs of
    registers in the first 10000 characters, an address under 0x1000. 3: two of rules that agree (two or more of one pattern),
    two symbols of concurrency, two of memory management. 4: any rule or pattern. 5: nothing. ``evidence`` names what was found up
    to the tier. Addresses are hexadecimal with 0x, else decimal.
    """
    words = lambda text, names: F.array_compact(F.array(*[F.when(text.contains(n.lower()), F.lit(n)) for n in names]))
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    by_rule = rule_hits.groupBy("log_id").agg(F.count(F.lit(1)).alias("rules"), F.count_distinct(F.nullif("pattern", F.lit(""))).alias("patterns"))
    by_pattern = pattern_hits.groupBy("log_id").agg(F.count(F.lit(1)).alias("hits"))
    rows = logs.join(by_rule, "log_id", "left").join(by_pattern, "log_id", "left")
    said = F.concat_ws(" ", low(F.col("crash_reason")), low(F.col("stack_functions")), low(F.substring("content", 1, 5000)))
    detector = F.get(words(said, DETECTORS), F.lit(0))
    text = F.col("crash_address")
    address = F.when(text.rlike("^0x[0-9a-fA-F]{1,15}$"), F.conv(F.substring(text, 3, 16), 16, 10).try_cast("long")).otherwise(text.try_cast("long"))
    found = lambda name, cond: F.when(F.coalesce(cond, F.lit(False)), F.lit(name))
    registers = F.array_compact(F.array(found("signal", F.upper("signal").contains("SIGSEGV")), found("registers", F.size(words(low(F.substring("content", 1, 10_000)), REGISTER_SIGNS)) > 0), found("near_null", address < 0x1000)))
    functions = low(F.col("stack_functions"))
    stack = F.array_compact(F.array(found("rules_agree", (F.col("rules") >= 2) & (F.col("patterns") == 1)), *[found(f"{k}_symbols", F.size(words(functions, names)) >= 2) for k, names in SYMBOL_FAMILIES.items()]))
    rows = rows.withColumn("_d", detector).withColumn("_r", registers).withColumn("_s", stack)
    any_hit = (F.coalesce("rules", F.lit(0)) > 0) | (F.coalesce("hits", F.lit(0)) > 0)
    tier = F.when(F.col("_d").isNotNull(), 1).when(F.size("_r") >= 2, 2).when(F.size("_s") >= 2, 3).when(any_hit, 4).otherwise(5)
    chain = F.when(F.col("_d").isNotNull(), F.array("_d")).when(F.size("_r") >= 2, F.col("_r")).when(F.size("_s") >= 2, F.concat("_r", "_s")).when(any_hit, F.concat("_r", "_s", F.array(F.lit("single_feature")))).otherwise(F.concat("_r", "_s"))
    label = F.when(tier <= 2, "high").when(tier == 3, "medium").otherwise("low")
    return rows.select("log_id", tier.alias("tier"), label.alias("confidence_label"), chain.alias("evidence"))


def resolve_conflicts(modes: DataFrame, evidence: DataFrame) -> DataFrame:
    """``modes(log_id, fault_mode, confidence)`` ordered by their evidence's best tier, then confidence."""
    best = evidence.groupBy("log_id", "fault_mode").agg(F.min("tier").alias("tier"))
    rows = modes.join(best, ["log_id", "fault_mode"], "left").withColumn("tier", F.coalesce("tier", F.lit(5)))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("log_id").orderBy("tier", F.desc("confidence"), "fault_mode")))


def diagnosis_status(modes: DataFrame, logs: DataFrame | None = None) -> DataFrame:
    """Confirmed from 0.85, probable with any mode; the best mode is the root cause. Of ``logs(log_id)`` those without a mode are
    preliminary."""
    by = modes.groupBy("log_id").agg(F.max("confidence").alias("confidence"), F.max_by("fault_mode", F.struct("confidence", "fault_mode")).alias("root_cause"))
    if logs is not None:
        by = logs.select("log_id").distinct().join(by, "log_id", "left")
    return by.withColumn("status", F.when(F.col("confidence") >= 0.85, "confirmed").when(F.col("root_cause").isNotNull(), "probable").otherwise("preliminary"))


def repair_gate(rows: DataFrame, least: float = 0.85) -> DataFrame:
    """Adds ``may_repair``: confirmed, and confident enough."""
    return rows.withColumn("may_repair", F.coalesce((F.col("status") == "confirmed") & (F.col("confidence") >= least), F.lit(False)))


def evidence_ceiling(rows: DataFrame, checks: dict[str, float]) -> DataFrame:
    """Adds ``missing`` (flags of ``checks`` that do not hold) and caps ``confidence`` by the lowest ceiling among them."""
    miss = F.filter(F.array(*[F.when(~F.coalesce(F.col(c), F.lit(False)), F.lit(c)) for c in checks]), lambda x: x.isNotNull())
    cap = F.least(F.lit(1.0), *[F.when(~F.coalesce(F.col(c), F.lit(False)), F.lit(v)).otherwise(1.0) for c, v in checks.items()])
    return rows.withColumn("missing", miss).withColumn("confidence", F.least(F.col("confidence"), cap))
