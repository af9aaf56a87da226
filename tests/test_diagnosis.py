"""Crash diagnosis on small tables."""

from decimal import Decimal as D

from pyspark.sql import functions as F

from faultline.operators import diagnosis, joins, retrieval


def test_modes_registers_and_grades(spark):
    events = spark.createDataFrame([(1, "SIGSEGV", "SEGV_MAPERR", D(0x18), "foo nullptr", None, None, None), (2, "SIGABRT", None, None, "__assert_fail", None, "Scudo ERROR", ["js_oom"]), (3, "SIGSEGV", None, D(0x7F0000001010), "", None, None, None)], "log_id int, signal string, signal_code string, fault decimal(20,0), frames_text string, fatal_message string, content string, hints array<string>")
    modes = diagnosis.cpp_fault_modes(events)
    got = {(m.log_id, m.fault_mode): m.confidence for m in modes.collect()}
    assert got[(1, "CPP-FM-01")] == 0.9 and got[(1, "CPP-FM-02")] == 0.72 and got[(2, "CPP-FM-15")] == 0.96 and got[(2, "CPP-FM-08")] == 0.88 and got[(2, "CPP-FM-14")] == 0.7
    regs = spark.createDataFrame([(1, "x0", D(0)), (1, "x1", D(5)), (3, "x2", D(0x7F0000001000)), (3, "x1", D(0x7F0000000FFF))], "log_id int, reg string, va decimal(20,0)")
    r = {x.log_id: (x.pattern, x.register, x.member_offset) for x in diagnosis.fault_register(events, regs).collect()}
    assert r == {1: ("null_base_plus_offset", "x0", 0x18), 2: ("no_address", None, None), 3: ("base_plus_offset", "x1", 0x11)}
    assert {x.log_id: x.grade for x in diagnosis.cpp_evidence_grade(events, modes, regs).collect()} == {1: "register", 2: "detector", 3: "register"}
    facts = {(x.log_id, x.fact) for x in diagnosis.deterministic_facts(events.withColumn("recursion", F.col("log_id") == 3)).collect()}
    assert facts == {(1, "null_pointer"), (2, "assertion"), (3, "stack_overflow")}


def test_pointer_checks(spark):
    points = spark.createDataFrame([(1, "sp", D(1040)), (1, "fp", D(1056)), (1, "pc", D(9000)), (2, "sp", D(5))], "log_id int, reg string, va decimal(20,0)").withColumn("point_id", F.col("reg"))
    maps = spark.createDataFrame([(1, 0, D(1024), D(900000), False, D(0), "[stack]"), (1, 1, D(8192), D(12288), True, D(0), "lib.so")], "log_id int, ord int, start decimal(20,0), end decimal(20,0), executable boolean, file_offset decimal(20,0), path string")
    got = {r.log_id: r for r in diagnosis.pointer_checks(joins.map_addresses(points, maps)).collect()}
    assert (got[1].sp_aligned, got[1].stack_overflow_risk, got[1].fp_above_sp, got[1].pc_in_code) == (True, "high", True, True)
    assert (got[2].sp_aligned, got[2].stack_overflow_risk) == (False, "outside")


def test_observations_sources_and_ingest(spark):
    obs = spark.createDataFrame([("odd", "s", "ok", " a ", 0, None), ("runtime_event", "s", "ok", "a", -1, None), ("verification", "s", "ok", "a", 0, None)], "kind string, source string, status string, summary string, round int, details string")
    assert diagnosis.dedup_observations(obs).count() == 2
    files = spark.createDataFrame([("a.cpp", "class Widget {\n  int m_size;\n};\nvoid Widget::Draw(int x) {\n  Renderer::Paint(m_size);\n}\n"), ("b.cpp", "struct Renderer {};\n")], "file string, text string")
    symbols, refs = diagnosis.extract_source_symbols(files)
    assert {(s.file, s.name, s.kind, s.line) for s in symbols.collect()} == {("a.cpp", "Widget", "type", 1), ("a.cpp", "m_size", "field", 2), ("a.cpp", "Widget::Draw", "function", 4), ("b.cpp", "Renderer", "type", 1)}
    assert ("a.cpp", "Renderer::Paint") in {tuple(r) for r in refs.collect()}
    chunks = spark.createDataFrame([("c1", "t", "body", "high", ["A::b"])], "chunk_id string, title string, chunk string, confidence string, symbols array<string>")
    one, two = (diagnosis.ingest_packs(chunks, F.lit(n))[0] for n in (1, 2))
    both = retrieval.upsert(one, two, ["pattern_id"]).collect()
    assert len(both) == 1 and both[0].created_at == 1 and both[0].confidence_score == 0.9
    weak = spark.createDataFrame([(1, "unknown", 0.2, "SIGSEGV", "", "null_deref_me", "f"), (2, "use_after_free", 0.9, "SIGSEGV", "", "", "f"), (3, "unknown", 0.2, "", "", "", "f")], "log_id int, crash_class string, confidence double, signal string, reason string, functions string, crash_function string")
    assert [(r.new_class, r.new_confidence) for r in diagnosis.classify_from_stack(weak).orderBy("log_id").collect()] == [("null_pointer_dereference", 0.72), ("use_after_free", 0.9), ("stack_symbol_hint", 0.45)]
