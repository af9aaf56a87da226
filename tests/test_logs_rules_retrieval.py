"""Log parsing, rules, timing, retrieval, evaluation, sources and streams on small tables."""

import json
import random

import pytest
from pyspark.sql import functions as F

from faultline.operators import evaluation, logs, retrieval, rules, stacks, timing
from faultline.sources import readers
from faultline.streaming import jobs


def log(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "log_id int, content string")


def test_log_kinds(spark):
    texts = ["", "Fatal signal 11 (SIGSEGV)", "AppFreeze THREAD_BLOCK_6S", "watchdog SIGKILL EXC_CRASH", "ANR in app\nSIGSEGV", "java.lang.OutOfMemoryError", "jetsam SIGSEGV", "memory pressure", "FATAL EXCEPTION: main", "#00 pc 0000", "hello", "watchdog", "x" * 13000 + "SIGSEGV"]
    want = ["unknown", "native_crash", "app_freeze", "watchdog", "mixed_anr_crash", "oom_kill", "mixed_oom_crash", "memory_pressure", "java_crash", "native_crash", "unknown", "watchdog", "unknown"]
    assert [r.log_kind for r in logs.classify_log_kind(log(spark, *texts)).orderBy("log_id").collect()] == want


def test_frames_maps_registers_sections(spark):
    text = "Reason:Signal:SIGSEGV\nRegisters:\n x0: 0000000000000000 x1: 6b6b6b6b6b6b6b6b\n pc: 0000007f12345678\nMaps:\n7f000000-7f100000 r-xp 00001000 00:00 0 /system/lib/liba.so\n0x1000 - 0x1fff +app arm64 <x> /Applications/app\n0x0 - 0xffffffffffffffff +??? unknown-arch\n#00 pc 0000abcd /system/lib/liba.so (foo(int)+12)\n3   CoreFoundation   0x00007fff2 -[NSException raise] + 9\n  at com.app.Main.run(Main.java:42)\nBuild id: libx.so BuildID: AB12CD34EF"
    lines = logs.explode_lines(log(spark, text))
    f = {r.line_no: r for r in logs.parse_frames(lines).collect()}
    assert (f[9].function, f[9].offset, f[9].module) == ("foo(int)", 12, "/system/lib/liba.so") and (f[10].frame_number, f[10].function, f[10].offset) == (3, "-[NSException raise]", 9) and (f[11].function, f[11].file, f[11].line) == ("com.app.Main.run", "Main.java", 42)
    assert {(r.path, int(r.end), r.executable) for r in logs.parse_maps(lines).collect()} == {("/system/lib/liba.so", 0x7F100000, True), ("/Applications/app", 0x2000, True)}
    regs = {r.reg: r for r in logs.parse_registers(lines).collect()}
    assert regs["x0"].is_null and regs["x1"].is_fill and int(regs["pc"].va) == 0x7F12345678
    assert {"signal", "registers", "maps", "backtrace", "build_id"} <= set(logs.detect_sections(log(spark, text)).first().sections)
    s = {r.line_no: (r.section, r.block) for r in logs.assign_sections(lines).collect()}
    assert s[1] == (None, 0) and s[3] == ("registers", 1) and s[6] == ("maps", 2)
    assert {r.field: r.value for r in logs.extract_headers(lines).collect()}["signal"] == "SIGSEGV"
    assert logs.parse_status(log(spark, text, "x"), logs.parse_frames(lines)).orderBy("log_id").collect()[1].status == "error"


def test_timeline_and_operations(spark):
    hilog = "\n".join(f"07-29 10:30:4{i}.123 12 34 E C0/Tag: msg {i}" for i in range(4))
    lines = logs.explode_lines(log(spark, hilog, "2026-07-29 10:30:45 click button\n" * 3, "short"))
    assert {(r.log_id, r.format) for r in logs.extract_timeline(lines).collect()} == {(0, "android_logcat"), (1, "generic")}
    assert {r.format for r in logs.extract_timeline(lines, prefer_hilog=True).where("log_id = 0").collect()} == {"harmony_hilog"}
    ops = spark.createDataFrame([(0, "App", "onResume"), (1, "x", "button click"), (2, "x", "zzz")], "i int, tag string, message string")
    assert {r.i: r.category for r in logs.classify_ops(ops).collect()} == {0: "lifecycle", 1: "user_action"}


def test_jank(spark):
    f = spark.createDataFrame([(1, "a", 8.0, "UIThread", "Build", "false"), (1, "b", 42.0, "UIThread", "Layout", None), (1, "c", 30.0, "RenderThread", "Fence", None), (1, "d", 16.67, "x", "y", None)], "log_id int, frame_id string, duration_ms double, thread string, stage string, jank string")
    s = timing.jank_summary(f).first()
    assert (s.frame_count, s.jank_count) == (4, 2)
    assert [r.frame_id for r in timing.jank_events(f).orderBy("rank").collect()] == ["b", "c"]
    modes = timing.jank_fault_modes(timing.jank_events(f)).collect()
    assert {(m.frame_id, m.fault_mode) for m in modes} == {("b", "JANK-FM-03"), ("c", "JANK-FM-05")}
    cpu = spark.createDataFrame([(1, "UIThread", "Running", 4.0, None), (1, "UIThread", "block", None, 3e6), (1, None, "zz", 1.0, None)], "log_id int, thread string, state string, duration_ms double, duration_ns double")
    assert [(r.thread, r.running, r.blocked) for r in timing.cpu_state_stats(cpu).collect()] == [("UIThread", 4.0, 3.0)]
    assert timing.coalesce_aliases(spark.createDataFrame([("", "7")], "`Frame Id` string, id string"), {"fid": ["frame_id", "id"], "none": ["q"]}).first().fid == "7"


def test_freeze(spark):
    s = spark.createDataFrame([(1, 0, ["a", "b", "c"]), (1, 1, ["a", "b", "c"]), (1, 2, ["z"]), (1, 3, [])], "log_id int, sample_id int, frames array<string>")
    top = stacks.cluster_stacks(s).orderBy("rank").first()
    assert (top.n, top.samples, top.prefix, top.ratio) == (2, 4, ["a", "b", "c"], 0.5)
    kinds = spark.createDataFrame([("THREAD_BLOCK_6S",), ("nothing",)], "t string").select(timing.classify_freeze(F.col("t")).alias("k")).collect()
    assert [(k.k.freeze_type, k.k.timeout_ms) for k in kinds] == [("THREAD_BLOCK_6S", 6000), ("UNKNOWN", None)]
    load = spark.createDataFrame([("cpu usage: 91% MemAvailable: 524288 kB low memory",), ("cpu: 10%",)], "t string").select(timing.system_load(F.col("t")).alias("l")).collect()
    assert (load[0].l.cpu_percent, load[0].l.available_mb, load[0].l.stressed, load[1].l.stressed) == (91, 512, True, False)
    edges = logs.parse_wait_edges(log(spark, "1:2 to 3:4 code 5 wait:6.5 s\n3:4 to 1:2 code 5 wait:1 s\nmain waiting on worker"))
    assert {(e.src, e.dst) for e in edges.collect()} == {("1:2", "3:4"), ("3:4", "1:2"), ("main", "worker")}


def test_rules(spark):
    f = spark.createDataFrame([(1, "SIGSEGV", "libapp", None), (2, "SIGABRT", None, "yes")], "log_id int, signal string, module string, flag string")
    dim = spark.createDataFrame([("a", "signal = sigsegv AND module ~ ^lib", 0.9, True, []), ("b", "module != x", 0.5, True, ["flag"]), ("c", "signal ~ [bad OR signal ~= (x", 0.6, True, []), ("d", "a OR ", 0.9, True, []), ("e", "missing != x", 0.3, True, [])], "rule_id string, condition string, confidence double, enabled boolean, required array<string>")
    got = {(r.log_id, r.rule_id) for r in rules.match_rules(f, dim).collect()}
    assert got == {(1, "a"), (2, "b"), (1, "e"), (2, "e")}
    va = [None, 0, 0x10, 0x2000, 0x6B6B6B6B6B6B6B6B, 0xDEADBEEF, 0x7FFE12345678, 0x12345678AB]
    from decimal import Decimal as D

    p = spark.createDataFrame([(i, None if v is None else D(v)) for i, v in enumerate(va)], "i int, v decimal(20,0)").select("i", rules.address_pattern(F.col("v")).alias("p")).orderBy("i").collect()
    assert [x.p for x in p] == ["unknown", "null", "null_offset", "low", "uaf_fill", "debug_poison", "stack_like", "normal"]


def fuse_loop(hits, max_hits, max_chars, limits):
    out, seen, layers, used, n = {}, set(), {}, 0, 0
    for h in hits:
        if n >= max_hits:
            out[h["id"]] = "hit_budget"
        elif h["fp"] in seen:
            out[h["id"]] = "duplicate"
        elif layers.get(h["layer"], 0) >= limits.get(h["layer"], 2):
            out[h["id"]] = "layer_budget"
        elif used >= max_chars:
            out[h["id"]] = "character_budget"
        else:
            room = max_chars - used
            used += h["chars"] if h["chars"] <= room else room + 1
            out[h["id"]], n = "selected", n + 1
            seen.add(h["fp"])
            layers[h["layer"]] = layers.get(h["layer"], 0) + 1
    return out


def test_fusion_equals_a_loop(spark):
    r = random.Random(6)
    hits = [{"q": q, "id": i, "layer": r.choice(["code", "crash", "concept", "other"]), "fp": f"f{r.randrange(9)}", "chars": r.randrange(1, 2500), "score": float(-i)} for q in range(5) for i in range(14)]
    text = "query_id int, hit_id int, backend string, layer string, fingerprint string, excerpt string, provenance string, source_type string, confidence string, confidence_score double, score double, qualified int"
    rows = [(h["q"], h["id"], "internal_case", h["layer"], h["fp"], "x" * h["chars"], "historical_case", None, "medium", None, h["score"], 0) for h in hits]
    rows.append((0, 99, "internal_case", "code", "zz", "x", "model_inferred", None, "low", None, 9.0, 0))
    got = {(x.query_id, x.hit_id): x.reason for x in retrieval.fuse_hits(spark.createDataFrame(rows, text)).collect()}
    assert got.pop((0, 99)) == "low_confidence_model_inferred"
    for q in range(5):
        want = fuse_loop([h for h in hits if h["q"] == q], 6, 4500, retrieval.LAYER_LIMITS)
        assert {i: got[(q, i)] for i in want} == want


def test_chunks_are_stable_and_whole(spark):
    docs = spark.createDataFrame([(1, "intro\n# A\n" + "x" * 4000 + "\n## B\nbody"), (2, ""), (3, None)], "doc_id int, text string")
    a, b = retrieval.chunk_docs(docs).collect(), retrieval.chunk_docs(docs.repartition(3)).collect()
    assert sorted(a) == sorted(b) and [(x.title, len(x.chunk)) for x in sorted(a, key=lambda x: (x.section_no, x.window_no))] == [("", 5), ("A", 1800), ("A", 1800), ("A", 400), ("B", 4)]


def test_upsert_keeps_created_at(spark):
    old = spark.createDataFrame([(1, "a", 10), (2, "b", 11)], "k int, v string, created_at int")
    new = spark.createDataFrame([(2, "c", 99), (3, "d", 99)], "k int, v string, created_at int")
    assert {tuple(r) for r in retrieval.upsert(old, new, ["k"]).collect()} == {(1, "a", 10), (2, "c", 11), (3, "d", 99)}


def test_evaluation(spark):
    runs = spark.createDataFrame([("a", "Null", "f.c"), ("b", "oom", None)], "case_id string, category string, file string")
    manifest = spark.createDataFrame([("a", "null", ""), ("b", "uaf", "g.c"), ("c", "x", "y")], "case_id string, expected_category string, expected_file string")
    got = {r.case_id: (r.status, r.category_match, r.file_match) for r in evaluation.evaluate_cases(runs, manifest, ("category", "file")).collect()}
    assert got == {"a": ("ok", "correct", "unknown"), "b": ("ok", "incorrect", "incorrect"), "c": ("missing_report", "unknown", "unknown")}


def test_vendor_json_reports_and_bundles(spark, tmp_path):
    sentry = {"exception": {"values": [{"stacktrace": {"frames": [{"function": "outer"}]}}, {"stacktrace": {"frames": [{"function": "main", "lineno": 1}, {"function": "crash", "lineno": 2}]}}]}}
    crashlytics = {"exceptions": [{"frames": [{"symbol": "top", "file": "a.m", "line": 3}]}]}
    got = readers.vendor_json_to_frames(log(spark, json.dumps(sentry), json.dumps(crashlytics), "not json")).collect()
    assert [(r.vendor, r.function, r.line) for r in sorted(got, key=lambda r: (r.log_id, r.pos))] == [("sentry", "crash", 2), ("sentry", "main", 1), ("crashlytics", "top", 3)]
    (tmp_path / "a.json").write_text('{"frames": [{"id": "1", "duration": "20"}]}')
    (tmp_path / "b.csv").write_text("﻿id, duration\n2,30\n3,\n")
    rows = sorted(str(r.row.get("id")) + ":" + str(r.row.get("duration")) for r in readers.read_perf_rows(spark, str(tmp_path)).collect())
    assert rows == ["1:20", "2:30", "3:"]
    files = spark.createDataFrame([(f"/x/memleak-native-app-{p}-{k}.txt",) for p, k in ((1, "sample"), (1, "smaps"), (1, "123"), (2, "sample"))] + [("/x/memleak-kernel-app-0-9.txt",)], "path string")
    b = readers.discover_bundles(files).orderBy("rank").collect()
    assert [(x.pid, x.kinds) for x in b] == [("1", 4), ("2", 2)]
    a = readers.read_logs(spark, str(tmp_path))
    assert a.count() == 2 and readers.directory_hash(a).count() == 1


def test_export_counts_and_streams(spark, tmp_path):
    df = spark.range(5)
    assert readers.export_snapshot({"t": df}, str(tmp_path / "out")) == {"t": 5}
    assert readers.import_snapshot(spark, str(tmp_path / "out"), ["t"])["t"].count() == 5
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.log").write_text("Fatal signal 11 (SIGSEGV)")
    q = jobs.triage(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("triage").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    assert spark.table("triage").first().log_kind == "native_crash"
    assert set(spark.table("triage").columns) == {"log_id", "os", "log_kind", "confidence"} and spark.table("triage").first().os is not None
    samples = spark.createDataFrame([(1, i, float(3 * i)) for i in range(10)], "pid long, pos long, value double")
    samples.write.parquet(str(tmp_path / "samples"))
    live = jobs.live_trend(spark.readStream.schema(samples.schema).parquet(str(tmp_path / "samples")))
    q = live.writeStream.format("memory").queryName("trend").outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp2")).start()
    q.awaitTermination(120)
    r = spark.table("trend").first()
    assert (r.n, r.first_value, r.last_value, r.max_step) == (10, 0, 27, 3) and r.slope == pytest.approx(3) and r.r2 == pytest.approx(1)


def test_first_seen_incidents_come_once(spark, tmp_path):
    from datetime import datetime

    src = tmp_path / "in"
    spark.createDataFrame([(datetime(2024, 5, 1, 1), "a"), (datetime(2024, 5, 1, 1, 5), "a"), (datetime(2024, 5, 1, 2), "b")], "ts timestamp, ident string").write.parquet(str(src))
    stream = jobs.first_seen(spark.readStream.schema("ts timestamp, ident string").parquet(str(src)), ["ident"])
    stream.writeStream.format("memory").queryName("seen").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start().awaitTermination(60)
    assert sorted(r.ident for r in spark.table("seen").collect()) == ["a", "b"]


def test_guidance_without_default_blocks(spark):
    hits = spark.createDataFrame([(1, "r", "p"), (1, "r", "q"), (2, "s", None)], "log_id long, rule_id string, pattern_id string")
    blocks = spark.createDataFrame([("b", None, None, 2, "t"), ("c", None, None, 1, "t"), ("d", "r", None, 1, "t"), ("d", None, "p", 1, "t"), ("e", None, "q", 0, "t")], "block_id string, rule_id string, pattern_id string, priority int, type string")
    got = lambda b: sorted((r.log_id, r.position, r.block_id) for r in retrieval.guidance_for(hits, b).collect())
    assert got(blocks) == [(1, 1, "c"), (1, 2, "b"), (1, 3, "d"), (1, 4, "e"), (2, 1, "c"), (2, 2, "b")]
    assert got(blocks.where("rule_id is not null or pattern_id is not null")) == [(1, 1, "d"), (1, 2, "e")]


def test_evidence_on_ties_by_its_fields(spark):
    items = spark.createDataFrame([(1, t, v, 0.5, 0.5) for t, v in (("b", 10), ("b", 9), (None, 1), ("a", 3), ("c", 1), ("a", 20), ("a", 3))], "log_id int, event_type string, v long, relevance double, confidence double")
    got = retrieval.dedup_evidence(items, ["event_type", "v"], 4).orderBy("rank").collect()
    assert [(r.event_type, r.v) for r in got] == [("a", 3), ("a", 20), ("b", 9), ("b", 10)]


def test_wait_lines_are_read_in_one_pass(spark, capsys):
    edges = logs.parse_wait_edges(log(spark, "1:2 to 3:0 code 5 wait:6.5 s\n3:4 to 1:00 code x wait:1 s a waiting on b\nmain Blocked on worker\nnothing"))
    assert sorted((r.src, r.dst, r.code, r.wait_seconds, r.ipc_full, r.ord) for r in edges.collect()) == [("1:2", "3:0", "5", 6.5, True, 1), ("3:4", "1:00", "x", 1.0, False, 2), ("main", "worker", None, None, False, 3)]
    edges.explain()
    assert "Union" not in capsys.readouterr().out


def test_seeded_symbols_are_written_once_and_dealt_out(spark, monkeypatch):
    kept, write = [], retrieval.materialize
    monkeypatch.setattr(retrieval, "materialize", lambda df, label: kept.append(write(df, label)) or kept[-1])
    stacks = spark.createDataFrame([(1, "A at B"), (2, "Z"), (3, "C C")], "log_id int, text string")
    docs = spark.createDataFrame([(1, ["A", "C"]), (2, ["B", "A"]), (3, ["Q"])], "doc_id int, symbols array<string>")
    got = sorted((r.log_id, r.symbol, r["rank"]) for r in retrieval.seed_symbols(stacks, docs, 2).collect())
    assert got == [(1, "A", 1), (1, "B", 2), (3, "A", 1), (3, "C", 2)] and len(kept) == 1
