"""Routes to knowledge, and cases from verified runs."""

from faultline.operators import knowledge

GATE = "run_id int, status string, level string, provenance string, command string, checks string, plan_fingerprint string, changed_files string, applied boolean, diff_status string, claim_level string, session_level string"


def test_routes_with_tags_filter_and_nothing_known(spark):
    rows = spark.createDataFrame([(1, ["LIBACE.so", "libpthread.so", None, "libace.so"]), (2, ["own.so", ""]), (3, None), (4, [])], "log_id int, modules array<string>")
    got = {r.log_id: r for r in knowledge.route_knowledge(rows).collect()}
    assert got[1].domains == ["concurrency", "ui_framework"] and got[1].categories == ["concurrency", "logic"]
    assert got[1].tags == sorted(["lifecycle", "rendering", "layout", "deadlock", "race_condition", "sync"])
    assert got[1].matched == {"LIBACE.so": "ui_framework", "libace.so": "ui_framework", "libpthread.so": "concurrency"}
    for i in (2, 3, 4):
        assert (got[i].domains, got[i].tags, got[i].categories, got[i].matched) == ([], [], [], {})
    hits = spark.createDataFrame([(i, p) for i in (1, 2) for p in ("a", "b", "c")], "log_id int, pattern_id string")
    patterns = spark.createDataFrame([("a", "logic"), ("b", "memory")], "pattern_id string, crash_category string")
    kept = knowledge.narrow_hits(hits, knowledge.route_knowledge(rows), patterns).collect()
    assert sorted((r.log_id, r.pattern_id) for r in kept) == [(1, "a"), (2, "a"), (2, "b"), (2, "c")]
    assert knowledge.route_knowledge(rows.where("false")).collect() == []


def test_selected_files_come_once_in_order_of_features(spark):
    features = spark.createDataFrame([(1, "cpp", "napi"), (1, "cpp", "asan"), (1, "cpp", "napi"), (2, "cpp", "none")], "log_id int, domain string, feature string")
    shelf = spark.createDataFrame([("cpp", "napi", 0, "n"), ("cpp", "napi", 1, "m"), ("cpp", "asan", 0, "m"), ("js", "napi", 0, "x")], "domain string, feature string, pos int, file string")
    modes = spark.createDataFrame([("m", "M1", 0), ("m", "M2", 1), ("n", "N1", 0), ("x", "X", 0)], "file string, mode_id string, ord int")
    got = knowledge.select_knowledge(features, shelf, modes).collect()
    assert sorted((r.log_id, r.file_rank, r.mode_id) for r in got) == [(1, 1, "M1"), (1, 1, "M2"), (1, 2, "N1")]


def test_gate(spark):
    full = dict(status="native_verified", level="L3", provenance="ci", command=None, checks=None, plan_fingerprint="p", changed_files="a.c", applied=True, diff_status="passed", claim_level="L3", session_level=None)
    cases = [({}, True), ({"level": "L2"}, False), ({"provenance": ""}, False), ({"plan_fingerprint": None}, False), ({"changed_files": ""}, False), ({"diff_status": "rejected"}, False), ({"diff_status": "rejected", "applied": False}, True), ({"diff_status": None}, True), ({"status": "failed"}, False), ({"status": " PASSED ", "level": None, "provenance": None}, True), ({"status": None, "level": None}, False), ({"level": "L1", "claim_level": None}, False), ({"claim_level": "", "session_level": "l4"}, False)]
    rows = [(i, *({**full, **over}.values())) for i, (over, _) in enumerate(cases)]
    got = {r.run_id: r.may_commit for r in knowledge.commit_gate(spark.createDataFrame(rows, GATE)).collect()}
    assert got == {i: want for i, (_, want) in enumerate(cases)}


RUN = "run_id int, ts int, fixed boolean, signature string, summary string, analysis string, query_text string, signal string, crash_reason string, os_type string, platform string, has_code boolean, has_log boolean, fixes array<struct<file:string,status:string>>, frames array<struct<function:string,resolved_function:string,module:string>>, root_cause string, confidence double"


def test_cases_are_stable_and_the_last_run_stands(spark):
    frames = [(f"f{i}", None, "lib.so") for i in (2, 1, 2, 3, 4, 5, 6)]

    def run(i, ts, **over):
        base = dict(fixed=True, signature="s", summary="", analysis=f"\n line {i} \nrest", query_text="q", signal="SIGSEGV", crash_reason=None, os_type=None, platform=None, has_code=None, has_log=True, fixes=[("b.c", "applied"), ("a.c", "applied"), ("c.c", "failed"), (None, "applied")], frames=frames, root_cause="r", confidence=None)
        return (i, ts, *({**base, **over}.values()))

    rows = [run(1, 5), run(2, 9), run(3, 1), run(4, 1, fixed=False), run(5, 1, frames=[]), run(6, 1, frames=None), run(7, 1, signature=None, analysis="分析失败", query_text="q" * 300, fixes=None, signal=None, crash_reason="lock order", frames=[("", " g ", None)])]
    patterns, evidence = (x.collect() for x in knowledge.case_records(spark.createDataFrame(rows, RUN)))
    by = {r.run_id: r for r in patterns}
    assert sorted(by) == [2, 7]
    assert (by[2].pattern_summary, by[2].crash_category, by[2].fix_files, by[2].symbols, by[2].root_cause_confidence) == ("line 2", "memory", ["a.c", "b.c"], ["f1", "f2", "f3", "f4", "f5", "f6"], 0.6)
    assert by[2].evidence_requirements == ["stack_trace", "log_fragment", "fix_applied"]
    assert (by[7].pattern_summary, by[7].crash_category, by[7].fix_files, by[7].symbols) == ("q" * 200, "concurrency", [], ["g"])
    kinds = sorted((e.pattern_id == by[2].pattern_id, e.evidence_type) for e in evidence)
    assert kinds.count((True, "stack_trace")) == 4 and kinds.count((False, "stack_trace")) == 1 and len({e.evidence_id for e in evidence}) == len(evidence) == 9
    again = knowledge.case_records(spark.createDataFrame(rows[::-1], RUN))[1].collect()
    assert sorted(e.evidence_id for e in again) == sorted(e.evidence_id for e in evidence)
