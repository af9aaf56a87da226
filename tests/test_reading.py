"""Quoted CSV reports and the times that samples carry."""

import csv
import datetime
import io

from pyspark.sql import functions as F

from faultline.operators import leak, logs
from faultline.sources import readers


def test_quoted_csv_equals_the_standard_reader(spark, tmp_path):
    text = 'id,name, note,id\n1,"a, b","said ""no""",9\n\n2,plain,,8\r\n3,"two\nlines",x,7\n4\n5,"",,"6",extra\n6,5" wide,y,z\n'
    (tmp_path / "a.csv").write_text(text)
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "head.csv").write_text("id,x\n")
    got = [r.row for r in readers.read_perf_rows(spark, str(tmp_path)).orderBy("ord").collect()]
    rows = [r for r in csv.reader(io.StringIO(text, newline="")) if r]
    head = [h.strip() for h in rows[0]]
    assert got == [dict(zip(head, r + [""] * 4)) for r in rows[1:]]


def test_sample_times(spark):
    texts = ["2024-01-31 10:20:30", " 2024/01/31 10:20:30", "2024-01-31_10-20-30*", "01-31 10:20:30.250", "2024-02-31 10:20:30", "31.01.2024", "", None, "2024-01-31"]
    got = [r.t for r in spark.createDataFrame(list(enumerate(texts)), "i int, s string").select("i", leak.sample_time(F.col("s")).alias("t")).orderBy("i").collect()]
    day = datetime.datetime(2024, 1, 31, 10, 20, 30)
    assert got == [day, day, day, datetime.datetime(1900, 1, 31, 10, 20, 30, 250000), None, None, None, None, None]


def test_headers_by_priority_then_line(spark):
    text = "Cmdline: later\nProcess: Edge [12]\nProcess: other [13]\nVersion: 5.5.2 (123)\nver 9\nsignal 11 (SIGSEGV), code 1 (SEGV_MAPERR), fault addr 0xa0\nCode Type: ARM-64 (Native)\npid: 3, tid: 4, name: worker >>> app <<<\nPlatform: \nCompiler:  \nAbort message: 'bad'\nDate/Time: 2024-01-01\nKERN_INVALID_ADDRESS at 0x10"
    rows = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "nothing here")], "log_id int, content string")
    got = logs.extract_headers(logs.explode_lines(rows)).collect()
    assert {r.log_id for r in got} == {1}
    want = {"process": "Edge", "process_id": "3", "thread_id": "4", "thread_name": "worker", "app_version": "5.5.2 (123)", "signal": "SIGSEGV", "signal_number": "11", "signal_code": "SEGV_MAPERR", "fault_address": "0xa0", "arch": "arm64", "abort_message": "bad", "timestamp": "2024-01-01"}
    assert {r.field: r.value for r in got} == want


def test_hex_codes_of_large_keys_stay_whole(spark, tmp_path):
    from faultline import bindings

    spark.createDataFrame([(k,) for k in (3, 65535, 65538, 1048575 * 3)], "p_partkey long").write.parquet(f"{tmp_path}/part.parquet")
    assert {r.log_id: r.code_norm for r in bindings.QUERIES["api_codes"](spark, str(tmp_path)).collect()} == {k: str(k) for k in (3, 65535, 65538, 1048575 * 3)}


def test_frames_beyond_the_hundredth_keep_their_numbers(spark, tmp_path):
    from faultline import bindings

    spark.range(0, 260).selectExpr("id as event_id", "7L as user_id").write.parquet(f"{tmp_path}/events.parquet")
    got = bindings.QUERIES["frame_forms"](spark, str(tmp_path)).collect()
    assert len(got) == 260 and all(r.frame_number in (None, r.line_no - 1) for r in got) and max(r.frame_number or 0 for r in got) == 259


def test_a_line_is_tried_once_by_all_forms(spark):
    from faultline.operators.frames import parse_frames

    lines = spark.createDataFrame([(1, 1, "#00 pc 00aa /lib/a.so (f+1)"), (1, 2, "no frame"), (1, 3, None), (1, 4, "#01 pc 0x1 a ()")], "log_id int, line_no int, text string")
    got = {r.line_no: (r.address, r.module, r.function, r.offset) for r in parse_frames(lines).collect()}
    assert got == {1: ("00aa", "/lib/a.so", "f", 1), 4: ("1", "a", None, None)}
    # once in the plan: a filter and a column each over the forms would repeat the first form's pattern
    assert parse_frames(lines)._jdf.queryExecution().optimizedPlan().toString().count("RLIKE(lambda") <= 15


def test_tables_are_dealt_out_by_their_rows(spark):
    from faultline.plans.runtime import by_size

    small, large = by_size(spark.range(40), "id", task_rows=10), by_size(spark.range(90), "id", task_rows=10)
    assert small.rdd.getNumPartitions() != 9 and large.rdd.getNumPartitions() == 9 and large.distinct().count() == 90
