"""Allocations, trends, mappings and buffers on small tables with known answers."""

import random

from pyspark.sql import functions as F

from faultline.operators import leak, logs


def test_outstanding_allocations_of_selected_sizes(spark):
    hook = spark.createDataFrame([(0, 1, 7, "malloc", 128, None), (0, 1, 7, "malloc", 128, 0), (0, 2, 7, "malloc", 64, 5), (0, 3, 7, "malloc", 32, 0)], "trace int, callchain_id long, tid long, event_type string, heap_size long, end_ts long")
    frames = spark.createDataFrame([(0, 1, 0, 10, 20), (0, 1, 1, 11, 20)], "trace int, callchain_id long, depth int, symbol_id long, file_id long")
    names = spark.createDataFrame([(0, 10, "malloc"), (0, 11, "App::Allocate"), (0, 20, "libapp.so")], "trace int, id long, data string")
    got = leak.outstanding_allocations(hook, frames, names, sizes=[128]).collect()
    assert [(g.outstanding_bytes, g.allocation_count, g.suspected_symbol, g.stack_type, g.total_bytes) for g in got] == [(256, 2, "App::Allocate", "native", 288)]
    whole = {g.signature: g.outstanding_bytes for g in leak.outstanding_allocations(hook, frames, names).collect()}
    assert whole == {"11:20": 256, "chain:3": 32}
    assert leak.outstanding_allocations(hook.limit(0), frames, names).count() == 0


def test_statistic_fallback(spark):
    stat = spark.createDataFrame([(0, 1, 5, "m", 4096, 1024), (0, 1, 6, "m", 100, 0), (0, 2, 5, "m", 1, 9)], "trace int, callchain_id long, ipid long, type string, apply_size long, release_size long")
    assert [(r.outstanding_bytes, r.pid) for r in leak.outstanding_from_stats(stat).collect()] == [(3072, 5)]


def shape_of(v):
    n = len(v)
    if n < 3:
        return "insufficient"
    growth, d = v[-1] - v[0], [b - a for a, b in zip(v, v[1:])]
    if growth <= 0:
        return "flat_or_declining"
    if max(d) >= 0.6 * growth:
        return "sudden_jump"
    if sum(abs(x) <= max(1, 0.02 * abs(growth)) for x in d) >= -(-len(d) // 2):
        return "stepwise"
    mx, my = (n - 1) / 2, sum(v) / n
    sxy, sxx, syy = sum((i - mx) * (y - my) for i, y in enumerate(v)), sum((i - mx) ** 2 for i in range(n)), sum((y - my) ** 2 for y in v)
    r2 = sxy**2 / (sxx * syy) if syy else 0
    return "linear" if r2 >= 0.85 and sum(x >= 0 for x in d) >= 0.8 * len(d) else "fluctuating"


def test_trend_shapes_equal_a_loop(spark):
    r = random.Random(2)
    series = {0: [100.0, 180.0, 280.0], 1: [5.0] * 6, 2: [1.0, 2.0], 3: [0.0, 0.0, 0.0, 50.0, 50.0, 50.0, 100.0, 100.0], 4: [float(10 * i) for i in range(20)], 5: [0.0, 1.0, 90.0, 100.0]}
    series |= {k: [float(r.randrange(0, 300) + 10 * i) for i in range(r.randrange(3, 12))] for k in range(6, 40)}
    rows = [(k, i, 60.0 * i, v) for k, vs in series.items() for i, v in enumerate(vs)] + [(0, 99, 9.0, None)]
    df = spark.createDataFrame(rows, "k int, pos int, t double, v double")
    got = {x.k: x for x in leak.metric_trend(df, ["k"], ["pos"], "t", "v").collect()}
    assert {k: got[k]["shape"] for k in series} == {k: shape_of(v) for k, v in series.items()}
    assert (got[0].start_value, got[0].end_value, got[0].growth, got[0].rate_per_min) == (100, 280, 180, 90)
    assert got[1].r2 == 0


def test_smaps_and_snapshots(spark):
    smaps = spark.createDataFrame([(1, "native_heap:jemalloc", 700.0, 100.0), (1, "[anon:ArkTS Heap]", 100.0, 20.0), (1, "/dev/ashmem/x", 40.0, 0.0), (1, None, 1.0, None), (1, "/data/app/lib.so", 2.0, 0.0), (1, "zz", 1.0, 0.0)], "log_id int, name string, pss_kb double, swap_pss_kb double")
    got = {r.category: (r.size, r.dominant) for r in leak.smaps_breakdown(smaps).collect()}
    assert got["jemalloc"] == (800, True) and got["arkts"] == (120, False) and got["ashmem"][0] == 40 and set(got) == {"jemalloc", "arkts", "ashmem", "anon", "file_mapping", "other"}
    nmd = spark.createDataFrame([(1, 1, 64, 1000), (1, 1, 128, 2000), (1, 2, 64, 1800), (1, 2, 128, 5000), (1, 2, 256, 7)], "log_id int, snapshot_no int, size_bytes long, allocated_bytes long")
    assert {r.size_bytes: r.growth for r in leak.snapshot_growth(nmd, ["log_id"], "snapshot_no", "size_bytes", "allocated_bytes").collect()} == {64: 800, 128: 3000, 256: 7}


def test_shared_buffers(spark):
    dma = spark.createDataFrame([(1, "render_service", 4096, "100", 0, "NativeWindow"), (1, "app", 4096, "100", 1, "NativeWindow"), (1, "app", 8192, "200", 2, None), (1, "other", 5, None, 3, "web-1"), (1, "other", 5, None, 4, "x")], "log_id int, process string, size long, ino string, ord int, buf_name string")
    owned = leak.dma_ownership(dma, ["log_id"], "ino", "process", "ord")
    assert owned.count() == 4 and {(r.process, r.dma_bytes) for r in leak.dma_totals(owned, ["log_id"], ["process"], "size").collect()} == {("app", 12288), ("other", 10)}
    rules = {r.ord: r.rule_id for r in leak.classify_dma(dma.withColumn("leak_type", F.lit(None).cast("string")).withColumn("buf_type", F.lit(""))).collect()}
    assert rules == {0: "native_surface", 1: "native_surface", 2: "unknown_dma", 3: "web", 4: "unknown_dma"}


def test_memory_text_tables(spark):
    text = "processName: x\nRSS(KB)  PSS(KB)  RunningTime\n100  90  0\n180  160*  60\n~  1,250  120\nsnapshot 1\nbin 64 allocated 1000\nsnapshot 2\nbin 64 allocated: 1800\n7f00-7f10 rw-p 00000000 00:00 0 [heap]\nSize: 64 kB\nRss: 10 kB\nPss: 9 kB\nSwapPss: 1 kB\nTotal U(device): 3000\nC:Texture: 2000\n"
    lines = logs.explode_lines(spark.createDataFrame([(1, text)], "log_id int, content string"))
    got = {(r.line_no, r.metric): (r.value, r.is_trigger) for r in logs.parse_mem_samples(lines).collect()}
    assert got[(3, "RSS(KB)")] == (100, False) and got[(4, "PSS(KB)")] == (160, True) and got[(5, "PSS(KB)")] == (1250, False) and got[(5, "RSS(KB)")][0] is None
    assert {(r.snapshot_no, r.size_bytes, r.allocated_bytes) for r in logs.parse_nmd(lines).collect()} == {(1, 64, 1000), (2, 64, 1800)}
    assert [(r.name, r.pss_kb, r.swap_pss_kb) for r in logs.parse_smaps(lines).collect()] == [("[heap]", 9, 1)]
    assert {(r.kind, r.item, r.bytes) for r in logs.parse_kernel_memory(lines).collect()} == {("gpu_total", "total", 3000), ("gpu", "Texture", 2000)}
