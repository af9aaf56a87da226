"""Committed tables and live trends: failures half way, replays, late rows."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from faultline.operators import leak
from faultline.streaming import jobs, trend
from faultline.streaming.versions import Conflict, VersionedTable


def at(day, hour):
    return datetime(2024, 5, day, hour)


def rows(spark, *x):
    return spark.createDataFrame(list(x), "window_start timestamp, signature string, n long")


def held(table, version=None):
    found = table.read(version)
    return set() if found is None else {(r.window_start, r.signature, r.n) for r in found.collect()}


def test_batches_are_committed_whole_and_once(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "counts")
    merge, table = jobs.upsert_counts(spark, path), jobs.counts_table(spark, path)
    assert held(table) == set()
    merge(rows(spark, (at(1, 1), "a", 2), (at(2, 1), "b", 1)), 0)
    first_day = table.manifest()["parts"]["2024-05-01"]
    for _ in range(2):  # a batch that comes again changes nothing
        merge(rows(spark, (at(2, 1), "b", 5), (at(2, 3), "a", 1), (at(3, 1), "c", 4)), 1)
    merge(rows(spark), 2)
    want = {(at(1, 1), "a", 2), (at(2, 1), "b", 5), (at(2, 3), "a", 1), (at(3, 1), "c", 4)}
    assert held(table) == want and table.versions() == [1, 2, 3]
    assert table.manifest()["parts"]["2024-05-01"] == first_day
    # a batch that dies between its write and its commit leaves nothing but an orphan
    with monkeypatch.context() as m:
        m.setattr(VersionedTable, "_commit", lambda self, manifest: (_ for _ in ()).throw(OSError("killed")))
        with pytest.raises(OSError):
            merge(rows(spark, (at(2, 1), "b", 99), (at(9, 1), "z", 1)), 3)
    assert held(jobs.counts_table(spark, path)) == want
    merge(rows(spark, (at(2, 1), "b", 6)), 3)
    assert held(table) == want - {(at(2, 1), "b", 5)} | {(at(2, 1), "b", 6)}
    # readers that pinned a version still see it
    assert held(table, 2) == want and held(table, 1) == {(at(1, 1), "a", 2), (at(2, 1), "b", 1)}
    gone = table.vacuum(2)
    assert len(gone) >= 1 and held(table, 3) == want and (at(2, 1), "b", 6) in held(table)


def test_one_of_two_writers_wins(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), ["k"], "p")
    assert table.merge(spark.createDataFrame([(1, None, "x"), (2, "q", "y")], "k int, p string, v string")) == 1
    stale = table.manifest()
    table.merge(spark.createDataFrame([(1, None, "z")], "k int, p string, v string"))
    with pytest.raises(Conflict):
        table._commit({**stale, "version": 2})
    assert {tuple(r) for r in table.read().collect()} == {(1, None, "z"), (2, "q", "y")}


def test_window_counts_stream_into_the_table(spark, tmp_path):
    src, path = tmp_path / "in", str(tmp_path / "counts")
    for k, part in enumerate([[(at(1, 1), "a"), (at(1, 1), "a"), (at(1, 2), "b")], [(at(1, 2), "b"), (at(2, 5), "a")]]):
        spark.createDataFrame(part, "ts timestamp, signature string").coalesce(1).write.parquet(str(src / str(k)))
    stream = spark.readStream.schema("ts timestamp, signature string").option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(src))
    q = jobs.signature_counts(stream, late="2 days").writeStream.outputMode("update").foreachBatch(jobs.upsert_counts(spark, path)).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    assert held(jobs.counts_table(spark, path)) == {(at(1, 1), "a", 2), (at(1, 2), "b", 2), (at(2, 5), "a", 1)}


def test_live_trend_with_late_rows_equals_the_batch(spark, tmp_path):
    r = random.Random(3)
    start, samples = datetime(2024, 5, 1), []
    shapes = {1: lambda i: 10.0 * i + r.random(), 2: lambda i: 1000.0 * (i >= 12), 3: lambda i: 50.0 - i, 4: lambda i: 100.0 * (i // 5), 5: lambda i: r.uniform(0, 100) + 8 * i}
    for key, f in shapes.items():
        samples += [(key, start + timedelta(seconds=10 * i + key), f(i)) for i in range(40 if key < 5 else 90)]
    samples += [(6, start + timedelta(seconds=5), 1.0), (6, start + timedelta(seconds=6), None), (7, start + timedelta(seconds=7), 4.0)]
    # arrival is shuffled within two minutes; the last row drives the watermark on
    arrival = sorted(samples, key=lambda s: s[1] + timedelta(seconds=r.uniform(0, 120)))
    src = tmp_path / "in"
    shape = "pid long, ts timestamp, value double"
    for k in range(0, len(arrival), 40):
        spark.createDataFrame(arrival[k : k + 40], shape).coalesce(1).write.parquet(str(src / f"{k:05d}"))
    end = start + timedelta(hours=2)
    spark.createDataFrame([(8, end, 0.0)], shape).coalesce(1).write.parquet(str(src / "99999"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(shape).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(src))
        q = trend.exact_trend(stream, "pid", "ts", "value", "3 minutes").writeStream.format("memory").queryName("exact").outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
        q.awaitTermination(240)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    last = {x.pid: x for x in spark.sql("select pid, max_by(struct(*), struct(as_of, n)) as x from exact group by pid").select("x.*").collect()}
    df = spark.createDataFrame(samples, shape)
    batch = leak.metric_trend(df.withColumn("at", F.unix_micros("ts") / 1e6), ["pid"], ["ts", "value"], "at", "value")
    want = {x.pid: x for x in batch.collect()}
    assert set(last) == set(want)
    for k, w in want.items():
        g = last[k]
        assert (g.n, g.start_value, g.end_value, g.peak_value, g.shape) == (w.n, w.start_value, w.end_value, w.peak_value, w.shape), k
        assert (g.growth, g.growth_percent, g.rate_per_min, g.r2) == pytest.approx((w.growth, w.growth_percent, w.rate_per_min, w.r2), abs=1e-6)
        assert g.fastest_pos == w.fastest_pos or w.n == 1
    assert {w.shape for w in want.values()} >= {"linear", "sudden_jump", "flat_or_declining", "stepwise", "insufficient"}
