"""A live memory trend that equals the batch trend over all samples up to the watermark, however late they come."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Row
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

METRICS = "n long, start_value double, end_value double, peak_value double, growth double, growth_percent double, rate_per_min double, fastest_pos long, r2 double, shape string"


class Trend(StatefulProcessor):
    """State of a key: samples that the watermark has not passed, the settled steps, and sums over the settled samples."""

    def __init__(self, key: str, idle_ms: int):
        self.key, self.idle_ms = key, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        sample = T.StructType([T.StructField("ts", T.LongType()), T.StructField("value", T.DoubleType())])
        self.waiting = handle.getListState("waiting", sample)
        self.steps = handle.getListState("steps", T.StructType([T.StructField("delta", T.DoubleType())]))
        longs, doubles = ("n", "first_ts", "last_ts", "rising", "fastest_pos"), ("first", "last", "peak", "max_delta", "fastest", "sy", "syy", "sxy")
        self.names = longs + doubles
        self.sums = handle.getValueState("sums", T.StructType([T.StructField(c, T.LongType()) for c in longs] + [T.StructField(c, T.DoubleType()) for c in doubles]))
        self.timer = handle.getValueState("timer", T.StructType([T.StructField("at", T.LongType())]))

    def _wake(self, at: int) -> None:
        """One timer a key, at the earliest moment that anything is due."""
        if self.timer.exists():
            old = self.timer.get()[0]
            if old == at:
                return
            self.handle.deleteTimer(old)
        self.handle.registerTimer(at)
        self.timer.update((at,))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new = [(r["_us"], float(r["_value"])) for r in rows if r["_value"] is not None and r["_us"] is not None]
        if new:
            self.waiting.appendList(new)
            due = min(t for t, _ in new) // 1000 + 1
            self._wake(min(due, self.timer.get()[0]) if self.timer.exists() and self._pending_timer() else due)
        return iter(())

    def _pending_timer(self) -> bool:
        """Whether the timer waits for samples (else it waits for idleness)."""
        return not self.sums.exists() or self.timer.get()[0] < self._of("last_ts") // 1000 + self.idle_ms

    def _of(self, name: str):
        return self.sums.get()[self.names.index(name)]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        mark = timerValues.getCurrentWatermarkInMs()
        self.timer.clear()
        samples = sorted(self.waiting.get()) if self.waiting.exists() else []
        settled, left = [s for s in samples if s[0] // 1000 < mark], [s for s in samples if s[0] // 1000 >= mark]
        if settled:
            s = self._settle(settled)
            if left:
                self.waiting.put(left)
            else:
                self.waiting.clear()
        elif not left and self.sums.exists() and mark > self._of("last_ts") // 1000 + self.idle_ms:
            for state in (self.waiting, self.steps, self.sums):
                state.clear()
            return iter(())
        self._wake(left[0][0] // 1000 + 1 if left else self._of("last_ts") // 1000 + self.idle_ms + 1)
        return iter([self._row(key, s, mark)]) if settled else iter(())

    def _settle(self, samples: list[tuple[int, float]]) -> dict:
        s = dict(zip(self.names, self.sums.get(), strict=True)) if self.sums.exists() else None
        deltas = []
        for ts, value in samples:
            if s is None:
                s = {"n": 1, "first_ts": ts, "last_ts": ts, "rising": 0, "fastest_pos": 0, "first": value, "last": value, "peak": value, "max_delta": float("-inf"), "fastest": float("-inf"), "sy": value, "syy": value * value, "sxy": 0.0}
                continue
            delta, gap, pos = value - s["last"], (ts - s["last_ts"]) / 1e6, s["n"]
            deltas.append((delta,))
            if gap > 0 and delta / gap > s["fastest"]:
                s["fastest"], s["fastest_pos"] = delta / gap, pos
            s["rising"] += delta >= 0
            s["max_delta"], s["peak"] = max(s["max_delta"], delta), max(s["peak"], value)
            s["sy"], s["syy"], s["sxy"] = s["sy"] + value, s["syy"] + value * value, s["sxy"] + pos * value
            s["n"], s["last"], s["last_ts"] = pos + 1, value, ts
        if deltas:
            self.steps.appendList(deltas)
        self.sums.update(tuple(s[c] for c in self.names))
        return s

    def _row(self, key, s: dict, mark: int) -> Row:
        n, growth, seconds = s["n"], s["last"] - s["first"], (s["last_ts"] - s["first_ts"]) / 1e6
        still = sum(abs(d) <= max(1.0, 0.02 * abs(growth)) for (d,) in self.steps.get()) if self.steps.exists() else 0
        sx, sxx = n * (n - 1) / 2, (n - 1) * n * (2 * n - 1) / 6
        vx, vy, c = sxx - sx * sx / n, s["syy"] - s["sy"] ** 2 / n, s["sxy"] - sx * s["sy"] / n
        r2 = min(1.0, max(0.0, c * c / (vx * vy))) if n > 2 and vx > 0 and vy > 0 else 0.0
        if n < 3:
            shape = "insufficient"
        elif growth <= 0:
            shape = "flat_or_declining"
        elif s["max_delta"] >= 0.6 * growth:
            shape = "sudden_jump"
        elif still >= -(-(n - 1) // 2):
            shape = "stepwise"
        else:
            shape = "linear" if r2 >= 0.85 and s["rising"] >= 0.8 * (n - 1) else "fluctuating"
        at = datetime.fromtimestamp(mark / 1000, tz=timezone.utc).replace(tzinfo=None)
        values = (key[0], at, n, s["first"], s["last"], s["peak"], growth, growth / s["first"] * 100 if s["first"] else 0.0, growth / seconds * 60 if seconds > 0 else 0.0, s["fastest_pos"], r2, shape)
        return Row(**dict(zip((self.key, "as_of", *(m.split(" ")[0] for m in METRICS.split(", "))), values, strict=True)))


def exact_trend(samples: DataFrame, key: str, time: str, value: str, late: str = "10 minutes", idle: int = 86_400) -> DataFrame:
    """A stream ``samples(key, time, value)`` to ``(key, as_of, n, start_value, ..., shape)``: the metrics of the batch trend over the samples
    before the watermark, in order of time and then value.

    Samples wait until the watermark, ``late`` behind the newest, has passed them, and are then put in order, so the order of
    arrival does not matter; later ones are dropped, as the watermark means. Each time samples of a key settle a row is given;
    the last holds. Null values and times are ignored. A key without a sample for ``idle`` seconds is forgotten. State is one
    number a settled sample, for the shape depends on all steps. Needs the RocksDB state store.
    """
    from pyspark.sql import functions as F

    kind = samples.schema[key].dataType.simpleString()
    rows = samples.select(F.col(key), F.col(time).alias("_ts"), F.unix_micros(time).alias("_us"), F.col(value).cast("double").alias("_value")).withWatermark("_ts", late)
    return rows.groupBy(key).transformWithState(Trend(key, idle * 1000), f"{key} {kind}, as_of timestamp_ntz, {METRICS}", "Update", "EventTime")
