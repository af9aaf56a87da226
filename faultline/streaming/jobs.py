"""Streaming forms: triage of arriving logs, first-seen incidents, live trends, signature counts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.operators.logs import detect_os, log_kind
from faultline.streaming.versions import VersionedTable


def triage(spark: SparkSession, path: str) -> DataFrame:
    """A stream of ``(log_id, os, log_kind, confidence)`` for the files that arrive in a directory."""
    raw = spark.readStream.text(path, wholetext=True)
    return raw.select(F.sha2("value", 256).alias("log_id"), detect_os(F.col("value")).alias("os"), log_kind(F.col("value")).alias("kind")).select("log_id", "os", "kind.log_kind", "kind.confidence")


def first_seen(incidents: DataFrame, identity: list[str], time: str = "ts", late: str = "1 hour") -> DataFrame:
    """Incidents of an identity not seen within the watermark."""
    return incidents.withWatermark(time, late).dropDuplicatesWithinWatermark(identity)


def live_trend(samples: DataFrame, key: str = "pid", at: str = "pos", value: str = "value") -> DataFrame:
    """Per key the trend so far: n, first, last, largest step, slope and R squared, from running sums.

    Exact for those; the shape of a series depends on its final growth and stays with the batch job.
    """

    def update(k: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, sx, sy, sxy, sxx, syy, first, last, step = state.get if state.exists else (0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)
        for pdf in frames:
            for x, y in pdf.sort_values(at)[[at, value]].itertuples(index=False):
                first, step = (y, step) if n == 0 else (first, max(step, y - last))
                n, sx, sy, sxy, sxx, syy, last = n + 1, sx + x, sy + y, sxy + x * y, sxx + x * x, syy + y * y, y
        state.update((n, sx, sy, sxy, sxx, syy, float(first), float(last), float(step)))
        vx, vy, c = sxx - sx * sx / n, syy - sy * sy / n, sxy - sx * sy / n
        yield pd.DataFrame({key: [k[0]], "n": [n], "first_value": [first], "last_value": [last], "max_step": [step], "slope": [c / vx if vx > 0 else 0.0], "r2": [min(1.0, c * c / (vx * vy)) if n > 2 and vx > 0 and vy > 0 else 0.0]})

    kind = samples.schema[key].dataType.simpleString()
    state = "n long, sx double, sy double, sxy double, sxx double, syy double, first double, last double, step double"
    return samples.groupBy(key).applyInPandasWithState(update, f"{key} {kind}, n long, first_value double, last_value double, max_step double, slope double, r2 double", state, "update", "NoTimeout")


def signature_counts(events: DataFrame, time: str = "ts", signature: str = "signature", width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts of each signature in tumbling windows."""
    by = events.withWatermark(time, late).groupBy(F.window(time, width), signature).count()
    return by.select(F.col("window.start").alias("window_start"), signature, F.col("count").alias("n"))


def upsert_counts(spark: SparkSession, path: str):
    """A ``foreachBatch`` function that merges window counts ``(window_start, signature, n)`` into a versioned table by day.

    A batch carries the whole counts of the windows that changed (update mode). It is committed whole under its number or not at
    all: one that stops half way leaves the table as it was, one that comes again changes nothing. Only the days that it
    touches, few by the watermark, are read and written anew. ``counts_table`` reads it.
    """
    table = counts_table(spark, path)

    def merge(batch: DataFrame, batch_id: int) -> None:
        table.merge(batch.select("window_start", "signature", "n", F.to_date("window_start").alias("day")), batch_id)

    return merge


def counts_table(spark: SparkSession, path: str) -> VersionedTable:
    """The table that :func:`upsert_counts` fills."""
    return VersionedTable(spark, path, ["window_start", "signature"], "day")
