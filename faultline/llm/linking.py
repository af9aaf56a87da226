"""From buckets of possibly similar rows to verified links and connected groups, without forming a bucket's pairs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.plans.components import connected_components
from faultline.plans.runtime import materialize


def link_buckets(buckets: DataFrame, verify: Callable[[DataFrame], DataFrame], threshold: float, rest: Callable[[DataFrame], DataFrame], more: DataFrame | None = None) -> DataFrame:
    """``buckets(bucket, id)`` to ``groups(node, component)``, connected by links with similarity >= threshold.

    ``verify`` takes pairs ``(a, b)``, a < b, and adds ``sim``. Each row of a bucket is first verified against the bucket's
    smallest id, ``low``. ``rest`` then gets ``(bucket, id, group, main, low)``, the buckets in which a row's group so far is not
    that of ``low`` (``main``), and gives the links ``(src, dst)`` that these rows still have. ``more`` are links known beforehand.
    """
    # written before it meets the buckets' rows again, so that the rows of a large bucket can be split over tasks
    low = buckets.groupBy("bucket").agg(F.min("id").alias("low"), F.count("*").alias("size")).where("size > 1").select("bucket", "low")
    shared = materialize(buckets.join(materialize(low, "lows"), "bucket"), "shared")
    star = shared.where("id <> low").select(F.least("low", "id").alias("a"), F.greatest("low", "id").alias("b")).distinct()
    links = verify(star).where(F.col("sim") >= threshold).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    if more is not None:
        links = links.unionByName(more)
    first = materialize(connected_components(links), "first")
    groups = first.select(F.col("node").alias("id"), F.col("component").alias("group"))
    mains = first.select(F.col("node").alias("low"), F.col("component").alias("main"))
    placed = shared.join(groups, "id", "left").join(mains, "low", "left").select("bucket", "id", F.coalesce("group", "id").alias("group"), F.coalesce("main", "low").alias("main"), "low")
    placed = materialize(placed, "placed")
    mixed = materialize(placed.where("group <> main").select("bucket").distinct(), "mixed-buckets")
    found = rest(materialize(placed.join(mixed, "bucket", "left_semi"), "mixed"))
    known = first.where("node <> component").select(F.col("node").alias("src"), F.col("component").alias("dst"))
    return connected_components(known.unionByName(found))
