"""Connected components over an edge table, by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from faultline.plans.runtime import drop, scratch


def _write(edges: DataFrame, label: str) -> tuple[DataFrame, str, tuple]:
    """Writes an edge set; its table, path, and a digest taken on the way: its size and an order-free hash sum."""
    seen = Observation()
    table, path = scratch(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")), label)
    return table, path, (seen.get["n"], seen.get["h"])


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """``edges(src, dst)`` to ``(node, component)``, the component being its smallest node.

    Nodes are longs or strings. Null ends and self loops are ignored (a node known only from those is not returned), repeated
    edges count once, an empty table gives an empty table. Each round is two aggregations and two joins, and its edges are
    written to the shared folder, so a lost executor costs one round at most. Rounds grow with the logarithm of the diameter.
    """
    spark = edges.sparkSession
    a, b = F.col(src), F.col(dst)
    start = edges.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    now, path, mark = _write(start, "components")
    for _ in range(max_rounds):
        if not mark[0]:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written before it meets the edges again, so that a hub's edges can be split over tasks
        low, low_path = scratch(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        nxt, nxt_path, new = _write(small, "components")
        drop(spark, path)
        drop(spark, low_path)
        now, path, same = nxt, nxt_path, new == mark
        mark = new
        if same:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
