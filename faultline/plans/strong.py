"""Strongly connected components of large graphs by raking, compressing and coloring.

Nodes that no edge enters or leaves lie on no cycle and go (rake). A node with one edge in and one edge out is on a cycle with both
its neighbours or with none; runs of such nodes become one edge (compress). Both together shrink trees and chains in rounds that
grow with the logarithm of their size. In what is left every node takes the smallest node that reaches it and the smallest that it
reaches; where both are one, the node belongs to it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.plans.doubling import _counted, cycle_places, on_cycles, to_ends
from faultline.plans.runtime import Growing, dealt, drop, materialize, scratch


def _rake(edges: DataFrame, keys: list[str]) -> DataFrame:
    """``edges`` without those that start at nodes nothing enters or end at nodes nothing leaves."""
    out, into = edges.select(*keys, F.col("src").alias("dst")).distinct(), edges.select(*keys, F.col("dst").alias("src")).distinct()
    return edges.join(dealt(out), [*keys, "dst"], "left_semi").join(dealt(into), [*keys, "src"], "left_semi")


def _lowest(edges: DataFrame, nodes: DataFrame, keys: list[str], src: str, dst: str, max_rounds: int) -> DataFrame:
    """``(keys, node, label)``: the smallest node from which the edges, read from ``src`` to ``dst``, lead to a node."""
    spark = edges.sparkSession
    now, path = scratch(nodes.withColumn("label", F.col("node")).withColumn("lower", F.lit(True)), "labels")
    for _ in range(max_rounds):
        # only nodes whose label fell tell their neighbours
        told = now.where("lower").select(*keys, F.col("node").alias(src), "label").join(dealt(edges.select(*keys, src, dst)), [*keys, src]).groupBy(*keys, F.col(dst).alias("node")).agg(F.min("label").alias("told"))
        moved = now.join(dealt(told), [*keys, "node"], "left").select(*keys, "node", F.least("label", "told").alias("label"), F.coalesce(F.col("told") < F.col("label"), F.lit(False)).alias("lower"))
        nxt, nxt_path, n = _counted(moved, "labels", lower=F.col("lower"))
        drop(spark, path)
        now, path = nxt, nxt_path
        if not n["lower"]:
            return now.select(*keys, "node", "label")
    raise RuntimeError(f"labels did not settle in {max_rounds} rounds")


def strong_components(edges: DataFrame, keys: list[str], max_rounds: int = 10_000, once: bool = False) -> DataFrame:
    """``edges(keys, src, dst)`` to ``(keys, node, component)`` of the nodes that lie on a cycle; a component is named by one of its
    nodes. Null ends are ignored, repeated edges count once, self loops are cycles; an empty table gives an empty table.

    Rounds grow with the logarithm of chains and trees and with the diameter of what branches and is still cyclic; they raise
    where they do not settle. ``once`` says that no edge of the table is repeated.
    """
    spark = edges.sparkSession
    start = edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull()).select(*keys, "src", "dst")
    now, path, n = _counted(start if once else start.distinct(), "core", rows=F.lit(1))
    kind = edges.schema["src"].dataType
    named = now.select(*keys, F.col("src").alias("node"), F.col("src").alias("component")).limit(0)
    found = Growing(named, "components")
    inner: list[DataFrame] = []  # of each compression the nodes that went, with the ends of their run
    # raking costs two joins and compressing many: it goes first as long as it takes half of the edges, as from flat trees
    for _ in range(max_rounds):
        if not n["rows"]:
            break
        raked, raked_path, m = _counted(_rake(now, keys), "core", rows=F.lit(1))
        drop(spark, path)
        now, path, before, n = raked, raked_path, n["rows"], m
        if 2 * n["rows"] > before:
            break
    for _ in range(max_rounds):
        if not n["rows"]:
            break
        # compress: runs of nodes with one edge in and one out
        ins = now.groupBy(*keys, F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("n"), F.first("src").alias("before")).where("n = 1").drop("n")
        outs = now.groupBy(*keys, F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("n"), F.first("dst").alias("to")).where("n = 1").drop("n")
        plain, plain_path, runs = _counted(ins.join(dealt(outs), [*keys, "node"]), "plain", rows=F.lit(1))
        if runs["rows"]:
            ahead, looping = to_ends(plain.select(*keys, "node", "to"), keys)
            back, _ = to_ends(plain.select(*keys, "node", F.col("before").alias("to")), keys)
            rings = on_cycles(looping, keys)
            found.add(cycle_places(rings, keys).select(*keys, "node", F.col("leader").alias("component")))
            ends = materialize(ahead.select(*keys, "node", F.col("end").alias("last")).join(dealt(back.select(*keys, "node", F.col("end").alias("first"))), [*keys, "node"]), "runs")
            inner.append(ends)
            gone = plain.select(*keys, "node")
            left = now.join(dealt(gone.withColumnRenamed("node", "src")), [*keys, "src"], "left_anti").join(dealt(gone.withColumnRenamed("node", "dst")), [*keys, "dst"], "left_anti")
            now = left.unionByName(ends.select(*keys, F.col("first").alias("src"), F.col("last").alias("dst"))).distinct()
        raked, raked_path, m = _counted(_rake(now, keys), "core", rows=F.lit(1))
        drop(spark, path)
        drop(spark, plain_path)
        now, path = raked, raked_path
        shrunk, n = m["rows"] < n["rows"], m
        if shrunk or not n["rows"]:
            continue
        # neither helps any more: color what is left, keep what is whole, cut what cannot be one component
        nodes = materialize(now.select(*keys, F.col("src").alias("node")).unionByName(now.select(*keys, F.col("dst").alias("node"))).distinct(), "core-nodes")
        labels = materialize(_lowest(now, nodes, keys, "src", "dst", max_rounds).withColumnRenamed("label", "a").join(dealt(_lowest(now, nodes, keys, "dst", "src", max_rounds).withColumnRenamed("label", "b")), [*keys, "node"]), "core-labels")
        found.add(labels.where("a = b").select(*keys, "node", F.col("a").alias("component")))
        rest = labels.where("a <> b")
        side = lambda end: rest.select(*keys, F.col("node").alias(end), F.struct("a", "b").alias(f"{end}_label"))
        cut = now.join(dealt(side("src")), [*keys, "src"]).join(dealt(side("dst")), [*keys, "dst"]).where("src_label = dst_label").select(*keys, "src", "dst")
        left, left_path, n = _counted(cut, "core", rows=F.lit(1))
        drop(spark, path)
        now, path = left, left_path
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    # a run lies in the component of its two ends, if they share one; ends of early runs may have gone in later ones
    for ends in reversed(inner):
        known = found.rows()
        end = lambda c: known.select(*keys, F.col("node").alias(c), F.col("component").alias(f"{c}_in"))
        found.add(ends.join(dealt(end("first")), [*keys, "first"]).join(dealt(end("last")), [*keys, "last"]).where("first_in = last_in").select(*keys, "node", F.col("first_in").cast(kind).alias("component")))
    return found.rows()
