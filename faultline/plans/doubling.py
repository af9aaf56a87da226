"""Pointer doubling over tables in which every node has one successor at most: ends of walks, cycles and places on them.

Rows are ``(key..., node, to)``; nodes of different keys never meet. A round joins the table with itself, so a walk of n steps
takes about log2 n rounds. Every round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from faultline.plans.runtime import Growing, dealt, drop, scratch

#: No walk is longer than 2 ** 62 steps.
MOST_ROUNDS = 64


def _counted(df: DataFrame, label: str, **counts) -> tuple[DataFrame, str, dict]:
    """Writes ``df`` and takes sums on the way."""
    seen = Observation()
    table, path = scratch(df.observe(seen, *[F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(n) for n, c in counts.items()]), label)
    return table, path, seen.get


def to_ends(successors: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """``(keys, node, end, steps)`` of the nodes whose walk ends, the end being a node without a successor, and ``(keys, node, to)``
    of those whose walk does not: they lie on a cycle or lead into one. Null ends are ignored."""
    spark = successors.sparkSession
    start, start_path = scratch(successors.where(F.col("node").isNotNull() & F.col("to").isNotNull()).select(*keys, "node", "to"), "successors")
    now, path = scratch(start.select(*keys, "node", "to", F.lit(1).cast("long").alias("steps"), F.lit(False).alias("done")), "walks")
    ended = Growing(now.limit(0), "ended")
    for _ in range(MOST_ROUNDS):
        known = now.unionByName(ended.rows()).select(*keys, F.col("node").alias("to"), F.col("to").alias("k_to"), F.col("steps").alias("k_steps"), F.col("done").alias("k_done"))
        moved = now.drop("done").join(dealt(known), [*keys, "to"], "left")
        moved = moved.select(*keys, "node", F.coalesce("k_to", "to").alias("to"), (F.col("steps") + F.coalesce("k_steps", F.lit(0))).alias("steps"), F.coalesce("k_done", F.lit(True)).alias("done"))
        nxt, nxt_path, n = _counted(moved, "walks", ended=F.col("done"), left=~F.col("done"))
        if n["ended"]:
            ended.add(nxt.where("done"))
        drop(spark, path)
        now, path = nxt.where("not done"), nxt_path
        # a walk that ends is found in the round of its length, and shorter ones before it: if none was, none is left
        if not n["ended"] or not n["left"]:
            break
    return ended.rows().select(*keys, "node", F.col("to").alias("end"), "steps"), start.join(dealt(now.select(*keys, "node")), [*keys, "node"], "left_semi")


def on_cycles(looping: DataFrame, keys: list[str]) -> DataFrame:
    """Of ``(keys, node, to)`` in which no walk ends the rows whose node lies on a cycle.

    Jumps of ever more steps are taken from what earlier jumps reached; once as many nodes are reached as jumped, all are on
    cycles.
    """
    spark = looping.sparkSession
    jumps, path, n = _counted(looping, "jumps", rows=F.lit(1))
    for _ in range(MOST_ROUNDS):
        reached, reached_path, m = _counted(jumps.select(*keys, F.col("to").alias("node")).distinct(), "reached", rows=F.lit(1))
        if m["rows"] == n["rows"]:
            drop(spark, path)
            return looping.join(dealt(reached), [*keys, "node"], "left_semi")
        inside = jumps.join(dealt(reached), [*keys, "node"])
        twice = inside.join(dealt(jumps.select(*keys, F.col("node").alias("to"), F.col("to").alias("k_to"))), [*keys, "to"]).select(*keys, "node", F.col("k_to").alias("to"))
        nxt, nxt_path, n = _counted(twice, "jumps", rows=F.lit(1))
        drop(spark, path)
        drop(spark, reached_path)
        jumps, path = nxt, nxt_path
    raise RuntimeError("cycles did not settle")


def cycle_places(cycles: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, node, to)`` of nodes on cycles to ``(keys, node, to, leader, place, size)``: the cycle's smallest node, how many steps
    after it the node comes, and how many nodes the cycle has."""
    spark = cycles.sparkSession
    start, start_path = scratch(cycles.select(*keys, "node", "to"), "cycles")
    now, path = scratch(start.withColumn("leader", F.least("node", "to")), "leaders")
    for _ in range(MOST_ROUNDS):
        other = now.select(*keys, F.col("node").alias("to"), F.col("to").alias("k_to"), F.col("leader").alias("k"))
        moved = now.join(dealt(other), [*keys, "to"]).select(*keys, "node", F.col("k_to").alias("to"), F.least("leader", "k").alias("leader"), (F.col("k") < F.col("leader")).alias("lower"))
        nxt, nxt_path, n = _counted(moved, "leaders", lower=F.col("lower"))
        drop(spark, path)
        now, path = nxt.drop("lower"), nxt_path
        if not n["lower"]:
            break
    led = start.join(dealt(now.select(*keys, "node", "leader")), [*keys, "node"])
    # the walk to the leader, which loses its own successor; a cycle of one node has no walk
    ends, _ = to_ends(led.where("node <> leader").select(*keys, "node", "to"), keys)
    steps = led.join(dealt(ends.select(*keys, "node", "steps")), [*keys, "node"], "left")
    size, _ = scratch(steps.groupBy(*keys, "leader").agg(F.count(F.lit(1)).alias("size")), "sizes")
    return steps.join(dealt(size), [*keys, "leader"]).select(*keys, "node", "to", "leader", F.pmod(F.col("size") - F.coalesce("steps", F.lit(0)), F.col("size")).alias("place"), "size")


def descendants(parents: DataFrame, keys: list[str], values: DataFrame, sets: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Sums and sets over the subtrees of a forest ``parents(keys, node, parent)``.

    ``values(keys, node, value)`` become ``(keys, node, total)`` over each node and all below it; of ``sets(keys, node, item)`` each
    node gets the different items of itself and of all below it. Rounds grow with the logarithm of the depth: what lies
    within 2^k steps below a node is its own within 2^(k-1) and that of the nodes just so far below it.
    """
    spark = parents.sparkSession
    up, path, n = _counted(parents.select(*keys, "node", F.col("parent").alias("up")), "ancestors", rows=F.lit(1))
    total, total_path = scratch(values.select(*keys, "node", F.col("value").alias("total")), "totals")
    # each round makes items different, so only those that no round sees are made so by themselves
    items = scratch((lambda x: x if n["rows"] else x.distinct())(sets.select(*keys, "node", "item")), "items") if sets is not None else None
    for _ in range(MOST_ROUNDS):
        if not n["rows"]:
            return total, items and items[0]
        step = up.select(*keys, "node", "up")
        below = step.join(dealt(total), [*keys, "node"]).groupBy(*keys, F.col("up").alias("node")).agg(F.sum("total").alias("below"))
        new_total, new_path = scratch(total.join(dealt(below), [*keys, "node"], "left").select(*keys, "node", (F.col("total") + F.coalesce("below", F.lit(0))).alias("total")), "totals")
        if items:
            lifted = items[0].join(dealt(step), [*keys, "node"]).select(*keys, F.col("up").alias("node"), "item")
            new_items = scratch(items[0].unionByName(lifted).distinct(), "items")
            drop(spark, items[1])
            items = new_items
        higher = up.select(*keys, F.col("node").alias("up"), F.col("up").alias("k_up"))
        nxt, nxt_path, n = _counted(up.join(dealt(higher), [*keys, "up"]).select(*keys, "node", F.col("k_up").alias("up")), "ancestors", rows=F.lit(1))
        drop(spark, path)
        drop(spark, total_path)
        up, path, total, total_path = nxt, nxt_path, new_total, new_path
    raise RuntimeError("the parents are no forest")


def listed(places: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, cycle)`` of :func:`cycle_places`: the nodes in order from the smallest, closed with it. A cycle is one row."""
    row = places.groupBy(*keys, "leader").agg(F.sort_array(F.collect_list(F.struct("place", "node"))).alias("at"))
    return row.select(*keys, F.concat(F.transform("at", lambda x: x["node"]), F.array("leader")).alias("cycle"))
