"""Wait graphs and heap graphs: cycles, blockers, distances, retained sizes, reference chains, clusters."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.plans.components import connected_components
from faultline.plans.doubling import cycle_places, descendants, listed, on_cycles, to_ends
from faultline.plans.runtime import Growing, dealt, drop, materialize, scratch
from faultline.plans.strong import strong_components

#: What holds an object, by the first hint contained in its holder's name and type.
ROOT_HINTS = [
    ("globalhandler", "JS-FM-01"),
    ("global", "JS-FM-01"),
    ("global_env", "JS-FM-01"),
    ("sourcetextmodule", "JS-FM-01"),
    ("source_text_module", "JS-FM-01"),
    ("listener", "JS-FM-02"),
    ("timer", "JS-FM-03"),
    ("promise", "JS-FM-04"),
    ("napi", "JS-FM-05"),
    ("localhandle", "JS-FM-05"),
    ("frame", "JS-FM-06"),
    ("function", "JS-FM-06"),
]


def dependency_cycles(edges: DataFrame, max_len: int = 8) -> DataFrame:
    """The simple cycles of ``edges(log_id, src, dst)``: ``(log_id, cycle, truncated)``.

    A cycle is given once, from its smallest node and closed with it. Only strongly connected components are looked at. One in
    which every node has one successor is a single cycle and is given whole, however long. In others, whose cycles can be
    exponentially many, those of ``max_len`` nodes at most are given; ``truncated`` tells that the log has longer paths there
    that might close. Null ends are ignored and repeated edges count once.
    """
    whole = edges.select("log_id", "src", "dst").where("src is not null and dst is not null").distinct()
    inside = strong_components(whole, ["log_id"])
    end = lambda c: inside.select("log_id", F.col("node").alias(c), F.col("component").alias(f"{c}_in"))
    core = materialize(whole.join(dealt(end("src")), ["log_id", "src"]).join(dealt(end("dst")), ["log_id", "dst"]).where("src_in = dst_in").select("log_id", F.col("src_in").alias("component"), "src", "dst"), "core")
    # every node of a component has a successor in it, so where none has two there are as many edges as nodes
    branching = materialize(core.groupBy("log_id", "component", "src").count().where("count > 1").select("log_id", "component").distinct(), "branching")
    rings = core.join(dealt(branching), ["log_id", "component"], "left_anti").select("log_id", F.col("src").alias("node"), F.col("dst").alias("to"))
    found = listed(cycle_places(rings, ["log_id"]), ["log_id"])
    core = materialize(core.join(dealt(branching), ["log_id", "component"], "left_semi"), "core")
    step = core.select("log_id", F.col("src").alias("at"), F.col("dst").alias("to"))
    paths = core.where("src <= dst").select("log_id", F.array("src", "dst").alias("path"))
    found = found.unionByName(paths.where(F.get("path", F.lit(0)) == F.get("path", F.lit(1))).select("log_id", F.col("path").alias("cycle")))
    paths = paths.where(F.get("path", F.lit(0)) < F.get("path", F.lit(1)))
    longer = None
    for n in range(2, max_len + 1):
        # each path starts at its smallest node, so each cycle appears once
        paths = materialize(paths, "paths")
        if not paths.head(1):
            break
        nxt = paths.withColumn("at", F.element_at("path", -1)).join(dealt(step), ["log_id", "at"])
        start = F.get("path", F.lit(0))
        found = found.unionByName(nxt.where(F.col("to") == start).select("log_id", F.concat("path", F.array("to")).alias("cycle")))
        grown = nxt.where((F.col("to") > start) & ~F.array_contains("path", F.col("to"))).select("log_id", F.concat("path", F.array("to")).alias("path"))
        if n == max_len:
            longer = grown.select("log_id").distinct()
        paths = grown
    if longer is None:
        return found.withColumn("truncated", F.lit(False))
    return found.join(dealt(longer.withColumn("truncated", F.lit(True))), "log_id", "left").withColumn("truncated", F.coalesce("truncated", F.lit(False)))


def deadlocks(edges: DataFrame, max_len: int = 8) -> DataFrame:
    """The smallest cycle of each log, of those that :func:`dependency_cycles` gives."""
    return dependency_cycles(edges, max_len).groupBy("log_id").agg(F.min("cycle").alias("cycle"))


def mutual_waits(edges: DataFrame) -> DataFrame:
    """``(log_id, node, component)`` of the nodes that wait for themselves over any number of others: their strongly connected
    component, named by its smallest node."""
    parts = materialize(strong_components(edges, ["log_id"]), "components")
    return parts.join(dealt(parts.groupBy("log_id", "component").agg(F.min("node").alias("least"))), ["log_id", "component"]).select("log_id", "node", F.col("least").alias("component"))


def root_blocker(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """From ``starts(log_id, start)`` along each node's first edge (by ``ord``) until there is none or a node comes again.

    ``(log_id, start, blocker, last_node, steps, deadlocked)``: ``blocker`` is the node without an edge, or the one that comes again;
    ``last_node`` is the last that is new, ``steps`` after the start. Walks of any length are followed, in rounds that grow with
    the logarithm of the longest. A start that no edge leaves blocks itself; a null start is ignored.
    """
    keys = ["log_id"]
    first = edges.where("src is not null and dst is not null").groupBy("log_id", F.col("src").alias("node")).agg(F.min_by("dst", F.struct("ord", "dst")).alias("to"))
    ends, looping = to_ends(first, keys)
    looping = materialize(looping, "looping")
    rings = materialize(cycle_places(on_cycles(looping, keys), keys).select("log_id", "node", "to", "size"), "rings")
    # the way into a cycle ends where the cycle begins
    ways, _ = to_ends(looping.join(dealt(rings.select("log_id", "node")), ["log_id", "node"], "left_anti"), keys)
    before = rings.select("log_id", F.col("to").alias("end"), F.col("node").alias("last_node"), "size")
    ways = ways.select("log_id", "node", "end", "steps").unionByName(rings.select("log_id", "node", F.col("node").alias("end"), F.lit(0).cast("long").alias("steps")))
    closed = ways.join(dealt(before), ["log_id", "end"]).select("log_id", "node", F.col("end").alias("blocker"), "last_node", (F.col("steps") + F.col("size") - 1).alias("steps"), F.lit(True).alias("deadlocked"))
    known = ends.select("log_id", "node", F.col("end").alias("blocker"), F.col("end").alias("last_node"), "steps", F.lit(False).alias("deadlocked")).unionByName(closed)
    rows = starts.where("start is not null").join(dealt(known.withColumnRenamed("node", "start")), ["log_id", "start"], "left")
    return rows.select("log_id", "start", F.coalesce("blocker", "start").alias("blocker"), F.coalesce("last_node", "start").alias("last_node"), F.coalesce("steps", F.lit(0).cast("long")).alias("steps"), F.coalesce("deadlocked", F.lit(False)).alias("deadlocked"))


# --- heaps: nodes(snapshot_id, node, name, type, self_size), edges(snapshot_id, src, dst, ord) -------------------------------


def heap_distance(nodes: DataFrame, edges: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """Breadth-first distance of each node that a root reaches; roots have no incoming edge, else node 0 is one."""
    step = edges.select("snapshot_id", F.col("src").alias("node"), F.col("dst").alias("to")).distinct()
    roots = nodes.select("snapshot_id", "node").join(edges.select("snapshot_id", F.col("dst").alias("node")), ["snapshot_id", "node"], "left_anti")
    rootless = nodes.select("snapshot_id").distinct().join(roots.select("snapshot_id"), "snapshot_id", "left_anti").withColumn("node", F.lit(0).cast(nodes.schema["node"].dataType))
    frontier = roots.unionByName(rootless).distinct().withColumn("distance", F.lit(0))
    seen = Growing(frontier, "bfs")
    frontier = seen.rows()
    for d in range(1, max_rounds):
        new = frontier.join(step, ["snapshot_id", "node"]).select("snapshot_id", F.col("to").alias("node")).distinct().join(seen.rows().select("snapshot_id", "node"), ["snapshot_id", "node"], "left_anti")
        frontier = seen.add(new.withColumn("distance", F.lit(d)))
        if not frontier.head(1):
            break
    else:
        raise RuntimeError(f"distances did not settle in {max_rounds} rounds")
    return seen.rows()


def heap_retained(nodes: DataFrame, edges: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """``(snapshot_id, node, retained_size)``: the sizes of all that a node reaches, itself too; sizes of 0 and less are dropped.

    This is reachability, not dominance. Nodes that reach each other are one part and retain the same. A part with one holder
    adds its sum to that holder's; parts with more holders are passed up as sets, so that each counts once however it is reached,
    and only what lies above such parts carries a set. Trees carry none. Rounds grow with the logarithm of the depth.
    ``candidates(snapshot_id, node)`` restricts the rows that are returned; a node that repeats counts with all its sizes.
    """
    keys = ["snapshot_id"]
    links = materialize(edges.where("src is not null and dst is not null").select("snapshot_id", "src", "dst").distinct(), "links")
    parts = strong_components(links, keys, once=True)
    ends = links.select("snapshot_id", F.col("src").alias("node")).unionByName(links.select("snapshot_id", F.col("dst").alias("node"))).withColumn("self_size", F.lit(0))
    sized = nodes.select("snapshot_id", "node", "self_size", F.lit(True).alias("listed")).unionByName(ends.withColumn("listed", F.lit(False))).groupBy("snapshot_id", "node").agg(F.sum("self_size").alias("size"), F.max("listed").alias("listed"))
    if parts.head(1):
        of = materialize(sized.join(dealt(parts), [*keys, "node"], "left").select("snapshot_id", "node", F.coalesce("component", "node").alias("part"), "size", "listed"), "parts")
        end = lambda c: of.select("snapshot_id", F.col("node").alias(c), F.col("part").alias(f"{c}_part"))
        held = materialize(links.join(dealt(end("src")), [*keys, "src"]).join(dealt(end("dst")), [*keys, "dst"]).where("src_part <> dst_part").select("snapshot_id", F.col("src_part").alias("src"), F.col("dst_part").alias("dst")).distinct(), "held")
    else:
        # no cycles: each node is a part by itself
        of, held = materialize(sized.withColumn("part", F.col("node")), "parts"), links
    holders = materialize(held.groupBy("snapshot_id", "dst").agg(F.count(F.lit(1)).alias("n"), F.first("src").alias("parent")), "holders")
    shared = holders.where("n > 1").select("snapshot_id", "dst")
    sets = held.join(dealt(shared), [*keys, "dst"], "left_semi").select("snapshot_id", F.col("src").alias("node"), F.col("dst").alias("item"))
    values = of.groupBy("snapshot_id", F.col("part").alias("node")).agg(F.sum("size").alias("value"))
    total, items = descendants(holders.where("n = 1").select("snapshot_id", F.col("dst").alias("node"), "parent"), keys, values, sets)
    if items.head(1):
        # what shared parts reach over others, by squaring
        reach, path = scratch(items.join(dealt(shared.withColumnRenamed("dst", "node")), [*keys, "node"], "left_semi").select("snapshot_id", "node", "item"), "reach")
        size = reach.count()
        while size:
            further = reach.select("snapshot_id", F.col("node").alias("item"), F.col("item").alias("next"))
            nxt, nxt_path = scratch(reach.unionByName(reach.join(dealt(further), [*keys, "item"]).select("snapshot_id", "node", F.col("next").alias("item"))).distinct(), "reach")
            drop(edges.sparkSession, path)
            reach, path, before, size = nxt, nxt_path, size, nxt.count()
            if size == before:
                break
        every = items
        if size:
            further = reach.select("snapshot_id", F.col("node").alias("item"), F.col("item").alias("next"))
            every = items.unionByName(items.join(dealt(further), [*keys, "item"]).select("snapshot_id", "node", F.col("next").alias("item"))).distinct()
        beside = every.join(dealt(total.select("snapshot_id", F.col("node").alias("item"), F.col("total").alias("own"))), [*keys, "item"]).groupBy("snapshot_id", "node").agg(F.sum("own").alias("beside"))
        total = total.join(dealt(beside), [*keys, "node"], "left").select("snapshot_id", "node", (F.col("total") + F.coalesce("beside", F.lit(0))).alias("total"))
    rows = of.select("snapshot_id", "node", "part", "listed").join(dealt(total.withColumnRenamed("node", "part")), [*keys, "part"])
    rows = rows.where("listed") if candidates is None else rows.join(dealt(candidates.select("snapshot_id", "node").distinct()), [*keys, "node"], "left_semi")
    return rows.where("total > 0").select("snapshot_id", "node", F.col("total").alias("retained_size"))


def heap_chain(nodes: DataFrame, edges: DataFrame, max_depth: int = 10) -> DataFrame:
    """``(snapshot_id, node, chain)``: names from the root side to the node, along each node's first incoming edge."""
    label = F.coalesce(F.nullif("name", F.lit("")), "type", F.lit(""))
    parent = materialize(edges.groupBy("snapshot_id", F.col("dst").alias("at")).agg(F.min_by("src", F.struct("ord", "src")).alias("up")).join(nodes.select("snapshot_id", F.col("node").alias("up"), label.alias("up_name")), ["snapshot_id", "up"]), "parents")
    now = nodes.select("snapshot_id", "node", F.col("node").alias("at"), F.array("node").alias("seen"), F.array(label).alias("chain"), F.lit(False).alias("done"))
    for _ in range(max_depth - 1):
        nxt = now.join(parent, ["snapshot_id", "at"], "left")
        stop = F.col("done") | F.col("up").isNull() | F.array_contains("seen", F.col("up"))
        now = nxt.select("snapshot_id", "node", F.when(stop, F.col("at")).otherwise(F.col("up")).alias("at"), F.when(stop, F.col("seen")).otherwise(F.concat("seen", F.array("up"))).alias("seen"), F.when(stop, F.col("chain")).otherwise(F.concat(F.array("up_name"), "chain")).alias("chain"), stop.alias("done"))
    return now.select("snapshot_id", "node", "chain")


def heap_fault_mode(text: Column) -> Column:
    """Fault mode of an object from what holds it."""
    low, mode = F.lower(text), F.lit("JS-FM-Unknown")
    for hint, ident in reversed(ROOT_HINTS):
        mode = F.when(low.contains(hint), ident).otherwise(mode)
    return mode


def heap_clusters(nodes: DataFrame, edges: DataFrame, top: int = 20, candidates: DataFrame | None = None) -> DataFrame:
    """Objects with something retained, the largest ``top`` of each snapshot, with chain, distance and fault mode."""
    retained = heap_retained(nodes, edges, candidates)
    parent = edges.groupBy("snapshot_id", F.col("dst").alias("node")).agg(F.min_by("src", F.struct("ord", "src")).alias("up"))
    up = nodes.select("snapshot_id", F.col("node").alias("up"), F.col("name").alias("up_name"), F.col("type").alias("up_type"))
    rows = nodes.join(retained, ["snapshot_id", "node"]).join(parent, ["snapshot_id", "node"], "left").join(up, ["snapshot_id", "up"], "left")
    rank = F.row_number().over(Window.partitionBy("snapshot_id").orderBy(F.desc("retained_size"), F.desc("self_size"), "name", "node"))
    rows = rows.withColumn("rank", rank).where(F.col("rank") <= top)
    rows = rows.withColumn("fault_mode", heap_fault_mode(F.concat_ws(" ", F.coalesce("up_name", "name"), F.coalesce("up_type", "type"))))
    return rows.join(heap_chain(nodes, edges), ["snapshot_id", "node"]).join(heap_distance(nodes, edges), ["snapshot_id", "node"], "left").drop("up", "up_name", "up_type")


@F.pandas_udf(T.DoubleType())
def lcs_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Longest common subsequence over the longer length; 0 where either chain has more than 50 entries."""

    def one(x, y) -> float:
        if len(x) > 50 or len(y) > 50:
            return 0.0
        row = [0] * (len(y) + 1)
        for i in x:
            last = 0
            for k, j in enumerate(y, 1):
                last, row[k] = row[k], last + 1 if i == j else max(row[k], row[k - 1])
        return row[-1] / max(len(x), len(y))

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)])


def _contains_run(outer: Column, inner: Column) -> Column:
    """Whether ``inner`` stands in ``outer`` without a gap."""
    mark = lambda c: F.concat(F.lit("\u0001"), F.array_join(c, "\u0001"), F.lit("\u0001"))
    return mark(outer).contains(mark(inner))


def merge_chains(clusters: DataFrame, threshold: float = 0.7) -> DataFrame:
    """``clusters(cluster_id, name, type, retained_size, chain)`` merged where chains are alike: one row a group.

    Alike means that one chain stands within the other, or that the common subsequence makes ``threshold`` of the longer
    one. Equal chains are merged first. Chains meet by rare names only: of names common to two alike chains the rarest is among
    the first few, by rarity, of both (a share 1 - threshold of a chain can be missing in the other), and where one stands within
    the other its own rarest name is in both. Names that all chains have, as the root's, make no pairs.
    """
    distinct = clusters.groupBy("chain").agg(F.min("cluster_id").alias("rep")).where(F.size("chain") > 0)
    distinct = materialize(distinct, "chains")
    words = distinct.select("rep", F.size("chain").alias("n"), F.explode(F.array_distinct("chain")).alias("word"))
    words = words.join(words.groupBy("word").agg(F.count("*").alias("chains")), "word")
    words = materialize(words.withColumn("place", F.row_number().over(Window.partitionBy("rep").orderBy("chains", "word"))), "words")
    few = words.where(F.col("place") <= F.floor((1 - threshold) * F.col("n") + 1e-9) + 1).select("rep", "word")
    rarest = words.where("place = 1").select("rep", "word")
    meet = lambda a, b: a.alias("a").join(b.alias("b"), F.expr("a.word = b.word and a.rep <> b.rep")).select(F.least("a.rep", "b.rep").alias("x"), F.greatest("a.rep", "b.rep").alias("y"))
    pairs = meet(few, few).unionByName(meet(rarest, words.select("rep", "word"))).distinct()
    full = pairs.join(distinct.select(F.col("rep").alias("x"), F.col("chain").alias("cx")), "x").join(distinct.select(F.col("rep").alias("y"), F.col("chain").alias("cy")), "y")
    within = _contains_run(F.col("cx"), F.col("cy")) | _contains_run(F.col("cy"), F.col("cx"))
    # the common subsequence cannot exceed the shorter chain
    could = F.least(F.size("cx"), F.size("cy")) >= threshold * F.greatest(F.size("cx"), F.size("cy"))
    sure = full.where(within).select(F.col("x").alias("src"), F.col("y").alias("dst"))
    tested = full.where(~within & could).where(lcs_ratio("cx", "cy") >= threshold).select(F.col("x").alias("src"), F.col("y").alias("dst"))
    groups = connected_components(sure.unionByName(tested))
    rows = clusters.join(distinct, "chain", "left").withColumn("node", F.coalesce("rep", "cluster_id")).join(groups, "node", "left").withColumn("grp", F.coalesce("component", "node"))
    best = F.struct("retained_size", -F.col("cluster_id"))
    return rows.groupBy("grp").agg(F.max_by("name", best).alias("name"), F.max_by("type", best).alias("type"), F.count("*").alias("instance_count"), F.sum("retained_size").alias("total_retained_size"), F.bround(F.avg("retained_size"), 1).alias("avg_retained_size"), F.max_by("chain", F.struct(F.size("chain"), -F.col("cluster_id"))).alias("representative_chain"))


def heap_series(clusters: DataFrame) -> DataFrame:
    """``clusters(snapshot_no, name, type, retained_size)``: in how many snapshots an object occurs, and its trend by name."""
    span = clusters.agg(F.countDistinct("snapshot_no").alias("snapshots"), F.min("snapshot_no").alias("lo"), F.max("snapshot_no").alias("hi"))
    rows = clusters.crossJoin(F.broadcast(span))  # one row of totals
    seen = rows.groupBy("name", "type").agg(F.countDistinct("snapshot_no").alias("occurrence_count"), F.max("snapshots").alias("snapshots"), F.sum("retained_size").alias("total_retained_size"))
    ends = rows.groupBy("name").agg(F.coalesce(F.max(F.when(F.expr("snapshot_no = lo"), F.col("retained_size"))), F.lit(0)).alias("first_max"), F.coalesce(F.max(F.when(F.expr("snapshot_no = hi"), F.col("retained_size"))), F.lit(0)).alias("last_max"))
    trend = F.when(F.col("last_max") > F.col("first_max") * 1.2, "growing").when(F.col("last_max") < F.col("first_max") * 0.8, "shrinking").otherwise("stable")
    return seen.join(ends, "name").withColumn("occurrence_ratio", F.bround(F.col("occurrence_count") / F.col("snapshots"), 3)).withColumn("growth_trend", trend)


def diff_heap(current: DataFrame, baseline: DataFrame, key: Sequence[str] = ("name", "type"), size: str = "retained_size") -> DataFrame:
    """New and grown objects: ``(key..., size, baseline_size, delta, change)``."""
    now, before = current.groupBy(*key).agg(F.max(size).alias("size")), baseline.groupBy(*key).agg(F.max(size).alias("baseline_size"))
    rows = now.join(before, list(key), "left")
    return rows.withColumn("delta", F.col("size") - F.coalesce("baseline_size", F.lit(0))).withColumn("change", F.when(F.col("baseline_size").isNull(), "new").when(F.col("size") > F.col("baseline_size"), "grown")).where("change is not null")


# --- source graphs -----------------------------------------------------------------------------------------------------------


def build_source_edges(refs: DataFrame, symbols: DataFrame, fan_out: int = 20, per_file: int = 50) -> DataFrame:
    """``refs(file, token)`` and ``symbols(file, name)`` to ``(src, dst, weight)``: a file names a symbol of another file.

    Symbols defined in more than ``fan_out`` files say nothing and are skipped; the heaviest edges of a file stay.
    """
    wide = symbols.groupBy("name").agg(F.countDistinct("file").alias("files")).where(F.col("files") <= fan_out)
    defined = symbols.join(wide, "name", "left_semi").select(F.col("file").alias("dst"), F.col("name").alias("token")).distinct()
    edges = refs.select(F.col("file").alias("src"), "token").join(defined, "token").where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("weight"))
    return edges.withColumn("rank", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("weight"), "dst"))).where(F.col("rank") <= per_file).drop("rank")


def rank_source_files(anchors: DataFrame, edges: DataFrame, passes: int = 3) -> DataFrame:
    """``anchors(file, points)`` summed, then ``passes`` times each file gives score * min(0.8, 0.1 * weight) to its targets."""
    score = anchors.groupBy("file").agg(F.sum("points").cast("double").alias("score"))
    for _ in range(passes):
        given = score.join(edges, F.col("file") == F.col("src")).select(F.col("dst").alias("file"), (F.col("score") * F.least(F.lit(0.8), 0.1 * F.col("weight"))).alias("score"))
        score = score.unionByName(given).groupBy("file").agg(F.sum("score").alias("score"))
    return score


def evidence_graph(items: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``items(kind, content)`` and ``links(src_content, label, dst_content)`` to nodes by content hash and edges between them."""
    nodes = items.select(F.sha2("content", 256).alias("node"), "kind", "content").dropDuplicates(["node"])
    edges = links.select(F.sha2("src_content", 256).alias("src"), "label", F.sha2("dst_content", 256).alias("dst")).distinct()
    for end in ("src", "dst"):
        edges = edges.join(nodes.select(F.col("node").alias(end)), end, "left_semi")
    return nodes, edges.select("src", "label", "dst")
