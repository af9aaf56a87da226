"""Heap snapshots of any size: one file is many tasks' work.

A snapshot is one JSON object whose arrays of numbers hold nearly all of it. The text source cuts files at commas, so a file's
splits are read side by side and each row is a number, a piece of the head or a piece of a string. Places of rows in their file
come from two passes: rows are numbered within their split, and split totals are summed over the file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from faultline.plans.runtime import materialize

#: Nodes and strings whose running sums one task keeps.
RANGE = 1 << 20


def _running(rows: DataFrame, key: list[str], part: str, order: str, value: str, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``value`` before each row in the order of (``part``, ``order``) within ``key``; a part is one task's work."""
    totals = rows.groupBy(*key, part).agg(F.sum(value).alias("_total"))
    before = totals.withColumn("_before", F.coalesce(F.sum("_total").over(Window.partitionBy(*key).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_total")
    within = F.sum(value).over(Window.partitionBy(*key, part).orderBy(order)) - F.col(value)
    return rows.withColumn("_within", within).join(before, [*key, part]).withColumn(name, F.col("_before") + F.col("_within")).drop("_before", "_within")


def _tokens(spark: SparkSession, path: str) -> DataFrame:
    """What lies between the commas of each file: ``(snapshot_id, block, seq, token, place)``, ``place`` counting from 0."""
    rows = spark.read.option("lineSep", ",").option("recursiveFileLookup", True).text(path)
    rows = rows.select(F.col("_metadata.file_path").alias("snapshot_id"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq"), F.col("value").alias("token"))
    rows = materialize(rows.withColumn("one", F.lit(1)), "snapshot-tokens")
    return materialize(_running(rows, ["snapshot_id"], "block", "seq", "one", "place").drop("one"), "snapshot-places")


def _starts(tokens: DataFrame, name: str) -> DataFrame:
    return tokens.where(F.col("token").rlike(rf'(?<!\\)"{name}"\s*:\s*\[')).groupBy("snapshot_id").agg(F.min("place").alias(f"{name}_at"))


def _heads(tokens: DataFrame, bounds: DataFrame) -> DataFrame:
    """Field names and node types from what stands before a file's first number."""
    near = tokens.join(bounds.select("snapshot_id", "nodes_at"), "snapshot_id").where("place <= nodes_at")
    text = near.groupBy("snapshot_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "token"))), lambda x: x["token"]), ",").alias("head"))
    v = F.try_parse_json(F.concat(F.regexp_replace("head", r'(?s),\s*"nodes"\s*:\s*\[[^\[]*$', ""), F.lit("}")))
    get = lambda p: F.try_variant_get(v, p, "array<string>")
    return text.select("snapshot_id", get("$.snapshot.meta.node_fields").alias("nf"), get("$.snapshot.meta.edge_fields").alias("ef"), get("$.snapshot.meta.node_types[0]").alias("types"))


def _numbers(tokens: DataFrame, bounds: DataFrame, name: str) -> DataFrame:
    """The numbers ``(snapshot_id, k, value)`` of an array; it ends at the first token that closes it."""
    t = F.regexp_replace("token", rf'(?s)^.*"{name}"\s*:\s*\[', "")
    inside = tokens.join(bounds.select("snapshot_id", F.col(f"{name}_at").alias("from"), F.col(f"{name}_to").alias("to")), "snapshot_id").where("place >= `from` and place <= `to`")
    digits = F.regexp_extract(F.when(F.col("place") == F.col("from"), t).otherwise(F.col("token")), r"^\s*(-?\d+)", 1)
    return inside.select("snapshot_id", (F.col("place") - F.col("from")).alias("k"), digits.try_cast("long").alias("value")).where("value is not null")


def _strings(tokens: DataFrame, bounds: DataFrame) -> DataFrame:
    """The strings ``(snapshot_id, i, string)``: a token that begins outside quotes begins a string, others go on with it."""
    t = F.when(F.col("place") == F.col("strings_at"), F.regexp_replace("token", r'(?s)^.*?(?<!\\)"strings"\s*:\s*\[', "")).otherwise(F.col("token"))
    rows = tokens.join(bounds.select("snapshot_id", "strings_at"), "snapshot_id").where("place >= strings_at").select("snapshot_id", "block", "place", t.alias("token"))
    quotes = F.regexp_count(F.regexp_replace("token", r"(?s)\\.", ""), F.lit('"'))
    rows = _running(rows.withColumn("quotes", quotes), ["snapshot_id"], "block", "place", "quotes", "before")
    rows = _running(rows.withColumn("begins", (F.col("before") % 2 == 0).cast("int")), ["snapshot_id"], "block", "place", "begins", "i")
    joined = rows.groupBy("snapshot_id", (F.col("i") + F.col("begins") - 1).alias("i")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "token"))), lambda x: x["token"]), ",").alias("raw"))
    literal = F.regexp_extract("raw", r'(?s)^\s*("(?:[^"\\]++|\\.)*+")', 1)
    return joined.select("snapshot_id", "i", F.try_variant_get(F.try_parse_json(literal), "$", "string").alias("string")).where("string is not null")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Files below ``path`` to nodes ``(snapshot_id, node, type, name, self_size, edge_count)`` and edges ``(snapshot_id, src, dst, ord)``.

    The same rows as ``readers.heap_snapshot_to_graph`` gives for parsed contents, with a file's path as its id, for files of any
    size: splits are read side by side, and no task holds more than a split's rows, ``RANGE`` nodes or one string. The arrays
    nodes, edges and strings must come in this order after the head, as writers have them. Files without these arrays, empty ones
    and such as are no snapshots give no row, nor do files that break off before their strings; where one breaks off within them,
    later names are null. Strings may hold commas, quotes and line breaks.
    """
    tokens = _tokens(spark, path)
    bounds = _starts(tokens, "nodes").join(_starts(tokens, "edges"), "snapshot_id").join(_starts(tokens, "strings"), "snapshot_id")
    closing = tokens.where(F.col("token").rlike(r"\]")).join(bounds, "snapshot_id")
    ends = closing.groupBy("snapshot_id").agg(F.min(F.when(F.col("place") >= F.col("nodes_at"), F.col("place"))).alias("nodes_to"), F.min(F.when(F.col("place") >= F.col("edges_at"), F.col("place"))).alias("edges_to"))
    bounds = materialize(bounds.join(ends, "snapshot_id"), "snapshot-bounds")
    heads = materialize(_heads(tokens, bounds), "snapshot-heads")
    width, field = F.size("nf"), lambda name: F.get("nf", (F.col("k") % F.size("nf")).cast("int")) == name
    cells = _numbers(tokens, bounds, "nodes").join(heads, "snapshot_id")
    taken = lambda name: F.max(F.when(field(name), F.col("value"))).alias(name)
    rows = cells.groupBy("snapshot_id", F.floor(F.col("k") / width).cast("int").alias("node")).agg(taken("type"), taken("name"), taken("self_size"), taken("edge_count"), F.count(F.lit(1)).alias("have"), F.first(width).alias("width"))
    rows = rows.where("have = width").drop("have", "width").withColumn("range", F.floor(F.col("node") / RANGE))
    rows = materialize(_running(rows, ["snapshot_id"], "range", "node", "edge_count", "begin"), "snapshot-nodes")
    named = rows.join(_strings(tokens, bounds).select("snapshot_id", F.col("i").alias("name"), "string"), ["snapshot_id", "name"], "left")
    nodes = named.join(heads.select("snapshot_id", "types"), "snapshot_id").select("snapshot_id", "node", F.coalesce(F.get("types", F.col("type").cast("int")), F.col("type").cast("string")).alias("type"), F.col("string").alias("name"), "self_size", "edge_count")
    owners = rows.where("edge_count > 0").select("snapshot_id", F.col("node").alias("src"), F.explode(F.sequence("begin", F.col("begin") + F.col("edge_count") - 1)).alias("ord"))
    counts = rows.groupBy("snapshot_id").agg((F.max("node") + 1).alias("node_count"))
    links = _numbers(tokens, bounds, "edges").join(heads, "snapshot_id").where(F.get("ef", (F.col("k") % F.size("ef")).cast("int")) == "to_node").join(counts, "snapshot_id")
    to: Column = F.when(F.col("value") >= width, F.floor(F.col("value") / width)).otherwise(F.col("value"))
    links = links.select("snapshot_id", F.floor(F.col("k") / F.size("ef")).cast("long").alias("ord"), to.cast("int").alias("dst"), "node_count").where("dst >= 0 and dst < node_count")
    return nodes, owners.join(links, ["snapshot_id", "ord"]).select("snapshot_id", "src", "dst", "ord")
