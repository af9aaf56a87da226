"""Stack frames in JSON of unknown layout: a breadth-first walk that stops, log by log, at the first list that looks like frames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.operators.frames import module_name
from faultline.plans.runtime import materialize

#: Keys that make an object look like a frame, and the names of each field, the first that has a value.
FRAME_KEYS = ("function", "func", "method", "symbol", "file", "filename", "abs_path", "line", "lineno", "lineNumber", "module", "library", "image", "address", "instruction_addr", "frame_addr")
FIELDS = {
    "address": ("address", "instruction_addr", "instructionAddress", "frame_addr", "pc", "symbolAddress"),
    "function": ("function", "func", "method", "symbol", "symbol_name", "name", "raw_function"),
    "file": ("file", "filename", "abs_path", "path"),
    "module": ("module", "package", "library", "image", "object_name", "binary", "binary_image"),
    "line": ("line", "lineno", "lineNumber", "line_number"),
    "offset": ("offset", "instruction_offset", "image_offset"),
    "in_app": ("in_app", "inApp", "in_project", "inProject"),
}


def _fields(v: Column) -> Column:
    """The objects of a list as frames: of each field's names the first with a value that is not blank."""
    named = "struct<" + ", ".join(f"`{n}`: string" for names in FIELDS.values() for n in names) + ">"
    said = lambda o, names: F.trim(F.get(F.filter(F.array(*[o[n] for n in names]), lambda x: F.trim(x) != ""), F.lit(0)))
    objects = F.filter(F.try_variant_get(v, "$", f"array<{named}>"), lambda o: o.isNotNull())
    return F.transform(objects, lambda o: F.struct(*[said(o, names).alias(f) for f, names in FIELDS.items()]))


def _of_frames(v: Column) -> Column:
    """Whether a list looks like frames; only keys are looked at."""
    keys = F.array(*map(F.lit, FRAME_KEYS))
    objects = F.filter(F.try_variant_get(v, "$", "array<map<string,struct<>>>"), lambda o: o.isNotNull())
    hits = lambda os: F.size(F.filter(F.slice(os, 1, 5), lambda o: F.arrays_overlap(F.map_keys(o), keys)))
    return F.exists(F.array(objects), lambda os: (F.size(os) > 0) & (hits(os) >= F.least(F.lit(2), F.size(os))))


def _inner(x: Column) -> Column:
    """The lists and objects within one, by the order of keys and places."""
    below = lambda step, v: F.struct(F.concat(x["path"], F.lit("/"), step).alias("path"), v.alias("v"))
    items = F.transform(F.try_variant_get(x["v"], "$", "array<variant>"), lambda v, i: below(i.cast("string"), v))
    values = F.transform(F.map_entries(F.try_variant_get(x["v"], "$", "map<string,variant>")), lambda e: below(e["key"], e["value"]))
    whole = lambda y, t: F.try_variant_get(y["v"], "$", t).isNotNull()
    return F.filter(F.coalesce(items, values, F.array().cast("array<struct<path:string,v:variant>>")), lambda y: whole(y, "struct<>") | whole(y, "array<struct<>>"))


def json_frames(logs: DataFrame, max_depth: int = 8) -> DataFrame:
    """``logs(log_id, content)`` to ``(log_id, depth, path, pos, function, file, module, library, line, address, offset, in_app)``.

    A list is taken for frames where of its first five objects two, or all if there are fewer, have a key that frames have. The
    list nearest the root wins, of equally deep ones the first by the order of keys and places, up to ``max_depth`` steps down.
    Elements that are no objects are left out. Texts that are no JSON, and JSON without such a list, give no row. Each step goes over
    the lists and objects of one depth, which stay in their log's row, so nothing is shuffled; a log ends where it is found.
    """
    # generators give a value to several uses; a filter or field over its expression would take it anew
    front = F.array(F.struct(F.lit("").alias("path"), F.col("v")))
    now = logs.select("log_id", F.explode(F.array(F.try_parse_json("content"))).alias("v")).where("v is not null").select("log_id", front.alias("front"))
    out = []
    for depth in range(max_depth + 1):
        first = F.get(F.filter("front", lambda x: _of_frames(x["v"])), F.lit(0))
        tried = now.select("log_id", F.inline(F.array(F.struct(first.alias("found"), F.col("front").alias("front")))))
        tried = materialize(tried.select("log_id", "found.path", _fields(F.col("found.v")).alias("frames"), F.when(F.col("found").isNull(), F.col("front")).alias("front")), "json")
        out.append(tried.where("path is not null").select("log_id", F.lit(depth).alias("depth"), "path", F.posexplode("frames").alias("pos", "o")).select("log_id", "depth", "path", "pos", "o.*"))
        left = tried.where("path is null")
        if depth < max_depth and not left.head(1):
            break
        now = left.select("log_id", F.flatten(F.transform("front", _inner)).alias("front"))
    rows = reduce(DataFrame.unionAll, out)
    in_app = F.when(F.lower("in_app").isin("1", "true", "yes"), True).when(F.col("in_app").isNotNull(), False)
    return rows.select("log_id", "depth", "path", "pos", "function", "file", "module", module_name(F.coalesce("module", "file")).alias("library"), F.col("line").try_cast("int").alias("line"), "address", "offset", in_app.alias("in_app"))
