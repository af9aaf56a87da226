"""Retrieval and knowledge maintenance: vector search, document scores, fusion under budgets, chunks, upserts, decay."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.operators.rules import one_row
from faultline.operators.terms import contained_terms
from faultline.operators.vectors import nearest
from faultline.plans.runtime import by_size, materialize

#: Ranks of where a hit comes from.
PROVENANCE_RANK = {"code": 4, "code_and_curated_document": 4, "code_and_crash_evidence": 4, "verified_historical_case": 3, "historical_case": 2, "curated_playbook": 2, "model_inferred": 1}
SOURCE_RANK = {"rule": 4, "pack_document": 3, "knowledge_pack_chunk": 2, "internal_case": 1}
CONFIDENCE = {"high": 0.9, "medium": 0.7, "low": 0.4}
LAYER_LIMITS = {"code": 2, "crash": 2, "concept": 2}


def _ranks(values: dict, key: Column, default) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key), F.lit(default))


def vector_topk(queries: DataFrame, vectors: DataFrame, n: int = 5, where: Column | None = None, **settings) -> DataFrame:
    """The ``n`` nearest of those ``vectors(pattern_id, embedding)`` that fulfil ``where``: see :func:`vectors.nearest`."""
    return nearest(queries, vectors.where(where) if where is not None else vectors, n, **settings)


def retrieve_patterns(queries: DataFrame, vectors: DataFrame, metadata: DataFrame, n: int = 5) -> DataFrame:
    """Nearest patterns with metadata ``(pattern_id, confidence, adopted, deprecated)``; deprecated ones go after the cut at ``n``.

    Similarity is 1 - d up to a distance of 1 and 1 / (1 + d) beyond; the score adds the confidence and min(0.2, 0.02 * adopted).
    """
    hits = vector_topk(queries, vectors, n).join(metadata, "pattern_id").where("not deprecated")
    sim = F.when(F.col("distance") <= 1, 1 - F.col("distance")).otherwise(1 / (1 + F.col("distance")))
    return hits.withColumn("similarity", sim).withColumn("score", sim + F.col("confidence") + F.least(F.lit(0.2), 0.02 * F.col("adopted")))


def hash_embed(df: DataFrame, text_col: str, dim: int = 384) -> DataFrame:
    """Adds ``embedding``: hashed word counts of unit length, the same in every process; zeros for a text without a word.

    Words are hashed by Spark's ``xxhash64``; each text's hashes are counted once, in Arrow batches.
    """
    words = F.filter(F.split(F.lower(F.coalesce(text_col, F.lit(""))), r"\W+"), lambda w: w != "")

    @F.pandas_udf("array<float>")
    def counted(slots: pd.Series) -> pd.Series:
        rows = [np.bincount(np.asarray(x, np.int64), minlength=dim) if len(x) else np.zeros(dim) for x in slots]
        return pd.Series([(x / n).astype(np.float32) if (n := np.sqrt((x * x).sum())) else x.astype(np.float32) for x in rows])

    return df.withColumn("embedding", counted(F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(dim)).cast("int"))))


def order_hits(hits: DataFrame) -> DataFrame:
    """Adds ``hit_no``, the order in which hits are considered, after dropping model-inferred ones of low confidence (kept in
    the result with ``reason``)."""
    provenance = F.coalesce("provenance", "source_type", F.lit(""))
    confidence = F.coalesce("confidence_score", _ranks(CONFIDENCE, F.lower(F.coalesce("confidence", F.lit("medium"))), 0.6))
    rows = hits.withColumn("conf", confidence).withColumn("reason", F.when((F.col("conf") <= 0.4) & (provenance == "model_inferred"), "low_confidence_model_inferred"))
    rank = F.when(F.col("backend") == "rule", 5).otherwise(_ranks(PROVENANCE_RANK, provenance, 0))
    order = [F.asc_nulls_first("reason"), F.desc(rank), F.desc(_ranks(SOURCE_RANK, F.coalesce("backend", F.lit("")), 0)), F.desc(F.coalesce("qualified", F.lit(0))), F.desc(F.coalesce("score", F.lit(0.0))), F.desc("conf"), "hit_id"]
    return rows.withColumn("hit_no", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))


def fuse_hits(hits: DataFrame, max_hits: int = 6, max_chars: int = 4500, layer_limits: dict[str, int] | None = None) -> DataFrame:
    """``hits(query_id, hit_id, backend, layer, fingerprint, excerpt, ...)`` to a verdict each: ``(query_id, hit_id, hit_no, reason,
    used_chars)``, the reason being selected or why not.

    Hits are taken greedily in order under budgets for hits, layers and characters. A query's hits are retrieved lists,
    short by nature; the greedy pick is a fold over them within the row.
    """
    limits = {**LAYER_LIMITS, **(layer_limits or {})}
    rows = order_hits(hits).select("query_id", F.struct("hit_no", "hit_id", F.coalesce("layer", F.lit("crash")).alias("layer"), "fingerprint", F.length(F.trim(F.coalesce("excerpt", F.lit("")))).alias("chars"), "reason").alias("h"))
    lists = rows.groupBy("query_id").agg(F.array_sort(F.collect_list("h")).alias("hs"))
    cap = lambda layer: _ranks(limits, layer, 2)
    verdict = "hit_id: {h}, hit_no: int, reason: string, used_chars: int"
    id_type = hits.schema["hit_id"].dataType.simpleString()
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("used"), F.array().cast("array<string>").alias("seen"), F.array().cast("array<string>").alias("layers"), F.array().cast(f"array<struct<{verdict.format(h=id_type)}>>").alias("out"))

    def step(a: Column, h: Column) -> Column:
        in_layer = F.size(F.filter(a["layers"], lambda x: x == h["layer"]))
        room = F.lit(max_chars) - a["used"]
        why = F.when(h["reason"].isNotNull(), h["reason"]).when(a["n"] >= max_hits, "hit_budget").when(F.array_contains(a["seen"], h["fingerprint"]), "duplicate").when(in_layer >= cap(h["layer"]), "layer_budget").when(room <= 0, "character_budget").otherwise("selected")
        ok = why == "selected"
        chars = F.when(h["chars"] > room, room + 1).otherwise(h["chars"])
        put = lambda xs, x: F.when(ok, F.concat(xs, F.array(x))).otherwise(xs)
        return F.struct((a["n"] + ok.cast("int")).alias("n"), (a["used"] + F.when(ok, chars).otherwise(0)).alias("used"), put(a["seen"], h["fingerprint"]).alias("seen"), put(a["layers"], h["layer"]).alias("layers"), F.concat(a["out"], F.array(F.struct(h["hit_id"].alias("hit_id"), h["hit_no"].alias("hit_no"), why.alias("reason"), F.when(ok, chars).otherwise(0).alias("used_chars")))).alias("out"))

    return lists.select("query_id", F.inline(F.aggregate("hs", zero, step)["out"]))


def drop_unrelated(vector_hits: DataFrame, pack_hits: DataFrame) -> DataFrame:
    """Vector hits without the plainly unrelated ones for queries that have document hits."""
    has = pack_hits.select("query_id").distinct().withColumn("_has", F.lit(True))
    words = F.concat_ws(" ", F.lower(F.coalesce("pattern_id", F.lit(""))), F.lower(F.coalesce("crash_signature", F.lit(""))))
    odd = (F.lower(F.coalesce("crash_category", F.lit(""))) == "arithmetic") | words.rlike("divide_by_zero|sigfpe|aba_problem")
    return vector_hits.join(has, "query_id", "left").where(F.col("_has").isNull() | ~odd).drop("_has")


def route_packs(queries: DataFrame, hints: DataFrame, forced: DataFrame | None = None) -> DataFrame:
    """``queries(query_id, text)`` and ``hints(pack_id, kind, hint)``: so_names 4, package_prefixes 3, stack_hints 5, path_hints 2 for
    each hint contained; a forced pack gets 100 more. The best pack above 0."""
    weight = _ranks({"so_names": 4, "package_prefixes": 3, "stack_hints": 5, "path_hints": 2}, F.col("kind"), 0)
    # stars in hints stand for nothing
    needles = hints.select("pack_id", "kind", F.replace(F.lower(F.trim("hint")), F.lit("*"), F.lit("")).alias("term")).where("term <> ''")
    hits = contained_terms(queries.select("query_id", F.lower("text").alias("text")), needles, "query_id").join(needles, "term").select("query_id", "pack_id", weight.alias("points"))
    if forced is not None:
        hits = hits.unionByName(forced.select("query_id", "pack_id", F.lit(100).alias("points")))
    by = hits.groupBy("query_id", "pack_id").agg(F.sum("points").alias("score")).where("score > 0")
    return by.withColumn("_r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "pack_id"))).where("_r = 1").drop("_r")


RUN = r"'[\\w:.]{4,}'"


def _runs(df: DataFrame, key: str, column: str) -> DataFrame:
    """``(key, run)``: the different runs of word characters, colons and dots of a text, in lower case."""
    return df.select(key, F.explode(F.array_distinct(F.expr(f"regexp_extract_all(lower({column}), {RUN}, 0)"))).alias("run"))


def _within(needles: DataFrame, runs: DataFrame) -> DataFrame:
    """``(needle, run)`` for each of ``needles(needle)``, of four characters or more, that stands in one of ``runs(run)``.

    Both meet by the needle's first four characters, so this is an equality join over different words.
    """
    pieces = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("run") - 3), lambda i: F.substr(F.col("run"), i, F.lit(4))))
    spread = runs.select("run").distinct().select("run", F.explode(pieces).alias("_g"))
    own = needles.select("needle").distinct().where(F.length("needle") >= 4).withColumn("_g", F.substring("needle", 1, 4))
    return own.join(spread, "_g").where(F.contains(F.col("run"), F.col("needle"))).select("needle", "run").distinct()


def score_docs(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """``queries(query_id, text)`` against ``docs(doc_id, symbols array, body)``: 8 for each symbol that the query contains, and for each
    query term of four characters or more that the body contains 1.5 if it is qualified (``::`` or ``lib``), else 0.5."""
    terms = _runs(queries, "query_id", "text")
    points = F.when(F.contains(F.col("needle"), F.lit("::")) | F.col("needle").startswith("lib"), 1.5).otherwise(0.5)
    # a term is a run itself, so it stands in a run of the body where it stands in the body
    in_body = contained_terms(docs.select("doc_id", F.lower("body").alias("text")), terms.select(F.col("run").alias("term")), "doc_id").select("doc_id", F.col("term").alias("needle")).distinct()
    a = terms.select("query_id", F.col("run").alias("needle")).join(in_body, "needle").select("query_id", "doc_id", points.alias("points"))
    symbols = docs.select("doc_id", F.explode(F.array_distinct(F.transform("symbols", lambda x: F.lower(F.trim(x))))).alias("needle"))
    in_query = _within(symbols, terms).join(terms, "run").select("query_id", "needle").distinct()
    b = in_query.join(symbols, "needle").select("query_id", "doc_id", F.lit(8.0).alias("points"))
    return a.unionByName(b).groupBy("query_id", "doc_id").agg(F.sum("points").alias("score"))


def select_docs(hits: DataFrame, most: int = 4, chars: int = 4500) -> DataFrame:
    """``hits(query_id, doc_id, score, length)``: the best ``most``, cut before the first that overflows the characters."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    rows = hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
    return rows.withColumn("running", F.sum("length").over(w)).where(F.col("running") <= chars)


def excerpt(body: Column, terms: Column, size: int = 600, before: int = 180) -> Column:
    """A window of the body from 180 characters before the earliest term, or from the start."""
    places = F.filter(F.transform(terms, lambda t: F.position(F.lower(t), F.lower(body))), lambda p: p > 0)
    start = F.coalesce(F.greatest(F.lit(1), F.array_min(places) - before), F.lit(1))
    return F.substr(body, start, F.lit(size))


def seed_symbols(stacks: DataFrame, docs: DataFrame, most: int = 40) -> DataFrame:
    """All symbols of documents that have one in the stack text, the first ``most`` per stack."""
    symbols = docs.select("doc_id", F.explode("symbols").alias("symbol"))
    words = stacks.select("log_id", F.explode(F.array_distinct(F.expr(r"regexp_extract_all(text, '[\\w:~]+', 0)"))).alias("symbol"))
    beside = symbols.join(symbols.withColumnRenamed("symbol", "seed"), "doc_id").select("seed", "symbol").distinct()
    # written, so that its rows can be counted and dealt out over tasks of bounded size
    every = materialize(words.withColumnRenamed("symbol", "seed").join(beside, "seed").select("log_id", "symbol"), "seeded")
    every = by_size(every, "log_id").distinct()
    return every.withColumn("rank", F.row_number().over(Window.partitionBy("log_id").orderBy("symbol"))).where(F.col("rank") <= most)


def front_matter(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, metadata map, body)``: the ``key: value`` lines between a text's first lines of dashes, the last of a key, and what
    follows; a text without such a head is all body."""
    head = r"(?s)\A---\s*\n(.*?)\n---\s*\n"
    text = F.coalesce(text_col, F.lit(""))
    lines = F.filter(F.split(F.regexp_extract(text, head, 1), r"\r?\n"), lambda x: x.contains(":") & ~F.ltrim(x).startswith("#"))
    value = lambda x: F.regexp_replace(F.trim(F.regexp_extract(x, r"^[^:]*:(.*)$", 1)), r"^(['\"])(.*)\1$", "$2")
    entries = F.transform(lines, lambda x: F.struct(F.trim(F.regexp_extract(x, r"^([^:]*):", 1)).alias("k"), value(x).alias("v")))
    meta = F.aggregate(entries, F.create_map().cast("map<string,string>"), lambda m, e: F.map_concat(F.map_filter(m, lambda k, _: k != e["k"]), F.create_map(e["k"], e["v"])))
    return docs.select(F.col(id_col).alias("doc_id"), meta.alias("metadata"), F.regexp_replace(text, head, "").alias("body"))


def chunk_docs(docs: DataFrame, size: int = 1800, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Sections under headings of levels 1 to 4 (the whole text without any), in windows of ``size`` characters with a stable id."""
    heading = r"(?m)^#{1,4}[ \t]+(.+?)[ \t]*$"
    text = F.coalesce(text_col, F.lit(""))
    parts = F.split(text, heading)
    titles = F.concat(F.array(F.lit("")), F.regexp_extract_all(text, F.lit(heading), F.lit(1)))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.arrays_zip(titles.alias("title"), parts.alias("part"))).alias("section_no", "s")).select("doc_id", "section_no", F.coalesce("s.title", F.lit("")).alias("title"), F.trim(F.col("s.part"), F.lit(" \t\r\n")).alias("body")).where("body <> ''")
    windows = F.transform(F.sequence(F.lit(0), F.floor((F.length("body") - 1) / size).cast("int")), lambda i: F.substr(F.col("body"), i * size + 1, F.lit(size)))
    cut = rows.select("doc_id", "section_no", "title", F.posexplode(windows).alias("window_no", "chunk"))
    return cut.withColumn("chunk_id", F.sha2(F.concat_ws("\u0000", F.col("doc_id").cast("string"), F.col("section_no").cast("string"), F.col("window_no").cast("string"), "chunk"), 256))


def upsert(table: DataFrame, changes: DataFrame, key: Sequence[str], keep: Sequence[str] = ("created_at",)) -> DataFrame:
    """The table after the changes: changed rows replace old ones but for the ``keep`` columns, new rows are added."""
    old, new = table.withColumn("_old", F.lit(True)).alias("o"), changes.withColumn("_new", F.lit(True)).alias("n")
    cond = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in key]
    rows = old.join(new, cond, "full")
    out = []
    for c in table.columns:
        if c in keep:
            out.append(F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")).alias(c))
        elif c in changes.columns:
            out.append(F.when(F.col("_new"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c))
        else:
            out.append(F.col(f"o.{c}").alias(c))
    return rows.select(*out)


def dedup_evidence(items: DataFrame, fields: Sequence[str], limit: int) -> DataFrame:
    """Items by the hash of their content, the most relevant of equal ones; the first ``limit`` of each log by relevance and
    confidence, on ties by the fields in their order."""
    rows = items.withColumn("evidence_id", F.sha2(F.to_json(F.struct(*fields)), 256))
    one = rows.withColumn("_r", F.row_number().over(Window.partitionBy("log_id", "evidence_id").orderBy(F.desc("relevance"), F.desc("confidence")))).where("_r = 1").drop("_r")
    return one.withColumn("rank", F.row_number().over(Window.partitionBy("log_id").orderBy(F.desc("relevance"), F.desc("confidence"), *[F.asc_nulls_last(f) for f in fields], "evidence_id"))).where(F.col("rank") <= limit)


def attach_strategies(hits: DataFrame, strategies: DataFrame) -> DataFrame:
    """Strategies any of whose applicable patterns is among a log's hits."""
    wide = strategies.select("strategy_id", F.explode("applicable_pattern_ids").alias("pattern_id"))
    return hits.select("log_id", "pattern_id").join(wide, "pattern_id").select("log_id", "strategy_id").distinct()


def guidance_for(hits: DataFrame, blocks: DataFrame) -> DataFrame:
    """``hits(log_id, rule_id, pattern_id)`` and ``blocks(block_id, rule_id, pattern_id, priority, type)``: default blocks, then those of
    the rules, then those of the patterns, each block once."""
    logs = hits.select("log_id").distinct()
    default = blocks.where("rule_id is null and pattern_id is null").select("block_id", "priority", "type")
    base = logs.join(one_row(default, "blocks"), F.lit(True)).select("log_id", F.inline("blocks")).withColumn("tier", F.lit(0))
    by_rule = hits.select("log_id", "rule_id").distinct().join(blocks.where("rule_id is not null"), "rule_id").withColumn("tier", F.lit(1))
    by_pattern = hits.select("log_id", "pattern_id").distinct().join(blocks.where("rule_id is null and pattern_id is not null"), "pattern_id").withColumn("tier", F.lit(2))
    cols = ["log_id", "block_id", "tier", "priority", "type"]
    rows = base.select(cols).unionByName(by_rule.select(cols)).unionByName(by_pattern.select(cols))
    one = rows.withColumn("_r", F.row_number().over(Window.partitionBy("log_id", "block_id").orderBy("tier"))).where("_r = 1").drop("_r")
    return one.withColumn("position", F.row_number().over(Window.partitionBy("log_id").orderBy("tier", "priority", "type", "block_id")))


def apply_feedback(patterns: DataFrame, feedback: DataFrame) -> DataFrame:
    """Adds the feedback's adoptions and rejections, terminal ones only, to each pattern's counts."""
    by = feedback.where("terminal").groupBy("pattern_id").agg(F.count_if("adopted").alias("_a"), F.count_if(~F.col("adopted")).alias("_r"))
    rows = patterns.join(by, "pattern_id", "left")
    return rows.withColumn("adopted_count", F.col("adopted_count") + F.coalesce("_a", F.lit(0))).withColumn("rejected_count", F.col("rejected_count") + F.coalesce("_r", F.lit(0))).drop("_a", "_r")


def decay(patterns: DataFrame, step: float = 0.01) -> DataFrame:
    """Confidence less ``step``, not below 0."""
    return patterns.withColumn("confidence", F.greatest(F.lit(0.0), F.col("confidence") - step))


def gc_patterns(patterns: DataFrame, least: float = 0.2, rejections: int = 5) -> DataFrame:
    """Marks patterns of low confidence or many rejections as deprecated."""
    return patterns.withColumn("deprecated", (F.col("confidence") < least) | (F.col("rejected_count") >= rejections))


def store_stats(tables: dict[str, DataFrame]) -> DataFrame:
    """Row counts of the knowledge tables."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table_name"), "rows")
        out = one if out is None else out.unionByName(one)
    return out
