"""Which of many terms a text contains: one automaton (Aho and Corasick, 1975), one pass over each text."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.plans.runtime import materialize

#: Terms of one automaton; a set within it is sent to all tasks, a larger one is dealt out over several.
SHARD_TERMS = 100_000
#: Characters of texts that meet one automaton in one task.
PACK_CHARS = 32_000_000


def automaton(terms: list[str]):
    """The automaton of ``terms``, or nothing where there is no term with a character."""
    found = ahocorasick.Automaton()
    for t in terms:
        if t:
            found.add_word(t, t)
    if not len(found):
        return None
    found.make_automaton()
    return found


def _hits(texts: list[str | None], machine, empty: bool) -> tuple[list[int], list[str]]:
    """Row and term of each different term of each text; the empty term stands in every text, none in a null one."""
    rows, terms = [], []
    for i, text in enumerate(texts):
        if text is None:
            continue
        seen = {t for _, t in machine.iter(text)} if machine is not None and text else set()
        if empty:
            seen.add("")
        rows += [i] * len(seen)
        terms += sorted(seen)
    return rows, terms


def contained_terms(texts: DataFrame, terms: DataFrame, key: str, text_col: str = "text", term_col: str = "term", shard_terms: int = SHARD_TERMS, pack_chars: int = PACK_CHARS) -> DataFrame:
    """``(key, term)``: for each row of ``texts`` every different one of ``terms`` that its text contains, as they stand.

    The empty term stands in every text, a null term or text in none; rows that repeat a key each give theirs. Texts are not
    shuffled where one automaton of ``shard_terms`` terms holds all. Beyond that terms and texts are dealt out, each automaton to
    packs of about ``pack_chars`` characters of texts, so no number of terms is too large; a text is then read once an automaton.
    """
    kind = texts.schema[key].dataType.simpleString()
    rows = texts.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text_col}`").alias("text"))
    wanted = terms.select(F.col(f"`{term_col}`").alias("term")).where("term is not null").distinct()
    few = [r.term for r in wanted.limit(shard_terms + 1).collect()]
    if len(few) <= shard_terms:
        held = texts.sparkSession.sparkContext.broadcast(few)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            machine, empty = automaton(held.value), "" in held.value
            for batch in batches:
                at, found = _hits(batch.column(1).to_pylist(), machine, empty)
                yield pa.record_batch([batch.column(0).take(pa.array(at, pa.int64())), pa.array(found, pa.string())], names=["key", "term"])

        return rows.mapInArrow(run, f"key {kind}, term string").withColumnRenamed("key", key)
    wanted = materialize(wanted, "terms")
    shards = -(-wanted.count() // shard_terms)
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    packs = max(1, -(-size // pack_chars))
    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(int(n) - 1))).alias(name)
    left = wanted.withColumn("shard", F.pmod(F.xxhash64("term"), F.lit(shards)).cast("int")).select("term", "shard", every(packs, "pack"))
    right = rows.where("text is not null").withColumn("pack", F.pmod(F.xxhash64("text", F.monotonically_increasing_id()), F.lit(packs)).cast("int")).select("key", "text", "pack", every(shards, "shard"))

    def match(own: pa.Table, sent: pa.Table) -> pa.Table:
        names = own["term"].to_pylist()
        at, found = _hits(sent["text"].to_pylist(), automaton(names), "" in names)
        return pa.table([sent["key"].take(pa.array(at, pa.int64())), pa.array(found, pa.string())], names=["key", "term"])

    met = left.groupBy("shard", "pack").cogroup(right.groupBy("shard", "pack"))
    return met.applyInArrow(match, f"key {kind}, term string").withColumnRenamed("key", key)
