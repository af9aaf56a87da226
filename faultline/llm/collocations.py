"""Phrase collocations by vertical partitioning of the suffixes of a corpus, after ERA (Mansour et al., 2011).

Every word starts a suffix, of which the first few words count. Prefixes are given to groups so that a group's suffixes fit a
memory budget: a prefix that alone has more is taken a word longer, small ones share a group. Each group builds its part of the
suffix tree, cut at that depth, on its own; a phrase's frequency is the sum of the leaves below its node.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm.pieces import by_chars
from faultline.plans.runtime import materialize

#: Suffixes are counted in pieces of text of so many bytes before they are shuffled.
PIECE = 8_000_000
#: Slots that prefixes are hashed to; small ones share a group, large ones are split over several.
SLOTS = 1 << 12
#: What parts pieces becomes a comma, A-Z become a-z, tabs spaces; spaces part words.
PLAIN = bytes(44 if c in b".,;:!?" or 10 <= c <= 13 else c + 32 if 65 <= c <= 90 else 32 if c == 9 else c for c in range(256))
ODD = np.uint64(0x9E3779B97F4A7C15)


def sorted_rows(columns: list[np.ndarray], base: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The order of rows by all ``columns`` (numbers under ``base``), and where in it, for each first columns, a new prefix begins."""
    key, size = columns[0].astype(np.int64), base
    for c in columns[1:]:
        if size > 2**62 // base:
            seen, key = np.unique(key, return_inverse=True)
            size = len(seen)
        key, size = key * base + c, size * base
    order = np.argsort(key, kind="stable")
    new, starts = np.zeros(len(order), bool), []
    if len(order):
        new[0] = True
    for c in columns:
        own = c[order]
        new[1:] |= own[1:] != own[:-1]
        starts.append(np.flatnonzero(new))
    return order, starts


class Piece:
    """The different suffixes of a piece of text: ``words`` and, in order, ``columns`` of their numbers from 1, 0 beyond the end."""

    def __init__(self, lang: str, texts: list[bytes], depth: int):
        plain = b",".join(texts).translate(PLAIN).replace(b",", b" , ")
        coded = pc.split_pattern(pa.array([plain], pa.large_binary()), pattern=b" ").flatten().dictionary_encode()
        ids, self.words, self.lang = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist(), lang
        number = {w: i for i, w in enumerate(self.words) if w in (b"", b",")}
        comma = number.get(b",", len(self.words))
        ids = np.append(ids[ids != number.get(b"", -1)], np.full(depth, comma, ids.dtype)).astype(np.int64)
        starts = np.flatnonzero(ids[: len(ids) - depth + 1] != comma)
        alive, columns = np.ones(len(starts), bool), []
        for i in range(depth):
            own = ids[starts + i]
            alive = alive & (own != comma)
            columns.append(np.where(alive, own + 1, 0))
        order, at = sorted_rows(columns, len(self.words) + 2)
        first = at[-1]
        self.columns = [c[order][first] for c in columns]
        self.counts = np.diff(np.append(first, len(order)))
        self.hashes = np.append(np.uint64(0), pd.util.hash_array(np.array(self.words, object), categorize=False)) ^ pd.util.hash_array(np.array([lang], object), categorize=False)[0]

    def prefixes(self, depth: int, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the suffixes ``rows`` (in order) the places of their different prefixes, and of each its suffixes and occurrences."""
        changed = np.zeros(len(rows), bool)
        changed[:1] = True
        for c in self.columns[:depth]:
            changed[1:] |= c[rows][1:] != c[rows][:-1]
        first = np.flatnonzero(changed)
        if not len(first):
            return first, first, first
        return rows[first], np.diff(np.append(first, len(rows))), np.add.reduceat(self.counts[rows], first)

    def hashed(self, depth: int, rows: np.ndarray) -> np.ndarray:
        h = np.zeros(len(rows), np.uint64)
        for c in self.columns[:depth]:
            h = (h ^ self.hashes[c[rows]]) * ODD
            h ^= h >> np.uint64(29)
        return h

    def listed(self, prefixes: list[tuple]) -> np.ndarray:
        """Which suffixes begin with one of ``prefixes`` (language and words)."""
        number = {w: i for i, w in enumerate(self.words, 1)}
        own = [[number.get(w.encode(), -1) for w in p[1:]] for p in prefixes if p[0] == self.lang]
        own = np.array([x for x in own if min(x) > 0], np.int64).reshape(-1, len(prefixes[0]) - 1 if prefixes else 1)
        if not len(own):
            return np.zeros(len(self.counts), bool)
        base = len(self.words) + 2
        both = [np.concatenate([c, own[:, i]]) for i, c in enumerate(self.columns[: own.shape[1]])]
        order, at = sorted_rows(both, base)
        group = np.zeros(len(order), np.int64)
        group[order[at[-1]]] = 1
        group = np.cumsum(group[order])
        of = np.empty(len(order), np.int64)
        of[order] = group
        return np.isin(of[: len(self.counts)], of[len(self.counts) :])

    def depths(self, hot: list[list[tuple]]) -> np.ndarray:
        """How many words the prefix has that decides on each suffix's group; 0 where the suffix ends before that."""
        depth = np.ones(len(self.counts), np.int32)
        for d, prefixes in enumerate(hot, 1):
            if prefixes:
                depth[(depth == d) & self.listed(prefixes)] = d + 1
        for d in range(2, len(self.columns) + 1):
            depth[(depth == d) & (self.columns[d - 1] == 0)] = 0
        return depth


def _over_pieces(docs: DataFrame, depth: int, lang_col: str, text_col: str, made: Callable[[Piece], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_chars(batch, 1, PIECE):
                held: dict[str, list[bytes]] = {}
                for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    if text:
                        held.setdefault(lang, []).append(text.encode())
                for lang, texts in held.items():
                    yield from made(Piece(lang, texts, depth))

    rows = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(run, schema)


def packed(loads: dict[int, int], budget: int) -> np.ndarray:
    """For each slot its first group and how many it has: neighbouring small slots share one of ``budget`` suffixes, a slot with more
    is split."""
    out, group, held = np.ones((SLOTS, 2), np.int64), 0, 0
    for slot in range(SLOTS):
        n = loads.get(slot, 0)
        parts = max(1, -(-2 * n // budget)) if n > budget else 1
        if held and held + n > budget:
            group, held = group + 1, 0
        out[slot] = group, parts
        held += n
        if parts > 1:
            group, held = group + parts, 0
    return out


def subtree(words: int, least: int):
    """Builds the subtree of a group's suffixes and reads its nodes: sorted suffixes, nodes where a prefix changes, leaf totals."""

    def build(rows: pa.Table) -> pa.Table:
        unpack = zstandard.ZstdDecompressor()
        names, parts, langs = [b""], [], sorted(set(rows["lang"].to_pylist()))
        for lang, depth, text, codes, n in zip(*(rows[c].to_pylist() for c in ("lang", "depth", "words", "codes", "n")), strict=True):
            own = unpack.decompress(text).split(b"\n")
            values = np.frombuffer(unpack.decompress(codes), "<u4").reshape(words + 1, n).astype(np.int64)
            # words are numbered from 1 in each piece; 0 stays 0
            values[:words] += np.where(values[:words] > 0, len(names) - 1, 0)
            names += own
            parts.append(np.vstack([np.full(n, langs.index(lang)), values, np.full(n, depth)]))
        coded = pa.array(names, pa.binary()).dictionary_encode()
        number = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        table = np.hstack(parts)
        table[1 : words + 1] = number[table[1 : words + 1]]
        order, starts = sorted_rows(list(table[: words + 1]), max(len(coded.dictionary), len(langs)) + 1)
        table = table[:, order]
        out: list[list] = [[], [], [], []]
        spelled = coded.dictionary.cast(pa.string())
        for d in range(1, words + 1):
            node = starts[d]
            f = np.add.reduceat(table[words + 1], node)
            # suffixes that end before this depth, and prefixes that other groups share, are no nodes here
            keep = (table[d, node] > 0) & (table[words + 2, node] <= d) & (f >= least)
            at = node[keep]
            out[0].append(pa.array([langs[i] for i in table[0, at]], pa.string()))
            columns = [spelled.take(pa.array(table[i, at])) for i in range(1, d + 1)]
            out[1].append(pc.binary_join_element_wise(*columns, " ") if len(at) else pa.array([], pa.string()))
            out[2].append(pa.array(np.full(len(at), d, np.int32)))
            out[3].append(pa.array(f[keep]))
        return pa.table([pa.concat_arrays(c) for c in out], names=["lang", "phrase", "k", "f"])

    return build


def frequencies(docs: DataFrame, words: int = 3, least: int = 10, budget: int = 1 << 19, lang_col: str = "lang", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """``(lang, phrase, k, f)`` of all phrases of up to ``words`` words that occur ``least`` times, and ``(lang, n)``.

    ``budget`` is the number of suffixes of a group, each counted once a piece of text. Prefixes of one word with more are taken a
    word longer, and so on; at full length they are single leaves. Prefixes are hashed to SLOTS slots, whose loads are counted
    first; only in slots beyond the budget is each prefix counted. A group may pass the budget by what hashing deals it. The
    texts are read twice for each length of prefix that is needed and once to send the suffixes, which leave a piece as one
    compressed row a group.
    """
    spark = docs.sparkSession
    nodes, loads, hot, n = [], {}, [], None
    for d in range(1, words):
        if d > 1 and not hot[-1]:
            break
        known = list(hot)

        def loaded(piece: Piece, d: int = d, known: list = known) -> Iterator[pa.RecordBatch]:
            rows = np.flatnonzero(piece.depths(known) == d)
            slot = (piece.hashed(d, rows) % np.uint64(SLOTS)).astype(np.int64)
            count, f = np.bincount(slot, minlength=SLOTS), np.bincount(slot, piece.counts[rows], minlength=SLOTS)
            at = np.flatnonzero(count)
            if len(at):
                yield pa.record_batch([pa.array([piece.lang] * len(at), pa.string()), pa.array(at), pa.array(count[at]), pa.array(f[at].astype(np.int64))], names=["lang", "slot", "rows", "f"])

        shares = materialize(_over_pieces(docs, words, lang_col, text_col, loaded, "lang string, slot long, rows long, f long").groupBy("lang", "slot").agg(F.sum("rows").alias("rows"), F.sum("f").alias("f")), "loads")
        if n is None:
            n = materialize(shares.groupBy("lang").agg(F.sum("f").alias("n")), "totals")
        own_loads = {r.slot: r.rows for r in shares.groupBy("slot").agg(F.sum("rows").alias("rows")).collect()}
        full = np.array(sorted(s for s, k in own_loads.items() if k > budget), np.int64)

        def counted(piece: Piece, d: int = d, known: list = known, full: np.ndarray = full) -> Iterator[pa.RecordBatch]:
            rows = np.flatnonzero(piece.depths(known) == d)
            rows = rows[np.isin(piece.hashed(d, rows) % np.uint64(SLOTS), full.astype(np.uint64))]
            at, suffixes, f = piece.prefixes(d, rows)
            names = pa.array([b"", *piece.words], pa.binary())
            if len(at):
                columns = [names.take(pa.array(c[at])).cast(pa.string()) for c in piece.columns[:d]]
                slot = (piece.hashed(d, at) % np.uint64(SLOTS)).astype(np.int64)
                yield pa.record_batch([pa.array([piece.lang] * len(at), pa.string()), *columns, pa.array(slot), pa.array(suffixes), pa.array(f)], names=["lang", *(f"w{i}" for i in range(1, d + 1)), "slot", "rows", "f"])

        hot.append([])
        if len(full):
            own = ["lang", *(f"w{i}" for i in range(1, d + 1))]
            seen = _over_pieces(docs, words, lang_col, text_col, counted, ", ".join([f"{c} string" for c in own]) + ", slot long, rows long, f long")
            # few: each has more than a budget of suffixes
            large = materialize(seen.groupBy(*own, "slot").agg(F.sum("rows").alias("rows"), F.sum("f").alias("f")).where(F.col("rows") > budget), "hot-prefixes")
            found = large.collect()
            hot[-1] = [tuple(r[c] for c in own) for r in found]
            for r in found:
                own_loads[r.slot] -= r.rows
            nodes.append(large.where(F.col("f") >= least).select("lang", F.concat_ws(" ", *own[1:]).alias("phrase"), F.lit(d).alias("k"), "f"))
            if d == words - 1:
                # leaves of full length are dealt evenly by their hashes
                for s in range(SLOTS):
                    own_loads[s] = own_loads.get(s, 0) + sum(r.rows for r in found) // SLOTS
        for s, k in own_loads.items():
            loads[s] = loads.get(s, 0) + k
    held = spark.sparkContext.broadcast((packed(loads, budget), hot))

    def sent(piece: Piece) -> Iterator[pa.RecordBatch]:
        groups, hot = held.value
        depth, group = piece.depths(hot), np.full(len(piece.counts), -1, np.int64)
        for d in range(1, words + 1):
            rows = np.flatnonzero(depth == d)
            if len(rows):
                h = piece.hashed(d, rows)
                first, parts = groups[(h % np.uint64(SLOTS)).astype(np.int64)].T
                group[rows] = (first + ((h >> np.uint64(20)) % parts.astype(np.uint64)).astype(np.int64)) * (words + 1) + d
        order = np.argsort(group, kind="stable")
        order = order[group[order] >= 0]
        cuts = np.append(np.flatnonzero(np.append(True, np.diff(group[order]) != 0)) if len(order) else [], len(order)).astype(np.int64)
        pack = zstandard.ZstdCompressor(level=3)
        out: list[list] = [[], [], [], [], [], []]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            rows = order[a:b]
            codes = np.stack([c[rows] for c in piece.columns])
            used = np.unique(codes)
            used = used[used > 0]
            codes = np.where(codes > 0, np.searchsorted(used, codes) + 1, 0)
            g = int(group[rows[0]])
            values = (g // (words + 1), piece.lang, g % (words + 1), pack.compress(b"\n".join([piece.words[i - 1] for i in used])), pack.compress(np.vstack([codes, piece.counts[rows]]).astype("<u4").tobytes()), b - a)
            for column, v in zip(out, values, strict=True):
                column.append(v)
        if out[0]:
            kinds = (pa.int32(), pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.int32())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["group", "lang", "depth", "words", "codes", "n"])

    rows = _over_pieces(docs, words, lang_col, text_col, sent, "group int, lang string, depth int, words binary, codes binary, n int")
    nodes.append(rows.groupBy("group").applyInArrow(subtree(words, least), "lang string, phrase string, k int, f long"))
    return materialize(reduce(DataFrame.unionAll, nodes), "phrases"), n


def _words(phrase: Column, first: int, count: int) -> Column:
    """``count`` words of a phrase from the one numbered ``first`` (from 1) on."""
    return F.array_join(F.slice(F.split(phrase, " "), first, count), " ")


def collocations(docs: DataFrame, words: int = 3, least: int = 10, top: int = 2000, share: int = 50, budget: int = 1 << 19, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """Each language's first ``top`` phrases by score: ``(lang, rank, phrase, a, l, r, n, score)``.

    ASCII capitals become small, ``[.,;:!?\\x0A-\\x0D]`` part pieces, spaces and tabs part words. a, l and r are the frequencies of
    a phrase of two to ``words`` words, of the part before a cut and of the part after it; the cut with the lowest
    floor(1000000 a a / (l r)) counts, the first of equals. Phrases that lie inside a longer one which is found in ``share``
    hundredths of their occurrences or more are left out. Equal scores go by a, then by the phrase's bytes. A null language is
    ``und`` and falls together with a language of that name; null, empty and wordless texts have no word; rows that repeat each
    count; texts of any length are read whole; an empty table gives an empty table. Other columns are not looked at.
    """
    nodes, n = frequencies(docs, words, least, budget, lang_col, text_col)
    phrases = nodes.where("k >= 2").withColumnRenamed("f", "a")
    cuts = phrases.select("lang", "phrase", "k", "a", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("*", _words(F.col("phrase"), F.lit(1), F.col("cut")).alias("left"), _words(F.col("phrase"), F.col("cut") + 1, F.col("k") - F.col("cut")).alias("right"))
    side = lambda part, f: nodes.select("lang", F.col("phrase").alias(part), F.col("f").alias(f))
    big = lambda c: f"cast({c} as decimal(19,0))"
    scored = cuts.join(side("left", "l"), ["lang", "left"]).join(side("right", "r"), ["lang", "right"])
    score = F.expr(f"(cast(1000000 as decimal(7,0)) * cast({big('a')} * {big('a')} as decimal(30,0))) div ({big('l')} * {big('r')})")
    best = scored.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("b"))
    longer = phrases.where("k >= 3").select("lang", "a", "phrase", F.explode(F.sequence(F.lit(2), F.col("k") - 1)).alias("size"), "k").select("lang", "a", "phrase", "size", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("size") + 1)).alias("at"))
    longer = longer.select("lang", _words(F.col("phrase"), F.col("at"), F.col("size")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longest"))
    kept = best.join(longer, ["lang", "phrase"], "left").where(F.col("longest").isNull() | (100 * F.col("longest") < share * F.col("a"))).select("lang", "phrase", "a", "b.l", "b.r", "b.score")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    # a language may hold a third of all phrases: its best are chosen in parts first
    part = F.row_number().over(Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*order))
    some = kept.withColumn("part", part).where(F.col("part") <= top).drop("part")
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
