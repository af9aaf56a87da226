"""Quality classification by an interpolated modified Kneser-Ney model of characters.

The model is trained on trusted texts; a text's perplexity under it is held against a quantile of trusted texts' perplexities in
its own language. Counts, continuation counts, discounts and context weights are aggregations and joins over the n-gram
tables. The n-grams of the documents meet the model's tables in joins sharded by n-gram, once for each different one, and go
back to the documents in chunks; no table of the model, of whatever size, is held whole in one place.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm.pieces import by_chars
from faultline.plans.runtime import materialize

#: Characters in an n-gram, and bits of a symbol, so that an n-gram is one long.
ORDER, BITS = 4, 15
#: Symbols: 0 stands before a text, 1 for every character that trusted texts do not hold (or beyond what BITS can number).
START, OTHER = 0, 1
#: Characters of text in a chunk of documents.
CHUNK_CHARS = 16_000_000
#: Text that is looked at at once: bytes, and bytes of it compressed.
PIECE_BYTES, PACKED_BYTES = 1_000_000, 400_000


class Symbols:
    """Characters to symbols, by a table over all code points."""

    def __init__(self, points: list[int]):
        self.count, self.table = len(points) + 2, np.full(0x110000, OTHER, np.uint16)
        self.table[np.array(points, np.int64)] = np.arange(2, 2 + len(points))

    def grams(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The n-gram ending at each character of each text, as one number, and the texts' lengths."""
        lengths, lead = np.array([len(t) for t in texts], np.int64), ORDER - 1
        flat = np.frombuffer("".join("\0" * lead + t for t in texts).encode("utf-32-le"), np.uint32)
        code = self.table[flat].astype(np.int64)
        starts = (np.cumsum(lengths + lead) - (lengths + lead))[:, None] + np.arange(lead)
        code[starts] = START
        grams = np.zeros(max(len(code) - lead, 0), np.int64)
        for i in range(ORDER):
            grams = grams << BITS | code[i : len(code) - lead + i]
        keep = np.ones(len(code), bool)
        keep[starts] = False
        return grams[keep[lead:]], lengths


def _suffix(gram: Column, k: int) -> Column:
    return gram.bitwiseAND(F.lit((1 << BITS * k) - 1).cast("long"))


def _context(gram: Column) -> Column:
    return F.shiftright(gram, BITS)


def _count(texts: DataFrame, of, kind: str) -> DataFrame:
    """Counts of the numbers that ``of`` makes of a list of texts, summed within tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_chars(batch, 0, PIECE_BYTES):
                keys, n = np.unique(of([t or "" for t in part.column(0).to_pylist()]), return_counts=True)
                yield pa.record_batch([pa.array(keys.astype(np.int64)), pa.array(n.astype(np.int64))], names=[kind, "n"])

    return texts.select("text").mapInArrow(run, f"{kind} long, n long").groupBy(kind).agg(F.sum("n").alias("n"))


def _discounts(counts: DataFrame) -> list[float]:
    """Modified Kneser-Ney discounts for counts of 1, 2, and 3 or more, from counts of counts."""
    n = [0.0, *(counts.agg(*[F.count_if(F.col("n") == i).alias(f"n{i}") for i in (1, 2, 3, 4)]).first() or (0,) * 4)]
    if not n[1] or not n[2]:
        return [0.5, 0.75, 0.9]
    y = n[1] / (n[1] + 2 * n[2])
    return [min(max(i - (i + 1) * y * n[i + 1] / n[i] if n[i] else 0.5 * i, 0.05), 0.95 * i) for i in (1, 2, 3)]


class Model:
    """Tables by order k: ``grams[k](gram, p)``, the interpolated probabilities of n-grams seen, and ``contexts[k](context, g)``, the
    weight that a context leaves to the order below; order 1 holds every symbol."""

    def __init__(self, points: list[int], grams: dict[int, DataFrame], contexts: dict[int, DataFrame]):
        self.points, self.grams, self.contexts = points, grams, contexts

    def resolve(self, grams: DataFrame) -> DataFrame:
        """``(gram, p)`` for the different n-grams of a table, each by joins with the model's tables from the lowest order up."""
        found = self.grams[1]
        for k in range(2, ORDER + 1):
            wanted = grams.select(_suffix(F.col("gram"), k).alias("gram")).distinct().select("gram", _context(F.col("gram")).alias("context"), _suffix(F.col("gram"), k - 1).alias("lower"))
            full = wanted.join(found.select(F.col("gram").alias("lower"), F.col("p").alias("below")), "lower").join(self.contexts[k], "context", "left").join(self.grams[k], "gram", "left")
            found = full.select("gram", F.coalesce("p", F.coalesce("g", F.lit(1.0)) * F.col("below")).alias("p"))
        return found


def fit(texts: DataFrame) -> Model:
    """The model of a table of trusted texts."""
    by_point = _count(texts, lambda texts: np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32), "point")
    points = [r.point for r in by_point.orderBy(F.desc("n"), "point").limit((1 << BITS) - 2).collect()]
    counts = {ORDER: materialize(_count(texts, lambda texts: Symbols(points).grams(texts)[0], "gram"), f"grams-{ORDER}")}
    for k in range(ORDER - 1, 0, -1):
        # continuation counts: how many different symbols stand before
        counts[k] = materialize(counts[k + 1].groupBy(_suffix(F.col("gram"), k).alias("gram")).agg(F.count("*").alias("n")), f"grams-{k}")
    # of order 1 every symbol keeps a share, seen or not; START is never predicted
    symbols = len(points) + 1
    total = counts[1].agg(F.sum("n")).first()[0] or 0
    every = texts.sparkSession.range(1, symbols + 1).select(F.col("id").alias("gram"))
    share = (F.coalesce("n", F.lit(0)) + 0.5) / F.lit(total + 0.5 * symbols)
    grams, contexts = {1: materialize(every.join(counts[1], "gram", "left").select("gram", share.alias("p")), "probabilities-1")}, {}
    for k in range(2, ORDER + 1):
        d = _discounts(counts[k])
        off = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
        rows = counts[k].select("gram", "n", off.alias("off"), _context(F.col("gram")).alias("context"), _suffix(F.col("gram"), k - 1).alias("lower"))
        of = materialize(rows.groupBy("context").agg(F.sum("n").alias("total"), (F.sum("off") / F.sum("n")).alias("g")), f"contexts-{k}")
        full = rows.join(of, "context").join(grams[k - 1].select(F.col("gram").alias("lower"), F.col("p").alias("below")), "lower")
        grams[k] = materialize(full.select("gram", ((F.col("n") - F.col("off")) / F.col("total") + F.col("g") * F.col("below")).alias("p")), f"probabilities-{k}")
        contexts[k] = of.select("context", "g")
    return Model(points, grams, contexts)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column, texts (null as empty), compressed."""
    import zstandard

    compress = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        for part in by_chars(batch, batch.num_columns - 1):
            packed = pa.array([compress((t or "").encode()) for t in part.column(part.num_columns - 1).to_pylist()], pa.binary())
            yield pa.record_batch([*part.columns[:-1], packed], names=[*part.schema.names[:-1], "packed"])


def _unpack(column: pa.Array) -> list[str]:
    import zstandard

    expand = zstandard.ZstdDecompressor().decompress
    return [expand(x).decode() for x in column.to_pylist()]


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column, compressed texts, as texts."""
    for batch in batches:
        for part in by_chars(batch, batch.num_columns - 1, PACKED_BYTES):
            yield pa.record_batch([*part.columns[:-1], pa.array(_unpack(part.column(part.num_columns - 1)), pa.string())], names=[*part.schema.names[:-1], "text"])


def trusted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``(good_id, lang, text)`` of all documents labelled of good quality and not toxic.

    Their ids are as many as the labels and are not broadcast; texts go to them compressed.
    """
    good = labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select(F.col("doc_id").alias("good_id")).distinct()
    rows = docs.select(F.col(id_col).alias("good_id"), F.col(lang_col).alias("lang"), F.col(text_col).cast("string").alias("text")).where(F.col("text").isNotNull())
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:2])
    packed = rows.mapInArrow(_pack, f"{kinds}, packed binary")
    return packed.join(good.hint("shuffle_hash"), "good_id", "left_semi").select("good_id", "lang", "packed").mapInArrow(_expand, f"{kinds}, text string")


def perplexities(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``(doc_id, th, lang, n_symbols, log10_p)``, one row per row of ``docs``, th being the text's hash; 0 and 0.0 for null and
    empty texts.

    The different n-grams of all documents are resolved by joins. Documents are dealt over chunks of about CHUNK_CHARS by
    hash; each chunk's different n-grams fetch their probabilities by a join and meet the chunk's documents again.
    """
    points = model.points
    source = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("th"), F.col(lang_col).alias("lang"), F.col(text_col).cast("string").alias("text"))
    size = source.agg(F.sum(F.length("text")).alias("n")).first()
    different = _count(source, lambda texts: Symbols(points).grams(texts)[0], "gram").select("gram")
    known = materialize(model.resolve(materialize(different, "document-grams")).select("gram", F.log10("p").alias("lp")), "resolved")
    chunks = max(1, -(-(size.n or 0) // CHUNK_CHARS))
    kinds = {f.name: f.dataType.simpleString() for f in source.schema.fields}
    # texts travel compressed, dealt once and read twice: both readers take all columns, so that they share one exchange
    chunk = F.pmod(F.xxhash64("doc_id", "th"), F.lit(chunks)).alias("chunk")
    packed = source.select("doc_id", "th", "lang", chunk, "text").mapInArrow(_pack, f"doc_id {kinds['doc_id']}, th long, lang {kinds['lang']}, chunk long, packed binary")
    dealt = packed.repartition("chunk")

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols, held = Symbols(points), {}
        for batch in batches:
            of = batch.column(3).to_numpy()
            for chunk in np.unique(of).tolist():
                for part in by_chars(batch.filter(pa.array(of == chunk)), 4, PACKED_BYTES):
                    new = np.unique(symbols.grams(_unpack(part.column(4)))[0])
                    held[chunk] = np.union1d(held[chunk], new) if chunk in held else new
        for chunk, grams in held.items():
            yield pa.record_batch([pa.array(np.full(len(grams), chunk, np.int64)), pa.array(grams)], names=["of_chunk", "gram"])

    values = dealt.mapInArrow(distinct, "of_chunk long, gram long").join(known, "gram")

    def score(rows: pa.Table, values: pa.Table) -> pa.Table:
        symbols = Symbols(points)
        order = np.argsort(values["gram"].to_numpy())
        grams, lp = values["gram"].to_numpy()[order], values["lp"].to_numpy()[order]
        lengths, sums = [], []
        for batch in rows.select(["packed"]).combine_chunks().to_batches():
            for part in by_chars(batch, 0, PACKED_BYTES):
                own, n = symbols.grams(_unpack(part.column(0)))
                total, some = np.zeros(len(n)), n > 0
                if some.any():
                    total[some] = np.add.reduceat(lp[np.searchsorted(grams, own)], (np.cumsum(n) - n)[some])
                lengths.append(n)
                sums.append(total)
        columns = [pa.array(np.concatenate(x) if x else np.zeros(0, t)) for x, t in ((lengths, np.int64), (sums, np.float64))]
        return pa.table([rows["doc_id"], rows["th"], rows["lang"], *columns], names=["doc_id", "th", "lang", "n_symbols", "log10_p"])

    return dealt.groupBy("chunk").cogroup(values.select("of_chunk", "gram", "lp").groupBy("of_chunk")).applyInArrow(score, f"doc_id {kinds['doc_id']}, th long, lang {kinds['lang']}, n_symbols long, log10_p double")


class Thresholds:
    """Per language: the mean and the upper quantile of the trusted texts' log10 perplexity."""

    def __init__(self, by_lang: dict[str | None, float], slack: float, noise: float):
        self.by_lang, self.slack, self.noise = by_lang, slack, noise

    def limit(self, lang: Column, n: Column) -> Column:
        """The highest log10 perplexity that a text of ``n`` symbols may have; short texts get more room."""
        overall = self.by_lang.get(None)
        named = [x for k, v in self.by_lang.items() if k is not None for x in (F.lit(k), F.lit(v))]
        of = F.coalesce(F.element_at(F.create_map(*named), lang), F.lit(overall)) if named else F.lit(overall)
        return of + self.slack + self.noise / F.sqrt(n.cast("double"))


def thresholds(scored: DataFrame, quantile: float = 0.99, slack: float = 0.05, noise: float = 1.0, least: int = 200) -> Thresholds:
    """From trusted texts with ``lang``, ``n_symbols`` and ``log10_p``: a quantile for each language, and over all.

    Texts under ``least`` symbols say little and take no part; ``limit`` gives short texts ``noise`` / sqrt(n) more.
    """
    ppl = F.when(F.col("n_symbols") >= least, -F.col("log10_p") / F.col("n_symbols"))
    cut = F.percentile_approx(ppl, F.lit(quantile), F.lit(10_000))
    by_lang: dict[str | None, float] = {r.lang: r.q for r in scored.where("lang is not null").groupBy("lang").agg(cut.alias("q")).collect() if r.q is not None}
    overall = scored.agg(cut.alias("q")).first().q
    by_lang[None] = overall if overall is not None else float("inf")
    return Thresholds(by_lang, slack, noise)


def judge(docs: DataFrame, labels: DataFrame, quantile: float = 0.99, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``(doc_id, th, lang, n_symbols, log10_p, kn_limit, kn_kept)``, one row per row of ``docs``; th is the text's hash.

    Every trusted document is used: the model is trained on three of four, and the limits are the quantiles of the fourth ones,
    which the model has not seen. ``kn_kept`` holds where the text's log10 perplexity is at most its language's limit. Null and empty
    texts have no perplexity and are not kept. A language that no such text has, or a null one, uses the limit over all. Without
    any trusted text nothing is known to be bad, and every text with a character is kept. Whole texts of any length are
    scored; ties at the limit are kept; repeated rows are scored each; other columns are not read. An empty table gives an
    empty table.
    """
    good = materialize(trusted(docs, labels, id_col, text_col, lang_col), "trusted")
    held_out = F.pmod(F.xxhash64(F.lit(7), "good_id"), F.lit(4)) == 0
    scored = materialize(perplexities(docs, fit(good.where(~held_out)), id_col, text_col, lang_col), "perplexities")
    # too few trusted documents to part: all of them set the limits
    asks = good.where(held_out).select("good_id").distinct()
    if asks.count() < 20:
        asks = good.select("good_id").distinct()
    limits = thresholds(scored.join(asks, F.col("doc_id") == F.col("good_id"), "left_semi"), quantile)
    n = F.col("n_symbols")
    limit = F.when(n > 0, limits.limit(F.col("lang"), n))
    return scored.withColumn("kn_limit", limit).withColumn("kn_kept", F.coalesce(-F.col("log10_p") / F.when(n > 0, n) <= F.col("kn_limit"), F.lit(False)))


def classify(docs: DataFrame, labels: DataFrame, quantile: float = 0.99, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` with ``n_symbols``, ``log10_p``, ``kn_limit`` and ``kn_kept`` of :func:`judge` added, one row per row.

    Columns of these names are replaced, all others pass.
    """
    added = ["n_symbols", "log10_p", "kn_limit", "kn_kept"]
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in added])
    judged = judge(docs, labels, quantile, id_col, text_col, lang_col)
    name = lambda c: c if c not in docs.columns else name(f"{c}_")
    own = {c: name(f"kn_{c}") for c in ("doc_id", "th", "lang")}
    # equal keys have equal verdicts
    judged = judged.dropDuplicates(["doc_id", "th", "lang"]).select(*[F.col(c).alias(x) for c, x in own.items()], *added)
    same = F.col(id_col).eqNullSafe(F.col(own["doc_id"])) & (F.xxhash64(text_col) == F.col(own["th"])) & F.col(lang_col).eqNullSafe(F.col(own["lang"]))
    return docs.join(judged, same).select(*[F.col(f"`{c}`") for c in docs.columns], *added)
