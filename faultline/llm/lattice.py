"""Language-model scores from a subword lattice.

Every word is the sum over all its segmentations into pieces of an existing vocabulary, by a forward recursion in log space.
The pieces weigh what the vocabulary's own scores say. A whole-word arc, weighted by the word's training count, joins the
lattice, so frequent words cost what they should.

The work is done once for each distinct word of the corpus, not for each occurrence: a table of distinct words carries
counts and scores; its most frequent words, a fixed number, are looked up from a broadcast and the others by a join.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm.pieces import MARK, by_chars
from faultline.plans.runtime import materialize

#: Words looked up from a broadcast (about 40 bytes each); all others are joined.
FREQUENT = 1 << 17
#: Distinct words that a task counts before it passes them on.
FLUSH = 200_000
PRIME = np.uint64(0x9E3779B97F4A7C15)
ADD = 0.1


def words_of(text: str | None) -> list[bytes]:
    """Words of a text with A-Z in lower case, as UTF-8. bytes.lower and bytes.split know ASCII only, as asked."""
    return (text or "").encode().lower().split()


class Lattice:
    """Pieces by the hash of their bytes, with natural-log weights; a leading space marks the start of a word."""

    def __init__(self, pieces: list[bytes], log_p: np.ndarray):
        self.pieces, self.log_p = pieces, np.asarray(log_p, np.float64)
        keys = np.array([self._key(p) for p in pieces], np.uint64)
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        self.longest = max(map(len, pieces))

    @staticmethod
    def _key(piece: bytes) -> int:
        h = 0
        for b in piece:
            h = (h * int(PRIME) + b + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    def arcs(self, x: np.ndarray) -> dict[int, np.ndarray]:
        """For words of one length, rows of bytes: length of piece to piece numbers by start, -1 where there is none."""
        n, h, out = x.shape[1], np.zeros(x.shape, np.uint64), {}
        up = x.astype(np.uint64) + np.uint64(1)
        for size in range(1, min(n, self.longest) + 1):
            h = h[:, : n - size + 1] * PRIME + up[:, size - 1 :]
            at = np.searchsorted(self.keys, h)
            at[at == len(self.keys)] = 0
            hit = self.keys[at] == h
            if hit.any():
                out[size] = np.where(hit, self.order[at], -1)
        return out

    def forward(self, x: np.ndarray, arcs: dict[int, np.ndarray]) -> np.ndarray:
        """Log probability of every prefix: column j sums all segmentations of the first j bytes."""
        n = x.shape[1]
        weight = {size: np.where(a >= 0, self.log_p[a], -np.inf) for size, a in arcs.items()}
        alpha = np.full((len(x), n + 1), -np.inf)
        alpha[:, 0] = 0
        for j in range(1, n + 1):
            terms = np.stack([alpha[:, j - size] + w[:, j - size] for size, w in weight.items() if size <= j], 1)
            top = terms.max(1)
            alpha[:, j] = top + np.log(np.exp(terms - top[:, None]).sum(1))
        return alpha

    @staticmethod
    def groups(words: list[bytes], most: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Words (each with its leading space) of equal length, as places in ``words`` and a matrix of bytes."""
        sizes = np.array([len(w) + 1 for w in words], np.int64)
        for n in np.unique(sizes):
            places = np.flatnonzero(sizes == n)
            step = max(1, most // int(n))
            for i in range(0, len(places), step):
                part = places[i : i + step]
                yield part, np.frombuffer(b"".join(b" " + words[k] for k in part), np.uint8).reshape(len(part), n)

    def log_probs(self, words: list[bytes]) -> np.ndarray:
        """Natural log of each word's marginal probability."""
        out = np.zeros(len(words))
        for places, x in self.groups(words):
            out[places] = self.forward(x, self.arcs(x))[:, -1]
        return out


def existing_vocabulary(model_path: str) -> Lattice:
    """The pieces of a sentencepiece model that lower-case words can use, weighted by its scores.

    A score that is a rank (a merge list's, 0, -1, -2, ...) is read as Zipf's law has it; other scores are log weights.
    Bytes are pieces too, so every word has a segmentation.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
    weights: dict[bytes, float] = {bytes([b]): 1e-9 for b in range(256)}
    scores = {i: sp.get_score(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
    ranks = min(scores.values(), default=0) < -200
    for i, score in scores.items():
        piece = sp.id_to_piece(i).encode().replace(MARK, b" ")
        if piece == piece.lower() and b" " not in piece[1:]:
            weights[piece] = weights.get(piece, 0) + (1 / (2.7 - score) if ranks else math.exp(score))
    total = sum(weights.values())
    return Lattice(list(weights), np.log(np.array(list(weights.values())) / total))


def count_words(docs: DataFrame, training: Column, text_col: str = "text") -> DataFrame:
    """``(word, n, n_train)`` for every distinct word of ``docs``, and for the end of text, whose word is empty."""
    source = docs.select(F.col(text_col).cast("string").alias("text"), training.alias("train"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: tuple[Counter, Counter] = (Counter(), Counter())

        def flush() -> pa.RecordBatch:
            every = list(found[0].keys() | found[1].keys())
            rows = pa.record_batch([pa.array(every, pa.binary()), pa.array([found[0][w] + found[1][w] for w in every], pa.int64()), pa.array([found[1][w] for w in every], pa.int64())], names=["word", "n", "n_train"])
            found[0].clear()
            found[1].clear()
            return rows

        for batch in batches:
            for part in by_chars(batch, 0):
                for text, train in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    to = found[bool(train)]
                    to.update(words_of(text))
                    to[b""] += 1
                if len(found[0]) + len(found[1]) > FLUSH:
                    yield flush()
        yield flush()

    return source.mapInArrow(run, "word binary, n long, n_train long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("n_train").alias("n_train"))


def score(docs: DataFrame, model_path: str, training: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` to ``(doc_id, n_tokens, n_known, train_tokens, base_score, score)``, one row per row.

    Tokens are a text's words and one end. With N training tokens, V distinct ones and c a token's count, ``base_score`` sums
    log10((c + 0.1) / (N + 0.1 (V + 1))) over the tokens; ``score`` sums log10((1 - u) c / N + u s), s being the word's sum over
    its segmentations and u the share of training tokens seen once (the chance of a new word). The end has no segmentations.
    ``training`` picks the rows to learn from, by columns of ``docs``; null counts as not picked. A null or empty text is the
    end alone. With nothing to learn from N is 0, and words count by their segmentations. Texts and words of any length are
    whole; repeated rows are counted and scored each; an empty table gives an empty table; other columns are not read.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.coalesce(training, F.lit(False)).alias("train"))
    words = materialize(count_words(source, F.col("train")), "words")
    total = words.agg(F.sum("n_train").alias("n"), F.count_if(F.expr("n_train > 0")).alias("v"), F.count_if(F.expr("n_train = 1 and word <> X''")).alias("once")).first()
    n, v = total.n or 0, total.v or 0
    new = (total.once + 1) / (n + 1) if n else 1.0
    lattice = existing_vocabulary(model_path)
    held = spark.sparkContext.broadcast((lattice.pieces, lattice.log_p))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Lattice(*held.value)
        for batch in batches:
            for i in range(0, batch.num_rows, 50_000):
                part = batch.slice(i, 50_000)
                texts, c = part.column(0).to_pylist(), part.column(2).to_numpy(zero_copy_only=False).astype(float)
                lone = np.array([t == b"" for t in texts])
                inner = np.where(lone, 0.0, np.exp(own.log_probs(texts)))
                p = (1 - new) * c / max(n, 1) + new * inner
                # a very long word's probability underflows; its log does not
                long = np.where(lone | (p > 0), np.log10(np.maximum(p, 1e-300)), 0.0)
                if (p <= 0).any():
                    rest = np.flatnonzero((p <= 0) & ~lone)
                    long[rest] = (own.log_probs([texts[k] for k in rest]) + math.log(new)) / math.log(10)
                base = np.log10((c + ADD) / (n + ADD * (v + 1)))
                yield pa.record_batch([*_hashes(texts), part.column(0), part.column(1), pa.array(c > 0), pa.array(base), pa.array(long)], names=["h", "g", "word", "n", "known", "base", "score"])

    weighed = materialize(words.mapInArrow(weigh, "h long, g long, word binary, n long, known boolean, base double, score double"), "weighed")
    top = _most_frequent(weighed).select("word", "known", "base", "score").toPandas()
    frequent = spark.sparkContext.broadcast((top["word"].map(bytes).tolist(), top[["known", "base", "score"]].to_numpy(np.float64)))
    id_type = source.schema["doc_id"].dataType.simpleString()

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, values = frequent.value
        place = {w: i for i, w in enumerate(names)}
        values = np.vstack([values, np.zeros(3)])
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in by_chars(batch, 1, 2_000_000):
                ids, sums, tokens, rare, rare_of = [], [], [], [], []
                for text in part.column(1).to_pylist():
                    split = [*words_of(text), b""]
                    at = np.array([place.get(w, -1) for w in split], np.int64)
                    sums.append(values[at].sum(0))
                    tokens.append(len(split))
                    missed = np.flatnonzero(at < 0).tolist()
                    rare += [split[k] for k in missed]
                    rare_of += [row] * len(missed)
                    ids.append(row)
                    row += 1
                sums = np.array(sums).reshape(-1, 3)
                m, k = len(ids), len(rare)
                none = [None] * k
                keys = _hashes([*(i.to_bytes(8, "little") for i in ids), *rare])
                # a text's own row takes part in the join under a key of its own, so that all come out of one exchange
                yield pa.record_batch(
                    [
                        pa.array(ids + rare_of, pa.int64()),
                        *keys,
                        pa.array([False] * m + [True] * k),
                        pa.concat_arrays([part.column(0), pa.nulls(k, part.column(0).type)]),
                        pa.array(tokens + none, pa.int64()),
                        pa.array(sums[:, 0].astype(np.int64).tolist() + none, pa.int64()),
                        pa.array(sums[:, 1].tolist() + none, pa.float64()),
                        pa.array(sums[:, 2].tolist() + none, pa.float64()),
                    ],
                    names=["row", "h", "g", "rare", "doc_id", "tokens", "known", "base", "score"],
                )

    rows = source.mapInArrow(look_up, f"row long, h long, g long, rare boolean, doc_id {id_type}, tokens long, known long, base double, score double")
    side = weighed.select(F.col("h").alias("wh"), F.col("g").alias("wg"), F.col("known").cast("long").alias("wknown"), F.col("base").alias("wbase"), F.col("score").alias("wscore"))
    joined = rows.join(side, (F.col("h") == F.col("wh")) & (F.col("g") == F.col("wg")) & F.col("rare"), "left")
    own = lambda c: F.sum(F.when(F.col("rare"), F.col(f"w{c}")).otherwise(F.col(c)))
    return joined.groupBy("row").agg(F.max(F.when(~F.col("rare"), F.col("doc_id"))).alias("doc_id"), F.max("tokens").alias("n_tokens"), own("known").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), own("base").alias("base_score"), own("score").alias("score")).drop("row")


def _most_frequent(words: DataFrame) -> DataFrame:
    """The words above the count that FREQUENT of them at most reach.

    The cut comes from a histogram of counts, 16 bins an octave, so no task sends more rows than there are in all.
    """
    step = F.floor(F.log2("n") * 16).cast("int")
    bins = {r.bin: r.words for r in words.groupBy(step.alias("bin")).agg(F.count("*").alias("words")).collect()}
    cut, held = max(bins, default=0) + 1, 0
    for b in sorted(bins, reverse=True):
        held += bins[b]
        if held > FREQUENT:
            break
        cut = b
    return words.where(step >= cut)


def _hashes(words: list[bytes]) -> list[pa.Array]:
    """128-bit hashes as two columns of longs."""
    import xxhash

    both = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), np.int64).reshape(-1, 2)
    return [pa.array(np.ascontiguousarray(both[:, i])) for i in (0, 1)]
