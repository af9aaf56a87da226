"""Near-duplicate classes by BagMinHash.

A text is a bag of word shingles. For every shingle, Poisson processes run over the dyadic intervals (0, 1], (1, 2], (2, 4], ...
of its weight; a point's place within its interval is found by halving, one hash bit a level, and counts where it lies within
the shingle's weight. The earliest point of each signature component makes the component, so two signatures agree in a
component with the probability of the bags' weighted Jaccard similarity. Signatures are banded, and what shares a band is
verified on the bags themselves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.linking import link_buckets
from faultline.llm.pieces import by_chars
from faultline.plans.components import connected_components
from faultline.plans.runtime import materialize

U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser: 64 well-spread bits from 64."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class WordHashes(dict):
    """Word to 64-bit hash, kept for words seen lately."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def shingles(text: str | None, width: int, hashes: WordHashes) -> np.ndarray:
    """Hashes of all ``width``-word runs of the lower-cased text; a shorter text is one run; no word, none."""
    words = (text or "").lower().encode().split()
    if not words:
        return np.zeros(0, U64)
    h = np.fromiter(map(hashes.__getitem__, words), U64, len(words))
    width = min(width, len(words))
    out = np.zeros(len(h) - width + 1, U64)
    for i in range(width):
        out = mix(out + h[i : i + len(out)] + U64(0x9E3779B97F4A7C15))
    return out


def bag(run: np.ndarray) -> np.ndarray:
    """A multiset as a sorted set: the n-th occurrence of a hash becomes a hash of its own."""
    s = np.sort(run)
    if len(s) > 1:
        new = np.concatenate([[True], s[1:] != s[:-1]])
        nth = np.arange(len(s)) - np.maximum.accumulate(np.where(new, np.arange(len(s)), 0))
        if nth.any():
            s = np.sort(np.where(nth > 0, mix(s + nth.astype(U64) * U64(0xD1342543DE82EF95)), s))
    return s


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two bags; two empty ones are alike."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return shared / (len(a) + len(b) - shared)


def signatures(runs: list[np.ndarray], size: int) -> np.ndarray:
    """BagMinHash signatures, a row each: for every one of ``size`` components the hash of its earliest accepted point.

    The bags, none empty, are worked on together; a bag's rows of (key, weight) share its time horizon.
    """
    out = np.zeros((len(runs), size), U64)
    if not runs:
        return out
    bags = [np.unique(r, return_counts=True) for r in runs]
    sizes = np.array([len(k) for k, _ in bags])
    keys, weight = np.concatenate([k for k, _ in bags]), np.concatenate([w for _, w in bags])
    # points up to this time: every component gets one but for a chance of about e^-3, else the time doubles
    horizon = size * (math.log(size) + 3) / np.array([len(r) for r in runs])
    todo = np.arange(len(runs))
    owner = np.repeat(todo, sizes)
    while len(todo):
        best_t, best_v = np.full(len(runs) * size, np.inf), np.zeros(len(runs) * size, U64)
        mine = np.isin(owner, todo) if len(todo) < len(runs) else np.ones(len(owner), bool)
        k, w, of, level = keys[mine], weight[mine], owner[mine], 0
        while len(k):
            # interval (2^(level-1), 2^level], or (0, 1]; its length is the rate of its process
            length = 1 if level == 0 else 1 << (level - 1)
            seed = mix(k + U64((level + 1) * 0xA24BAED4963EE407 & 0xFFFFFFFFFFFFFFFF))
            t, at, step = np.zeros(len(k)), np.arange(len(k)), 0
            while True:
                step += 1
                r = mix(seed[at] + U64(step * 0x9FB21C651E98DF25 & 0xFFFFFFFFFFFFFFFF))
                t = t - np.log(((r >> U64(11)).astype(np.float64) + 0.5) / 9007199254740992.0) / length
                live = t <= horizon[of[at]]
                t, at, point = t[live], at[live], mix(r[live])
                if not len(at):
                    break
                pt, pv, po = t, point, of[at]
                if length > 1:
                    # halving the interval, a bit a level, places the point on a unit of weight
                    ok = length + (mix(point) & U64(length - 1)).astype(np.int64) + 1 <= w[at]
                    pt, pv, po = pt[ok], pv[ok], po[ok]
                slot = po * size + ((pv >> U64(32)) % U64(size)).astype(np.int64)
                before = best_t[slot]
                np.minimum.at(best_t, slot, pt)
                first = (pt == best_t[slot]) & (pt < before)
                best_v[slot[first]] = pv[first]
            level += 1
            above = w > (1 << (level - 1))
            k, w, of = k[above], w[above], of[above]
        full = np.isfinite(best_t).reshape(-1, size).all(1)
        done = todo[full[todo]]
        out[done] = best_v.reshape(-1, size)[done]
        todo = todo[~full[todo]]
        horizon[todo] *= 2
    return out


def sketch(docs: DataFrame, id_col: str, text_col: str, width: int, bands: int, rows: int) -> DataFrame:
    """``(doc_id, n, same, band_keys)``: shingles in all, a 128-bit key of the bag, and a key for each band."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        hashes = WordHashes()
        index = np.arange(bands, dtype=U64) * U64(0x9E3779B97F4A7C15)
        for batch in batches:
            for part in by_chars(batch, 1):
                runs = [shingles(t, width, hashes) for t in part.column(1).to_pylist()]
                full = [i for i, r in enumerate(runs) if len(r)]
                sig = signatures([runs[i] for i in full], bands * rows).reshape(len(full), bands, rows)
                band = np.zeros((len(runs), bands), U64)
                for i in range(rows):
                    band[full] = mix(band[full] + sig[:, :, i] + index)
                yield pa.record_batch(
                    [part.column(0), pa.array([len(r) for r in runs], pa.int64()), pa.array([xxhash.xxh3_128_digest(bag(r).tobytes()) for r in runs], pa.binary()), pa.ListArray.from_arrays(pa.array(np.arange(len(runs) + 1) * bands, pa.int32()), pa.array(band.view(np.int64).ravel()))],
                    names=["doc_id", "n", "same", "band_keys"],
                )

    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, n long, same binary, band_keys array<long>")


def verify(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """``pairs(a, b)`` with ``sim``, the weighted Jaccard similarity of the two texts' bags."""
    text = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    full = pairs.join(text.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").join(text.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, kept_text, kept = WordHashes(), None, None
        for batch in batches:
            out = []
            for ta, tb in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if ta != kept_text or kept is None:
                    kept_text, kept = ta, bag(shingles(ta, width, hashes))
                out.append(similarity(kept, bag(shingles(tb, width, hashes))))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(out, pa.float64())], names=["a", "b", "sim"])

    kind = docs.schema[id_col].dataType.simpleString()
    return full.mapInArrow(run, f"a {kind}, b {kind}, sim double")


#: Rows of a family, and rows that ask, that meet in one group.
BLOCK_ROWS = 256


def family_links(mixed: DataFrame, docs: DataFrame, id_col: str, text_col: str, width: int, threshold: float, size: int) -> DataFrame:
    """The links that rows outside their bucket's main group have, for :func:`link_buckets`.

    A main group and all rows that share a bucket with it are a family. Each row outside the main group is held against its
    whole family. The family lies in blocks and the rows that ask in packs, both of bounded size, and a block and a pack make a
    group, so no task holds more however large a family is; inside a group signatures rule out most rows (at 4.5 standard deviations
    under the threshold), the bags decide on the others, the most similar first, and one link to each group is enough. What
    is passed on are links, not pairs.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    cut = threshold - 4.5 * math.sqrt(threshold * (1 - threshold) / size)
    outer = mixed.where("group <> main").select("main", "id").distinct()
    inner = mixed.select("main", "id", "group").distinct()
    inner = materialize(inner, "families")
    ids = inner.select("id").distinct()
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(ids, "id", "left_semi")

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for part in by_chars(batch, 1):
                runs = [shingles(t, width, hashes) for t in part.column(1).to_pylist()]
                sig = signatures(runs, size).astype(np.uint16)
                yield pa.record_batch([part.column(0), pa.array([x.tobytes() for x in sig], pa.binary()), pa.array([bag(x).tobytes() for x in runs], pa.binary())], names=["id", "sig", "bag"])

    held = materialize(source.mapInArrow(bags, f"id {kind}, sig binary, bag binary"), "bags")
    asks = F.coalesce("asks", F.lit(False))
    marked = inner.join(outer.withColumn("asks", F.lit(True)), ["main", "id"], "left").select("main", "id", "group", asks.alias("asks"))
    count = lambda which: F.greatest(F.ceil(F.sum(which.cast("long")) / BLOCK_ROWS), F.lit(1)).cast("long")
    sizes = materialize(marked.groupBy("main").agg(count(F.lit(True)).alias("blocks"), count(F.col("asks")).alias("packs")), "family-sizes")
    full = materialize(marked.join(sizes, "main").join(held, "id"), "family-rows")
    dealt = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    members = full.select("main", dealt("blocks").alias("block"), each("packs").alias("pack"), "id", "group", "sig", "bag")
    asked = full.where("asks").select(F.col("main").alias("qmain"), each("blocks").alias("qblock"), dealt("packs").alias("qpack"), F.col("id").alias("qid"), F.col("group").alias("qgroup"), F.col("sig").alias("qsig"), F.col("bag").alias("qbag"))

    def meet(rows: pa.Table, queries: pa.Table) -> pa.Table:
        src, dst = [], []
        if rows.num_rows:
            ids, groups, bags_ = (rows[c].to_pylist() for c in ("id", "group", "bag"))
            sig = np.frombuffer(b"".join(rows["sig"].to_pylist()), np.uint16).reshape(-1, size)
            decoded: dict[int, np.ndarray] = {}
            for x, gx, sx, bx in zip(*(queries[c].to_pylist() for c in ("qid", "qgroup", "qsig", "qbag")), strict=True):
                alike = (sig == np.frombuffer(sx, np.uint16)).mean(1)
                near = np.flatnonzero(alike >= cut)
                done, own = {gx}, np.frombuffer(bx, U64)
                for k in near[np.argsort(-alike[near])].tolist():
                    if groups[k] not in done:
                        other = decoded.setdefault(k, np.frombuffer(bags_[k], U64))
                        if min(len(own), len(other)) >= threshold * max(len(own), len(other)) and similarity(own, other) >= threshold:
                            done.add(groups[k])
                            src.append(x)
                            dst.append(ids[k])
        return pa.table({"src": pa.array(src, rows.schema.field("id").type), "dst": pa.array(dst, rows.schema.field("id").type)})

    return materialize(members.groupBy("main", "block", "pack").cogroup(asked.groupBy("qmain", "qblock", "qpack")).applyInArrow(meet, f"src {kind}, dst {kind}"), "family-links")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, threshold: float = 0.8, bands: int = 25, rows: int = 5) -> DataFrame:
    """``docs`` to ``(doc_id, class_id, n_shingles)``, one row for each distinct non-null id.

    ``class_id`` is the smallest id of the connected group under "weighted Jaccard similarity of ``width``-word shingles of
    ``threshold`` or more". Copies (equal bags) share a class and are represented by their smallest id, so groups of copies of
    any size cost one row each. Texts shorter than ``width`` words are one shingle; null texts, empty texts and texts without a
    word each stand alone. A text of any length is shingled whole. Rows that repeat an id count once where their texts are
    equal; where they differ, the id's texts are joined in one class. Rows with a null id are left out. An empty table
    gives an empty table. Other columns are not read.

    Candidates share a band (at similarity 0.8 all but 5 in 100,000 pairs do). Within a bucket each text is first verified
    against the smallest id; texts that this leaves outside are held against their whole family, see :func:`family_links`.
    """
    texts = docs.where(F.col(id_col).isNotNull())
    marks = materialize(sketch(texts, id_col, text_col, width, bands, rows), "sketch")
    some = marks.where("n > 0").select("doc_id", "same")
    # copies to their representative: the least id of each key first, then a join, for a third of all rows may share one key
    reps = materialize(some.groupBy("same").agg(F.min("doc_id").alias("rep")), "representatives")
    members = materialize(some.join(reps, "same").select("doc_id", "rep"), "members")
    keyed = marks.where("n > 0").join(members.where("doc_id = rep").select("doc_id").distinct(), "doc_id", "left_semi")
    band = F.transform("band_keys", lambda k, i: F.xxhash64(i, k))
    buckets = materialize(keyed.select(F.col("doc_id").alias("id"), F.explode(F.array_distinct(band)).alias("bucket")), "buckets")
    # an id with several texts ties their classes together
    tied = members.groupBy("doc_id").agg(F.min("rep").alias("src"), F.max("rep").alias("dst")).where("src <> dst").select("src", "dst")
    groups = link_buckets(buckets, lambda pairs: verify(pairs, texts, id_col, text_col, width), threshold, lambda mixed: family_links(mixed, texts, id_col, text_col, width, threshold, bands * rows), tied)
    rep = members.groupBy("doc_id").agg(F.min("rep").alias("rep")).join(groups.select(F.col("node").alias("rep"), "component"), "rep", "left").select("doc_id", F.coalesce("component", "rep").alias("class_id"))
    return marks.groupBy("doc_id").agg(F.max("n").alias("n_shingles")).join(rep, "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), "n_shingles")
