"""Exact top-k search by inner product with Fagin's threshold algorithm.

Vectors lie in blocks of similar ones. A block keeps, for every dimension, its values in order. A query reads each list from
the end that its sign prefers; what it has not met yet can score no more than the threshold, the sum over dimensions of its
weight times the value where that list stands. It stops once the threshold is below the k-th best score known.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.plans.runtime import materialize

#: How far all lists are read before the threshold is looked at, each time twice as far.
FIRST_DEPTH = 8
LEAST = np.iinfo(np.int64).min


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component as long; null where the vector is null or has a null or non-finite component."""
    x = lambda c: c.cast("double")
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(x(c)) | (F.abs(x(c)) == float("inf")))
    return F.when(~bad, F.transform(vector, lambda c: F.floor(x(c) * scale).cast("long")))


class Block:
    """Vectors with their ids in order, and the sorted list of each dimension."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        by_id = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[by_id], vectors[by_id]
        self.repeats = bool((self.ids[1:] == self.ids[:-1]).any())
        self.order = np.argsort(self.vectors, axis=0, kind="stable")  # ascending places, a column a dimension
        self.sorted = np.take_along_axis(self.vectors, self.order, axis=0)

    def thresholds(self, queries: np.ndarray, depth: int) -> np.ndarray:
        """The most that a vector can score which is beyond ``depth`` in every list, for each query."""
        n = len(self.ids)
        high, low = self.sorted[n - 1 - depth], self.sorted[depth]
        return np.maximum(queries, 0) @ high + np.minimum(queries, 0) @ low

    def top(self, query_id: int, query: np.ndarray, k: int, floor: int) -> list[tuple[int, int]]:
        """Up to k best (score, id) of the block that can be among the best k of all; ``floor`` is a k-th best known."""
        n, depth = len(self.ids), 0
        seen = np.zeros(n, bool)
        places, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        up, used = query > 0, query != 0
        while depth < n and self.thresholds(query[None], depth)[0] >= floor:
            to = min(n, max(FIRST_DEPTH, 2 * depth))
            # the lists' next entries: from the high end where the weight is positive, else from the low end
            met = np.concatenate([self.order[n - to : n - depth, up].ravel(), self.order[depth:to, used & ~up].ravel()]) if used.any() else np.arange(n)
            new = np.unique(met[~seen[met]])
            seen[new] = True
            fresh = self.vectors[new] @ query
            places, scores = np.concatenate([places, new]), np.concatenate([scores, fresh])
            keep = np.lexsort((self.ids[places], -scores))
            if self.repeats:  # an id's best vector stands for it
                keep = keep[np.sort(np.unique(self.ids[places[keep]], return_index=True)[1])]
            keep = keep[: k + 1]
            places, scores = places[keep], scores[keep]
            other = scores[self.ids[places] != query_id]
            if len(other) >= k:
                floor = max(floor, int(other[k - 1]))
            depth = to if used.any() else n
        return [(int(s), int(self.ids[p])) for s, p in zip(scores, places, strict=True) if self.ids[p] != query_id][:k]


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, cells: int = 32, block_rows: int = 8192, query_rows: int = 4096) -> DataFrame:
    """The k best partners of each query: ``(query_id, rank, vec_id, score)``.

    Both tables are ``(vec_id long, v array<long>)``, null vectors left out before. Ties go to the smaller id; a query is not
    its own partner (by id); fewer partners than k give fewer rows; empty tables give an empty table. Rows that repeat a query
    id count once, and an id that stands for several vectors counts with its best score. All vectors must have one length.

    Each vector goes to the nearest of ``cells`` vectors picked by hash (a fixed number, broadcast), and a cell of more than
    ``block_rows`` is dealt out over several blocks, so equal vectors however many fill blocks of bounded size. Queries lie in
    packs of ``query_rows``, and a pack and a block make a group, so what a task holds depends on neither table's size; of a
    pack each block returns k rows a query at most. The picked vectors also give every query a k-th best score to begin with,
    by which most blocks end at once.
    """
    vectors = vectors.where("vec_id is not null and v is not null")
    queries = queries.where("vec_id is not null and v is not null").dropDuplicates(["vec_id"])
    picked = {r.vec_id: r.v for r in vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(cells * 32).collect()}
    if not picked:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    pick_ids, picks = np.array(list(picked), np.int64), np.array(list(picked.values()), np.int64)
    held = vectors.sparkSession.sparkContext.broadcast((pick_ids, picks))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = held.value[1][:cells].astype(np.float64)
        half = (centres**2).sum(1) / 2
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(1))
                cell = np.argmax(x @ centres.T - half, 1)
                yield pa.record_batch([batch.column(0), batch.column(1), pa.array(cell.astype(np.int32))], names=["vec_id", "v", "cell"])

    placed = materialize(vectors.select("vec_id", "v").mapInArrow(place, "vec_id long, v array<long>, cell int"), "cells")
    sizes = {r.cell: r.n for r in placed.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    parts = {c: -(-n // block_rows) for c, n in sizes.items()}
    first = dict(zip(parts, accumulate([0, *parts.values()]), strict=False))
    of_cell = lambda by: F.element_at(F.create_map(*[F.lit(x) for c in parts for x in (c, by[c])]), F.col("cell"))
    block = of_cell(first) + F.pmod(F.xxhash64("vec_id", "v"), of_cell(parts))
    packs = max(1, -(-queries.count() // query_rows))
    numbers = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    # each block is repeated for each pack and each query for each block; groups are one of each
    blocked = placed.select("vec_id", "v", block.alias("block"), numbers(packs).alias("pack"))
    sent = queries.select("vec_id", "v", numbers(sum(parts.values())).alias("q_block"), F.pmod(F.xxhash64("vec_id"), F.lit(packs)).cast("long").alias("q_pack"))

    def best(block: pa.Table, sent: pa.Table) -> pa.Table:
        out = []
        if block.num_rows and sent.num_rows:
            own, (pick_ids, picks) = Block(block["vec_id"].to_numpy(), _matrix(block["v"])), held.value
            q_ids, q = sent["vec_id"].to_numpy(), _matrix(sent["v"])
            # the k-th best among the picked vectors, itself not counted
            scores = q @ picks.T
            scores[q_ids[:, None] == pick_ids[None, :]] = LEAST
            floors = np.partition(scores, -k, 1)[:, -k] if len(picks) >= k else np.full(len(q), LEAST)
            for i in np.flatnonzero(own.thresholds(q, 0) >= floors):
                out += [(int(q_ids[i]), v, s) for s, v in own.top(int(q_ids[i]), q[i], k, int(floors[i]))]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query_id", "vec_id", "score"), zip(*out, strict=True) if out else ([], [], []), strict=True)})

    found = blocked.groupBy("block", "pack").cogroup(sent.groupBy("q_block", "q_pack")).applyInArrow(best, "query_id long, vec_id long, score long")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Lists of one length as rows."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
