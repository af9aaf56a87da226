"""Centroid clustering (Lloyd's rounds on whole numbers) over dictionaries of subvectors.

Vectors are written once as chunks. A chunk cuts the dimensions into blocks and keeps, without loss, each block's distinct
subvectors and a code a vector. A round computes the squared distance of every distinct subvector to every centroid once and
adds, for each vector, the parts that its codes name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.topk import quantised
from faultline.plans.runtime import materialize

#: Vectors of a chunk; neighbouring blocks become one while their distinct subvectors are at most a FEW-th of its vectors.
CHUNK, FEW = 32_768, 4
#: Components lie within this, so that 64 squared differences fit in a long.
LARGEST = 2**27

ENCODED = "ids array<long>, blocks array<struct<first int, width int, entries binary, codes binary>>"


def encode(x: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Blocks of dimensions of the rows ``x``: first dimension, distinct subvectors, and each row's code.

    One dimension a block to begin with; two neighbours are joined where that leaves few distinct subvectors, and so on.
    """
    blocks = []
    for d in range(x.shape[1]):
        values, codes = np.unique(x[:, d], return_inverse=True)
        blocks.append((d, values[:, None], codes))
    joined = True
    while joined and len(blocks) > 1:
        joined, out, i = False, [], 0
        while i < len(blocks):
            if i + 1 < len(blocks):
                (d, u, a), (_, v, b) = blocks[i : i + 2]
                if max(len(u), len(v)) * FEW <= len(x):
                    pairs, codes = np.unique(a * len(v) + b, return_inverse=True)
                    if len(pairs) * FEW <= len(x):
                        out.append((d, np.concatenate([u[pairs // len(v)], v[pairs % len(v)]], 1), codes))
                        joined, i = True, i + 2
                        continue
            out.append(blocks[i])
            i += 1
        blocks = out
    return blocks


def _code_type(entries: int) -> np.dtype:
    return np.dtype("<u2" if entries <= 65_536 else "<u4")


def nearest(blocks: list[dict], centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a chunk as written the number of each vector's nearest centroid (the smaller of equals) and the squared distance."""
    total = None
    for b in blocks:
        entries = np.frombuffer(b["entries"], "<i8").reshape(-1, b["width"])
        own = centroids[:, b["first"] : b["first"] + b["width"]]
        part = np.zeros((len(entries), len(centroids)), np.int64)
        for d in range(b["width"]):
            part += (entries[:, d, None] - own[None, :, d]) ** 2
        rows = part[np.frombuffer(b["codes"], _code_type(len(entries)))]
        total = rows if total is None else np.add(total, rows, out=total)
    best = np.argmin(total, 1)
    return best, total[np.arange(len(best)), best]


def _decoded(blocks: list[dict]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for b in blocks:
        entries = np.frombuffer(b["entries"], "<i8").reshape(-1, b["width"])
        yield b["first"], entries, np.frombuffer(b["codes"], _code_type(len(entries)))


def dictionaries(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``(vec_id, v)`` as written chunks of :data:`ENCODED`; a chunk holds vectors of one partition."""

    def written(ids: list, parts: list[np.ndarray]) -> pa.RecordBatch:
        blocks = [{"first": d, "width": e.shape[1], "entries": e.astype("<i8").tobytes(), "codes": c.astype(_code_type(len(e))).tobytes()} for d, e, c in encode(np.concatenate(parts))]
        kind = pa.list_(pa.struct([("first", pa.int32()), ("width", pa.int32()), ("entries", pa.binary()), ("codes", pa.binary())]))
        return pa.record_batch([pa.array([ids], pa.list_(pa.int64())), pa.array([blocks], kind)], names=["ids", "blocks"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts, n = [], [], 0
        for batch in batches:
            if batch.num_rows:
                ids += batch.column(0).to_pylist()
                parts.append(batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1))
                n += batch.num_rows
            if n >= chunk:
                yield written(ids, parts)
                ids, parts, n = [], [], 0
        if n:
            yield written(ids, parts)

    return materialize(rows.select(F.col("vec_id").cast("long"), "v").mapInArrow(run, ENCODED), "subvectors")


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, seed: int = 2, dims: int = 64, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256)``, a row for each vector that takes part.

    Components become floor(``scale`` * x). Vectors that are null, have not exactly ``dims`` components, or hold one that is null,
    not finite or beyond LARGEST after scaling take no part. Centroids start as the ``k`` vectors whose ``seed:vec_id`` has the
    smallest SHA-256 (rows that repeat an id in order of their components, a null id as empty text), all where there are fewer.
    Each round moves every centroid that has vectors to their exact floor(sum / count); equal distances go to the smaller
    number. Repeated rows each count. An empty table gives an empty table; other columns are not looked at. An inertia beyond a
    long is null.

    What a task holds is one chunk; k * dims sums leave it a round. Only the centroids pass the driver.
    """
    spark = vectors.sparkSession
    x = F.col(f"`{vector_col}`")
    whole = vectors.where((F.size(x) == dims) & ~F.exists(x, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) > LARGEST // scale)))
    rows = whole.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), quantised(x, scale).alias("v"))
    named = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    start = [r.v for r in rows.select(named.alias("h"), "v").orderBy("h", "v").limit(k).collect()]
    if not start:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    chunks = dictionaries(rows)
    centroids = np.array(start, np.int64)

    def sums(now: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, count = np.zeros((len(now), dims), np.int64), np.zeros(len(now), np.int64)
            for batch in batches:
                for row in batch.column(1):
                    blocks = row.as_py()
                    best, _ = nearest(blocks, now)
                    count += np.bincount(best, minlength=len(now))
                    for first, entries, codes in _decoded(blocks):
                        # how often each centroid has each subvector, then the subvectors' sums
                        often = np.bincount(best * len(entries) + codes, minlength=len(now) * len(entries)).reshape(len(now), -1)
                        total[:, first : first + entries.shape[1]] += often @ entries
            at = np.flatnonzero(count)
            yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(total[at].tolist(), pa.list_(pa.int64())), pa.array(count[at])], names=["cluster", "sums", "n"])

        return run

    def assigned(now: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for ids, row in zip(batch.column(0), batch.column(1), strict=True):
                    best, distance = nearest(row.as_py(), now)
                    yield pa.record_batch([ids.values, pa.array(best.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"])

        return run

    big = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    for _ in range(rounds):
        parts = chunks.mapInArrow(sums(centroids), "cluster int, sums array<long>, n long")
        moved = parts.select("cluster", "n", F.posexplode("sums").alias("dim", "s")).groupBy("cluster", "dim").agg(big("s"), big("n")).collect()
        for r in moved:
            centroids[r.cluster, r.dim] = int(r.s) // int(r.n)
    out = materialize(chunks.mapInArrow(assigned(centroids), "vec_id long, cluster int, distance long"), "clusters")
    each = {r.cluster: int(r.distance) for r in out.groupBy("cluster").agg(big("distance")).collect()}
    long = lambda n: n if n < 2**63 else None
    known = [(c, long(n), long(sum(each.values())), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, n in each.items()]
    return out.join(F.broadcast(spark.createDataFrame(known, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
