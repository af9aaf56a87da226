"""Exact nearest vectors by Euclidean distance, pruned with pivots and the triangle inequality.

Every vector lies in the ball of its nearest pivot and remembers its distance from it. A query measures its distance to the pivots;
no vector of a ball can be nearer than what the triangle inequality leaves between those distances. The query's own ball gives a
k-th best distance to begin with; only balls, and in them only vectors, that could beat it are measured.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.plans.runtime import materialize

#: Distances are rounded to so many places before they are ranked; bounds leave that much room.
PLACES = 6
ROOM = 2 * 10.0**-PLACES
#: Vectors of a ball that are measured together; values, and pairs to measure exactly, that a task holds at once.
SEGMENT, VALUES, PAIRS = 256, 2_000_000, 200_000
#: Values of a block's or a pack's vectors, and rows that are held against the pivots at once.
LONGEST, PORTION = 2_000_000, 1024


def _usable(vector: Column, dims: int) -> Column:
    """Vectors of the right length without null or non-finite components."""
    x = lambda c: c.cast("double")
    return (F.size(vector) == dims) & ~F.exists(vector, lambda c: c.isNull() | F.isnan(x(c)) | (F.abs(x(c)) == float("inf")))


def _rows(column: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def _portions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, PORTION):
            yield batch.slice(i, PORTION)


def _slack(square: np.ndarray, dims: int) -> np.ndarray:
    """What rounding may add to or take from a squared distance found by a product of matrices, for the greatest squared norm."""
    return 8 * (dims + 8) * np.finfo(np.float64).eps * square


def _apart(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of rows to pivots."""
    square = (vectors**2).sum(1)[:, None] + (pivots**2).sum(1)[None, :] - 2 * vectors @ pivots.T
    return np.sqrt(np.maximum(square, 0))


def _pair_squares(x: np.ndarray, q: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of the rows ``a`` of ``x`` and ``b`` of ``q``, summed in the order of the dimensions."""
    out, step = np.zeros(len(a)), max(1, VALUES // x.shape[1])
    for i in range(0, len(a), step):
        square = np.ascontiguousarray((x[a[i : i + step]] - q[b[i : i + step]]).T) ** 2
        for d in square:
            out[i : i + step] += d
    return out


def best_places(query: np.ndarray, square: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Places that can be among the n best of their query once distances are rounded, equal ones by id; of one distance n places at
    most. They are sorted by query and distance."""
    order = np.lexsort((ids, square, query))
    if len(order):
        of, s = query[order], square[order]
        new = np.append(True, of[1:] != of[:-1])
        first = np.flatnonzero(new)
        run = np.cumsum(new) - 1
        last = np.append(first[1:], len(order)) - 1
        nth = np.where(first + n - 1 <= last, s[np.minimum(first + n - 1, last)], np.inf)
        tied = np.flatnonzero(new | np.append(True, s[1:] != s[:-1]))
        in_tie = np.arange(len(order)) - np.repeat(tied, np.diff(np.append(tied, len(order))))
        order = order[(s <= nth[run] + ROOM) & (in_tie < n)]
    return order


def laid_out(counts: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Shelves for balls of so many rows, in their order: each ball's first shelf and how many are its own. Small neighbours share a
    shelf of about ``rows`` rows at most, a ball of more has several to itself."""
    first, parts = np.zeros(len(counts), np.int64), np.maximum(-(-counts // rows), 1)
    shelf, filled = -1, rows
    for i, (count, own) in enumerate(zip(counts.tolist(), parts.tolist(), strict=True)):
        if own > 1 or filled + count > rows:
            shelf, filled = shelf + 1, 0
        first[i] = shelf
        shelf, filled = shelf + own - 1, rows if own > 1 else filled + count
    return first, parts


def chain(centres: np.ndarray) -> np.ndarray:
    """Pivots in an order in which each is followed by the nearest that is left."""
    apart, order = _apart(centres, centres), [0]
    left = np.ones(len(centres), bool)
    for _ in range(len(centres) - 1):
        left[order[-1]] = False
        order.append(int(np.argmin(np.where(left, apart[order[-1]], np.inf))) if np.isfinite(apart[order[-1]][left]).any() else int(np.flatnonzero(left)[0]))
    return np.array(order)


def _distinct(block: pa.Table, n: int, dims: int) -> tuple[np.ndarray, ...]:
    """Ball, distance from its pivot, id and vector of a block's rows by ball and distance; of equal vectors those with the n
    smallest ids, for others are in no answer."""
    ball, r, ids, x = block["ball"].to_numpy(), block["r"].to_numpy(), block["pattern_id"].to_numpy(), _rows(block["v"], dims) + 0.0
    _, same = np.unique(np.ascontiguousarray(x).view(np.dtype((np.void, 8 * dims))).ravel(), return_inverse=True)
    order = np.lexsort((ids, same))
    new = np.flatnonzero(np.append(True, np.diff(same[order]) != 0))
    keep = order[np.arange(len(order)) - np.repeat(new, np.diff(np.append(new, len(order)))) < n]
    keep = keep[np.lexsort((r[keep], ball[keep]))]
    return ball[keep], r[keep], ids[keep], x[keep]


def _block_best(block: tuple[np.ndarray, ...], q: np.ndarray, limit: np.ndarray, centres: np.ndarray, n: int) -> tuple[np.ndarray, ...]:
    """Of a block, as :func:`_distinct` has it, what can be among the n best of each row of ``q``, with squared distances up to
    ``limit``: row of ``q``, id, square; and how many distances each row has cost.

    Vectors of one ball whose distances from the pivot are alike meet, in one product of matrices, those queries whose own distance
    from it allows of a near one. The product only chooses pairs; their distances are then summed as they are defined.
    """
    ball, r, ids, x = block
    dims = x.shape[1]
    limit, cost = limit.copy(), np.zeros(len(q), np.int64)
    norm, q_norm = (x**2).sum(1), (q**2).sum(1)
    wide, q_wide = np.column_stack([x, norm / -2]), np.column_stack([q, np.ones(len(q))])
    best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    waiting, size = [], 0

    def settle() -> None:
        nonlocal best, size
        at, place = (np.concatenate(c) for c in zip(*waiting, strict=True))
        best = tuple(np.concatenate(c) for c in zip(best, (at, ids[place], _pair_squares(x, q, place, at)), strict=True))
        kept = best_places(best[0], best[2], best[1], n)
        best = tuple(c[kept] for c in best)
        first = np.flatnonzero(np.append(True, np.diff(best[0]) != 0))
        nth = first[np.append(first[1:], len(best[0])) - first >= n] + n - 1
        limit[best[0][nth]] = np.minimum(limit[best[0][nth]], best[2][nth] + ROOM)
        waiting.clear()
        size = 0

    starts = np.flatnonzero(np.append(True, np.diff(ball) != 0))
    ends = np.append(starts[1:], len(ball))
    apart = _apart(q, centres[ball[starts]])
    nearest_ball = np.argmin(apart, 1)
    # each row first meets the block's ball that is nearest to it, then the others within what that has left
    for own, b in [(own, b) for own in (True, False) for b in range(len(starts))]:
        if not own and b == 0 and size:
            settle()
        mine = np.flatnonzero((nearest_ball == b) == own)
        centre_norm = (centres[ball[starts[b]]] ** 2).sum()
        for i in range(starts[b], ends[b], SEGMENT):
            j = min(i + SEGMENT, ends[b])
            room = _slack(np.maximum(q_norm[mine], max(norm[i:j].max(), centre_norm)), dims)
            # a vector's distance from the pivot differs from the query's by no more than their distance
            bound = np.maximum(apart[mine, b] - r[j - 1], r[i] - apart[mine, b])
            near = ~(bound > np.sqrt(limit[mine]) + 1e-6 + 2 * np.sqrt(room))
            some, room = mine[near], room[near]
            cost[some] += j - i
            step = max(1, VALUES // (j - i))
            for k in range(0, len(some), step):
                rows = some[k : k + step]
                least = (q_norm[rows] - limit[rows] - room[k : k + step]) / 2
                at, place = np.nonzero(~(q_wide[rows] @ wide[i:j].T < least[:, None]))
                waiting.append((rows[at], place + i))
                size += len(at)
                if size >= PAIRS:
                    settle()
    if size:
        settle()
    return *best, cost


def ball_search(queries: DataFrame, vectors: DataFrame, n: int = 5, pivots: int = 256, block_rows: int = 8192, pack_rows: int = 8192) -> DataFrame:
    """``(query_id, pattern_id, square, computed)``: a superset of each query's ``n`` nearest of ``vectors(pattern_id, embedding)``, with
    squared distances; rows without a ``pattern_id`` tell how many distances a block has cost.

    ``pivots`` vectors picked by hash are collected and sent to all tasks (a fixed number). Neighbouring balls fill blocks of at most
    ``block_rows``, a larger ball is dealt out over several, so equal vectors however many fill blocks of bounded size; queries fill
    packs of ``pack_rows`` in the same way. Long vectors make smaller blocks and packs. A block meets the packs of which some query
    can find a nearer vector in it, once, and of a pack only such queries. Where nothing can be left out (vectors that are all equally
    far apart), all pairs are measured, in products of matrices.
    """
    spark = vectors.sparkSession
    shape = "query_id long, pattern_id long, square double, computed long"
    dims = queries.agg(F.max(F.size("embedding"))).first()[0]
    single = all(d.schema["embedding"].dataType.simpleString() == "array<float>" for d in (queries, vectors))
    kind = "array<float>" if single else "array<double>"
    known = vectors.where(_usable(F.col("embedding"), dims or 0) & F.col("pattern_id").isNotNull()).select(F.col("pattern_id").cast("long").alias("pattern_id"), F.col("embedding").cast(kind).alias("v"))
    picked = known.orderBy(F.xxhash64("pattern_id", F.lit(7)), "pattern_id", "v").limit(pivots).collect() if dims and dims > 0 else []
    if not picked:
        return spark.createDataFrame([], shape)
    centres = np.array([r.v for r in picked], np.float64)
    centres = centres[chain(centres)]
    sent_centres = spark.sparkContext.broadcast(centres)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _portions(batches):
            apart = _apart(_rows(batch.column(1), dims), sent_centres.value)
            ball = np.argmin(apart, 1)
            yield pa.record_batch([*batch.columns, pa.array(ball.astype(np.int32)), pa.array(apart[np.arange(len(ball)), ball])], names=[*batch.schema.names, "ball", "r"])

    placed = materialize(known.mapInArrow(place, f"pattern_id long, v {kind}, ball int, r double"), "balls")
    asked = queries.where(_usable(F.col("embedding"), dims) & F.col("query_id").isNotNull()).select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").cast(kind).alias("q"))
    asked = materialize(asked.mapInArrow(place, f"query_id long, q {kind}, ball int, r double"), "asked")
    # one row a ball, as many as pivots at most
    stats = {x.ball: x for x in placed.groupBy("ball").agg(F.count(F.lit(1)).alias("rows"), F.min("r").alias("lo"), F.max("r").alias("hi")).collect()}
    homes = {x.ball: x.rows for x in asked.groupBy("ball").agg(F.count(F.lit(1)).alias("rows")).collect()}
    all_balls = range(len(centres))
    rows = max(1, LONGEST // dims)
    first, parts = laid_out(np.array([stats[b].rows if b in stats else 0 for b in all_balls]), min(block_rows, rows))
    first_pack, packs = laid_out(np.array([homes.get(b, 0) for b in all_balls]), min(pack_rows, rows))
    lo, hi = (np.array([stats[b][c] if b in stats else np.inf for b in all_balls]) for c in ("lo", "hi"))
    layout = F.broadcast(spark.createDataFrame([(int(b), int(first[b]), int(parts[b]), int(first_pack[b]), int(packs[b])) for b in all_balls], "ball int, first int, parts int, first_pack int, packs int"))
    blocked = placed.join(layout, "ball").select("pattern_id", "v", "ball", "r", (F.col("first") + F.pmod(F.xxhash64("pattern_id", "v"), F.col("parts"))).cast("int").alias("block"))
    # a query begins with one block of its own ball
    asked = asked.join(layout, "ball").select("query_id", "q", *[(F.col(a) + F.pmod(F.xxhash64("query_id"), F.col(b))).cast("int").alias(c) for a, b, c in (("first", "parts", "home"), ("first_pack", "packs", "pack"))])

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The blocks besides its own that a query visits: those with a ball whose bound is within ``tau``."""
        holds = np.zeros((len(centres), int((first + parts).max())), np.float32)
        for b in stats:
            holds[b, first[b] : first[b] + parts[b]] = 1
        for batch in _portions(batches):
            q, home, tau = _rows(batch.column(1), dims), batch.column(2).to_numpy(), batch.column(4).to_numpy()
            apart = _apart(q, sent_centres.value)
            top = np.maximum((q**2).sum(1)[:, None], ((np.sqrt((sent_centres.value**2).sum(1)) + np.where(np.isfinite(hi), hi, 0)) ** 2)[None])
            bound = np.maximum(np.maximum(apart - hi, lo - apart), 0)
            near = ~(bound > tau[:, None] + 1e-6 + 2 * np.sqrt(_slack(top, dims)))
            near[:, ~np.isfinite(hi)] = False
            goes = near.astype(np.float32) @ holds > 0
            goes[np.arange(len(q)), home] = False
            ends = np.append(0, np.cumsum(goes.sum(1))).astype(np.int32)
            yield pa.record_batch([*[batch.column(i) for i in (0, 1, 3, 4)], pa.ListArray.from_arrays(pa.array(ends), pa.array(np.nonzero(goes)[1].astype(np.int32)))], names=["query_id", "q", "pack", "tau", "blocks"])

    def measure(block: pa.Table, sent: pa.Table) -> pa.Table:
        columns = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)], np.zeros(0, np.int64), np.zeros(0, np.int64)
        if block.num_rows and sent.num_rows:
            q, ids = _rows(sent["q"], dims), sent["query_id"].to_numpy()
            limit = sent["tau"].to_numpy() ** 2
            apart = _apart(q, sent_centres.value)
            if apart.shape[1] >= n:
                # the n-th nearest pivot is no nearer than the n-th nearest vector
                nth = np.partition(apart, n - 1, 1)[:, n - 1] + np.sqrt(_slack(np.maximum((q**2).sum(1), (sent_centres.value**2).sum(1).max()), dims))
                limit = np.fmin(limit, nth**2 + ROOM)
            at, pattern, square, cost = _block_best(_distinct(block, n, dims), q, limit, sent_centres.value, n)
            columns = [ids[at], pattern, square], ids, cost
        hits, asking, cost = columns
        none = lambda rows, kind: pa.nulls(len(rows), kind)
        one, two = [*map(pa.array, hits), none(hits[0], pa.int64())], [pa.array(asking), none(asking, pa.int64()), none(asking, pa.float64()), pa.array(cost)]
        return pa.table([pa.chunked_array(c) for c in zip(one, two, strict=True)], names=["query_id", "pattern_id", "square", "computed"])

    def visit(going: DataFrame) -> DataFrame:
        needed = going.select(F.explode("blocks").alias("block"), "pack").distinct()
        met = blocked.join(needed, "block").select("block", "pack", "pattern_id", "v", "ball", "r")
        sent = going.select(F.explode("blocks").alias("q_block"), F.col("pack").alias("q_pack"), "query_id", "q", "tau")
        return materialize(met.groupBy("block", "pack").cogroup(sent.groupBy("q_block", "q_pack")).applyInArrow(measure, shape), "measured")

    own = visit(asked.select("query_id", "q", "pack", F.lit(float("inf")).alias("tau"), F.array("home").alias("blocks")))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("square"))
    # the n-th best so far, rounded up; a query whose block holds fewer looks everywhere
    nth = own.where("pattern_id is not null").withColumn("rank", rank).where(F.col("rank") == n).select("query_id", F.sqrt(F.col("square") + ROOM).alias("tau"))
    others = asked.join(nth, "query_id", "left").select("query_id", "q", "home", "pack", F.coalesce("tau", F.lit(float("inf"))).alias("tau"))
    return own.unionByName(visit(materialize(others.mapInArrow(visits, f"query_id long, q {kind}, pack int, tau double, blocks array<int>"), "visits")))


def nearest(queries: DataFrame, vectors: DataFrame, n: int = 5, **settings) -> DataFrame:
    """The ``n`` nearest of ``vectors(pattern_id, embedding)`` for each of ``queries(query_id, embedding)``: ``(query_id, pattern_id,
    distance, rank)``, the distance being squared and rounded to PLACES; ties go to the smaller id.

    Ids are longs and queries differ in theirs. Vectors that are null, hold a null or non-finite component or are not as long as
    the longest query take no part, as queries or as hits; a query that is among the vectors finds itself. An empty table gives
    an empty table.
    """
    rows = ball_search(queries, vectors, n, **settings).where("pattern_id is not null").select("query_id", "pattern_id", F.round("square", PLACES).alias("distance"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "pattern_id"))).where(F.col("rank") <= n)


def search_work(found: DataFrame) -> DataFrame:
    """``(query_id, computed)``: how many distances each query of :func:`ball_search` has cost."""
    return found.groupBy("query_id").agg(F.sum("computed").alias("computed"))
