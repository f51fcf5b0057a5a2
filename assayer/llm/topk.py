"""Exact top-k inner products: norm-sorted candidates, SVD-rotated partial sums.

Candidates are dealt into bands of descending length, and a band into cells of bounded
bytes.  A query's k-th best product among the ``LONGEST_BYTES`` of longest vectors is a floor
under its result; it meets only the cells of bands whose longest vector can
still reach the floor, length times length.  A cell sorts its candidates by descending length
and rotates them onto their singular directions, so that the first
coordinates hold most of every product.  Block by block, a query first asks the same of
lengths, then adds partial sums, ``STEP_DIMS`` coordinates at a time, and the Cauchy-Schwarz
bound of the residual; after each step queries and candidates that are left without an open
pair drop out.  Only pairs that pass all steps count as exact products, which
are integers below 2**53 in float64, so exact.  Bounds carry a slack above the rounding
error, so nothing that belongs to the result is pruned.

The work is queries times candidates where lengths are alike and bounds don't tell vectors
apart, as for random directions; cells then hold it to products of blocks.

Defined cases: a vector that is null, empty or holds null or non-finite
components, or has no id, takes no part; products exist between vectors of the
same dimension only; a vector of any dimension fits a cell, of more than ``TURNED`` it is not
rotated but its coordinates are sorted by weight; vectors with components beyond what float64 multiplies
exactly are multiplied with Python's integers, the others of their cell are not; a repeated id
counts once, with its best score; equal scores go to the smaller id; fewer than
k candidates give fewer rows; products outside 64 bits saturate; an empty
table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.llm.common import keep, map_slices, release, ship

SCALE = 256
#: Coordinates of a partial sum's step, candidates of a block, the widest vectors that are rotated.
STEP_DIMS, STEP, TURNED = 16, 256, 1024
#: Bytes of integers meant for one cell's candidates, its queries, and the longest vectors that every query meets first.
CELL_BYTES, QUERY_BYTES, LONGEST_BYTES = 24 << 20, 4 << 20, 1 << 18
#: Bands of lengths at most, cells of candidates at least.
BANDS, LEAST_CELLS = 1024, 32
LOW = np.iinfo(np.int64).min
RESULT = "query_id long, vec_id long, score long"


def integers(vector: Column) -> Column:
    """floor(SCALE * x) of every component as long; null if the vector takes no part."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    sound = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(sound & (F.size(wide) > 0), F.transform(wide, lambda x: F.floor(x * SCALE).cast("long")))


def _merge(best: dict[int, int], found: dict[int, int], k: int) -> dict[int, int]:
    """The k best of both, ties to the smaller id."""
    for i, s in found.items():
        best[i] = max(best.get(i, LOW), s)
    return dict(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k]) if len(best) > k else best


def _plain(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> list[dict[int, int]]:
    """Every product with Python's integers, saturated at 64 bits: by query, its k best."""
    out = []
    wide = vectors.astype(object)
    for qid, q in zip(query_ids.tolist(), queries.astype(object)):
        found: dict[int, int] = {}
        for at in range(0, len(wide), STEP):
            scores = wide[at : at + STEP] @ q
            for i, s in zip(ids[at : at + STEP].tolist(), scores):
                if i != qid:
                    found[i] = max(found.get(i, LOW), max(LOW, min(-1 - LOW, int(s))))
            found = _merge(found, {}, k)
        out.append(found)
    return out


def _axes(real: np.ndarray) -> np.ndarray | None:
    """The right singular vectors, the strongest first; None where there are too many coordinates for that."""
    return np.linalg.eigh(real.T @ real)[1][:, ::-1] if real.shape[1] <= TURNED else None


def _pruned(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int, floors: np.ndarray, tally: list[int]) -> list[dict[int, int]]:
    """By query, its k best of at least its floor among vectors with ids of their own, all products below 2**53."""
    real, asked_real = vectors.astype(np.float64), queries.astype(np.float64)
    lengths = np.sqrt((real**2).sum(1))
    order = np.lexsort((ids, -lengths))
    ids, real, lengths = ids[order], real[order], lengths[order]
    dim = real.shape[1]
    axes = _axes(real)
    if axes is None:
        heavy = np.argsort(-(real**2).sum(0), kind="stable")
        turned, asked = real[:, heavy], asked_real[:, heavy]
    else:
        turned, asked = real @ axes, asked_real @ axes
    spans = [(a, min(dim, a + STEP_DIMS)) for a in range(0, dim, STEP_DIMS)]
    rest, q_rest = ([np.sqrt((x[:, end:] ** 2).sum(1)) for _, end in spans] for x in (turned, asked))
    q_length = np.sqrt((asked_real**2).sum(1))
    best: list[dict[int, int]] = [{} for _ in queries]
    floor = floors.astype(np.float64).copy()
    for at in range(0, len(real), STEP):
        slack = 1e-9 * q_length * lengths[at] * dim + 1e-6
        rows = np.flatnonzero(q_length * lengths[at] + slack >= floor)
        if not len(rows):
            break
        cols = np.arange(at, min(at + STEP, len(real)))
        partial = np.zeros((len(rows), len(cols)))
        for step, (a, b) in enumerate(spans):
            partial += asked[rows, a:b] @ turned[cols, a:b].T
            bound = partial + q_rest[step][rows, None] * rest[step][None, cols] + slack[rows, None]
            open_ = (bound >= floor[rows, None]) & (query_ids[rows, None] != ids[None, cols])
            left, right = open_.any(1), open_.any(0)
            if not left.all() or not right.all():
                rows, cols = rows[left], cols[right]
                partial, open_ = partial[np.ix_(left, right)], open_[np.ix_(left, right)]
            if not len(rows):
                break
        if not len(rows):
            continue
        tally[0] += int(open_.sum())
        scores = asked_real[rows] @ real[cols].T
        open_ &= scores >= floor[rows, None]
        for i in np.flatnonzero(open_.any(1)).tolist():
            own = np.flatnonzero(open_[i])
            q = int(rows[i])
            best[q] = _merge(best[q], {int(ids[cols[j]]): int(scores[i, j]) for j in own.tolist()}, k)
            if len(best[q]) == k:
                floor[q] = max(floor[q], min(best[q].values()))
    return best


def search(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int, floors: np.ndarray | None = None, tally: list[int] | None = None) -> list[tuple[int, int, int]]:
    """Rows (query, id, score): each query's k best in ``vectors``; some below its floor may be left out.

    A floor is a score that k other ids reach.  ``tally[0]`` grows by the number of exact products.
    """
    if not len(queries) or not len(vectors):
        return []
    tally = [0] if tally is None else tally
    floors = np.full(len(queries), -np.inf) if floors is None else floors
    safe = math.isqrt((1 << 53) // queries.shape[1]) - 1
    within = [(x >= -safe).all(1) & (x <= safe).all(1) for x in (queries, vectors)]
    best: list[dict[int, int]] = [{} for _ in queries]

    def join(rows: np.ndarray, found: list[dict[int, int]]) -> None:
        for q, own in zip(rows.tolist(), found, strict=True):
            best[q] = _merge(best[q], own, k)

    small = np.flatnonzero(within[0])
    # Each layer has an id once; a floor holds for every layer.
    mine = np.flatnonzero(within[1])
    mine = mine[np.argsort(ids[mine], kind="stable")]
    first = np.ones(len(mine), bool)
    first[1:] = ids[mine][1:] != ids[mine][:-1]
    nth = np.arange(len(mine)) - np.maximum.accumulate(np.where(first, np.arange(len(mine)), 0))
    for layer in range(int(nth.max(initial=-1)) + 1):
        own = mine[nth == layer]
        if len(small):
            join(small, _pruned(query_ids[small], queries[small], ids[own], vectors[own], k, floors[small], tally))
    large = np.flatnonzero(~within[0])
    if len(large):
        join(large, _plain(query_ids[large], queries[large], ids, vectors, k))
    if len(small) and not within[1].all():
        join(small, _plain(query_ids[small], queries[small], ids[~within[1]], vectors[~within[1]], k))
    return [(q, i, s) for q, own in zip(query_ids.tolist(), best, strict=True) for i, s in own.items()]


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    return np.asarray(pa.concat_arrays([c.flatten() for c in chunks]) if chunks else [], np.int64).reshape(-1, dim)


def _with_floors(asking: DataFrame, longest: dict[int, tuple[np.ndarray, np.ndarray]], k: int) -> DataFrame:
    """The queries with the k-th best of their products with the longest vectors, null if they have fewer."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, sizes = np.asarray(batch.column(0), np.int64), np.asarray(pa.compute.list_value_length(batch.column(1)))
            floors: list[int | None] = [None] * len(ids)
            for dim in np.unique(sizes).tolist():
                if dim in longest:
                    own = np.flatnonzero(sizes == dim)
                    queries = _matrix(batch.column(1).take(pa.array(own)), dim)
                    for at, (i, query) in enumerate(zip(ids[own], queries)):
                        found = search(np.array([i]), query[None], *longest[dim], k)
                        if len(found) == k:
                            floors[own[at]] = min(s for *_, s in found)
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(floors, pa.int64())], ["vec_id", "v", "square", "floor"])

        return each

    return map_slices(asking.select("vec_id", "v", "square"), make, "vec_id long, v array<long>, square double, floor long")


def top_k(df: DataFrame, asks: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows for each row where ``asks`` holds (a condition on ``vec_id``)."""
    ship(df.sparkSession)
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), integers(F.col(vector_col)).alias("v")).where("vec_id is not null and v is not null")
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    rows = rows.withColumn("asks", F.coalesce(asks, F.lit(False))).withColumn("square", square)
    count, different, asking, parts = rows.agg(F.count(F.lit(1)), F.countDistinct("vec_id"), F.count_if("asks"), F.coalesce(F.sum(F.size("v")), F.lit(0))).first()
    if count > different:  # a row given twice is one row
        rows = rows.dropDuplicates(["vec_id", "v"])
    width = 8 * max(1, math.ceil(parts / max(1, count)))  # bytes of a vector, on average
    size = max(1, min(CELL_BYTES // width, math.ceil(count / LEAST_CELLS)))
    sets = max(1, math.ceil(asking * width / QUERY_BYTES))

    # Bands by descending length, each with its longest vector and its number of cells.
    n_bands = min(BANDS, max(1, math.ceil(count / size)))
    quantiles = [i / n_bands for i in range(n_bands - 1, 0, -1)]
    bounds = sorted({*(rows.agg(F.percentile_approx("square", quantiles, 10 * BANDS)).first()[0] or [])}, reverse=True) if quantiles else []
    # A vector lies below as many bounds as there are bands before its own.
    band = F.size(F.filter(F.lit(bounds).cast("array<double>"), lambda b: b > F.col("square"))) if bounds else F.lit(0)
    rows = rows.withColumn("band", band)
    known = {r["band"]: r for r in rows.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.max("square").alias("top")).collect()}
    bands = [known[b] for b in sorted(known)]
    cells = [math.ceil(b["n"] / size) for b in bands]
    starts = [sum(cells[:i]) for i in range(len(cells) + 1)]
    if not bands:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    place = F.array_position(F.lit([b["band"] for b in bands]), F.col("band")).cast("int")
    cell = F.element_at(F.lit(starts), place) + F.pmod(F.xxhash64("vec_id", F.lit(2)), F.element_at(F.lit(cells), place))

    # The longest vectors, bounded in bytes, for a floor under every query's k-th best.
    first = rows.select("vec_id", "v").orderBy(F.desc("square"), "vec_id").limit(max(k + 1, LONGEST_BYTES // width)).collect()
    longest = {}
    for dim in {len(r.v) for r in first}:
        own = {r.vec_id: r.v for r in first if len(r.v) == dim}
        longest[dim] = np.array([*own], np.int64), np.array([*own.values()], np.int64)
    asked = keep(_with_floors(rows.where("asks"), longest, k), "queries")
    tops = F.lit([float(b["top"]) for b in bands])
    reach = F.size(F.filter(tops, lambda top: F.col("floor").isNull() | (F.sqrt("square") * F.sqrt(top) * (1 + 1e-9) + 1 >= F.col("floor"))))

    def meet(table: pa.Table) -> pa.Table:
        out = []
        sizes = np.asarray(pa.compute.list_value_length(table.column("v")))
        asks_ = np.asarray(table.column("asking"))
        for dim in np.unique(sizes).tolist():
            own, queries = (table.filter(pa.array((sizes == dim) & (asks_ == side))) for side in (False, True))
            if own.num_rows and queries.num_rows:
                floors = np.array([-np.inf if f is None else float(f) for f in queries.column("floor").to_pylist()])
                slack = np.where(np.isfinite(floors), np.abs(floors) * 1e-12, 0)  # floors beyond 2**53 are rounded
                out += search(np.asarray(queries.column("vec_id"), np.int64), _matrix(queries.column("v"), dim), np.asarray(own.column("vec_id"), np.int64), _matrix(own.column("v"), dim), k, floors - slack)
        release()
        return pa.table({n: pa.array([r[i] for r in out], pa.int64()) for i, n in enumerate(("query_id", "vec_id", "score"))})

    def upto(n: Column) -> Column:
        return F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)

    none = F.lit(None).cast("long")
    candidates = rows.select("vec_id", "v", F.lit(False).alias("asking"), none.alias("floor"), cell.cast("long").alias("g"), F.explode(upto(F.lit(sets))).alias("s"))
    queries = asked.where(reach > 0).select("vec_id", "v", F.lit(True).alias("asking"), "floor", F.explode(upto(F.element_at(F.lit(starts), reach + 1))).alias("g"), F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(sets).cast("long")).alias("s"))
    near = candidates.union(queries).groupBy("g", "s").applyInArrow(meet, RESULT)
    once = near.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
