"""Row-against-row work in blocks: vectors meet block by block, never as a cross join of rows.

Every vector goes to one of a few tiles; a unit is a pair of tiles, which its task
works block by block, so a matrix of distances never exceeds a pair of blocks and the
rows shuffled are those of the tiles, not of the blocks.  What leaves a unit is the
caller's reduction (best k, sums per group), or all pairs where the pairs are the result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import AnalysisError

#: Vectors per block, most blocks of a tile, and the number of tiles up to which a tile is one block.
BLOCK, WIDE, FEW = 2000, 16, 8
#: Where the pairs are the result: vectors per tile at first, so that small tables have several; numbers
#: of a tile's vectors at most; and units a core, so that tiles are no more, and no less, than keep all busy.
SMALL, LARGE, UNITS = 1000, 1 << 21, 3
#: Most partitions of units.
PARTS = 20_000
#: Pairs of a listed run: so many rows (i, j) of one i, then their (j, i); j whose distances are computed
#: at once, in whole runs; and pairs that leave a task at once.
RUN, STRIP, LISTED = 32, 512, 1 << 17
#: Pairs whose exact distances a task computes at once.
RECHECK = 1 << 18
#: Numbers of dense rows that a task fills at once.
CELLS = 1 << 20
#: Columns that give a row's first bound when nearest ones are sought.
FIRST = 256


def _safe(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.divide(a, b, out=np.zeros_like(a), where=b != 0)


def _each(a, b, f):
    """f(rows of a minus-like pairing) per row of a, bounded to one row's worth of memory."""
    return np.stack([f(row[None, :], b) for row in a]) if len(a) else np.zeros((0, len(b)))


def _sq(a, b):
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0)


def _cosine(a, b):
    na, nb = np.sqrt((a * a).sum(1)), np.sqrt((b * b).sum(1))
    return np.maximum(1 - _safe(a @ b.T, np.outer(na, nb)), 0)


METRICS = {
    "euclidean": lambda a, b: _each(a, b, lambda x, y: np.sqrt(((x - y) ** 2).sum(1))),
    "sqeuclidean": lambda a, b: _each(a, b, lambda x, y: ((x - y) ** 2).sum(1)),
    "manhattan": lambda a, b: _each(a, b, lambda x, y: np.abs(x - y).sum(1)),
    "chebyshev": lambda a, b: _each(a, b, lambda x, y: np.abs(x - y).max(1)),
    "cosine": _cosine,
    "correlation": lambda a, b: _cosine(a - a.mean(1, keepdims=True), b - b.mean(1, keepdims=True)),
    "canberra": lambda a, b: _each(a, b, lambda x, y: _safe(np.abs(x - y), np.abs(x) + np.abs(y)).sum(1)),
    "braycurtis": lambda a, b: _each(a, b, lambda x, y: _safe(np.abs(x - y).sum(1), np.abs(x + y).sum(1))),
}


def vectors(x: DataFrame, obs: DataFrame, var: DataFrame) -> DataFrame:
    """(obs_id, obs_ord, vec): dense rows in feature order; implicit zeros filled."""
    n = var.count()
    row = x.join(var.select("feature_id", "feature_ord"), "feature_id").groupBy("obs_id").agg(F.collect_list(F.struct(F.col("feature_ord").cast("long").alias("at"), F.col("value").cast("double").alias("value"))).alias("cells"))
    rows = obs.select("obs_id", "obs_ord").join(row, "obs_id", "left")

    def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, CELLS // max(1, n))
        for whole in batches:
            for batch in (whole.slice(at, step) for at in range(0, whole.num_rows, step)):
                cells = batch.column(2)
                lengths = pc.fill_null(pc.list_value_length(cells), 0).to_numpy(zero_copy_only=False)
                cells = cells.flatten()
                at, value = (cells.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
                m = np.zeros((batch.num_rows, n))
                m[np.repeat(np.arange(len(m)), lengths), at] = value
                vec = pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * n, pa.int32()), pa.array(m.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), vec], ["obs_id", "obs_ord", "vec"])

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("obs_id", "obs_ord"))
    return rows.mapInArrow(dense, f"{kinds}, vec array<double>")


def block_pairs(points: DataFrame, work, schema: str, n_points: int | None = None, dealt_by: tuple[Column, int] | None = None, once: bool = False) -> DataFrame:
    """``work(left, right)`` on pandas frames of every ordered pair of tiles, neither empty; it yields frames.

    Tiles are dealt by ``obs_id`` and hold about ``WIDE`` blocks at most, unless ``dealt_by`` gives (the tile of a row, tiles).
    ``once``: of two tiles one order only, a tile with itself as one frame twice; few units share a partition.
    """
    if dealt_by:
        own, tiles = dealt_by[0].cast("int"), dealt_by[1]
    else:
        n = points.count() if n_points is None else n_points
        tiles = max(1, min(math.ceil(n / BLOCK), FEW), math.ceil(n / (BLOCK * WIDE)))
        own = F.pmod(F.xxhash64("obs_id"), F.lit(tiles)).cast("int")
    every = F.sequence(F.lit(0), F.lit(tiles - 1))
    # each row goes to the units of its tile on the left and on the right, tagged by side
    sides = points.select("*", own.alias("_own"), F.explode(every).alias("_other"))
    unit = F.array(F.struct(F.col("_own").alias("i"), F.col("_other").alias("j"), F.lit(True).alias("left")), F.struct(F.col("_other").alias("i"), F.col("_own").alias("j"), F.lit(False).alias("left")))
    dealt = sides.withColumn("_unit", F.explode(unit)).select(*points.columns, F.col("_unit.i").alias("_i"), F.col("_unit.j").alias("_j"), F.col("_unit.left").alias("_left"))
    if once:
        # a number of its own: units are much work on few bytes, which adaptive execution would coalesce
        dealt = dealt.where("_i < _j OR _i = _j AND _left").repartition(min(tiles * (tiles + 1), PARTS), "_i", "_j")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(batches), ignore_index=True)
        left, own = pdf["_left"].to_numpy(bool), pdf["_i"].iat[0] == pdf["_j"].iat[0]
        pdf = pdf.drop(columns=["_i", "_j", "_left"])
        if once and own:
            yield from work(pdf, pdf)
        elif left.any() and not left.all():
            yield from work(pdf[left], pdf[~left])

    return dealt.groupBy("_i", "_j").applyInPandas(run, schema)


def cuts(n: int) -> list[slice]:
    """The blocks of a tile of ``n`` rows."""
    return [slice(at, min(at + BLOCK, n)) for at in range(0, n, BLOCK)]


class Screen:
    """Distances of two tiles, block by block.

    Euclidean ones come from inner products: squared, and at most ``slack`` off for a row of
    ``a``; ``exact`` gives chosen pairs by the definition.  Other metrics are exact at once.
    """

    def __init__(self, name: str, a: np.ndarray, b: np.ndarray):
        self.name, self.a, self.b, self.f = name, a, b, metric(name)
        self.fast = name in ("euclidean", "sqeuclidean")
        if self.fast:
            self.na, self.nb = (a * a).sum(1)[:, None], (b * b).sum(1)[:, None]
            # |x|^2 + |y|^2 - 2 xy as one product
            self.left, self.right = np.hstack([-2 * a, self.na, np.ones_like(self.na)]), np.hstack([b, np.ones_like(self.nb), self.nb])

    def block(self, p: slice, q: slice) -> tuple[np.ndarray, np.ndarray]:
        if not self.fast:
            return self.f(self.a[p], self.b[q]), np.zeros(p.stop - p.start)
        return self.left[p] @ self.right[q].T, 1e-15 * (self.a.shape[1] + 8) * (self.na[p, 0] + self.nb[q].max())

    def exact(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Of pairs of rows, ``name`` being fast."""
        parts = [((self.a[i[at : at + RECHECK]] - self.b[j[at : at + RECHECK]]) ** 2).sum(1) for at in range(0, len(i), RECHECK)]
        d = np.concatenate(parts) if parts else np.zeros(0)
        return np.sqrt(d) if self.name == "euclidean" else d

    def distances(self, p: slice, q: slice) -> np.ndarray:
        """All of a pair of blocks; those that inner products give few digits of by the definition."""
        s, slack = self.block(p, q)
        if not self.fast:
            return s
        i, j = np.divmod(np.flatnonzero(s <= 1e7 * slack[:, None]), s.shape[1])
        if self.name == "euclidean":
            np.sqrt(np.maximum(s, 0, out=s), out=s)
        s[i, j] = self.exact(i + p.start, j + q.start)
        return s


def nearest_rows(name: str, a: np.ndarray, b: np.ndarray, same, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows of ``a``, rows of ``b``, distance): the k nearest of every row, ties by the place in ``b``.

    ``same(p, q)`` marks the pairs of two blocks that do not count, or is None.
    """
    screen = Screen(name, a, b)
    for p in cuts(len(a)):
        rows, at, dist = np.zeros(0, int), np.zeros(0, int), np.zeros(0)
        limit = np.full(p.stop - p.start, np.inf)
        for q in cuts(len(b)):
            s, slack = screen.block(p, q)
            if same is not None:
                s[same(p, q)] = np.inf
            few, open_ = min(k, s.shape[1]), np.flatnonzero(np.isinf(limit))
            bound = limit + 2 * slack
            if len(open_) and few == k:
                part = s[open_, : max(k, FIRST)]  # the k-th of some is a bound for all
                bound[open_] = np.partition(part, k - 1, axis=1)[:, k - 1] + 2 * slack[open_]
            i, j = np.divmod(np.flatnonzero(s <= bound[:, None]), s.shape[1])
            d = screen.exact(i + p.start, j + q.start) if screen.fast else s[i, j]
            if same is not None and screen.fast:
                d = np.where(np.isinf(s[i, j]), np.inf, d)
            keep = np.isfinite(d)
            rows, at, dist = np.concatenate([rows, i[keep]]), np.concatenate([at, j[keep] + q.start]), np.concatenate([dist, d[keep]])
            order = np.lexsort((at, dist, rows))
            rows, at, dist = rows[order], at[order], dist[order]
            rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
            rows, at, dist, rank = rows[rank < k], at[rank < k], dist[rank < k], rank[rank < k]
            limit[rows[rank == k - 1]] = dist[rank == k - 1] ** (2 if name == "euclidean" else 1)
        yield rows + p.start, at, dist


def matrix(pdf: pd.DataFrame) -> np.ndarray:
    return np.array(pdf.vec.tolist(), float).reshape(len(pdf), -1)


def metric(name: str):
    if name not in METRICS:
        raise AnalysisError(f"metric must be one of {', '.join(sorted(METRICS))}")
    return METRICS[name]


def _runs(n: int) -> list[tuple[slice, int]]:
    """(strip, its run) of ``n`` rows: strips of whole runs, then what is left as a shorter run."""
    whole = n - n % RUN
    out = [(slice(at, min(at + STRIP, whole)), RUN) for at in range(0, whole, STRIP)]
    return out + [(slice(whole, n), n - whole)] * (whole < n)


def _as_sql(x: np.ndarray, digits: int) -> np.ndarray:
    """``round(x, digits)`` of non-negative doubles as the SQL computes it: scaled, rounded half up, scaled back."""
    with np.errstate(invalid="ignore", over="ignore"):
        y = x * 10.0**digits
        whole = np.floor(y)
        whole += y - whole >= 0.5
    whole /= 10.0**digits
    return np.where(np.isfinite(whole), whole, x)


def _tiled(points: DataFrame) -> tuple[DataFrame, int, int]:
    """(points, their number, tiles to deal them to) for all pairs.

    A vector is shuffled once per tile.  Tiles grow with the table up to ``LARGE`` numbers, as a task keeps two of them
    and works strip by strip, so their number stays as ``UNITS`` asks for.  Vectors of single precision are sent as such.
    """
    single = F.transform("vec", lambda v: v.cast("float"))
    row = points.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("wide"), F.every(F.transform(single, lambda v: v.cast("double")) == F.col("vec")).alias("single")).first()
    busy = math.ceil(math.sqrt(2 * UNITS * points.sparkSession.sparkContext.defaultParallelism))
    tiles = max(1, min(math.ceil(row.n / SMALL), max(FEW, busy)), math.ceil(row.n * max(1, row.wide or 0) / LARGE))
    return points.withColumn("vec", single) if row.single else points, row.n, tiles


def pairwise(points: DataFrame, name: str = "euclidean", digits: int | None = None) -> DataFrame:
    """(i, j, distance) of all ordered pairs i <> j, rounded if ``digits`` are given: for tables whose square is wanted.

    A distance is computed once for both orders.  ``RUN`` rows (i, j) of one i are followed by their (j, i):
    a Parquet page then holds every run of distances twice, near enough for its compression to store it once.
    What is shuffled grows with the vectors, not with their pairs, until tiles reach ``LARGE``.
    """
    f = metric(name)
    points, n, tiles = _tiled(points.select("obs_id", "vec"))

    def work(left: pd.DataFrame, right: pd.DataFrame) -> Iterator[pd.DataFrame]:
        own = right is left
        a, i = matrix(left), left.obs_id.to_numpy()
        b, j = (a, i) if own else (matrix(right), right.obs_id.to_numpy())
        for q, run in _runs(len(b)):
            step = max(1, LISTED // (q.stop - q.start))
            for p in range(0, q.stop if own else len(a), step):
                d = f(a[p : p + step], b[q])
                if digits is not None:
                    d = _as_sql(d, digits)
                d = d.reshape(len(d), -1, run)
                ours, theirs = np.broadcast_to(i[p : p + step, None, None], d.shape), np.broadcast_to(j[q].reshape(1, -1, run), d.shape)
                out = [np.stack(x, 2).ravel() for x in ((ours, theirs), (theirs, ours), (d, d))]
                if own:  # every pair from its earlier row
                    earlier = np.arange(p, p + len(d))[:, None, None] < np.arange(q.start, q.stop).reshape(1, -1, run)
                    keep = np.stack((earlier, earlier), 2).ravel() & (out[0] != out[1])
                    out = [x[keep] for x in out]
                yield pd.DataFrame(dict(zip(("i", "j", "distance"), out, strict=True)), copy=False)

    kind = points.schema["obs_id"].dataType.simpleString()
    own = F.pmod(F.xxhash64("obs_id"), F.lit(tiles))
    return block_pairs(points, work, f"i {kind}, j {kind}, distance double", n, (own, tiles), once=True)
