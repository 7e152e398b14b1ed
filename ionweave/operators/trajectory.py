"""Spatial trajectories: projection on a polyline and feature trends along it."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import AnalysisError
from ..model import MatrixBundle, check_rows, not_finite, require, whole


def path_segments(path: list[tuple[float, float]]) -> list[tuple[float, float, float, float, float, float]]:
    """(x0, y0, dx, dy, length, start) per segment; at least two finite points, none repeated in a row."""
    points = [(float(x), float(y)) for x, y in path]
    if len(points) < 2 or not all(math.isfinite(v) for p in points for v in p):
        raise AnalysisError("a path needs at least two finite points")
    out, start = [], 0.0
    for (x0, y0), (x1, y1) in zip(points, points[1:]):
        length = math.hypot(x1 - x0, y1 - y0)
        if length == 0:
            raise AnalysisError("a path must not repeat a point")
        out.append((x0, y0, x1 - x0, y1 - y0, length, start))
        start += length
    return out


def project_points(points: DataFrame, path: list[tuple[float, float]]) -> DataFrame:
    """``points(x, y)`` with trajectory_position in [0, 1] and trajectory_distance.

    The path's segments are literals, so every row is projected inside one
    expression without a join; the nearest segment wins, ties go to the first.
    """
    segments = path_segments(path)
    total = segments[-1][4] + segments[-1][5]

    def candidate(k: int, s: tuple):
        x0, y0, dx, dy, length, start = s
        t = ((F.col("x") - x0) * dx + (F.col("y") - y0) * dy) / (length * length)
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
        d = F.hypot(F.col("x") - (x0 + t * dx), F.col("y") - (y0 + t * dy))
        return F.struct(d.alias("d"), F.lit(k).alias("k"), ((start + t * length) / total).alias("p"))

    best = F.array_min(F.array(*[candidate(k, s) for k, s in enumerate(segments)]))
    return points.withColumn("_b", best).withColumns({"trajectory_position": F.col("_b.p"), "trajectory_distance": F.col("_b.d")}).drop("_b")


def project_points_exact(points: DataFrame, path: list[tuple[float, float]]) -> DataFrame:
    """As ``project_points`` in long doubles, and distances within rounding error tie: the earlier segment stays."""
    segments = path_segments(path)
    total = np.longdouble(segments[-1][4] + segments[-1][5])
    eps = np.finfo(np.longdouble).eps

    @F.pandas_udf("struct<p double, d double>")
    def run(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        px, py = x.to_numpy(np.longdouble), y.to_numpy(np.longdouble)
        best, place, slack = np.full(len(px), np.inf, np.longdouble), np.zeros(len(px), np.longdouble), np.zeros(len(px), np.longdouble)
        for x0, y0, dx, dy, length, start in segments:
            qx, qy = px - x0, py - y0
            t = np.clip((qx * dx + qy * dy) / (np.longdouble(dx) ** 2 + np.longdouble(dy) ** 2), 0, 1)
            d = np.hypot(qx - t * dx, qy - t * dy)
            bound = 16 * eps * (np.abs(qx) + np.abs(qy) + abs(dx) + abs(dy))
            better = d < best - np.maximum(bound, slack)
            best, slack = np.where(better, d, best), np.where(better, bound, slack)
            place = np.where(better, start + t * np.longdouble(length), place)
        return pd.DataFrame({"p": np.clip(place / total, 0, 1).astype(float), "d": best.astype(float)})

    return points.withColumn("_b", run("x", "y")).withColumns({"trajectory_position": F.col("_b.p"), "trajectory_distance": F.col("_b.d")}).drop("_b")


def fit_trajectory(bundle: MatrixBundle, path: list[tuple[float, float]], exact: bool = True) -> MatrixBundle:
    require(bundle.obs, ["x", "y"], AnalysisError, "obs")
    check_rows(bundle.obs, {"coordinates must be finite": not_finite(F.col("x")) | not_finite(F.col("y"))}, AnalysisError)
    obs = (project_points_exact if exact else project_points)(bundle.obs, path)
    return MatrixBundle(obs, bundle.var, bundle.x, dict(bundle.layers), {**bundle.meta, "trajectory": {"path": [list(map(float, p)) for p in path]}})


def _basis(x: np.ndarray, knots: np.ndarray, degree: int = 3) -> np.ndarray:
    """B-spline basis by the Cox-de Boor recursion."""
    b = ((x[:, None] >= knots[None, :-1]) & (x[:, None] < knots[None, 1:])).astype(float)
    last = np.flatnonzero(knots[:-1] < knots[1:])[-1]
    b[x >= knots[-1], last] = 1.0
    for d in range(1, degree + 1):
        n = len(knots) - d - 1
        out = np.zeros((len(x), n))
        for i in range(n):
            left, right = knots[i + d] - knots[i], knots[i + d + 1] - knots[i + 1]
            if left > 0:
                out[:, i] += (x - knots[i]) / left * b[:, i]
            if right > 0:
                out[:, i] += (knots[i + d + 1] - x) / right * b[:, i + 1]
        b = out
    return b


#: Inner knots of a trend, and the smoothing parameters tried.
INNER, SMOOTHING = 8, np.logspace(-4, 4, 17)


def _knots(inner: int = INNER) -> np.ndarray:
    return np.concatenate([[0] * 3, np.linspace(0, 1, inner), [1] * 3])


def fit_sums(bb: np.ndarray, by: np.ndarray, yy: float, n: int, grid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Penalised cubic spline from B'B, B'y and y'y; smoothing chosen by generalised cross-validation.

    Fit and 95 % prediction band on ``grid``.  The effective degrees of freedom are
    the trace of (B'B + lP)^-1 B'B, so nothing has the length of the data.
    """
    fitted, low, high = fit_many(bb, np.asarray(by, float)[None, :], np.array([yy], float), n, grid)
    return fitted[0], low[0], high[0]


def fit_many(bb: np.ndarray, by: np.ndarray, yy: np.ndarray, n: int, grid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``fit_sums`` of one feature per row of ``by``: each smoothing is inverted once for all of them."""
    penalty = np.diff(np.eye(len(bb)), 2, axis=0)
    penalty = penalty.T @ penalty
    g = _basis(grid, _knots())
    best = np.full(len(by), np.inf)
    fitted, sigma2, spread = np.zeros((len(by), len(grid))), np.zeros(len(by)), np.zeros((len(by), len(grid)))
    for k, lam in enumerate(SMOOTHING):
        inverse = np.linalg.pinv(bb + lam * penalty)
        beta = by @ inverse.T
        free = max(n - np.trace(inverse @ bb), 1e-6)
        rss = np.maximum(yy - 2 * (beta * by).sum(1) + ((beta @ bb) * beta).sum(1), 0.0)
        score = n * rss / free**2
        better = score < best if k else np.ones(len(by), bool)
        best[better], sigma2[better] = score[better], rss[better] / free
        fitted[better], spread[better] = beta[better] @ g.T, np.einsum("ij,jk,ik->i", g, inverse, g)
    half = 1.959963984540054 * np.sqrt(np.maximum(sigma2[:, None] * (1 + spread), 0))
    return fitted, fitted - half, fitted + half


def smooth_trend(position: np.ndarray, value: np.ndarray, grid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``fit_sums`` of data in memory."""
    b = _basis(position, _knots())
    return fit_sums(b.T @ b, b.T @ value, float(value @ value), len(value), grid)


def trend_sums(obs: DataFrame, x: DataFrame) -> tuple[np.ndarray, int, DataFrame]:
    """(B'B, observations, (feature_id, by array, yy)): all that the trends of ``x`` need.

    B'B is the same for every feature.  Zeros add nothing to B'y and y'y, so only
    the values stored are joined, and their products are summed before the shuffle.
    """
    knots = _knots()
    size = len(knots) - 4

    @F.pandas_udf("array<double>")
    def basis(position: pd.Series) -> pd.Series:
        return pd.Series(list(_basis(position.to_numpy(float), knots)))

    spread = obs.select("obs_id", basis(F.col("trajectory_position").cast("double")).alias("_b"))
    pairs = [(i, j) for i in range(size) for j in range(i + 1)]
    row = spread.agg(F.count("*").alias("n"), *[F.sum(F.get("_b", F.lit(i)) * F.get("_b", F.lit(j))).alias(f"_{i}_{j}") for i, j in pairs]).first()
    bb = np.zeros((size, size))
    for i, j in pairs:
        bb[i, j] = bb[j, i] = row[f"_{i}_{j}"] or 0.0
    sums = x.join(spread, "obs_id").groupBy("feature_id").agg(
        F.array(*[F.sum(F.col("value") * F.get("_b", F.lit(i))) for i in range(size)]).alias("by"), F.sum(F.col("value") * F.col("value")).alias("yy")
    )
    return bb, row.n, sums


def feature_trends(bundle: MatrixBundle, features: list[str] | None = None, points: int = 100, layer: str | None = None) -> DataFrame:
    """(feature, position, fitted, lower, upper) on an even grid, of ``bundle.matrix(layer)``; all features or those named.

    A feature without values has the trend 0.  What is fitted per feature is a few
    sums, whatever the number of observations.
    """
    whole("points", points, AnalysisError, low=2)
    require(bundle.obs, ["trajectory_position"], AnalysisError, "obs")
    wanted = F.lit(True) if features is None else F.col("feature_id").isin(features)
    if features is not None:
        if not features or len(set(features)) != len(features):
            raise AnalysisError("features must be given and distinct")
        known = {r.feature_id for r in bundle.var.where(wanted).select("feature_id").collect()}  # the features named by the caller
        if missing := [f for f in features if f not in known]:
            raise AnalysisError(f"unknown features: {missing}")
    placed = F.coalesce(F.col("trajectory_position").between(0, 1), F.lit(False))
    row = bundle.obs.agg(F.count_distinct("trajectory_position").alias("n"), F.count_if(~placed).alias("bad")).first()
    if row.n < 2 or row.bad:
        raise AnalysisError("trends need at least two distinct positions within [0, 1]")
    bb, n, sums = trend_sums(bundle.obs, bundle.matrix(layer).where(wanted))
    every = bundle.var.where(wanted).select("feature_id").join(sums, "feature_id", "left")

    def fit(parts):
        at = np.linspace(0, 1, points)
        for pdf in parts:
            if pdf.empty:
                continue
            by = np.array([np.zeros(len(bb)) if b is None else b for b in pdf.by], float)
            fitted, low, high = fit_many(bb, by, pdf.yy.fillna(0.0).to_numpy(float), n, at)
            yield pd.DataFrame({"feature": np.repeat(pdf.feature_id.astype(str).to_numpy(), points), "position": np.tile(at, len(pdf)), "fitted": fitted.ravel(), "lower": low.ravel(), "upper": high.ravel()})

    return every.mapInPandas(fit, "feature string, position double, fitted double, lower double, upper double")
