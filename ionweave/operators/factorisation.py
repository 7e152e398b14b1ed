"""Consensus factorisation: non-negative programmes of features, fitted over blocks of observations.

The matrix of the most variable features, divided by their deviations, lies in
blocks of rows.  The usage of a row follows from the spectra alone (a few sweeps of
coordinate descent from a fixed start), so no state of the rows is kept between
rounds: each round broadcasts the spectra of all replicates still running, sums
W'M and W'W over the blocks through a tree, and updates the spectra from these
sums, whose size is that of the spectra.
"""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import AnalysisError
from ..functions import blocks
from ..model import MatrixBundle, check_rows, number, whole
from ..session import cut
from .variance import top_features

#: Rounds over the blocks at most, and the fall of the error, as a share of the squares, at which a replicate ends.
ITERATIONS, ENOUGH = 60, 1e-5
#: Sweeps of coordinate descent for usages and for spectra, and rows of a block.
SWEEPS, BLOCK = 12, 1000
SPECTRA = "k INT, replicate INT, component INT, spectrum ARRAY<DOUBLE>, error DOUBLE"


def descend(w: np.ndarray, a: np.ndarray, b: np.ndarray, sweeps: int = SWEEPS) -> np.ndarray:
    """Non-negative ``w`` towards the least |M - wH|, given a = MH' and b = HH'; ``w`` is changed."""
    for _ in range(sweeps):
        for c in range(len(b)):
            if b[c, c] > 0:
                w[:, c] = np.maximum(w[:, c] + (a[:, c] - w @ b[:, c]) / b[c, c], 0)
    return w


def usage_of(m: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The usage of the programmes ``h`` by the rows of ``m``."""
    a, b = m @ h.T, h @ h.T
    return descend(np.maximum(a, 0) / (b.sum(1) + 1e-12), a, b)


def start(k: int, features: int, mean: float, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return rng.random((k, features)) * math.sqrt(max(mean, 1e-12) / k) + 1e-6


def _tally(state: dict, row, spectra: dict) -> dict:
    m = np.frombuffer(row["data"]).reshape(row["n"], -1)
    for key, h in spectra.items():
        w = usage_of(m, h)
        a, b = w.T @ m, w.T @ w
        state[key] = (state[key][0] + a, state[key][1] + b) if key in state else (a, b)
    return state


def _merge(a: dict, b: dict) -> dict:
    return a | {k: (a[k][0] + v[0], a[k][1] + v[1]) if k in a else v for k, v in b.items()}


def fit(matrix: DataFrame, cells: list[tuple[int, int]], seed: int) -> list[tuple]:
    """Rows of SPECTRA for ``cells`` of (k, replicate) over ``matrix(obs_ids, n, data)``."""
    size = matrix.agg(F.max(F.octet_length("data") / (8 * F.col("n")))).first()[0]
    if not size:
        raise AnalysisError("factorisation needs observations and variable features")
    sc, features = matrix.sparkSession.sparkContext, int(size)
    rows = matrix.select("n", "data").rdd
    squares, total, n = rows.treeAggregate(
        (0.0, 0.0, 0),
        lambda s, r: (s[0] + float((m := np.frombuffer(r["data"])) @ m), s[1] + float(m.sum()), s[2] + r["n"]),
        lambda a, b: tuple(x + y for x, y in zip(a, b)),
    )
    spectra = {(k, r): start(k, features, total / (n * features), seed + 1000 * k + r) for k, r in cells}
    errors: dict = {}
    running = dict(spectra)
    for last in [False] * (ITERATIONS - 1) + [True]:
        sent = sc.broadcast(running)
        sums = rows.treeAggregate({}, lambda state, row: _tally(state, row, sent.value), _merge)
        sent.unpersist()
        for key, (a, b) in sums.items():
            h = running[key]
            error = max(float(squares - 2 * (h * a).sum() + ((b @ h) * h).sum()), 0.0)
            done = last or errors.get(key, math.inf) - error <= ENOUGH * squares
            errors[key] = error
            if done:
                spectra[key] = running.pop(key)
            else:
                running[key] = descend(h.T.copy(), a.T, b).T
        if not running:
            break
    scaled = {key: h / np.maximum(np.linalg.norm(h, axis=1, keepdims=True), 1e-300) for key, h in spectra.items()}
    return [(k, r, c, row.tolist(), errors[k, r]) for (k, r), h in scaled.items() for c, row in enumerate(h)]


def matrix_blocks(bundle: MatrixBundle, n_features: int) -> tuple[DataFrame, DataFrame]:
    """((obs_ids, n, data), features): rows of the scaled matrix in blocks, and its columns in order."""
    n = bundle.obs.count()
    keep = top_features(bundle.x, bundle.var, n, n_features).where("variance > 0")
    var = cut(keep.select("feature_id", (F.row_number().over(Window.orderBy("feature_ord")) - 1).alias("feature_ord"), F.sqrt("variance").alias("deviation")))  # n_features rows
    scaled = bundle.x.join(F.broadcast(var.select("feature_id", "deviation")), "feature_id").select("obs_id", "feature_id", (F.col("value") / F.col("deviation")).alias("value"))
    dense = blocks.vectors(scaled, bundle.obs, var.drop("deviation")).select("obs_id", "vec")
    kind = bundle.obs.schema["obs_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                m = part.num_rows
                ids = pa.ListArray.from_arrays(pa.array([0, m], pa.int32()), part.column(0))
                data = part.column(1).flatten().to_numpy(zero_copy_only=False).tobytes()
                yield pa.RecordBatch.from_arrays([ids, pa.array([m], pa.int32()), pa.array([data], pa.binary())], ["obs_ids", "n", "data"])

    return dense.mapInArrow(run, f"obs_ids array<{kind}>, n int, data binary"), var


def _grid(components: list[int], n_iter: int, seed: int, worker_index: int, total_workers: int) -> list[tuple[int, int]]:
    for k in components:
        whole("components", k, AnalysisError, low=2)
    whole("n_iter", n_iter, AnalysisError)
    whole("total_workers", total_workers, AnalysisError)
    whole("worker_index", worker_index, AnalysisError, low=0, high=total_workers - 1)
    whole("seed", seed, AnalysisError, low=0, high=2**32 - 1)
    return [(k, r) for k in components for r in range(n_iter)][worker_index::total_workers]


def factorize(bundle: MatrixBundle, components: list[int], n_iter: int = 10, seed: int = 14, n_features: int = 300, worker_index: int = 0, total_workers: int = 1) -> DataFrame:
    """(k, replicate, component, spectrum, error): one factorisation per (k, replicate), all over the same rounds.

    Of several workers, each takes every ``total_workers``-th replicate of the grid.
    """
    cells = _grid(components, n_iter, seed, worker_index, total_workers)
    check_rows(bundle.x, {"factorisation needs non-negative values": F.col("value") < 0}, AnalysisError)
    matrix, _ = matrix_blocks(bundle, n_features)
    return bundle.obs.sparkSession.createDataFrame(fit(cut(matrix), cells, seed) if cells else [], SPECTRA)


# --------------------------------------------------------------------------
# prepared runs


@dataclass(frozen=True)
class PreparedCnmf:
    """A folder with the matrix and settings of a run, which several workers share."""

    path: str
    components: list[int]
    n_iter: int
    seed: int
    n_features: int

    def matrix(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/matrix")

    def features(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/features")


def _new(df: DataFrame, path: str) -> None:
    """Write ``df`` where nothing was written before."""
    try:
        df.write.mode("error").parquet(path)
    except AnalysisException as error:
        if "ALREADY_EXISTS" in (error.getCondition() or ""):
            raise AnalysisError(f"{path} exists; a prepared run is never overwritten") from None
        raise


def prepare_cnmf(bundle: MatrixBundle, path: str, components: list[int], n_iter: int = 10, seed: int = 14, n_features: int = 300) -> PreparedCnmf:
    """Write the scaled matrix, its features and the settings; these come last and mark the run complete."""
    _grid(components, n_iter, seed, 0, 1)
    check_rows(bundle.x, {"factorisation needs non-negative values": F.col("value") < 0}, AnalysisError)
    matrix, features = matrix_blocks(bundle, n_features)
    _new(features, f"{path}/features")
    _new(matrix, f"{path}/matrix")
    run = PreparedCnmf(path, list(components), n_iter, seed, n_features)
    settings = bundle.obs.sparkSession.createDataFrame([(json.dumps({k: v for k, v in asdict(run).items() if k != "path"}),)], "value string")
    _new(settings.coalesce(1), f"{path}/run")
    return run


def load_prepared(spark: SparkSession, path: str) -> PreparedCnmf:
    try:
        text = spark.read.parquet(f"{path}/run").first()
    except AnalysisException:
        text = None
    if text is None:
        raise AnalysisError(f"{path} holds no prepared run")
    return PreparedCnmf(path, **json.loads(text.value))


def factorize_prepared(spark: SparkSession, run: PreparedCnmf, worker_index: int = 0, total_workers: int = 1) -> DataFrame:
    """Fit a worker's replicates and store their spectra, which no other run replaces."""
    cells = _grid(run.components, run.n_iter, run.seed, worker_index, total_workers)
    target = f"{run.path}/spectra/worker={worker_index}-{total_workers}"
    _new(spark.createDataFrame(fit(run.matrix(spark), cells, run.seed) if cells else [], SPECTRA).coalesce(1), target)
    return spark.read.schema(SPECTRA).parquet(target)


def prepared_spectra(spark: SparkSession, run: PreparedCnmf) -> DataFrame:
    """The spectra of all workers; every replicate must be there once."""
    spectra = spark.read.schema(SPECTRA).parquet(f"{run.path}/spectra/*")
    found = sorted((r.k, r.replicate) for r in spectra.where("component = 0").select("k", "replicate").collect())  # a line per replicate
    if found != sorted((k, r) for k in run.components for r in range(run.n_iter)):
        raise AnalysisError("replicates are missing or were fitted twice")
    return spectra


# --------------------------------------------------------------------------
# choice and consensus


def select_k(spectra: DataFrame) -> DataFrame:
    """(k, stability, error): how well replicates' spectra of a k form k groups (mean silhouette), and the mean squared error."""

    def judge(pdf: pd.DataFrame) -> pd.DataFrame:
        k = int(pdf.k.iloc[0])
        s = np.array(pdf.sort_values(["replicate", "component"]).spectrum.tolist())
        own = _kmeans(s, k, 0)[1]
        d = np.sqrt(np.maximum(2 - 2 * s @ s.T, 0))
        values = []
        for i in range(len(s)):
            same = (own == own[i]) & (np.arange(len(s)) != i)
            others = [d[i, own == c].mean() for c in set(own.tolist()) - {own[i]}]
            if same.any() and others:
                a, b = d[i, same].mean(), min(others)
                values.append((b - a) / max(a, b, 1e-300))
            else:
                values.append(0.0)
        return pd.DataFrame({"k": [k], "stability": [float(np.mean(values))], "error": [float(pdf.groupby("replicate").error.first().mean())]})

    return spectra.groupBy("k").applyInPandas(judge, "k int, stability double, error double")

def _kmeans(s: np.ndarray, k: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Centres and labels; starts from the points farthest apart."""
    rng = np.random.default_rng(seed)
    centers = s[[0]]
    while len(centers) < k:
        far = np.min(((s[:, None] - centers[None]) ** 2).sum(2), axis=1)
        centers = np.vstack([centers, s[int(far.argmax())]])
    for _ in range(100):
        own = ((s[:, None] - centers[None]) ** 2).sum(2).argmin(1)
        new = np.stack([s[own == c].mean(0) if (own == c).any() else s[int(rng.integers(len(s)))] for c in range(k)])
        if np.allclose(new, centers):
            break
        centers = new
    return centers, own


def consensus_spectra(spectra: DataFrame, k: int, density_threshold: float = 0.5, seed: int = 14) -> np.ndarray:
    """Medians of the replicates' spectra of ``k``, clustered after outliers are dropped: a row per programme."""
    number("density_threshold", density_threshold, AnalysisError, low=0)
    s = np.array(spectra.where(F.col("k") == k).orderBy("replicate", "component").toPandas().spectrum.tolist())  # k lines per replicate
    if not len(s):
        raise AnalysisError(f"no replicate has k = {k}")
    d = np.sqrt(np.maximum(2 - 2 * s @ s.T, 0))
    near = max(1, int(0.3 * len(s) / k))
    s = s[np.sort(d, axis=1)[:, 1 : near + 1].mean(1) < density_threshold] if len(s) > k else s
    if len(s) < k:
        raise AnalysisError("the density threshold leaves too few spectra")
    centers, own = _kmeans(s, k, seed)
    return np.stack([np.median(s[own == c], axis=0) if (own == c).any() else centers[c] for c in range(k)])


def usages(matrix: DataFrame, h: np.ndarray) -> DataFrame:
    """(obs_id, Usage_1..k) of the programmes ``h`` over ``matrix(obs_ids, n, data)``, most used first; a row's usages sum to 1."""
    kind = matrix.schema["obs_ids"].dataType.elementType.simpleString()
    names = [f"Usage_{i + 1}" for i in range(len(h))]

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                m = np.frombuffer(batch.column(2)[i].as_py()).reshape(batch.column(1)[i].as_py(), -1)
                w = usage_of(m, h)
                w = w / np.where(w.sum(1) == 0, 1, w.sum(1))[:, None]
                yield pa.RecordBatch.from_arrays([batch.column(0)[i].values, *map(pa.array, w.T.copy())], ["obs_id", *names])

    found = cut(matrix.select("obs_ids", "n", "data").mapInArrow(run, f"obs_id {kind}, " + ", ".join(f"{c} double" for c in names)))
    totals = found.agg(*[F.sum(c).alias(c) for c in names]).first()
    order = np.argsort([-(totals[c] or 0.0) for c in names], kind="stable")
    return found.select("obs_id", *[F.col(names[j]).alias(names[i]) for i, j in enumerate(order)])


def consensus_usage(bundle: MatrixBundle, spectra: DataFrame, k: int, density_threshold: float = 0.5, n_features: int = 300, seed: int = 14) -> DataFrame:
    """(obs_id, Usage_1..k): the rows' usage of the consensus programmes, refitted."""
    h = consensus_spectra(spectra, k, density_threshold, seed)
    return usages(matrix_blocks(bundle, n_features)[0], h)


def run_cnmf(bundle: MatrixBundle, components: list[int], k: int, n_iter: int = 10, seed: int = 14, n_features: int = 300, density_threshold: float = 0.5) -> tuple[MatrixBundle, DataFrame]:
    """(bundle whose obs carry the usage of ``k`` programmes, table of stability and error per k)."""
    if k not in components:
        raise AnalysisError("k must be among the components")
    spectra = factorize(bundle, components, n_iter, seed, n_features)
    usage = consensus_usage(bundle, spectra, k, density_threshold, n_features, seed)
    return MatrixBundle(load_usage(bundle.obs, usage), bundle.var, bundle.x, dict(bundle.layers), dict(bundle.meta)), select_k(spectra)


def load_usage(obs: DataFrame, usage: DataFrame) -> DataFrame:
    """``obs`` with the usage columns, aligned by id; ids must match exactly, values be finite and >= 0."""
    columns = [c for c in usage.columns if c != "obs_id"]
    clash = sorted(set(columns) & set(obs.columns))
    if not columns or clash:
        raise AnalysisError(f"usage columns are missing or collide: {clash}")
    typed = usage.select("obs_id", *[F.col(f"`{c}`").try_cast("double").alias(c) for c in columns])
    bad = [F.col(f"`{c}`").isNull() | F.isnan(f"`{c}`") | (F.col(f"`{c}`") < 0) | (F.col(f"`{c}`") == float("inf")) for c in columns]
    check_rows(typed, {"usage values must be finite and non-negative": F.array_contains(F.array(*bad), True)}, AnalysisError)
    check_rows(typed.groupBy("obs_id").count(), {"usage identifiers must be unique": F.col("count") > 1}, AnalysisError)
    both = obs.select("obs_id", F.lit(1).alias("_o")).join(typed.select("obs_id", F.lit(1).alias("_u")), "obs_id", "full")
    check_rows(both, {"usage identifiers must match the observations exactly": F.col("_o").isNull() | F.col("_u").isNull()}, AnalysisError)
    return obs.join(typed, "obs_id")
