"""Feature filters, row normalisation and removal of matrix peaks."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import PreprocessError
from ..functions.joins import UNITS, candidate_pairs
from ..model import MatrixBundle, check_rows, choice, not_finite, number, require

REMOVALS = ("reference", "blank", "denovo")


def check_mz(var: DataFrame) -> None:
    require(var, ["feature_id", "mz"], PreprocessError, "var")
    check_rows(var, {"mz must be numeric, finite and positive": not_finite(F.col("mz")) | (F.col("mz") <= 0)}, PreprocessError)


def occurrence(x: DataFrame) -> DataFrame:
    """(feature_id, n): observations with a non-zero value; stored zeros do not count."""
    return x.where("value <> 0").groupBy("feature_id").agg(F.count("*").alias("n"))


def frequent_features(x: DataFrame, n_obs: int, min_occurrence: float = 0.05) -> DataFrame:
    """Features found in a share of observations strictly above the threshold."""
    number("min_occurrence", min_occurrence, PreprocessError, low=0, high=1)
    return occurrence(x).where(F.try_divide(F.col("n"), F.lit(n_obs)) > F.lit(float(min_occurrence))).select("feature_id")


def _restrict(bundle: MatrixBundle, keep: DataFrame, how: str) -> MatrixBundle:
    layers = {k: v.join(keep, "feature_id", how) for k, v in bundle.layers.items()}
    return replace(bundle, var=bundle.var.join(keep, "feature_id", how), x=bundle.x.join(keep, "feature_id", how), layers=layers)


def filter_features(bundle: MatrixBundle, min_occurrence: float = 0.05) -> MatrixBundle:
    return _restrict(bundle, frequent_features(bundle.x, bundle.obs.count(), min_occurrence), "left_semi")


def normalised(x: DataFrame, method: str = "rms", n_vars: int | None = None) -> DataFrame:
    """Rows divided by their root mean square over all features, or by their total absolute value.

    Zero rows keep factor 1.  The sums are aggregated before the shuffle and
    joined back, so a row is never held in one place.
    """
    choice("method", method, ("rms", "tic", "none"), PreprocessError)
    if method == "none":
        return x.select("obs_id", "feature_id", "value")
    if method == "rms":
        if n_vars is None:
            raise PreprocessError("rms needs the number of features")
        # without features, as after a filter that keeps none, there is no row to divide
        size = F.sqrt(F.sum(F.col("value") * F.col("value")) / F.lit(float(max(n_vars, 1))))
    else:
        size = F.sum(F.abs("value"))
    factor = x.groupBy("obs_id").agg(size.alias("_f"))
    scaled = F.col("value") / F.when(F.col("_f") == 0, F.lit(1.0)).otherwise(F.col("_f"))
    return x.join(factor, "obs_id").select("obs_id", "feature_id", scaled.alias("value"))


def normalize(bundle: MatrixBundle, method: str = "rms", layer: str = "normalized") -> MatrixBundle:
    """The normalised matrix as a layer; ``x`` stays as it is."""
    if not isinstance(layer, str) or not layer:
        raise PreprocessError("layer must be a non-empty string")
    return bundle.with_layer(layer, normalised(bundle.x, method, bundle.var.count() if method == "rms" else None))


def near_reference(var: DataFrame, reference: DataFrame, tolerance: float = 10, unit: str = "ppm") -> DataFrame:
    """Features whose m/z lies within the tolerance (relative to the feature) of some reference m/z."""
    number("tolerance", tolerance, PreprocessError, above=0)
    choice("unit", unit, UNITS, PreprocessError)
    pairs = candidate_pairs(var.select("feature_id", "mz"), reference.select(F.col("mz").alias("ref_mz")), "mz", "ref_mz", tolerance, unit)
    return pairs.select("feature_id").distinct()


def frequent_among(x: DataFrame, members: DataFrame, frequency: float = 0.8) -> DataFrame:
    """Features occurring in a share of ``members(obs_id)`` strictly above ``frequency``."""
    number("matrix_frequency", frequency, PreprocessError, low=0, high=1)
    total = members.agg(F.count("*").alias("_n"))
    found = occurrence(x.join(members.select("obs_id"), "obs_id", "left_semi"))
    return found.crossJoin(F.broadcast(total)).where(F.col("n") / F.col("_n") > F.lit(float(frequency))).select("feature_id")  # one row


def edge_observations(obs: DataFrame) -> DataFrame:
    """Observations at the smallest or largest x or y."""
    box = obs.agg(*[f(c).alias(f"_{n}{c}") for n, f in (("lo", F.min), ("hi", F.max)) for c in ("x", "y")])
    on_edge = reduce(lambda a, b: a | b, [F.col(c) == F.col(f"_{n}{c}") for n in ("lo", "hi") for c in ("x", "y")])
    return obs.crossJoin(F.broadcast(box)).where(on_edge).select("obs_id")  # one row


def remove_matrix_peaks(bundle: MatrixBundle, method: str, reference: DataFrame | None = None, blanks: list[str] | None = None, matrix_frequency: float = 0.8, tolerance: float = 10, unit: str = "ppm") -> tuple[MatrixBundle, DataFrame]:
    """(bundle without matrix peaks, report of feature_id, mz, reason)."""
    choice("method", method, REMOVALS, PreprocessError)
    number("tolerance", tolerance, PreprocessError, above=0)
    number("matrix_frequency", matrix_frequency, PreprocessError, low=0, high=1)
    if method == "reference":
        if reference is None:
            raise PreprocessError("reference removal needs a reference table")
        drop, reason = near_reference(bundle.var, reference, tolerance, unit), "reference_match"
    elif method == "blank":
        if not blanks:
            raise PreprocessError("blank removal needs blank dataset names")
        drop, reason = frequent_among(bundle.x, bundle.obs.where(F.col("dataset").isin(list(blanks))), matrix_frequency), "blank_frequency"
    else:
        drop, reason = frequent_among(bundle.x, edge_observations(bundle.obs), matrix_frequency), "edge_frequency"
    report = bundle.var.join(drop, "feature_id", "left_semi").select("feature_id", "mz", F.lit(reason).alias("reason"))
    return _restrict(bundle, drop, "left_anti"), report


def preprocess(bundle: MatrixBundle, min_occurrence: float = 0.05, normalization: str = "rms", removal: dict | None = None) -> MatrixBundle:
    """Check, filter, optionally remove matrix peaks, normalise into a layer."""
    check_mz(bundle.var)
    bundle = filter_features(bundle, min_occurrence)
    if removal:
        bundle, _ = remove_matrix_peaks(bundle, **removal)
    return normalize(bundle, normalization)
