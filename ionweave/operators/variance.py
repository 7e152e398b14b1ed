"""Variance of features from sums over non-zero values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import AnalysisError
from ..model import whole


def feature_variance(x: DataFrame, var: DataFrame, n_obs: int) -> DataFrame:
    """(feature_id, feature_ord, mean, variance): population variance, zeros included."""
    sums = x.groupBy("feature_id").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"))
    n = F.lit(float(n_obs))
    mean = F.coalesce(F.col("s") / n, F.lit(0.0))
    out = var.select("feature_id", "feature_ord").join(sums, "feature_id", "left")
    return out.select("feature_id", "feature_ord", mean.alias("mean"), F.greatest(F.coalesce(F.col("q") / n, F.lit(0.0)) - mean * mean, F.lit(0.0)).alias("variance"))


def top_features(x: DataFrame, var: DataFrame, n_obs: int, n: int) -> DataFrame:
    """The ``n`` most variable features; ties in feature order."""
    whole("n", n, AnalysisError)
    ranked = feature_variance(x, var, n_obs).orderBy(F.desc("variance"), "feature_ord").limit(n)
    return ranked
