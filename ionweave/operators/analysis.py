"""Clustering, marker ranking and COSG; feature variance and consensus factorisation under their names here.

Statistics are sums over non-zero values with the group sizes supplied, so
implicit zeros cost nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import AnalysisError
from ..functions import blocks
from ..functions.descent import neighbors
from ..functions.ordering import global_row_number
from ..functions.stats import benjamini_hochberg, normal_two_sided, student_p
from ..model import MatrixBundle, check_rows, choice, number, require, whole
from ..session import cut
from .communities import leiden
from .factorisation import PreparedCnmf, consensus_usage, factorize, factorize_prepared, load_prepared, load_usage, prepare_cnmf, prepared_spectra, run_cnmf, select_k  # noqa: F401
from .variance import feature_variance, top_features  # noqa: F401

RANKINGS = ("t-test", "t-test_overestim_var", "wilcoxon")


# --------------------------------------------------------------------------
# clustering


def principal_components(points: DataFrame, n_features: int, components: int = 50) -> DataFrame:
    """(obs_id, obs_ord, vec): scores of the centred rows; one feature gives its centred column."""
    n = points.count()
    mean = points.select(F.posexplode("vec").alias("k", "v")).groupBy("k").agg(F.avg("v").alias("m")).orderBy("k")
    centre = [r.m for r in mean.collect()]  # one number per feature
    centred = points.withColumn("vec", F.zip_with("vec", F.array(*[F.lit(m) for m in centre]), lambda a, b: a - b))
    k = min(components, n - 1, n_features)
    if n_features == 1:
        return centred
    model = PCA(k=max(1, k), inputCol="_in", outputCol="_out").fit(centred.withColumn("_in", array_to_vector("vec")))
    return model.transform(centred.withColumn("_in", array_to_vector("vec"))).select("obs_id", "obs_ord", vector_to_array("_out").alias("vec"))


def knn(points: DataFrame, k: int, metric: str = "euclidean") -> DataFrame:
    """(obs_id, rank, neighbor, distance): exact k nearest others; ties by identifier.

    Each pair of tiles keeps k per row, so n * tiles * k rows are shuffled, never n^2.
    """
    whole("k", k, AnalysisError)
    blocks.metric(metric)

    def work(left: pd.DataFrame, right: pd.DataFrame) -> Iterator[pd.DataFrame]:
        right = right.sort_values("obs_id")
        ours, theirs = left.obs_id.to_numpy(), right.obs_id.to_numpy()
        same = (lambda p, q: ours[p][:, None] == theirs[q][None, :]) if np.isin(ours, theirs).any() else None
        for i, j, d in blocks.nearest_rows(metric, blocks.matrix(left), blocks.matrix(right), same, k):
            yield pd.DataFrame({"obs_id": ours[i], "neighbor": theirs[j], "distance": d})

    kind = points.schema["obs_id"].dataType.simpleString()
    found = blocks.block_pairs(points.select("obs_id", "vec"), work, f"obs_id {kind}, neighbor {kind}, distance double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("obs_id").orderBy("distance", "neighbor")))
    return ranked.where(F.col("rank") <= k).select("obs_id", "rank", "neighbor", "distance")


def neighbor_graph(neighbors: DataFrame) -> DataFrame:
    """(a, b, weight), a < b: how many of the two directions name each other, times closeness."""
    edge = neighbors.select(F.least("obs_id", "neighbor").alias("a"), F.greatest("obs_id", "neighbor").alias("b"), (1 / (1 + F.col("distance"))).alias("w"))
    return edge.groupBy("a", "b").agg(F.sum("w").alias("weight"))


def cluster_cells(bundle: MatrixBundle, n_neighbors: int = 15, resolution: float = 0.6, seed: int = 0, key: str = "cluster", n_features: int | None = None) -> MatrixBundle:
    """PCA, neighbour descent, Leiden communities; ``obs`` gains ``key``.  Cluster names follow size, then first member.

    Neighbours are exact up to ``descent.BUCKET`` observations and approximate above.
    """
    whole("n_neighbors", n_neighbors, AnalysisError, low=2)
    number("resolution", resolution, AnalysisError, above=0)
    whole("seed", seed, AnalysisError, low=0, high=2**32 - 1)
    n = bundle.obs.count()
    if n < 3 or n_neighbors > n - 1:
        raise AnalysisError("clustering needs at least 3 observations and n_neighbors below their number")
    if not key or key in bundle.obs.columns:
        raise AnalysisError(f"key {key!r} is empty or taken")
    var, x = bundle.var, bundle.x
    if n_features is not None:
        keep = top_features(x, var, n, n_features).where("variance > 0")
        var = keep.select("feature_id", (F.row_number().over(Window.orderBy("feature_ord")) - 1).alias("feature_ord"))  # n_features rows
        x = x.join(var, "feature_id", "left_semi")
    # read by every pass of the components and of the neighbours
    points = cut(principal_components(cut(blocks.vectors(x, bundle.obs, var)), var.count()))
    pairs, near = neighbors(points, n_neighbors, seed)
    edges = neighbor_graph(pairs.toDF("obs_id", "rank", "neighbor", "distance"))
    found = cut(leiden(edges, near, resolution, seed))
    sizes = found.groupBy("community").agg((-F.count("*")).alias("less"), F.min("node").alias("first"))
    names = global_row_number(sizes, ["less", "first"], "_name").select("community", F.col("_name").cast("string").alias(key))
    labels = found.join(names, "community").join(bundle.obs.select("obs_id", F.col("obs_ord").cast("long").alias("node")), "node").select("obs_id", key)
    meta = {**bundle.meta, "clustering": {"n_neighbors": n_neighbors, "resolution": resolution, "seed": seed, "key": key}}
    return MatrixBundle(bundle.obs.join(labels, "obs_id", "left"), bundle.var, bundle.x, dict(bundle.layers), meta)


# --------------------------------------------------------------------------
# marker ranking


def group_order(groups: DataFrame, categories: list[str] | None = None) -> list[str]:
    """Category order if given, else first seen; at least two groups of at least two members."""
    rows = groups.where("grp IS NOT NULL").groupBy("grp").agg(F.min("obs_ord").alias("o"), F.count("*").alias("n")).orderBy("o").collect()
    if len(rows) < 2 or min(r.n for r in rows) < 2:
        raise AnalysisError("ranking needs at least two groups of at least two members")
    seen = [r.grp for r in rows]
    return [c for c in categories if c in seen] if categories else seen


def _moments(x: DataFrame, var: DataFrame, groups: DataFrame) -> DataFrame:
    """Per (feature, group): n, mean and sample variance inside and outside the group."""
    members = groups.where("grp IS NOT NULL").select("obs_id", "grp")
    sizes = members.groupBy("grp").agg(F.count("*").alias("n"))
    total = sizes.agg(F.sum("n").alias("all"))
    cells = x.join(members, "obs_id").groupBy("feature_id", "grp").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"))
    every = var.select("feature_id", "feature_ord").crossJoin(F.broadcast(sizes.crossJoin(total)))  # one row per group
    grid = every.join(cells, ["feature_id", "grp"], "left").fillna(0.0, ["s", "q"])
    w = Window.partitionBy("feature_id")
    grid = grid.withColumn("sr", F.sum("s").over(w) - F.col("s")).withColumn("qr", F.sum("q").over(w) - F.col("q")).withColumn("nr", F.col("all") - F.col("n"))

    def variance(q: str, s: str, n: str):
        return F.greatest((F.col(q) - F.col(s) * F.col(s) / F.col(n)) / (F.col(n) - 1), F.lit(0.0))

    return grid.select("feature_id", "feature_ord", "grp", "n", "nr", (F.col("s") / F.col("n")).alias("mean"), (F.col("sr") / F.col("nr")).alias("mean_rest"), variance("q", "s", "n").alias("var"), variance("qr", "sr", "nr").alias("var_rest"))


def t_scores(moments: DataFrame, overestimate: bool = False) -> DataFrame:
    """Welch t and degrees of freedom; ``overestimate`` takes the group's size for the rest's."""
    nr = F.col("n") if overestimate else F.col("nr")
    a, b = F.col("var") / F.col("n"), F.col("var_rest") / nr
    t = F.coalesce(F.try_divide(F.col("mean") - F.col("mean_rest"), F.sqrt(a + b)), F.lit(0.0))
    dof = F.try_divide((a + b) * (a + b), a * a / (F.col("n") - 1) + b * b / (nr - 1))
    return moments.withColumn("scores", t).withColumn("_dof", dof)


def wilcoxon_scores(x: DataFrame, var: DataFrame, groups: DataFrame) -> DataFrame:
    """(feature_id, grp, scores): rank-sum z of group against rest, without tie correction.

    Zeros of a feature are one tied block between negatives and positives; its size
    and mean rank follow from the counts, so only non-zero values are ranked.
    """
    members = groups.where("grp IS NOT NULL").select("obs_id", "grp")
    sizes = members.groupBy("grp").agg(F.count("*").alias("n"))
    total = sizes.agg(F.sum("n").alias("all"))
    values = x.where("value <> 0").join(members, "obs_id")
    per_value = values.groupBy("feature_id", "value", "grp").agg(F.count("*").alias("c"))
    distinct = per_value.groupBy("feature_id", "value").agg(F.sum("c").alias("ties"))
    w = Window.partitionBy("feature_id").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy("feature_id")
    ranked = distinct.crossJoin(F.broadcast(total))  # one row
    ranked = ranked.withColumn("_below", F.sum("ties").over(w) - F.col("ties")).withColumn("_nnz", F.sum("ties").over(every))
    zeros = F.col("all") - F.col("_nnz")
    ranked = ranked.withColumn("rank", F.col("_below") + F.when(F.col("value") > 0, zeros).otherwise(0) + (F.col("ties") + 1) / F.lit(2.0))
    sums = per_value.join(ranked.select("feature_id", "value", "rank"), ["feature_id", "value"]).groupBy("feature_id", "grp").agg(F.sum(F.col("rank") * F.col("c")).alias("rs"), F.sum("c").alias("nnz_g"))
    block = values.groupBy("feature_id").agg(F.count_if(F.col("value") < 0).alias("neg"), F.count("*").alias("nnz"))
    grid = var.select("feature_id", "feature_ord").crossJoin(F.broadcast(sizes.crossJoin(total)))  # one row per group
    grid = grid.join(block, "feature_id", "left").join(sums, ["feature_id", "grp"], "left").fillna(0, ["neg", "nnz", "nnz_g", "rs"])
    zero_rank = F.col("neg") + (F.col("all") - F.col("nnz") + 1) / F.lit(2.0)
    rank_sum = F.col("rs") + (F.col("n") - F.col("nnz_g")) * zero_rank
    n1, n2, n = F.col("n"), F.col("all") - F.col("n"), F.col("all")
    z = (rank_sum - n1 * (n + 1) / F.lit(2.0)) / F.sqrt(n1 * n2 * (n + 1) / F.lit(12.0))
    return grid.select("feature_id", "feature_ord", "grp", z.alias("scores"))


def rank_scores(x: DataFrame, var: DataFrame, groups: DataFrame, method: str = "wilcoxon") -> DataFrame:
    """(feature_id, feature_ord, grp, scores, logfoldchanges, _dof) for every feature and group."""
    choice("method", method, RANKINGS, AnalysisError)
    moments = _moments(x, var, groups)
    fold = F.log2((F.expm1("mean") + 1e-9) / (F.expm1("mean_rest") + 1e-9))
    if method == "wilcoxon":
        scored = wilcoxon_scores(x, var, groups).join(moments.drop("feature_ord"), ["feature_id", "grp"]).withColumn("_dof", F.lit(None).cast("double"))
    else:
        scored = t_scores(moments, method == "t-test_overestim_var")
    return scored.select("feature_id", "feature_ord", "grp", "scores", fold.alias("logfoldchanges"), "_dof")


def chosen_groups(groups: DataFrame, categories: list[str] | None = None, only: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """``groups`` reduced to ``only`` those named, and their order: that of ``categories``, else first seen."""
    require(groups, ["obs_id", "obs_ord", "grp"], AnalysisError, "groups")
    if only is not None:
        if len(set(only)) != len(only):
            raise AnalysisError("groups are named twice")
        groups = groups.where(F.col("grp").isin(only))
    order = group_order(groups, categories)
    if only is not None and set(order) != set(only):
        raise AnalysisError(f"unknown groups: {sorted(set(only) - set(order))}")
    if categories is not None:
        groups = groups.where(F.col("grp").isin(order))
    return groups, order


def rank_metabolites(x: DataFrame, var: DataFrame, groups: DataFrame, method: str = "wilcoxon", categories: list[str] | None = None) -> DataFrame:
    """(grp, group_ord, rank, names, scores, logfoldchanges, pvals, pvals_adj), best first; ties in feature order.

    ``groups(obs_id, obs_ord, grp)``; observations without a group take no part.
    group_ord counts the groups from 0 in the order of ``categories``, else as first seen.
    ``x`` is any matrix of a bundle, ``bundle.matrix(layer)`` for a layer.
    """
    groups, order = chosen_groups(groups, categories)
    scored = rank_scores(x, var, groups, method)
    p = normal_two_sided("scores") if method == "wilcoxon" else student_p("scores", "_dof")
    adjusted = benjamini_hochberg(scored.withColumn("pvals", F.when(F.isnan(p), 1.0).otherwise(p)), ["grp"], "pvals", "pvals_adj")
    rank = F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("scores"), "feature_ord"))
    at = F.array_position(F.lit(order), F.col("grp")).cast("int") - 1
    return adjusted.select("grp", at.alias("group_ord"), rank.alias("rank"), F.col("feature_id").alias("names"), "scores", "logfoldchanges", "pvals", "pvals_adj")


def cosg_scores(x: DataFrame, var: DataFrame, groups: DataFrame, mu: float = 1.0, expressed_pct: float = 0.1, remove_lowly_expressed: bool = False) -> DataFrame:
    """(grp, feature_id, score): cosine of a feature with the group's indicator, times its share
    c^2 / ((1 - mu) c^2 + mu sum of c^2 over groups)."""
    members = groups.where("grp IS NOT NULL").select("obs_id", "grp")
    sizes = members.groupBy("grp").agg(F.count("*").alias("n"))
    cells = x.join(members, "obs_id").groupBy("feature_id", "grp").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"), F.count_if(F.col("value") > 0).alias("pos"))
    norm = F.sqrt(F.sum("q").over(Window.partitionBy("feature_id")))
    scored = cells.join(F.broadcast(sizes), "grp").withColumn("c", F.coalesce(F.try_divide(F.col("s"), norm * F.sqrt("n")), F.lit(0.0)))  # one row per group
    c2 = F.col("c") * F.col("c")
    share = F.try_divide(c2, (1 - F.lit(mu)) * c2 + F.lit(mu) * F.sum(c2).over(Window.partitionBy("feature_id")))
    score = F.col("c") * F.coalesce(share, F.lit(0.0))
    if remove_lowly_expressed:
        score = F.when(F.col("pos") < F.col("n") * expressed_pct, -1.0).otherwise(score)
    return scored.select("grp", "feature_id", score.alias("score"))


def run_cosg(x: DataFrame, var: DataFrame, groups: DataFrame, n_genes: int = 20, mu: float = 1.0, expressed_pct: float = 0.1, remove_lowly_expressed: bool = False, only: list[str] | None = None, categories: list[str] | None = None) -> DataFrame:
    """(rank, one column of marker names per group, in the order of ``categories``, else as first seen).

    ``only`` names the groups to compare; ``x`` is any matrix of a bundle, ``bundle.matrix(layer)`` for a layer.
    """
    whole("n_genes", n_genes, AnalysisError)
    number("mu", mu, AnalysisError, low=0)
    number("expressed_pct", expressed_pct, AnalysisError, low=0, high=1)
    groups, order = chosen_groups(groups, categories, only)
    scored = cosg_scores(x, var, groups, mu, expressed_pct, remove_lowly_expressed).join(var.select("feature_id", "feature_ord"), "feature_id")
    rank = F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("score"), "feature_ord"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= n_genes).groupBy("rank").pivot("grp", order).agg(F.first("feature_id"))
