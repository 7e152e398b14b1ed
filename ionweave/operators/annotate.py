"""Annotation of features with reference masses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import AnalysisError
from ..functions.joins import candidate_pairs
from ..model import check_rows, not_finite, number

HMDB = ("accession", "name", "mz", "mode")
METABOSCAPE = ("Measured m/z", "Molecular Formula", "Name")


def _checked(reference: DataFrame, columns: tuple[str, ...], mz: str) -> DataFrame:
    if sorted(c for c in reference.columns if c != "ref_ord") != sorted(columns):
        raise AnalysisError(f"reference columns must be exactly {list(columns)}, with or without ref_ord")
    if dict(reference.dtypes)[mz] == "boolean":
        raise AnalysisError(f"{mz} must be numeric")
    typed = reference.withColumn(mz, F.col(f"`{mz}`").try_cast("double"))
    if "ref_ord" not in reference.columns:
        typed = typed.withColumn("ref_ord", F.monotonically_increasing_id())
    check_rows(typed, {f"{mz} must be numeric, finite and positive": not_finite(F.col(f"`{mz}`")) | (F.col(f"`{mz}`") <= 0)}, AnalysisError)
    return typed


def matches(var: DataFrame, reference: DataFrame, ppm: float) -> DataFrame:
    """Feature and reference pairs within ``ppm`` of the feature plus two ulps; ppm 0 is equality.

    ``reference`` carries ref_ord and ref_mz.
    """
    number("ppm", ppm, AnalysisError, low=0)
    return candidate_pairs(var.select("feature_id", "mz"), reference, "mz", "ref_mz", ppm, "ppm", slack=True)


def annotate(var: DataFrame, reference: DataFrame, fields: dict[str, Column], ppm: float) -> DataFrame:
    """``var`` with one JSON list per field: all matches in reference order, ``[]`` without any.

    The order is ``ref_ord``, of any type that sorts; tables from files carry it.
    Masses meet, not rows: references of equal mass are one list, and features of
    equal mass share one text, so pairs grow with the distinct masses.
    """
    row = F.struct("ref_ord", *[c.alias(n) for n, c in fields.items()])
    listed = reference.groupBy("ref_mz").agg(F.collect_list(row).alias("_r"))
    masses = var.select("mz").distinct().select(F.col("mz").alias("feature_id"), "mz")
    lists = matches(masses, listed, ppm).groupBy("mz").agg(F.array_sort(F.flatten(F.collect_list("_r"))).alias("_m"))
    names = {n: f"_text{i}" for i, n in enumerate(fields)}
    texts = lists.select(F.col("mz").alias("_mz"), *[F.to_json(F.col(f"_m.{n}")).alias(t) for n, t in names.items()])
    out = var.join(texts, F.col("mz") == F.col("_mz"), "left")
    return out.withColumns({n: F.coalesce(t, F.lit("[]")) for n, t in names.items()}).drop("_mz", *names.values())


def annotate_hmdb(var: DataFrame, reference: DataFrame, mode: str, ppm: float = 5) -> DataFrame:
    """hmdb_accessions and hmdb_names; rows of the reference whose mode equals ``mode`` but for case and blanks."""
    number("ppm", ppm, AnalysisError, low=0)
    if not isinstance(mode, str) or not mode.strip():
        raise AnalysisError("mode must be a non-empty string")
    typed = _checked(reference, HMDB, "mz")
    check_rows(typed, {"accession and name must not be missing": F.col("accession").isNull() | F.col("name").isNull()}, AnalysisError)
    wanted = typed.where(F.lower(F.trim("mode")) == mode.strip().lower()).withColumnRenamed("mz", "ref_mz")
    return annotate(var, wanted, {"hmdb_accessions": F.col("accession"), "hmdb_names": F.col("name")}, ppm)


def annotate_metaboscape(var: DataFrame, reference: DataFrame, ppm: float = 3) -> DataFrame:
    """metaboscape_formulas and metaboscape_names."""
    number("ppm", ppm, AnalysisError, low=0)
    typed = _checked(reference, METABOSCAPE, "Measured m/z")
    check_rows(typed, {"formula and name must not be missing": F.col("`Molecular Formula`").isNull() | F.col("Name").isNull()}, AnalysisError)
    named = typed.select("ref_ord", F.col("`Measured m/z`").alias("ref_mz"), F.col("`Molecular Formula`").alias("formula"), "Name")
    return annotate(var, named, {"metaboscape_formulas": F.col("formula"), "metaboscape_names": F.col("Name")}, ppm)
