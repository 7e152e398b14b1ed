"""Plot-ready tables; drawing itself needs matplotlib, which is optional.

Every plot is a DataFrame of what it shows, so large tables are reduced on the
executors before anything reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..errors import AnalysisError
from ..model import MatrixBundle, RegistrationResult, check_rows, not_finite, require


def segmentation_plot(pixels: DataFrame) -> DataFrame:
    """(row, col, label) of the foreground."""
    require(pixels, ["row", "col", "label"], AnalysisError, "pixels")
    return pixels.where("label <> 0").select("row", "col", "label")


def contour_plot(pixels: DataFrame, height: int, width: int) -> DataFrame:
    """(row, col) on the outer side of label boundaries: background beside a label, and pixels beside another label.

    Each foreground pixel names its four neighbours; one equi-join tells which of them differ.
    """
    px = segmentation_plot(pixels)
    steps = F.array(*[F.struct((F.col("row") + dy).alias("row"), (F.col("col") + dx).alias("col")) for dy, dx in ((-1, 0), (1, 0), (0, -1), (0, 1))])
    asked = px.select(F.explode(steps).alias("p"), F.col("label").alias("from")).select("p.row", "p.col", "from")
    asked = asked.where(F.col("row").between(0, height - 1) & F.col("col").between(0, width - 1))
    met = asked.join(px, ["row", "col"], "left")
    return met.where(F.col("label").isNull() | (F.col("label") != F.col("from"))).select("row", "col").distinct()


def category_codes(obs: DataFrame, column: str, categories: list[str] | None = None) -> DataFrame:
    """(obs_id, code): positions in ``categories``, else in the sorted distinct values; codes start at 0."""
    if categories is not None:
        at = F.array_position(F.array(*[F.lit(c) for c in categories]), F.col(column)) - 1
        return obs.select("obs_id", at.cast("int").alias("code"))
    values = obs.select(column).where(F.col(column).isNotNull()).distinct()
    ranked = values.withColumn("code", (F.row_number().over(Window.orderBy(column)) - 1).cast("int"))  # one line per category
    return obs.select("obs_id", column).join(ranked, column, "left").select("obs_id", "code")


def spatial_plot(bundle: MatrixBundle, feature: str, layer: str | None = None) -> DataFrame:
    """(obs_id, x, y, value) of an annotation (categories as codes) or else of a feature, zeros included."""
    if not isinstance(feature, str) or not feature:
        raise AnalysisError("feature must be a non-empty string")
    require(bundle.obs, ["x", "y"], AnalysisError, "obs")
    at = bundle.obs.select("obs_id", "x", "y")
    if feature in bundle.obs.columns:
        check_rows(bundle.obs, {f"annotation {feature!r} must not be missing": F.col(feature).isNull()}, AnalysisError)
        if isinstance(bundle.obs.schema[feature].dataType, NumericType):
            return bundle.obs.select("obs_id", "x", "y", F.col(feature).cast("double").alias("value"))
        codes = category_codes(bundle.obs.withColumn(feature, F.col(feature).cast("string")), feature)
        return at.join(codes, "obs_id").select("obs_id", "x", "y", F.col("code").cast("double").alias("value"))
    if not bundle.var.where(F.col("feature_id") == feature).limit(1).count():
        raise AnalysisError(f"{feature!r} is neither an annotation nor a feature")
    values = bundle.matrix(layer).where(F.col("feature_id") == feature).select("obs_id", "value")
    return at.join(values, "obs_id", "left").fillna(0.0, ["value"])


def registration_plot(result: RegistrationResult) -> DataFrame:
    """(x, y, title) of registered marks."""
    require(result.mapping, ["centroid_row", "centroid_col"], AnalysisError, "mapping")
    return result.mapping.select(F.col("centroid_col").alias("x"), F.col("centroid_row").alias("y"), F.lit(result.transform["orientation"]).alias("title"))


def usage_plot(bundle: MatrixBundle, usage: str) -> DataFrame:
    """(obs_id, x, y, value) of a numeric usage column."""
    require(bundle.obs, ["x", "y", usage], AnalysisError, "obs")
    check_rows(bundle.obs, {f"usage {usage!r} must be finite": not_finite(F.col(usage))}, AnalysisError)
    return bundle.obs.select("obs_id", "x", "y", F.col(usage).cast("double").alias("value"))


def trajectory_plot(trends: DataFrame) -> DataFrame:
    """Checked (feature, position, fitted, lower, upper)."""
    columns = ["feature", "position", "fitted", "lower", "upper"]
    require(trends, columns, AnalysisError, "trends")
    tests = {f"{c} must be finite": not_finite(F.col(c)) for c in columns[1:]}
    tests |= {"feature must be named": F.coalesce(F.trim("feature"), F.lit("")) == "", "lower must not exceed upper": F.col("lower") > F.col("upper")}
    check_rows(trends, tests, AnalysisError)
    return trends.select(columns)


def gallery_summary(bundle: MatrixBundle) -> DataFrame:
    """(feature_id, feature_ord, low, high, mean) over all observations, zeros included.

    low and high are the exact 1st and 99th percentiles, widened to the extremes where they coincide.
    Zeros are not expanded: they enter the percentile as one value with its frequency.
    """
    n = bundle.obs.count()
    counts = bundle.x.groupBy("feature_id", "value").agg(F.count("*").alias("c"))
    nnz = bundle.x.groupBy("feature_id").agg(F.count("*").alias("k"))
    zeros = bundle.var.select("feature_id").join(nnz, "feature_id", "left").select("feature_id", F.lit(0.0).alias("value"), (F.lit(n) - F.coalesce("k", F.lit(0))).alias("c"))
    every = counts.unionByName(zeros).where("c > 0")
    p = every.groupBy("feature_id").agg(
        F.percentile("value", F.lit(0.01), F.col("c")).alias("low"), F.percentile("value", F.lit(0.99), F.col("c")).alias("high"),
        F.min("value").alias("_min"), F.max("value").alias("_max"), (F.sum(F.col("value") * F.col("c")) / F.lit(float(n))).alias("mean"),
    )
    flat = F.col("high") <= F.col("low")
    p = p.select("feature_id", F.when(flat, F.col("_min")).otherwise(F.col("low")).alias("low"), F.when(flat, F.col("_max") + 1).otherwise(F.col("high")).alias("high"), "mean")
    return bundle.var.select("feature_id", "feature_ord").join(p, "feature_id")


def contact_sheet(summary: DataFrame, preferred: list[str], most: int = 12) -> DataFrame:
    """Features of the contact sheet: preferred ones in their order, then by feature order."""
    wanted = F.array_position(F.array(*[F.lit(p) for p in preferred]).cast("array<string>"), F.col("feature_id").cast("string"))
    first = F.when(wanted > 0, wanted).otherwise(len(preferred) + 1)
    return summary.orderBy(first, "feature_ord").limit(most)


def draw(points: DataFrame, title: str = "", save: str | None = None):
    """Scatter of (x, y[, value]); needs matplotlib."""
    try:
        from matplotlib.figure import Figure
    except ImportError as e:
        raise AnalysisError("drawing needs the optional package matplotlib") from e
    pdf = points.toPandas()
    figure = Figure()
    axes = figure.subplots()
    shown = axes.scatter(pdf.x, pdf.y, c=pdf.value if "value" in pdf else None, s=4)
    if "value" in pdf:
        figure.colorbar(shown, ax=axes)
    axes.set_title(title)
    axes.set_aspect("equal")
    axes.invert_yaxis()
    if save:
        figure.savefig(save)
    return figure
