"""Apportioning mark spectra to cells: raster overlap, selection, abundances, residuals."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import QuantifyError
from ..functions.stats import spread
from ..model import MatrixBundle, QuantificationResult, check_rows, choice, not_finite, number, require
from ..session import cut

METHODS = ("specificity_filtered", "legacy_proportional")


def mark_labels(marks: DataFrame) -> DataFrame:
    """(laser_label, laser_obs_id): the raster labels of every observation, ``"2_3"`` being two.

    Labels stay decimal where they exceed the signed 64-bit range.
    """
    require(marks, ["obs_id", "seg_label"], QuantifyError, "marks")
    parts = marks.select("obs_id", F.posexplode(F.split(F.col("seg_label").cast("string"), "_")).alias("pos", "part"))
    return parts.select(F.expr("try_cast(part AS BIGINT)").alias("laser_label"), F.col("obs_id").alias("laser_obs_id"))


def check_marks(marks: DataFrame) -> None:
    """Raise unless every label is a positive integer that belongs to one observation."""
    check_rows(mark_labels(marks).groupBy("laser_label").count(), {
        "seg_label must consist of positive integers joined by '_'": F.col("laser_label").isNull() | (F.col("laser_label") <= 0),
        "a raster label maps to more than one observation": F.col("count") > 1,
    }, QuantifyError)


def group_pixels(pixels: DataFrame) -> DataFrame:
    """(label, area, centroid_row, centroid_col) of the foreground labels."""
    return pixels.where("label <> 0").groupBy("label").agg(
        F.count("*").alias("area"), F.avg("row").alias("centroid_row"), F.avg("col").alias("centroid_col")
    )


def cells_inside(cells: DataFrame, marks: DataFrame, boundary_margin: float) -> DataFrame:
    """Cells whose centroid lies strictly inside the marks' centroid box widened by the margin."""
    m = F.lit(float(boundary_margin))
    box = marks.agg(
        (F.min("centroid_row") - m).alias("r0"), (F.max("centroid_row") + m).alias("r1"),
        (F.min("centroid_col") - m).alias("c0"), (F.max("centroid_col") + m).alias("c1"),
    )
    inside = (F.col("centroid_row") > F.col("r0")) & (F.col("centroid_row") < F.col("r1")) & (F.col("centroid_col") > F.col("c0")) & (F.col("centroid_col") < F.col("c1"))
    # the box is one row
    return cells.join(F.broadcast(box), inside).select(cells.columns)


def overlap_table(cell_pixels: DataFrame, laser_pixels: DataFrame, marks: DataFrame, boundary_margin: float = 20.0, pixels: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(overlaps, cells): pixels shared by each cell and registered mark, and the cells inside the boundary.

    With the number of ``pixels`` known, they are dealt by mark into partitions of a bounded number of rows.

    Both rasters are joined on (row, col) without background, so the shuffle
    carries foreground pixels only, and counts combine before the second one.
    """
    number("boundary_margin", boundary_margin, QuantifyError, low=0)
    for name, px in (("cell pixels", cell_pixels), ("laser pixels", laser_pixels)):
        require(px, ["row", "col", "label"], QuantifyError, name)
    require(marks, ["obs_id", "seg_label", "centroid_row", "centroid_col"], QuantifyError, "marks")
    cells = cells_inside(group_pixels(cell_pixels), marks, boundary_margin)
    cells = cells.withColumn("cell_id", F.concat(F.lit("c"), F.col("label").cast("string")))
    areas = laser_pixels.where("label <> 0").groupBy(F.col("label").alias("laser_label")).agg(F.count("*").alias("laser_area"))
    shared = (
        cell_pixels.where("label <> 0").select("row", "col", F.col("label").alias("cell_label"))
        .join(laser_pixels.where("label <> 0").select("row", "col", F.col("label").alias("laser_label")), ["row", "col"])
        .select("cell_label", "laser_label")
    )
    if pixels is not None:
        shared = spread(shared, ["laser_label"], pixels)
    shared = shared.groupBy("cell_label", "laser_label").agg(F.count("*").alias("occupied_pixels"))
    named = shared.join(mark_labels(marks), "laser_label").join(areas, "laser_label")
    named = named.join(cells.select(F.col("label").alias("cell_label"), "cell_id"), "cell_label")
    overlaps = named.select(
        "cell_id", "cell_label", "laser_label", "laser_obs_id", "occupied_pixels", "laser_area",
        (F.col("occupied_pixels") / F.col("laser_area")).alias("occupied_ratio"),
    )
    return overlaps, cells


def select_specific(overlaps: DataFrame, unique_min: float = 0.10, dominant_min: float = 0.60, secondary_max: float = 0.15) -> DataFrame:
    """``overlaps`` with ``rejection_reason``, null for accepted rows.  One window per mark."""
    for name, value in (("unique_min", unique_min), ("dominant_min", dominant_min), ("secondary_max", secondary_max)):
        number(name, value, QuantifyError, low=0, high=1)
    require(overlaps, ["cell_id", "laser_label", "occupied_ratio"], QuantifyError, "overlaps")
    per_mark = Window.partitionBy("laser_label")
    ranked = per_mark.orderBy(F.desc("occupied_ratio"), "cell_id")
    out = overlaps.select(
        "*",
        F.row_number().over(ranked).alias("_rank"),
        F.count("*").over(per_mark).alias("_n"),
        F.max("occupied_ratio").over(per_mark).alias("_top"),
        F.nth_value("occupied_ratio", 2).over(ranked.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_second"),
    )
    dominant = (F.col("_top") > F.col("_second")) & (F.col("_top") > F.lit(dominant_min)) & (F.col("_second") < F.lit(secondary_max))
    reason = (
        F.when((F.col("_n") == 1) & (F.col("occupied_ratio") > F.lit(unique_min)), F.lit(None).cast("string"))
        .when(F.col("_n") == 1, "unique_overlap_not_above_threshold")
        .when(dominant & (F.col("_rank") == 1), F.lit(None).cast("string"))
        .when(dominant, "non_dominant_mapping")
        .otherwise("ambiguous_multi_mapping")
    )
    return out.withColumn("rejection_reason", reason).drop("_rank", "_n", "_top", "_second")


def legacy_abundance(accepted: DataFrame, x: DataFrame) -> DataFrame:
    """(cell_id, feature_id, value): each cell sums its marks' spectra times the occupied ratio."""
    joined = accepted.select("cell_id", F.col("laser_obs_id").alias("obs_id"), "occupied_ratio").join(x, "obs_id")
    return joined.groupBy("cell_id", "feature_id").agg(F.sum(F.col("value") * F.col("occupied_ratio")).alias("value"))


def specificity_abundance(overlaps: DataFrame, accepted: DataFrame, x: DataFrame) -> DataFrame:
    """Spectra times ratio, weighted by the share of the mark's cell pixels and divided by the weights.

    Shares come from all overlaps before selection; weights of a cell count
    marks without any signal too.
    """
    totals = overlaps.groupBy("laser_label").agg(F.sum("occupied_pixels").alias("_all"))
    weighted = accepted.join(totals, "laser_label").withColumn("_w", F.col("occupied_pixels") / F.col("_all"))
    weight = weighted.groupBy("cell_id").agg(F.sum("_w").alias("_sum"))
    joined = weighted.select("cell_id", F.col("laser_obs_id").alias("obs_id"), "occupied_ratio", "_w").join(x, "obs_id")
    sums = joined.groupBy("cell_id", "feature_id").agg(F.sum(F.col("value") * F.col("_w") * F.col("occupied_ratio")).alias("_v"))
    return sums.join(weight, "cell_id").select("cell_id", "feature_id", (F.col("_v") / F.col("_sum")).alias("value"))


def mapping_text(cells: DataFrame, accepted: DataFrame) -> DataFrame:
    """``cells`` with status, and labels and covered pixels joined by ``_`` in label order."""
    pairs = accepted.groupBy("cell_id").agg(F.array_sort(F.collect_list(F.struct("laser_label", "occupied_pixels"))).alias("_m"))
    out = cells.join(pairs, "cell_id", "left")

    def text(name: str):
        return F.coalesce(F.array_join(F.transform("_m", lambda p: p[name].cast("string")), "_"), F.lit("0"))

    status = F.when(F.col("_m").isNull(), "zero").otherwise("quantified")
    return out.select(*cells.columns, status.alias("quantification_status"), text("laser_label").alias("laser_labels"), text("occupied_pixels").alias("laser_coverage"))


def partition_difference(overlaps: DataFrame, accepted: DataFrame, rejected: DataFrame) -> DataFrame:
    """Rows by which accepted and rejected together differ from the overlaps as multisets; empty if sound.

    Rows are counted with a sign, once for all three tables, in partitions of a bounded number of rows.
    """
    columns = list(overlaps.columns)
    signed = [t.select(*columns, F.lit(sign).alias("_sign")) for t, sign in ((overlaps, 1), (accepted, -1), (rejected, -1))]
    every = spread(reduce(DataFrame.unionByName, signed), ["laser_label"], 2 * overlaps.count())
    odd = every.groupBy(*columns).agg(F.sum("_sign").alias("_odd")).where("_odd <> 0")
    return odd.select(*columns, F.explode(F.array_repeat(F.lit(True), F.abs("_odd").cast("int"))).alias("_each")).select(columns)


def quantify_cells(bundle: MatrixBundle, cell_pixels: DataFrame, laser_pixels: DataFrame, method: str = "specificity_filtered", boundary_margin: float = 20.0, unique_min: float = 0.10, dominant_min: float = 0.60, secondary_max: float = 0.15, layer: str | None = None) -> QuantificationResult:
    """Abundances of every cell inside the boundary; ``bundle.obs`` carries seg_label and centroids."""
    choice("method", method, METHODS, QuantifyError)
    check_marks(bundle.obs)
    overlaps, cells = overlap_table(cell_pixels, laser_pixels, bundle.obs, boundary_margin)
    overlaps, cells = cut(overlaps), cut(cells)  # every table of the result reads them
    judged = select_specific(overlaps, unique_min, dominant_min, secondary_max)
    if method == "specificity_filtered":
        accepted = judged.where("rejection_reason IS NULL").drop("rejection_reason")
        rejected = judged.where("rejection_reason IS NOT NULL")
        values = specificity_abundance(overlaps, accepted, bundle.matrix(layer))
    else:
        accepted, rejected = overlaps, judged.where(F.lit(False))
        values = legacy_abundance(accepted, bundle.matrix(layer))
    obs = mapping_text(cells, accepted).withColumnRenamed("cell_id", "obs_id").withColumn("obs_ord", F.col("label"))
    x = values.withColumnRenamed("cell_id", "obs_id").where("value <> 0")
    report = (
        obs.agg(F.count("*").alias("included_cells"), F.count_if(F.col("quantification_status") == "quantified").alias("quantified_cells"))
        .crossJoin(F.broadcast(accepted.agg(F.count("*").alias("accepted_overlaps"))))
        .crossJoin(F.broadcast(rejected.agg(F.count("*").alias("rejected_overlaps"))))  # single rows
    )
    return QuantificationResult(MatrixBundle(obs, bundle.var, x, meta={"quantification_method": method}), overlaps, accepted, rejected, report)


RESIDUAL = "laser_residual_"
OVERLAP = ("cell_id", "cell_label", "laser_label", "laser_obs_id", "occupied_pixels", "laser_area", "occupied_ratio")


def check_accepted(cells: MatrixBundle, marks: MatrixBundle, accepted: DataFrame) -> None:
    """Raise unless ``accepted`` fits the cells, the marks and itself, and both bundles have the same features."""
    require(accepted, OVERLAP, QuantifyError, "accepted overlaps")
    named = accepted.select(*OVERLAP)
    known = cells.obs.select(F.col("obs_id").alias("cell_id"), *([F.col("label").alias("_cell")] if "label" in cells.obs.columns else []), F.lit(True).alias("_known"))
    owner = mark_labels(marks.obs).select("laser_label", F.col("laser_obs_id").alias("_owner"))
    joined = named.join(known, "cell_id", "left").join(owner, "laser_label", "left")
    ratio = F.col("occupied_pixels") / F.col("laser_area")
    rules = {
        "an accepted overlap has missing values": reduce(or_, [F.col(c).isNull() for c in OVERLAP]),
        "labels and areas must be positive, pixels not negative": (F.col("cell_label") <= 0) | (F.col("laser_label") <= 0) | (F.col("laser_area") <= 0) | (F.col("occupied_pixels") < 0),
        "occupied_pixels exceeds laser_area": F.col("occupied_pixels") > F.col("laser_area"),
        "occupied_ratio differs from occupied_pixels / laser_area": F.abs(F.col("occupied_ratio") - ratio) > 1e-12 * ratio,
        "an accepted overlap names an unknown cell": F.col("_known").isNull(),
        "laser_label does not belong to laser_obs_id": ~F.col("_owner").eqNullSafe(F.col("laser_obs_id")),
    }
    if "_cell" in known.columns:
        rules["cell_label does not belong to cell_id"] = F.col("_known").isNotNull() & ~F.col("_cell").cast("decimal(20,0)").eqNullSafe(F.col("cell_label").cast("decimal(20,0)"))
    check_rows(joined, rules, QuantifyError)
    check_rows(named.groupBy("cell_id", "laser_label").count(), {"a cell and a mark are mapped twice": F.col("count") > 1}, QuantifyError)
    ours, theirs = (b.var.select("feature_id", "feature_ord", "mz") for b in (cells, marks))
    check_rows(ours.exceptAll(theirs).unionByName(theirs.exceptAll(ours)), {"cells and marks must have the same features in the same order": F.lit(True)}, QuantifyError)


def residual_marks(marks: DataFrame, accepted: DataFrame, min_residual_fraction: float = 0.2) -> DataFrame:
    """Marks whose uncovered share is at least the threshold, with ``residual_fraction``.

    The comparison (area - occupied) >= threshold * area is made in decimals, so
    neither large areas nor a share exactly at the threshold are misjudged.
    """
    number("min_residual_fraction", min_residual_fraction, QuantifyError, low=0, high=1)
    require(marks, ["obs_id", "area"], QuantifyError, "marks")
    occupied = accepted.groupBy(F.col("laser_obs_id").alias("obs_id")).agg(F.sum("occupied_pixels").alias("_px"))
    out = marks.join(occupied, "obs_id", "left").withColumn("_px", F.coalesce("_px", F.lit(0)).cast("decimal(20,0)"))
    # exact decimal text of the area; doubles print the shortest text that reads back
    area = F.col("area").cast("string").cast("decimal(28,6)")
    threshold = F.lit(repr(float(min_residual_fraction))).cast("double").cast("string").cast("decimal(9,8)")
    free = (area - F.col("_px")).cast("decimal(28,6)")
    clamped = F.greatest(free, F.lit(0).cast("decimal(28,6)"))
    keep = clamped >= (threshold * area)
    fraction = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (clamped / area).cast("double")))
    return out.where(keep).withColumn("residual_fraction", fraction).drop("_px")


def mixed_bundle(cells: MatrixBundle, marks: MatrixBundle, accepted: DataFrame, min_residual_fraction: float = 0.2) -> MatrixBundle:
    """Cells and residual marks in one bundle; annotations that one side lacks are null."""
    check_rows(marks.obs, {"area must be positive and finite": not_finite(F.col("area")) | (F.col("area") <= 0)}, QuantifyError)
    check_accepted(cells, marks, accepted)
    residual = residual_marks(marks.obs, accepted, min_residual_fraction)
    new_id = F.concat(F.lit(RESIDUAL), F.col("obs_id"))
    x = marks.x.join(residual.select("obs_id", "residual_fraction"), "obs_id")
    x = x.select(new_id.alias("obs_id"), "feature_id", (F.col("value") * F.col("residual_fraction")).alias("value"))
    residual_obs = residual.withColumn("obs_id", new_id).withColumn("data_type", F.lit("laser_residual"))
    alike = cells.obs.where(F.startswith("obs_id", F.lit(RESIDUAL)))
    if not alike.isEmpty():  # other identifiers cannot collide
        clash = alike.join(residual_obs.select("obs_id"), "obs_id", "left_semi")
        check_rows(clash, {"residual identifiers collide with cell identifiers": F.lit(True)}, QuantifyError)
    shared = [c for c in residual_obs.columns if c in cells.obs.columns]
    for c in shared:  # one type per column
        residual_obs = residual_obs.withColumn(c, F.col(c).cast(cells.obs.schema[c].dataType))
    obs = cells.obs.withColumn("data_type", F.lit("cell")).unionByName(residual_obs, allowMissingColumns=True)
    return MatrixBundle(obs, cells.var, cells.x.select("obs_id", "feature_id", "value").unionByName(x.where("value <> 0")), meta=dict(cells.meta))
