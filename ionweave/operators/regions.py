"""Region tables: row detection, exclusion, merging, simulated marks.

A region has label, area, centroid_row and centroid_col.  Tables of several
images carry a ``dataset`` column in ``keys``; every window is partitioned by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import RegionError
from ..model import SegmentationResult, check_rows, choice, not_finite, number, require, whole

REGION = ("label", "area", "centroid_row", "centroid_col")


def check_regions(regions: DataFrame) -> None:
    require(regions, REGION, RegionError, "regions")
    check_rows(regions, {
        "label must be a positive integer": F.col("label").isNull() | (F.col("label") <= 0),
        "area must be finite and positive": not_finite(F.col("area")) | (F.col("area") <= 0),
        "centroids must be finite": not_finite(F.col("centroid_row")) | not_finite(F.col("centroid_col")),
    }, RegionError)


def _order(keys: tuple[str, ...]):
    return Window.partitionBy(*keys, *([] if keys else [F.lit(1)])).orderBy("centroid_row", "centroid_col", "label")


def _all(keys: tuple[str, ...]):
    return Window.partitionBy(*keys, *([] if keys else [F.lit(1)]))


def gap_breaks(regions: DataFrame, expected_rows: int | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """``_break`` 1 where a new row starts: at the expected_rows - 1 widest gaps (ties: the earlier),
    or at gaps above median + max(5 MAD, machine epsilon)."""
    ordered = regions.withColumn("_pos", F.row_number().over(_order(keys)))
    ordered = ordered.withColumn("_gap", F.col("centroid_row") - F.lag("centroid_row").over(_order(keys)))
    if expected_rows is not None:
        widest = _all(keys).orderBy(F.desc_nulls_last("_gap"), "_pos")
        ordered = ordered.withColumn("_break", F.when(F.col("_gap").isNotNull() & (F.row_number().over(widest) <= expected_rows - 1), 1).otherwise(0))
        return ordered.drop("_gap", "_pos")
    stats = ordered.withColumn("_med", F.expr("percentile(_gap, 0.5)").over(_all(keys)))
    stats = stats.withColumn("_mad", F.expr("percentile(abs(_gap - _med), 0.5)").over(_all(keys)))
    limit = F.col("_med") + F.greatest(5 * F.col("_mad"), F.lit(2.220446049250313e-16))
    return stats.withColumn("_break", F.when(F.col("_gap") > limit, 1).otherwise(0)).drop("_gap", "_pos", "_med", "_mad")


def variance_breaks(regions: DataFrame, window_size: int = 5, variance_threshold: float = 50.0, thinning: int = 4, keys: tuple[str, ...] = ()) -> DataFrame:
    """``_break`` 1 at the last row of every ``thinning``-th full trailing window whose population
    variance exceeds the threshold; the window that ends at the table's last row is not examined."""
    w = _order(keys)
    ordered = regions.withColumn("_pos", F.row_number().over(w)).withColumn("_n", F.count("*").over(_all(keys)))
    variance = F.var_pop("centroid_row").over(w.rowsBetween(-(window_size - 1), 0))
    candidate = (F.col("_pos") >= window_size) & (F.col("_pos") < F.col("_n")) & (variance > variance_threshold)
    ordered = ordered.withColumn("_cand", F.when(candidate, 1).otherwise(0))
    nth = F.sum("_cand").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return ordered.withColumn("_break", F.when((F.col("_cand") == 1) & ((nth - 1) % thinning == 0), 1).otherwise(0)).drop("_pos", "_n", "_cand")


def detect_rows(regions: DataFrame, expected_rows: int | None = None, method: str = "coordinate_gap", window_size: int = 5, variance_threshold: float = 50.0, thinning: int = 4, keys: tuple[str, ...] = ()) -> DataFrame:
    """``regions`` with seg_label, morphology, row_number, column_number and right_to_left."""
    choice("method", method, ("coordinate_gap", "rolling_variance"), RegionError)
    whole("window_size", window_size, RegionError)
    whole("thinning", thinning, RegionError)
    number("variance_threshold", variance_threshold, RegionError, low=0)
    if expected_rows is not None:
        whole("expected_rows", expected_rows, RegionError)
    require(regions, REGION, RegionError, "regions")
    cut_ = gap_breaks(regions, expected_rows, keys) if method == "coordinate_gap" else variance_breaks(regions, window_size, variance_threshold, thinning, keys)
    numbered = cut_.withColumn("row_number", (F.sum("_break").over(_order(keys).rowsBetween(Window.unboundedPreceding, 0)) + 1).cast("int")).drop("_break")
    return _number_columns(numbered.withColumn("seg_label", F.col("label").cast("string")).withColumn("morphology", F.lit("intact")), keys)


def _number_columns(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """column_number 1..n and right_to_left -n..-1 within each row, by column then row position."""
    in_row = Window.partitionBy(*keys, "row_number")
    column = F.row_number().over(in_row.orderBy("centroid_col", "centroid_row", "seg_label"))
    return rows.withColumn("column_number", column.cast("int")).withColumn("right_to_left", (F.col("column_number") - F.count("*").over(in_row) - 1).cast("int"))


def check_row_count(rows: DataFrame, expected_rows: int) -> None:
    found = rows.agg(F.coalesce(F.max("row_number"), F.lit(0)).alias("n")).first().n
    if found != expected_rows:
        raise RegionError(f"found {found} rows instead of {expected_rows}")


def exclude_regions(regions: DataFrame, min_row: float | None = None, max_row: float | None = None, min_column: float | None = None, max_column: float | None = None) -> DataFrame:
    """Regions whose centroid lies within the bounds, ends included; a bound of None is open."""
    for axis, low, high in (("row", min_row, max_row), ("col", min_column, max_column)):
        for value in (low, high):
            if value is not None:
                number(f"{axis} bound", value, RegionError)
        if low is not None and high is not None and low > high:
            raise RegionError(f"minimum {axis} bound exceeds the maximum")
        if low is not None:
            regions = regions.where(F.col(f"centroid_{axis}") >= float(low))
        if high is not None:
            regions = regions.where(F.col(f"centroid_{axis}") <= float(high))
    return regions


def parse_rules(rules: DataFrame) -> DataFrame:
    """(rule_ord, row_number, source_labels, source): one row per source of rules like ``"3,4"``."""
    require(rules, ["row_number", "source_labels"], RegionError, "merge rules")
    parts = F.transform(F.split("source_labels", "[,_|]"), lambda p: F.trim(p))
    parsed = rules.withColumn("rule_ord", F.col("rule_ord") if "rule_ord" in rules.columns else F.xxhash64("row_number", "source_labels")).withColumn("_p", parts)
    check_rows(parsed, {
        "a merge rule needs at least two source labels": F.size("_p") < 2,
        "a merge rule repeats a source label": F.size(F.array_distinct("_p")) != F.size("_p"),
        "a merge rule has an empty source label": F.array_contains("_p", ""),
    }, RegionError)
    return parsed.select("rule_ord", F.col("row_number").cast("int").alias("row_number"), F.array_join("_p", "_").alias("combined"), F.posexplode("_p").alias("_at", "source"))


def merge_regions(rows: DataFrame, rules: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Sources become ``spoilt`` and keep their numbers; each rule adds a ``combined`` region with its first
    source's other columns; active rows are renumbered.

    The rules apply at once, which equals applying them in turn as long as no
    label of a row is named by two rules; that is checked.
    """
    sources = parse_rules(rules)
    check_rows(sources.groupBy("row_number", "source").count(), {"two merge rules use one label of a row": F.col("count") > 1}, RegionError)
    intact = rows.where("morphology = 'intact'")
    matched = sources.join(intact.select("row_number", F.col("seg_label").alias("source"), "area", "centroid_row", "centroid_col", *keys), ["row_number", "source"], "left")
    check_rows(matched.groupBy("rule_ord", "row_number", "source").agg(F.count("area").alias("n")), {"a merge source must match exactly one intact region": F.col("n") != 1}, RegionError)
    # whatever else the first source carries goes to the combined region
    own = [c for c in rows.columns if c not in {"row_number", "seg_label", "area", "centroid_row", "centroid_col", "morphology", "column_number", "right_to_left", *keys}]
    first = rows.where("morphology = 'intact'").select(F.col("seg_label").alias("source"), "row_number", *keys, F.struct("centroid_col", "centroid_row", "seg_label").alias("_place"), F.struct(*own).alias("_own") if own else F.lit(None).alias("_own"))
    matched = matched.join(first, ["row_number", "source", *keys])
    combined = matched.groupBy(*keys, "rule_ord", "row_number", "combined").agg(F.avg("centroid_row").alias("centroid_row"), F.avg("centroid_col").alias("centroid_col"), F.sum("area").alias("area"), F.min_by("_own", "_place").alias("_own"))
    spoilt = rows.join(sources.select("row_number", F.col("source").alias("seg_label"), F.lit(True).alias("_hit")), ["row_number", "seg_label"], "left")
    spoilt = spoilt.withColumn("morphology", F.when(F.col("_hit") & (F.col("morphology") == "intact"), "spoilt").otherwise(F.col("morphology"))).drop("_hit")
    added = combined.select(*keys, *[F.col(f"_own.`{c}`").alias(c) for c in own], F.col("combined").alias("seg_label"), F.lit("combined").alias("morphology"), "row_number", "centroid_row", "centroid_col", "area")
    everything = spoilt.unionByName(added, allowMissingColumns=True)
    active = _number_columns(everything.where("morphology <> 'spoilt'"), keys)
    rest = everything.where("morphology = 'spoilt'")
    for c in ("column_number", "right_to_left"):
        rest = rest.withColumn(c, F.col(c).cast("int") if c in rows.columns else F.lit(None).cast("int"))
    return active.unionByName(rest)


def region_table(pixels: DataFrame) -> DataFrame:
    """(label, area, centroid_row, centroid_col) of a label raster's foreground."""
    return pixels.where("label <> 0").groupBy("label").agg(F.count("*").cast("double").alias("area"), F.avg("row").alias("centroid_row"), F.avg("col").alias("centroid_col"))


def disk(center_row: Column, center_col: Column, radius: int, height: int, width: int) -> Column:
    """Array of (row, col) strictly within ``radius`` of the centre, clipped to the image."""
    rows = F.sequence(F.floor(center_row - radius), F.ceil(center_row + radius))
    cols = F.sequence(F.floor(center_col - radius), F.ceil(center_col + radius))
    square = F.flatten(F.transform(rows, lambda r: F.transform(cols, lambda c: F.struct(r.alias("row"), c.alias("col")))))

    def inside(p: Column) -> Column:
        dr, dc = (p["row"] - center_row) / radius, (p["col"] - center_col) / radius
        return (dr * dr + dc * dc < 1) & p["row"].between(0, height - 1) & p["col"].between(0, width - 1)

    return F.filter(square, inside)


def simulate_marks(msi: DataFrame, anchors: DataFrame, image_shape: tuple[int, int], radius: int) -> SegmentationResult:
    """Disks evenly spaced between each row's leftmost and rightmost anchors.

    ``msi(x, y)`` must be a complete grid; ``anchors(row_number, centroid_row,
    centroid_col)`` has one row number per MSI row, from 1.
    """
    whole("radius", radius, RegionError)
    height, width = (whole("image_shape", n, RegionError) for n in image_shape)
    check_rows(msi, {"spatial coordinates must be finite": not_finite(F.col("x")) | not_finite(F.col("y"))}, RegionError)
    grid = msi.agg(F.count("*").alias("n"), F.count_distinct("x").alias("nx"), F.count_distinct("y").alias("ny"), F.count_distinct("x", "y").alias("np")).first()
    if not grid.n:
        raise RegionError("the grid must hold at least one point")
    if grid.np != grid.n or grid.n != grid.nx * grid.ny:
        raise RegionError("the points must form a complete rectangular grid")
    ends = anchors.groupBy("row_number").agg(
        F.count("*").alias("n"), F.min(F.struct("centroid_col", "centroid_row")).alias("a"), F.max(F.struct("centroid_col", "centroid_row")).alias("b")
    )
    if ends.count() != grid.ny:
        raise RegionError(f"the grid has {grid.ny} rows; anchors must have as many")
    check_rows(ends, {"an anchor row needs two different endpoints": (F.col("n") < 2) | (F.col("a") == F.col("b"))}, RegionError)
    steps = max(grid.nx - 1, 1)
    marks = ends.select("row_number", "a", "b", F.explode(F.sequence(F.lit(0), F.lit(grid.nx - 1))).alias("k"))
    at = lambda c: F.col(f"a.{c}") + (F.col(f"b.{c}") - F.col(f"a.{c}")) * F.col("k") / steps
    label = ((F.col("row_number") - 1) * grid.nx + F.col("k") + 1).cast("long")
    marks = marks.select("row_number", (F.col("k") + 1).cast("int").alias("column_number"), label.alias("label"), disk(at("centroid_row"), at("centroid_col"), radius, height, width).alias("px"))
    check_rows(marks, {"a simulated mark has no pixels inside the image": F.size("px") == 0}, RegionError)
    pixels = marks.select("label", F.explode("px").alias("p")).select(F.col("p.row").cast("int").alias("row"), F.col("p.col").cast("int").alias("col"), "label")
    check_rows(pixels.groupBy("row", "col").count(), {"simulated marks overlap": F.col("count") > 1}, RegionError)
    regions = region_table(pixels).join(marks.drop("px"), "label").withColumns({
        "seg_label": F.col("label").cast("string"), "morphology": F.lit("simulated"), "right_to_left": (F.col("column_number") - grid.nx - 1).cast("int"),
    })
    return SegmentationResult(pixels, regions, {"method": "simulated", "radius": radius, "object_count": grid.n})
