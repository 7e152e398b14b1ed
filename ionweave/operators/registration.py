"""Pairing the MSI grid with laser marks by rank."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import RegistrationError
from ..model import MatrixBundle, RegistrationResult, check_rows, choice, not_finite, number, require

ORIENTATIONS = ("identity", "flip_x", "flip_y", "flip_xy", "swap_xy", "swap_flip_x", "swap_flip_y", "swap_flip_xy")
EDGES = ("error", "truncate_left", "truncate_right")


def check_inputs(pixels: DataFrame, regions: DataFrame) -> None:
    require(pixels, ["obs_id", "x", "y"], RegistrationError, "pixels")
    require(regions, ["seg_label", "morphology", "row_number", "column_number", "centroid_row", "centroid_col"], RegistrationError, "regions")
    check_rows(pixels, {"coordinates must be finite": not_finite(F.col("x")) | not_finite(F.col("y"))}, RegistrationError)
    keys = [F.count("*").alias("n"), F.count_distinct("obs_id").alias("i"), F.count_distinct("x", "y").alias("p")]
    if "dataset" in pixels.columns:
        keys.append(F.count_distinct("dataset").alias("d"))
    row = pixels.agg(*keys).first()
    if row.i != row.n:
        raise RegistrationError("observation identifiers must be unique")
    if row.p != row.n:
        raise RegistrationError("coordinates must be unique")
    if "dataset" in pixels.columns and row.d > 1:
        raise RegistrationError("registration takes one dataset at a time")
    active = regions.where("morphology <> 'spoilt'")
    check_rows(active.groupBy("row_number", "column_number").count(), {"active regions must be unique by row and column": F.col("count") > 1}, RegistrationError)


def orient(pixels: DataFrame, orientation: str) -> DataFrame:
    """x and y swapped and mirrored about min + max, as the orientation says."""
    choice("orientation", orientation, ORIENTATIONS, RegistrationError)
    if orientation.startswith("swap"):
        pixels = pixels.withColumns({"x": F.col("y"), "y": F.col("x")})
    flips = [c for c in "xy" if orientation.endswith((f"flip_{c}", "flip_xy"))]
    if flips:
        mid = pixels.agg(*[(F.min(c) + F.max(c)).alias(f"_m{c}") for c in flips])
        pixels = pixels.crossJoin(F.broadcast(mid))  # one row
        pixels = pixels.withColumns({c: F.col(f"_m{c}") - F.col(c) for c in flips}).drop(*[f"_m{c}" for c in flips])
    return pixels


def _row_ranks(rows: DataFrame, key: str, out: str) -> DataFrame:
    """Counts per row with the row's rank; one line per row of the grid."""
    sizes = rows.groupBy(key).agg(F.count("*").alias("_n"))
    return sizes.withColumn(out, F.row_number().over(Window.orderBy(key)))  # as many lines as grid rows


def rank_zip(pixels: DataFrame, regions: DataFrame, orientation: str = "identity", edge_policy: str = "error") -> DataFrame:
    """Regions with ``pixel_id`` and ``truncated``: k-th row with k-th row, j-th pixel with j-th mark.

    Where a pixel row is longer, the policy drops pixels on its left or right;
    lengths are returned for checking, so the plan stays lazy.
    """
    choice("edge_policy", edge_policy, EDGES, RegistrationError)
    active = regions.where("morphology <> 'spoilt'")
    turned = orient(pixels, orientation).select(F.col("obs_id").alias("pixel_id"), "x", "y")
    px_rows, mark_rows = _row_ranks(turned, "y", "_k"), _row_ranks(active, "row_number", "_k")
    paired = mark_rows.select("_k", "row_number", F.col("_n").alias("_marks")).join(px_rows.select("_k", "y", F.col("_n").alias("_pixels")), "_k")
    paired = F.broadcast(paired.withColumn("truncated", F.col("_pixels") - F.col("_marks")))  # one line per grid row
    shift = F.col("truncated") if edge_policy == "truncate_left" else F.lit(0)
    left = turned.join(paired.select("y", "row_number", "truncated"), "y")
    left = left.withColumn("_j", F.row_number().over(Window.partitionBy("row_number").orderBy("x")) - shift).select("row_number", "_j", "pixel_id", "truncated")
    right = active.withColumn("_j", F.row_number().over(Window.partitionBy("row_number").orderBy("column_number", "seg_label")))
    return right.join(left, ["row_number", "_j"]).drop("_j")


def _complaint(pixels: DataFrame, regions: DataFrame, orientation: str, edge_policy: str) -> str | None:
    """Why the orientation cannot be used, or None; compares row lengths only."""
    active = regions.where("morphology <> 'spoilt'")
    marks = [(r.row_number, r["count"]) for r in active.groupBy("row_number").count().orderBy("row_number").collect()]
    rows = [(r.y, r["count"]) for r in orient(pixels, orientation).groupBy("y").count().orderBy("y").collect()]
    if len(rows) != len(marks):
        return f"orientation {orientation}: the grid has {len(rows)} rows, the marks form {len(marks)}"
    for (_, n), (row, m) in zip(rows, marks):
        if m > n:
            return f"row {row}: {m} marks for {n} pixels"
        if n > m and edge_policy == "error":
            return f"row {row}: {n - m} pixels stay without a mark; an edge policy is needed"
    return None


def register(bundle: MatrixBundle, regions: DataFrame, orientation: str = "auto", edge_policy: str = "error") -> RegistrationResult:
    """Registered bundle, mapping, transform and report.

    ``auto`` needs exactly one orientation whose rows fit.  Mirroring x never
    changes row lengths, so fits come in pairs and ``auto`` reports either none
    or several; that contract is kept.
    """
    choice("orientation", orientation, ("auto", *ORIENTATIONS), RegistrationError)
    choice("edge_policy", edge_policy, EDGES, RegistrationError)
    check_inputs(bundle.obs, regions)
    if orientation == "auto":
        fits = [o for o in ORIENTATIONS if _complaint(bundle.obs, regions, o, edge_policy) is None]
        if not fits:
            raise RegistrationError("no orientation fits the marks")
        if len(fits) > 1:
            raise RegistrationError(f"several orientations fit the marks: {fits}")
        orientation = fits[0]
    elif problem := _complaint(bundle.obs, regions, orientation, edge_policy):
        raise RegistrationError(problem)
    mapping = rank_zip(bundle.obs, regions, orientation, edge_policy)
    metadata = [c for c in mapping.columns if c not in ("pixel_id", "label", "truncated")]
    clash = sorted(set(metadata) & set(bundle.obs.columns))
    if clash:
        raise RegistrationError(f"mark columns already exist among the observations: {clash}")
    obs = bundle.obs.drop("x", "y").join(mapping.select(F.col("pixel_id").alias("obs_id"), *metadata), "obs_id")
    obs = obs.withColumns({"x": F.col("centroid_col"), "y": F.col("centroid_row")})
    x = bundle.x.join(mapping.select(F.col("pixel_id").alias("obs_id")), "obs_id", "left_semi")
    report = mapping.groupBy("row_number").agg(F.count("*").alias("registered_pixels"), F.max("truncated").alias("truncated_pixels"))
    transform = {"orientation": orientation, "edge_policy": edge_policy}
    return RegistrationResult(MatrixBundle(obs, bundle.var, x, meta={**bundle.meta, "registration": transform}), mapping.drop("truncated"), transform, report)


def mount_images(bundle: MatrixBundle, images: dict[str, tuple[str, int, int]], library_id: str = "sample", spot_diameter: float = 1.0) -> MatrixBundle:
    """Record named images (path, height, width) of equal size and their scale factors."""
    number("spot_diameter", spot_diameter, RegistrationError, above=0)
    if not images or len({(h, w) for _, h, w in images.values()}) != 1:
        raise RegistrationError("images must be given and have equal height and width")
    entry = {"images": {k: v[0] for k, v in images.items()}, "scalefactors": {**{f"tissue_{k}_scalef": 1.0 for k in images}, "spot_diameter_fullres": float(spot_diameter)}}
    return MatrixBundle(bundle.obs, bundle.var, bundle.x, dict(bundle.layers), {**bundle.meta, "spatial": {library_id: entry}})
