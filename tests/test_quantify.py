from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from ionweave.errors import QuantifyError
from ionweave.model import MatrixBundle
from ionweave.operators import quantify as q

# mark 5 has six pixels, mark 9 eight; cell 2 lies over both, cell 3 partly over 9
LASER = [[5, 5, 5, 0, 9, 9, 9, 9], [5, 5, 5, 0, 9, 9, 9, 9]]
CELLS = [[1, 1, 2, 2, 2, 2, 3, 3], [1, 1, 2, 2, 2, 2, 3, 0]]


def pixels(spark, raster):
    return spark.createDataFrame([(r, c, v) for r, row in enumerate(raster) for c, v in enumerate(row)], "row int, col int, label long")


def marks(spark, rows=(("s1", "5", 6.0, 0.5, 1.0), ("s2", "9", 8.0, 0.5, 5.5))):
    return spark.createDataFrame(list(rows), "obs_id string, seg_label string, area double, centroid_row double, centroid_col double")


def spectra(spark):
    return spark.createDataFrame([("s1", "m1", 6.0), ("s1", "m2", 18.0), ("s2", "m1", 16.0), ("s2", "m2", 24.0)], "obs_id string, feature_id string, value double")


def var(spark):
    return spark.createDataFrame([("m1", 0, 121.5), ("m2", 1, 340.25)], "feature_id string, feature_ord int, mz double")


def bundle(spark):
    return MatrixBundle(marks(spark), var(spark), spectra(spark))


def overlaps(spark, rows):
    return spark.createDataFrame([(c, 0, m, f"p{m}", 1, 10, r) for c, m, r in rows], "cell_id string, cell_label long, laser_label long, laser_obs_id string, occupied_pixels long, laser_area long, occupied_ratio double")


def test_overlap_table(spark):
    found, cells = q.overlap_table(pixels(spark, CELLS), pixels(spark, LASER), marks(spark), 10)
    assert sorted((r.cell_id, r.laser_label, r.occupied_ratio) for r in found.collect()) == [("c1", 5, 4 / 6), ("c2", 5, 2 / 6), ("c2", 9, 4 / 8), ("c3", 9, 3 / 8)]
    assert {r.cell_id: r.area for r in cells.collect()} == {"c1": 4, "c2": 8, "c3": 3}


def test_boundary_is_strict(spark):
    raster = [[1, 2, 0, 0, 3]]
    found = q.overlap_table(pixels(spark, raster), pixels(spark, raster), marks(spark, [("a", "1", 1.0, 0.0, 1.0), ("b", "3", 1.0, 0.0, 3.0)]), 0.75)[1]
    assert [r.cell_id for r in found.collect()] == ["c2"]
    edge = q.overlap_table(pixels(spark, raster), pixels(spark, raster), marks(spark, [("a", "1", 1.0, 0.0, 1.0), ("b", "3", 1.0, 0.0, 3.0)]), 1.0)[1]
    assert [r.cell_id for r in edge.collect()] == ["c2"]  # columns 0 and 4 lie on the box


def test_random_rasters_equal_naive(spark):
    rng = random.Random(3)
    a = [[rng.randrange(4) for _ in range(11)] for _ in range(9)]
    b = [[rng.randrange(4) for _ in range(11)] for _ in range(9)]
    found = q.overlap_table(pixels(spark, a), pixels(spark, b), marks(spark, [(f"p{k}", str(k), 1.0, 4.0, 5.0) for k in (1, 2, 3)]), 100)[0]
    naive = {}
    for r in range(9):
        for c in range(11):
            if a[r][c] and b[r][c]:
                naive[a[r][c], b[r][c]] = naive.get((a[r][c], b[r][c]), 0) + 1
    assert {(r.cell_label, r.laser_label): r.occupied_pixels for r in found.collect()} == naive


def test_selection_reasons(spark):
    rows = [("c1", 1, 0.2), ("c1", 2, 0.7), ("c2", 2, 0.1), ("c3", 3, 0.05)]
    found = {(r.cell_id, r.laser_label): r.rejection_reason for r in q.select_specific(overlaps(spark, rows)).collect()}
    assert found == {("c1", 1): None, ("c1", 2): None, ("c2", 2): "non_dominant_mapping", ("c3", 3): "unique_overlap_not_above_threshold"}


@pytest.mark.parametrize("ratios", [[0.1], [0.6, 0.1], [0.7, 0.15], [0.5, 0.5]])
def test_selection_is_strict(spark, ratios):
    found = q.select_specific(overlaps(spark, [(f"c{i}", 1, r) for i, r in enumerate(ratios)]))
    assert found.where("rejection_reason IS NULL").count() == 0


def test_legacy_and_specificity_abundance(spark):
    legacy = q.quantify_cells(bundle(spark), pixels(spark, CELLS), pixels(spark, LASER), "legacy_proportional", 10)
    assert {(r.obs_id, r.feature_id): r.value for r in legacy.bundle.x.collect()} == pytest.approx({("c1", "m1"): 4.0, ("c1", "m2"): 12.0, ("c2", "m1"): 10.0, ("c2", "m2"): 18.0, ("c3", "m1"): 6.0, ("c3", "m2"): 9.0})
    table = spark.createDataFrame([("c1", 1, 2, "b", 8, 10, 0.8), ("c2", 2, 2, "b", 1, 10, 0.1), ("c1", 1, 1, "a", 1, 2, 0.5)], "cell_id string, cell_label long, laser_label long, laser_obs_id string, occupied_pixels long, laser_area long, occupied_ratio double")
    x = spark.createDataFrame([("a", "m", 100.0), ("b", "m", 50.0)], "obs_id string, feature_id string, value double")
    judged = q.select_specific(table)
    accepted = judged.where("rejection_reason IS NULL")
    assert [r.value for r in q.specificity_abundance(table, accepted, x).collect()] == [pytest.approx(770 / 17)]
    rejected = judged.where("rejection_reason IS NOT NULL")
    assert q.partition_difference(table, accepted, rejected).count() == 0
    assert q.partition_difference(table, accepted, rejected.limit(0)).count() == 1


def test_cells_without_marks_stay(spark):
    cells = [*CELLS, [7] + [0] * 7]
    found = q.quantify_cells(bundle(spark), pixels(spark, cells), pixels(spark, LASER), "legacy_proportional", 10)
    rows = {r.obs_id: (r.laser_labels, r.laser_coverage, r.quantification_status) for r in found.bundle.obs.collect()}
    assert rows == {"c1": ("5", "4", "quantified"), "c2": ("5_9", "2_4", "quantified"), "c3": ("9", "3", "quantified"), "c7": ("0", "0", "zero")}
    assert found.report.first().asDict() == {"included_cells": 4, "quantified_cells": 3, "accepted_overlaps": 4, "rejected_overlaps": 0}


@pytest.mark.parametrize("area, occupied, threshold, kept", [(10.0, 8, 0.2, True), (2e15, 1_600_000_000_000_001, 0.2, False), (4.0, 5, 0.2, False), (4.0, 5, 0.0, True), (4.0, 0, 1.0, True)])
def test_residual_threshold(spark, area, occupied, threshold, kept):
    accepted = spark.createDataFrame([("p", occupied)], "laser_obs_id string, occupied_pixels long")
    found = q.residual_marks(marks(spark, [("p", "1", area, 0.0, 0.0)]), accepted, threshold).collect()
    assert bool(found) == kept
    if kept and area == 10.0:
        assert found[0].residual_fraction == 0.2


def test_mixed_bundle_with_combined_mark(spark):
    m = marks(spark, [("p", "2_3", 20.0, 0.5, 2.5)])
    x = spark.createDataFrame([("p", "m1", 30.0), ("p", "m2", 40.0)], "obs_id string, feature_id string, value double")
    cells = MatrixBundle(spark.createDataFrame([("c1", 5.0)], "obs_id string, area double"), var(spark), x.limit(0))
    accepted = spark.createDataFrame([("c1", 1, 2, "p", 3, 10, 0.3), ("c1", 1, 3, "p", 7, 10, 0.7)], OVERLAP)
    found = q.mixed_bundle(cells, MatrixBundle(m, var(spark), x), accepted)
    assert {r.feature_id: r.value for r in found.x.collect()} == {"m1": 15.0, "m2": 20.0}
    assert {r.obs_id: (r.data_type, r.residual_fraction) for r in found.obs.collect()} == {"c1": ("cell", None), "laser_residual_p": ("laser_residual", 0.5)}


OVERLAP = "cell_id string, cell_label long, laser_label long, laser_obs_id string, occupied_pixels long, laser_area long, occupied_ratio double"


def test_residual_names_must_not_be_taken(spark):
    cells = MatrixBundle(spark.createDataFrame([("laser_residual_s1", 1)], "obs_id string, label long"), var(spark), spectra(spark).limit(0))
    accepted = spark.createDataFrame([("laser_residual_s1", 1, 5, "s1", 1, 6, 1 / 6)], OVERLAP)
    with pytest.raises(QuantifyError, match="collide"):
        q.mixed_bundle(cells, bundle(spark), accepted)


@pytest.mark.parametrize("change, message", [
    (dict(cell_id="c9"), "unknown cell"), (dict(laser_obs_id="s2"), "does not belong to laser_obs_id"), (dict(cell_label=4), "does not belong to cell_id"), (dict(occupied_ratio=0.5), "differs"),
    (dict(occupied_pixels=9), "exceeds"), (dict(laser_area=None), "missing"), (dict(laser_label=77), "does not belong to laser_obs_id"), (dict(occupied_pixels=-1, occupied_ratio=-1 / 6), "positive"),
])
def test_accepted_overlaps_must_fit(spark, change, message):
    row = dict(cell_id="c1", cell_label=1, laser_label=5, laser_obs_id="s1", occupied_pixels=4, laser_area=6, occupied_ratio=4 / 6)
    cells = MatrixBundle(spark.createDataFrame([("c1", 1), ("c2", 2)], "obs_id string, label long"), var(spark), spectra(spark).limit(0))

    def table(*rows):
        return spark.createDataFrame([tuple(r.values()) for r in rows], OVERLAP)

    q.check_accepted(cells, bundle(spark), table(row))
    with pytest.raises(QuantifyError, match=message):
        q.check_accepted(cells, bundle(spark), table(row | change))
    with pytest.raises(QuantifyError, match="twice"):
        q.check_accepted(cells, bundle(spark), table(row, row))
    with pytest.raises(QuantifyError, match="same features"):
        q.check_accepted(MatrixBundle(cells.obs, var(spark).withColumn("mz", F.col("mz") + 1e-9), cells.x), bundle(spark), table(row))


@pytest.mark.parametrize("labels", [["1", "1"], ["1_1"], ["a"], ["-1"], [""]])
def test_bad_labels(spark, labels):
    with pytest.raises(QuantifyError):
        q.check_marks(marks(spark, [(f"p{i}", v, 1.0, 0.0, 0.0) for i, v in enumerate(labels)]))


def test_empty_rasters(spark):
    found = q.quantify_cells(bundle(spark), pixels(spark, [[0]]), pixels(spark, [[0]]))
    assert found.overlaps.count() == 0 and found.bundle.obs.count() == 0 and found.report.first().included_cells == 0


@pytest.mark.parametrize("value", [True, -0.1, 1.1, float("nan"), "x"])
def test_bad_thresholds(spark, value):
    with pytest.raises(QuantifyError):
        q.select_specific(overlaps(spark, [("c", 1, 0.5)]), unique_min=value)


def test_partition_difference_counts_copies_in_one_pass(spark):
    row = "cell_id string, laser_label long, n int"
    table = spark.createDataFrame([("a", 1, None)] * 3 + [("b", 2, 5)], row)
    accepted, rejected = spark.createDataFrame([("a", 1, None)], row), spark.createDataFrame([("b", 2, 5), ("b", 2, 5), ("c", 3, 1)], row)
    found = q.partition_difference(table, accepted, rejected)
    assert sorted(map(str, (tuple(r) for r in found.collect()))) == sorted(map(str, [("a", 1, None)] * 2 + [("b", 2, 5), ("c", 3, 1)]))
    assert "EXCEPT" not in found._jdf.queryExecution().toString().upper() and found.columns == table.columns
