from __future__ import annotations

import itertools

import pytest

from ionweave.errors import RegionError, RegistrationError
from ionweave.model import MatrixBundle
from ionweave.operators import regions as g
from ionweave.operators import registration as reg

REGION = "label long, area double, centroid_row double, centroid_col double"
FOUR = [(1, 5.0, 10.0, 10.0), (2, 5.0, 10.5, 20.0), (3, 5.0, 40.0, 10.0), (4, 7.0, 40.5, 20.0)]


def regions(spark, rows=FOUR):
    return spark.createDataFrame(rows, REGION)


def numbered(df):
    return {r.label: (r.row_number, r.column_number, r.right_to_left) for r in df.collect()}


def test_rows_by_expected_gap(spark):
    assert numbered(g.detect_rows(regions(spark), expected_rows=2)) == {1: (1, 1, -2), 2: (1, 2, -1), 3: (2, 1, -2), 4: (2, 2, -1)}


def test_rows_by_robust_gap(spark):
    rows = [(i * 3 + j + 1, 1.0, i * 30.0 + j * 0.5, j * 10.0) for i in range(4) for j in range(3)]
    assert {v[0] for v in numbered(g.detect_rows(regions(spark, rows))).values()} == {1, 2, 3, 4}


def test_last_window_is_not_examined(spark):
    rows = [(i + 1, 1.0, float(v), float(i)) for i, v in enumerate([0, 0, 0, 0, 100])]
    assert {v[0] for v in numbered(g.detect_rows(regions(spark, rows), method="rolling_variance", window_size=5, variance_threshold=1)).values()} == {1}
    rows.append((6, 1.0, 100.0, 9.0))
    assert {v[0] for v in numbered(g.detect_rows(regions(spark, rows), method="rolling_variance", window_size=5, variance_threshold=1)).values()} == {1, 2}


def test_thinning_takes_every_nth(spark):
    rows = [(i + 1, 1.0, float(i * 10), 0.0) for i in range(12)]
    found = numbered(g.detect_rows(regions(spark, rows), method="rolling_variance", window_size=2, variance_threshold=1, thinning=4))
    assert max(v[0] for v in found.values()) == 4  # candidates 2..11, breaks at 2, 6, 10


def test_empty_regions(spark):
    assert g.detect_rows(regions(spark, []).limit(0)).collect() == []
    with pytest.raises(RegionError):
        g.check_row_count(g.detect_rows(regions(spark, [])), 2)


def test_exclusion_includes_bounds(spark):
    assert sorted(r.label for r in g.exclude_regions(regions(spark), min_column=15).collect()) == [2, 4]
    assert sorted(r.label for r in g.exclude_regions(regions(spark), min_row=10.5, max_row=40).collect()) == [2, 3]
    with pytest.raises(RegionError):
        g.exclude_regions(regions(spark), min_row=2, max_row=1)


def rules(spark, rows):
    return spark.createDataFrame(rows, "row_number int, source_labels string")


def test_merge_literal(spark):
    rows = g.detect_rows(regions(spark), expected_rows=2)
    merged = {r.seg_label: r for r in g.merge_regions(rows, rules(spark, [(2, "3,4")])).collect()}
    assert merged["3_4"].area == 12 and merged["3_4"].morphology == "combined" and merged["3_4"].centroid_row == 40.25
    assert {k for k, r in merged.items() if r.morphology == "spoilt"} == {"3", "4"}
    assert (merged["3_4"].column_number, merged["3_4"].right_to_left) == (1, -1)
    before = {r.seg_label: r for r in rows.collect()}
    assert all((merged[k].column_number, merged[k].right_to_left) == (before[k].column_number, before[k].right_to_left) for k in "34")  # spoilt ones keep theirs
    assert merged["3_4"].label == before["3"].label


def test_merge_two_rules_in_a_row(spark):
    rows = g.detect_rows(regions(spark, [(i, 1.0, 0.0, float(i)) for i in range(1, 7)]), expected_rows=1)
    merged = g.merge_regions(rows, rules(spark, [(1, "1,2"), (1, "4_5")])).where("morphology <> 'spoilt'").orderBy("column_number").collect()
    assert [(r.seg_label, r.column_number, r.right_to_left) for r in merged] == [("1_2", 1, -4), ("3", 2, -3), ("4_5", 3, -2), ("6", 4, -1)]


@pytest.mark.parametrize("bad", [[(1, "1")], [(1, "1,1")], [(1, "1,9")], [(2, "1,2")], [(1, "1,2"), (1, "2,3")], [(1, "1,")]])
def test_bad_rules(spark, bad):
    rows = g.detect_rows(regions(spark, [(i, 1.0, 0.0, float(i)) for i in range(1, 4)]), expected_rows=1)
    with pytest.raises(RegionError):
        g.merge_regions(rows, rules(spark, bad))


def simulated(spark, anchors, shape=(10, 10), radius=2, nx=3, ny=2):
    msi = spark.createDataFrame([(float(x), float(y)) for x in range(nx) for y in range(ny)], "x double, y double")
    table = spark.createDataFrame([(r, float(a), float(b)) for r, a, b in anchors], "row_number int, centroid_row double, centroid_col double")
    return g.simulate_marks(msi, table, shape, radius)


def test_simulated_marks(spark):
    found = simulated(spark, [(1, 2, 1), (1, 2, 8), (2, 8, 1), (2, 8, 8)])
    rows = found.regions.orderBy("label").collect()
    assert [(r.row_number, r.column_number, r.right_to_left) for r in rows] == [(1, 1, -3), (1, 2, -2), (1, 3, -1), (2, 1, -3), (2, 2, -2), (2, 3, -1)]
    clipped = simulated(spark, [(1, 0, 1), (1, 0, 7), (2, 6, 1), (2, 6, 7)]).regions.where("label = 1").first()
    assert (clipped.area, clipped.centroid_row, clipped.centroid_col) == (6.0, 0.5, 1.0)


@pytest.mark.parametrize("anchors, more", [([(1, 2, 1), (1, 2, 2), (2, 8, 1), (2, 8, 8)], {}), ([(1, 2, 1), (1, 2, 8)], {}), ([(1, 2, 1), (2, 8, 1), (2, 8, 8)], {}), ([(1, 50, 1), (1, 50, 8), (2, 8, 1), (2, 8, 8)], {}), ([(1, 2, 1), (1, 2, 8), (2, 8, 1), (2, 8, 8)], {"radius": 0})])
def test_bad_simulations(spark, anchors, more):
    with pytest.raises(RegionError):
        simulated(spark, anchors, **more)


# --------------------------------------------------------------------------


def grid(spark, nx=3, ny=2):
    return spark.createDataFrame([(f"p{x}{y}", float(x), float(y)) for y in range(1, ny + 1) for x in range(1, nx + 1)], "obs_id string, x double, y double")


def marks(spark, nx=3, ny=2):
    rows = [(f"{y}{x}", "intact", y, x, y * 10.0, x * 10.0) for y in range(1, ny + 1) for x in range(1, nx + 1)]
    return spark.createDataFrame(rows, "seg_label string, morphology string, row_number int, column_number int, centroid_row double, centroid_col double")


def order(df):
    return [r.pixel_id for r in df.orderBy("row_number", "column_number").collect()]


@pytest.mark.parametrize("orientation", reg.ORIENTATIONS)
def test_eight_orientations(spark, orientation):
    swap = orientation.startswith("swap")
    pixels = [(x, y) for x, y in itertools.product((1, 2, 3), (1, 2))]

    def turned(p):
        x, y = (p[1], p[0]) if swap else p
        width, height = (2, 3) if swap else (3, 2)
        if orientation.endswith(("flip_x", "flip_xy")):
            x = width + 1 - x
        if orientation.endswith(("flip_y", "flip_xy")):
            y = height + 1 - y
        return y, x

    want = [f"p{x}{y}" for x, y in sorted(pixels, key=turned)]
    assert order(reg.rank_zip(grid(spark), marks(spark, *((2, 3) if swap else (3, 2))), orientation)) == want


def bundle(spark, nx=3, ny=2):
    g_ = grid(spark, nx, ny)
    x = g_.selectExpr("obs_id", "'m1' AS feature_id", "x AS value")
    return MatrixBundle(g_, spark.createDataFrame([("m1", 0)], "feature_id string, feature_ord int"), x)


@pytest.mark.parametrize("policy, first", [("truncate_left", 2), ("truncate_right", 1)])
def test_truncation(spark, policy, first):
    found = reg.register(bundle(spark, 4), marks(spark), "identity", policy)
    assert order(found.mapping) == [f"p{x}{y}" for y in (1, 2) for x in range(first, first + 3)]
    assert {r.row_number: (r.registered_pixels, r.truncated_pixels) for r in found.report.collect()} == {1: (3, 1), 2: (3, 1)}
    spatial = {r.obs_id: (r.x, r.y) for r in found.bundle.obs.collect()}
    assert spatial[f"p{first}1"] == (10.0, 10.0) and len(spatial) == 6 and found.bundle.x.count() == 6


def test_spoilt_marks_take_no_part(spark):
    table = marks(spark).union(spark.createDataFrame([("x", "spoilt", 1, 1, 0.0, 0.0)], marks(spark).schema))
    assert len(order(reg.register(bundle(spark), table, "identity").mapping)) == 6


@pytest.mark.parametrize("nx, ny, orientation, policy", [(4, 2, "identity", "error"), (2, 2, "identity", "truncate_left"), (3, 3, "identity", "truncate_left"), (3, 2, "sideways", "error"), (3, 2, "identity", "keep")])
def test_registration_errors(spark, nx, ny, orientation, policy):
    with pytest.raises(RegistrationError):
        reg.register(bundle(spark, nx, ny), marks(spark), orientation, policy)


def test_auto_reports_none_or_several(spark):
    with pytest.raises(RegistrationError, match="several"):
        reg.register(bundle(spark), marks(spark), "auto")
    with pytest.raises(RegistrationError, match="no orientation"):
        reg.register(bundle(spark, 5, 5), marks(spark), "auto")


def test_duplicate_inputs(spark):
    b = bundle(spark)
    with pytest.raises(RegistrationError):
        reg.register(MatrixBundle(b.obs.union(b.obs), b.var, b.x), marks(spark), "identity")
    with pytest.raises(RegistrationError):
        reg.register(b, marks(spark).union(marks(spark)), "identity")


def test_mounted_images(spark):
    b = reg.mount_images(bundle(spark), {"hires": ("a.png", 10, 20), "laser": ("b.png", 10, 20)}, spot_diameter=2)
    assert b.meta["spatial"]["sample"]["scalefactors"]["spot_diameter_fullres"] == 2.0
    with pytest.raises(RegistrationError):
        reg.mount_images(b, {"a": ("a", 1, 1), "b": ("b", 2, 1)})
