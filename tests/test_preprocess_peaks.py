from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from ionweave.errors import PreprocessError
from ionweave.functions.joins import candidate_pairs
from ionweave.model import MatrixBundle
from ionweave.operators import peaks as p
from ionweave.operators import preprocess as pp


def values(spark, mz):
    return spark.createDataFrame([(float(v),) for v in mz], "mz double")


def peak_table(spark, spectra):
    return spark.createDataFrame([(i, j, float(m), float(v)) for i, s in enumerate(spectra) for j, (m, v) in enumerate(s)], "pixel_ord int, peak_ord int, mz double, intensity double")


def axis_of(df):
    return [round(r.mz, 9) for r in df.orderBy("col_ord").collect()]


def naive_groups(mz, tolerance, unit):
    span = (lambda v: tolerance) if unit == "da" else (lambda v: v * tolerance / 1e6)
    groups = []
    for v in sorted(mz):
        if groups:
            g = groups[-1]
            c = (sum(g) + v) / (len(g) + 1)
            if abs(g[0] - c) <= span(g[0]) and abs(v - c) <= span(v):
                g.append(v)
                continue
        groups.append([v])
    return [sum(g) / len(g) for g in groups]


def test_consensus_axis_literals(spark):
    assert axis_of(p.consensus_axis(values(spark, [100.0, 200.0, 100.006, 300.0]), 0.01, "da")) == [100.003, 200.0, 300.0]


@pytest.mark.parametrize("unit, tolerance, width", [("ppm", 20, 0.4), ("da", 0.01, 0.5), ("ppm", 500, 50)])
def test_consensus_equals_naive_fold(spark, unit, tolerance, width):
    mz = np.random.default_rng(5).uniform(100, 100 + width, 150).round(4)
    found = [r.mz for r in p.consensus_axis(values(spark, mz), tolerance, unit).orderBy("col_ord").collect()]
    assert found == pytest.approx(naive_groups(mz, tolerance, unit), rel=1e-12)


def test_consensus_over_many_partitions(spark):
    """One continuous run of values, cut at range bounds: groups and centres are those of a single fold."""
    rng = np.random.default_rng(6)
    runs = {
        "dense": (rng.uniform(100, 101, 3000).round(4), 25, "ppm"),
        "grid": (np.arange(100, 104, 0.002).round(3), 0.0031, "da"),
        "repeats": (rng.choice(np.arange(100, 100.2, 0.001).round(3), 2000), 15, "ppm"),
        "one group": (rng.uniform(100, 101, 500).round(4), 5, "da"),
        "no tolerance": (np.unique(rng.uniform(100, 101, 300).round(3)), 0, "da"),
    }
    keep = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for name, (mz, tolerance, unit) in runs.items():
            groups = p.consensus_groups(values(spark, mz), tolerance, unit).collect()
            want = naive_groups(mz, tolerance, unit)
            centers = {r.group_id: r.center for r in groups}
            assert [centers[i] for i in sorted(centers)] == pytest.approx(want, rel=1e-12), name
            assert sorted(centers) == list(range(len(want))) and sum(r.n for r in groups) == len(mz)
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
    assert p.consensus_groups(values(spark, [1.0]).where("mz < 0"), 1).count() == 0


@pytest.mark.parametrize("seed", range(25))
def test_partitions_meet_the_carried_fold(seed):
    rng = np.random.default_rng(seed)
    mz = np.unique(rng.uniform(100, 100.5, 300).round(3))
    n = rng.integers(1, 4, len(mz))
    span = lambda v: v * 18e-6
    whole, _, end, _ = p._fold(mz.tolist(), n.tolist(), span)
    cuts = [0, *sorted(rng.choice(np.arange(1, len(mz)), 5, replace=False).tolist()), len(mz)]
    state, rows, total = None, [], 0
    for a, b in zip(cuts, cuts[1:]):
        part, new, state = p._fold_part(mz[a:b].tolist(), n[a:b].tolist(), span, state)
        rows += [[a + i, total + g, take] for i, g, take in part]
        total += new
    assert rows == whole and state == pytest.approx(end)


def test_projection_literal(spark):
    axis = spark.createDataFrame([(0, 100.0), (1, 200.0)], "col_ord int, mz double")
    found = p.project(peak_table(spark, [[(99.999, 2), (100.001, 3), (200, 7)], [(100, 11)]]), axis, 0.01, "da")
    assert {(r.pixel_ord, r.col_ord): r.value for r in found.collect()} == {(0, 0): 5.0, (0, 1): 7.0, (1, 0): 11.0}


def test_projection_tie_takes_lower_entry(spark):
    axis = spark.createDataFrame([(0, 99.0), (1, 101.0)], "col_ord int, mz double")
    assert [r.col_ord for r in p.project(peak_table(spark, [[(100.0, 1)]]), axis, 1, "da").collect()] == [0]


def test_projection_equals_naive(spark):
    rng = np.random.default_rng(1)
    axis = np.unique(rng.uniform(100, 110, 200))
    mz = rng.uniform(100, 110, 300)
    found = p.project(peak_table(spark, [[(m, 1.0)] for m in mz]), spark.createDataFrame([(i, float(a)) for i, a in enumerate(axis)], "col_ord int, mz double"), 100, "ppm")
    got = {r.pixel_ord: r.col_ord for r in found.collect()}
    naive = {i: int(np.abs(axis - m).argmin()) for i, m in enumerate(mz) if np.abs(axis - m).min() <= m * 100 / 1e6}
    assert got == naive


def test_profile_bins(spark):
    axis, binned = p.bin_profiles(peak_table(spark, [[(100.1, 1), (100.7, 2), (101.2, 3)], [(100.2, 4), (101.8, 5)]]), 1.0)
    assert axis_of(axis) == [100.5, 101.5]
    assert {(r.pixel_ord, r.col_ord): r.value for r in binned.collect()} == {(0, 0): 3.0, (0, 1): 3.0, (1, 0): 4.0, (1, 1): 5.0}


def test_unused_bins_stay(spark):
    assert len(axis_of(p.bin_profiles(peak_table(spark, [[(100.1, 1), (103.5, 1)]]), 1.0)[0])) == 4


@pytest.mark.parametrize("mz, tolerance, expected", [([100, 100.006, 200], 0.01, {100.003: 3.0, 200.0: 4.0}), ([100, 102, 102.1], 1, {101.0: 3.0, 102.1: 4.0})])
def test_align_features(spark, mz, tolerance, expected):
    var = spark.createDataFrame([(f"f{i}", i, float(m)) for i, m in enumerate(mz)], "feature_id string, feature_ord int, mz double")
    x = spark.createDataFrame([("o", f"f{i}", v) for i, v in enumerate([1.0, 2.0, 4.0])], "obs_id string, feature_id string, value double")
    b = p.align_features(MatrixBundle(var, var, x), tolerance, "da")
    assert {round(r.mz, 6): r.value for r in b.var.join(b.x, "feature_id").collect()} == expected


def matrix(spark):
    rows = [[1, 0, 3], [1, 0, 0], [1, 2, 0]]
    x = spark.createDataFrame([(f"p{i}", f"m{j}", float(v)) for i, row in enumerate(rows) for j, v in enumerate(row) if v], "obs_id string, feature_id string, value double")
    obs = spark.createDataFrame([("p0", 0, "blank"), ("p1", 1, "blank"), ("p2", 2, "sample")], "obs_id string, obs_ord int, dataset string")
    var = spark.createDataFrame([("m0", 0, 100.0), ("m1", 1, 200.0), ("m2", 2, 300.0)], "feature_id string, feature_ord int, mz double")
    return MatrixBundle(obs, var, x)


def kept(b):
    return sorted(r.feature_id for r in b.var.collect())


def test_filter_is_strict(spark):
    assert kept(pp.filter_features(matrix(spark), 0.5)) == ["m0"]
    assert kept(pp.filter_features(matrix(spark), 1 / 3)) == ["m0"]
    assert kept(pp.filter_features(MatrixBundle(matrix(spark).obs.limit(0), matrix(spark).var, matrix(spark).x.limit(0)))) == []


def test_normalise(spark):
    x = spark.createDataFrame([("a", "m0", 3.0), ("a", "m1", 4.0)], "obs_id string, feature_id string, value double")
    assert {r.feature_id: r.value for r in pp.normalised(x, "rms", 2).collect()} == pytest.approx({"m0": 3 / 12.5**0.5, "m1": 4 / 12.5**0.5})
    assert {r.feature_id: r.value for r in pp.normalised(x.withColumn("value", -F.col("value")), "tic").collect()} == pytest.approx({"m0": -3 / 7, "m1": -4 / 7})
    zero = x.withColumn("value", F.lit(0.0))
    assert [r.value for r in pp.normalised(zero, "rms", 2).collect()] == [0.0, 0.0]


def test_removals(spark):
    b = matrix(spark)
    left, report = pp.remove_matrix_peaks(b, "reference", reference=values(spark, [100.0005]), tolerance=10)
    assert kept(left) == ["m1", "m2"] and [r.reason for r in report.collect()] == ["reference_match"]
    assert kept(pp.remove_matrix_peaks(b, "reference", reference=values(spark, [100.0, 100.0011]), tolerance=1)[0]) == ["m1", "m2"]
    left, report = pp.remove_matrix_peaks(b, "blank", blanks=["blank"], matrix_frequency=0.8)
    assert kept(left) == ["m1", "m2"] and [r.reason for r in report.collect()] == ["blank_frequency"]
    grid = [(f"p{i}", i, float(i % 3), float(i // 3)) for i in range(9)]
    obs = spark.createDataFrame(grid, "obs_id string, obs_ord int, x double, y double")
    x = spark.createDataFrame([(o, "m0", 1.0) for o, _, a, c in grid if (a, c) != (1, 1)] + [("p4", "m1", 1.0)], "obs_id string, feature_id string, value double")
    left, report = pp.remove_matrix_peaks(MatrixBundle(obs, b.var, x), "denovo")
    assert kept(left) == ["m1", "m2"] and [r.reason for r in report.collect()] == ["edge_frequency"]


@pytest.mark.parametrize("arguments", [dict(method="other"), dict(method="reference"), dict(method="blank", blanks=[]), dict(method="denovo", tolerance=0), dict(method="denovo", matrix_frequency=2)])
def test_bad_removals(spark, arguments):
    with pytest.raises(PreprocessError):
        pp.remove_matrix_peaks(matrix(spark), **arguments)


def test_range_join_equals_nested_loop(spark):
    rng = np.random.default_rng(2)
    q, r = rng.uniform(100, 101, 120).round(3), rng.uniform(100, 101, 150).round(3)
    left = spark.createDataFrame([(i, float(v)) for i, v in enumerate(q)], "i int, a double")
    right = spark.createDataFrame([(i, float(v)) for i, v in enumerate(r)], "j int, b double")
    for unit, t in (("ppm", 100.0), ("da", 0.01), ("ppm", 0.0)):
        limit = (lambda v: t) if unit == "da" else (lambda v: v * t / 1e6)
        naive = {(i, j) for i, a in enumerate(q) for j, b in enumerate(r) if abs(b - a) <= limit(a)}
        assert {(x.i, x.j) for x in candidate_pairs(left, right, "a", "b", t, unit).collect()} == naive
    plan = candidate_pairs(left, right, "a", "b", 5.0, "ppm")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_preprocess_without_frequent_features(spark):
    """A filter that keeps no feature leaves an empty matrix, not an error."""
    obs = spark.range(40).select(F.col("id").alias("obs_id"), F.col("id").alias("obs_ord"))
    var = spark.range(40).select(F.col("id").alias("feature_id"), F.col("id").alias("feature_ord"), (F.col("id") + 100.0).alias("mz"))
    x = spark.range(40).select(F.col("id").alias("obs_id"), F.col("id").alias("feature_id"), F.lit(2.0).alias("value"))
    out = pp.preprocess(MatrixBundle(obs, var, x))
    assert out.layers["normalized"].count() == out.var.count() == 0 and out.obs.count() == 40
    with pytest.raises(PreprocessError):
        pp.normalised(x, "rms")
