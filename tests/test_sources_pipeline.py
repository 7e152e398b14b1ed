from __future__ import annotations

import json

import numpy as np
import pytest
import yaml
from pyspark.sql import functions as F

from ionweave import cli
from ionweave.errors import ConfigError, RegionError, SourceError, StageError
from ionweave.operators import imaging as im
from ionweave.plans import config as cfg
from ionweave.plans.pipeline import Pipeline
from ionweave.plans.store import StageStore, content_digest, stage_signature
from ionweave.sources import external, imzml, sinks, tables
from ionweave.streaming import projection


def disks(shape=(80, 100), circles=((25, 25, 8), (55, 70, 9))):
    y, x = np.indices(shape)
    return sum(((y - a) ** 2 + (x - b) ** 2 <= r * r).astype(float) for a, b, r in circles)


# --------------------------------------------------------------------------
# image segmentation


def test_two_disks():
    labels, facts = im.segment_image(disks(), top_hat_radius=0, min_peak_distance=5)
    assert facts["object_count"] == 2 and {labels[25, 25], labels[55, 70]} == {1, 2}
    table = {k: (np.argwhere(labels == k).mean(0).round().tolist(), int((labels == k).sum())) for k in (1, 2)}
    assert table[labels[25, 25]][0] == [25, 25] and table[labels[55, 70]][0] == [55, 70]


def test_touching_disks_split():
    image = disks((60, 80), ((30, 30, 10), (30, 48, 10)))
    labels, facts = im.segment_image(image, top_hat_radius=0, min_peak_distance=8)
    assert facts["object_count"] == 2 and labels[30, 25] != labels[30, 53]


def test_mask_small_objects_and_border():
    image = disks((60, 60), ((30, 30, 8), (2, 30, 6), (50, 50, 2)))
    labels, facts = im.segment_image(image, top_hat_radius=0, min_peak_distance=5)
    assert facts["object_count"] == 1
    mask = np.zeros(image.shape, bool)
    with pytest.raises(RegionError):
        im.segment_image(image, mask)
    for bad in (dict(min_size=0), dict(marker_connectivity=3), dict(unknown=1), dict(top_hat_mode="x"), dict(intensity_cutoff=True)):
        with pytest.raises(RegionError):
            im.segment_image(image, **bad)


def test_image_steps_equal_naive():
    rng = np.random.default_rng(1)
    mask = rng.random((17, 23)) < 0.7
    back = np.argwhere(~mask)
    naive = np.array([[np.sqrt(((back - (r, c)) ** 2).sum(1)).min() for c in range(23)] for r in range(17)])
    assert im.distance(mask) == pytest.approx(naive)
    a = rng.random((9, 11))
    for r in (1, 2):
        offsets = im._disk(r)
        want = [[min(a[y + dy, x + dx] for dy, dx in offsets if 0 <= y + dy < 9 and 0 <= x + dx < 11) for x in range(11)] for y in range(9)]
        assert im.erode(a, offsets) == pytest.approx(np.array(want))
    for connectivity in (1, 2):
        parts = im.label(mask, connectivity)
        seen, count = np.zeros(mask.shape, int), 0
        for start in np.argwhere(mask):
            if seen[tuple(start)]:
                continue
            count += 1
            stack = [tuple(start)]
            while stack:
                y, x = stack.pop()
                if 0 <= y < 17 and 0 <= x < 23 and mask[y, x] and not seen[y, x]:
                    seen[y, x] = count
                    stack += [(y + dy, x + dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if abs(dy) + abs(dx) <= connectivity]
        assert (parts == seen).all()
    bimodal = np.concatenate([rng.normal(0.2, 0.02, 500), rng.normal(0.8, 0.02, 500)])
    assert 0.25 < im.otsu(bimodal) < 0.75


def test_images_in_parallel(spark):
    frames = []
    for k, image in enumerate((disks(), disks((60, 60), ((30, 30, 9),)))):
        frames.append(tables.raster_pixels(spark, image, "value").withColumn("image_id", F.lit(k)))
    found = im.segment_images(frames[0].union(frames[1]), top_hat_radius=0, min_peak_distance=5)
    assert {r.image_id: r.n for r in found.groupBy("image_id").agg(F.count_distinct("label").alias("n")).collect()} == {0: 2, 1: 1}


# --------------------------------------------------------------------------
# sources and sinks


def test_imzml(spark, tmp_path):
    path = str(tmp_path / "run.imzML")
    imzml.write_imzml(path, [(1, 2, [100.0, 200.0], [1.0, 2.0]), (2, 2, [100.004, 300.0], [3.0, 4.0])])
    b = imzml.read_imzml(spark, path, "d", 0.01, "da")
    assert b.var.count() == 3 and {(r.obs_id, r.x, r.y, r.dataset) for r in b.obs.collect()} == {("p1", 1, 2, "d"), ("p2", 2, 2, "d")}
    got = {(r.obs_id, round(r.mz, 3)): r.value for r in b.x.join(b.var, "feature_id").collect()}
    assert got == {("p1", 100.002): 1.0, ("p2", 100.002): 3.0, ("p1", 200.0): 2.0, ("p2", 300.0): 4.0}
    parts = spark.read.format("imzml").option("spectraPerPartition", 1).load(path)
    assert parts.rdd.getNumPartitions() == 2 and parts.count() == 2
    with pytest.raises(SourceError):
        imzml.read_imzml(spark, str(tmp_path / "none.imzML"), "d")
    (tmp_path / "empty.imzML").write_text("<mzML/>")
    (tmp_path / "empty.ibd").write_bytes(b"")
    with pytest.raises(SourceError):
        imzml.read_index(str(tmp_path / "empty.imzML"))


def test_shared_axis_and_profiles(spark, tmp_path):
    path = str(tmp_path / "s.imzML")
    imzml.write_imzml(path, [(1, 1, [100.0, 100.0001], [1.0, 0.0]), (2, 1, [100.0, 100.0001], [3.0, 4.0])])
    assert imzml.read_imzml(spark, path, "d").var.count() == 2  # a common axis is kept as it is
    assert imzml.read_imzml(spark, path, "d", profile_bin_size=1.0).var.count() == 1


def test_segmentations(spark, tmp_path):
    good = np.array([[0, 1], [2, 2]])
    np.save(tmp_path / "a.npy", good)
    np.savez(tmp_path / "b.npz", labels=good)
    for name in ("a.npy", "b.npz"):
        assert {(r.row, r.col, r.label) for r in tables.read_segmentation(spark, str(tmp_path / name)).collect()} == {(0, 1, 1), (1, 0, 2), (1, 1, 2)}
    np.savez(tmp_path / "c.npz", other=good)
    np.save(tmp_path / "d.npy", good - 5)
    np.save(tmp_path / "e.npy", good.astype(float))
    np.save(tmp_path / "f.npy", good[None])
    (tmp_path / "g.pkl").write_bytes(b"")
    for name in ("c.npz", "d.npy", "e.npy", "f.npy", "g.pkl", "h.npy", "i.tif"):
        with pytest.raises(SourceError):
            tables.load_labels(str(tmp_path / name), trusted_pickle=True)


def test_tables(spark, tmp_path):
    (tmp_path / "rules.csv").write_text('row_number,source_labels,note\n1,"2, 3",x\n2,4_5,\n')
    assert [(r.row_number, r.source_labels) for r in tables.load_merge_rules(spark, str(tmp_path / "rules.csv")).collect()] == [(1, "2|3"), (2, "4|5")]
    (tmp_path / "mz.csv").write_text("mz\n100.5\n")
    assert tables.load_reference_mz(spark, str(tmp_path / "mz.csv")).first().mz == 100.5
    (tmp_path / "bad.csv").write_text("mz\n-1\n")
    with pytest.raises(SourceError):
        tables.load_reference_mz(spark, str(tmp_path / "bad.csv"))
    (tmp_path / "path.csv").write_text("x,y\n0,0\n3,4\n")
    assert tables.load_path(spark, str(tmp_path / "path.csv")) == [(0.0, 0.0), (3.0, 4.0)]
    (tmp_path / "usage.tsv").write_text("id\tUsage_1\n007\t0.5\n")
    assert tables.load_usage_table(spark, str(tmp_path / "usage.tsv")).first().obs_id == "007"
    (tmp_path / "ref.txt").write_text("a\tb\n1\t2\n")
    assert tables.load_annotation_table(spark, str(tmp_path / "ref.txt")).columns == ["a", "b", "ref_ord"]
    assert tables.file_digests(spark, str(tmp_path / "mz.csv")).first().size == 9


def test_atomic_and_csv(spark, tmp_path):
    with pytest.raises(RuntimeError), sinks.atomic_path(tmp_path / "x") as tmp:
        open(tmp, "w").write("half")
        raise RuntimeError
    assert list(tmp_path.iterdir()) == []
    sinks.write_json(tmp_path / "j.json", {1: np.int64(2), "k": (1, 2)})
    assert json.loads((tmp_path / "j.json").read_text()) == [[1, 2], ["k", [1, 2]]]
    sinks.write_csv(spark.createDataFrame([(1, "a")], "i int, s string"), tmp_path / "t.csv")
    assert json.loads((tmp_path / "t.csv.schema.json").read_text())["fields"][0]["type"] == "integer"
    with pytest.raises(SourceError):
        sinks.write_results(object(), str(tmp_path))
    with pytest.raises(SourceError):
        external.run_external(spark, "s.R", "in", str(tmp_path / "o"), "d", rscript="no-such-program")
    with pytest.raises(SourceError):
        tables.read_h5ad(spark, "x.h5ad")


class FakeGroup(dict):
    """What an open HDF5 group offers: keys, members, attributes."""

    attrs = {"_index": "_index"}

    def __enter__(self):
        return self

    def __exit__(self, *_):
        return False


class FakeArray:
    def __init__(self, values):
        self.values = np.array(values)

    def __getitem__(self, _):
        return self.values


@pytest.mark.parametrize("sparse", [True, False])
def test_h5ad_layout(spark, monkeypatch, sparse):
    """The package is absent here, so its file object is imitated."""
    import sys
    import types

    dense = [[1.0, 0.0], [0.0, 2.5], [0.0, 0.0]]
    x = FakeGroup(data=FakeArray([1.0, 2.5]), indices=FakeArray([0, 1]), indptr=FakeArray([0, 1, 2, 2])) if sparse else FakeArray(dense)
    kind = FakeGroup(codes=FakeArray([0, 1, -1]), categories=FakeArray([b"a", b"b"]))
    obs = FakeGroup(_index=FakeArray([b"p1", b"p2", b"p3"]), dataset=kind, area=FakeArray([1.0, 2.0, 3.0]))
    var = FakeGroup(_index=FakeArray(["m1", "m2"]), mz=FakeArray([100.0, 200.0]))
    file = FakeGroup(X=x, obs=obs, var=var, obsm=FakeGroup(spatial=FakeArray([[1, 2], [3, 4], [5, 6]])))
    monkeypatch.setitem(sys.modules, "h5py", types.SimpleNamespace(File=lambda path, mode: file))
    b = tables.read_h5ad(spark, "x.h5ad")
    assert {(r.obs_id, r.feature_id): r.value for r in b.x.collect()} == {("p1", "m1"): 1.0, ("p2", "m2"): 2.5}
    assert [(r.obs_id, r.dataset, r.area, r.x, r.y, r.obs_ord) for r in b.obs.orderBy("obs_ord").collect()] == [("p1", "a", 1.0, 1.0, 2.0, 0), ("p2", "b", 2.0, 3.0, 4.0, 1), ("p3", None, 3.0, 5.0, 6.0, 2)]
    assert [r.mz for r in b.var.orderBy("feature_ord").collect()] == [100.0, 200.0]


def test_streaming_projection(spark, tmp_path):
    spectra = spark.createDataFrame([(0, [100.0, 200.0], [1.0, 2.0]), (1, [100.0005], [5.0])], "pixel_ord int, mz array<double>, intensity array<double>")
    spectra.write.parquet(str(tmp_path / "in"))
    axis = spark.createDataFrame([(0, 100.0), (1, 200.0)], "col_ord int, mz double")
    stream = spark.readStream.schema(spectra.schema).parquet(str(tmp_path / "in"))
    run = projection.project_stream(stream, axis, str(tmp_path / "out"), str(tmp_path / "ck"), 10, "ppm")
    run.awaitTermination(120)
    assert {(r.pixel_ord, r.col_ord): r.value for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {(0, 0): 1.0, (0, 1): 2.0, (1, 0): 5.0}
    events = spark.createDataFrame([("2024-01-01 00:01:00", "a", 1.0), ("2024-01-01 00:02:00", "a", 2.0), ("2024-01-01 00:12:00", "a", 4.0)], "t string, k string, v double").withColumn("t", F.to_timestamp("t"))
    assert sorted((r.total, r.n) for r in projection.windowed_totals(events, "t", "k", "v").collect()) == [(3.0, 2), (4.0, 1)]


# --------------------------------------------------------------------------
# configuration, store, pipeline, command line


def minimal(**more):
    return {"project": {"name": "p", "output_dir": "out"}, "input": {"imzml": "a.imzML"}, **more}


def test_config(tmp_path, monkeypatch):
    c = cfg.resolve(minimal(), tmp_path)
    assert c["input"]["imzml"] == str(tmp_path / "a.imzML") and c["quantification"]["dominant_min_overlap"] == 0.6 and c["analysis"]["cnmf"]["selected_k"] == 14
    monkeypatch.setenv("WHERE", str(tmp_path / "w"))
    assert cfg.resolve(minimal(input={"bundle": "${WHERE}/b"}), "/")["input"]["bundle"] == str(tmp_path / "w/b")
    bad = [
        minimal(extra=1), minimal(qc={"outlier_contamination": 0.5}), minimal(qc={"enabled": "yes"}), minimal(input={}), minimal(input={"imzml": "a", "h5ad": "b"}), minimal(registration={"orientation": "up"}),
        minimal(preprocessing={"min_occurrence": 2}), minimal(preprocessing={"matrix_removal": {"tolerance": 0}}), minimal(analysis={"cnmf": {"enabled": True, "components": [3], "selected_k": 4}}), minimal(trajectory={"enabled": True}),
        minimal(annotation={"enabled": True}), {"input": {"imzml": "a"}}, minimal(clustering={"n_neighbors": True}), minimal(input={"imzml": "$NOT_SET_ANYWHERE/x"}), [1],
    ]
    for tree in bad:
        with pytest.raises(ConfigError):
            cfg.resolve(tree, tmp_path)
    (tmp_path / "c.yaml").write_text(yaml.safe_dump(minimal()))
    cfg.write_resolved(cfg.load_config(str(tmp_path / "c.yaml")), str(tmp_path / "r.yaml"))
    assert cfg.load_config(str(tmp_path / "r.yaml")) == c
    with pytest.raises(ConfigError):
        cfg.load_config(str(tmp_path / "none.yaml"))


def test_store(spark, tmp_path):
    calls = []

    def produce(n=1):
        calls.append(n)
        return {"t": spark.createDataFrame([(n, "a"), (n + 1, "b")], "i int, s string")}, {"n": n}

    store = StageStore(spark, str(tmp_path))
    first, facts = store.run("s", "sig", produce)
    again, _ = StageStore(spark, str(tmp_path)).run("s", "sig", produce)
    assert calls == [1] and facts == {"n": 1} and content_digest(first["t"]) == content_digest(again["t"].repartition(3))
    with pytest.raises(StageError):
        store.run("s", "other", produce)
    StageStore(spark, str(tmp_path), overwrite=True).run("s", "other", lambda: produce(5))
    assert calls == [1, 5] and sorted(r.i for r in store.tables("s")["t"].collect()) == [5, 6]
    version = store.manifest()["stages"]["s"]["version"]
    spark.createDataFrame([(9, "z")], "i int, s string").write.mode("overwrite").parquet(str(tmp_path / "stages/s" / version / "t"))
    with pytest.raises(StageError):  # the content changed behind the manifest
        store.run("s", "other", produce)

    def fail():
        raise RuntimeError("broken")

    with pytest.raises(RuntimeError):
        store.run("f", "sig", fail)
    assert store.manifest()["stages"]["f"]["status"] == "failed" and not list(tmp_path.glob("stages/f/*"))
    store.run("f", "sig", produce)
    assert store.manifest()["stages"]["f"]["status"] == "complete"
    (tmp_path / "stages/f/orphan").mkdir()  # a run that ended before its record
    StageStore(spark, str(tmp_path))
    assert not (tmp_path / "stages/f/orphan").exists() and store.tables("f")["t"].count() == 2
    with pytest.raises(StageError):
        StageStore(spark, str(tmp_path), resume=False).run("f", "sig", produce)


def test_a_crash_before_the_record_leaves_the_old_version(spark, tmp_path, monkeypatch):
    store = StageStore(spark, str(tmp_path), overwrite=True)
    store.run("s", "one", lambda: ({"t": spark.range(3).toDF("i")}, {}))
    monkeypatch.setattr(store, "_record", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
    with pytest.raises(KeyboardInterrupt):
        store.run("s", "two", lambda: ({"t": spark.range(9).toDF("i")}, {}))
    again, _ = StageStore(spark, str(tmp_path)).run("s", "one", None)
    assert again["t"].count() == 3


def test_signatures():
    assert stage_signature({"a": 1, "b": 2}, {}) == stage_signature({"b": 2, "a": 1}, {}) != stage_signature({"a": 1, "b": 3}, {})


@pytest.fixture
def run_folder(tmp_path):
    rng = np.random.default_rng(1)
    spectra = [(x, y, [100.0, 200.0, 300.0], [float(v) for v in rng.uniform(1, 9, 3)]) for y in (1, 2) for x in (1, 2, 3)]
    imzml.write_imzml(str(tmp_path / "a.imzML"), spectra)
    cells = np.zeros((40, 60), int)
    for k, (r, c) in enumerate([(6, 6), (6, 26), (6, 46), (26, 6), (26, 26), (26, 46)], 1):
        cells[r : r + 8, c : c + 8] = k
    np.save(tmp_path / "cells.npy", cells)
    (tmp_path / "path.csv").write_text("x,y\n0,0\n60,40\n")
    (tmp_path / "hmdb.tsv").write_text("accession\tname\tmz\tmode\nH1\tone\t100.0001\tpos\n")
    tree = {
        "project": {"name": "d", "output_dir": "out"}, "input": {"imzml": "a.imzML", "cell_segmentation": "cells.npy"},
        "laser_segmentation": {"method": "simulated", "radius": 5, "parameters": {"image_shape": [40, 60], "anchors": [[1, 10, 10], [1, 10, 50], [2, 30, 10], [2, 30, 50]]}},
        "registration": {"orientation": "identity"}, "quantification": {"method": "legacy_proportional"}, "clustering": {"n_neighbors": 2},
        "annotation": {"enabled": True, "hmdb_reference": "hmdb.tsv"}, "trajectory": {"enabled": True, "path_file": "path.csv", "features": ["m1"], "points": 5},
    }
    (tmp_path / "c.yaml").write_text(yaml.safe_dump(tree))
    return tmp_path


def test_full_run_resumes(spark, run_folder):
    config = cfg.load_config(str(run_folder / "c.yaml"))
    pipeline = Pipeline(spark, config)
    frames, _ = pipeline.run()
    obs = frames["obs"].toPandas()
    assert len(obs) == 6 and {"cluster", "outlier", "trajectory_position", "laser_labels"} <= set(obs.columns) and (obs.quantification_status == "quantified").all()
    assert frames["trends"].count() == 5
    assert [r.hmdb_accessions for r in frames["var"].orderBy("feature_ord").collect()] == ['["H1"]', "[]", "[]"]
    before = {k: v["finished"] for k, v in pipeline.store.manifest()["stages"].items()}
    Pipeline(spark, config).run()
    assert before == {k: v["finished"] for k, v in pipeline.store.manifest()["stages"].items()}
    config["quantification"]["boundary_margin"] = 30.0
    with pytest.raises(StageError):
        Pipeline(spark, config).run(until="quantify")
    Pipeline(spark, config, overwrite=True).run(until="quantify")
    with pytest.raises(StageError):
        Pipeline(spark, config).run(until="nothing")


def test_command_line(spark, run_folder, capsys):
    assert cli.main(["quantify", "--config", str(run_folder / "c.yaml")]) == 0
    assert set(json.loads((run_folder / "out/manifest.json").read_text())["stages"]) == {"preprocess", "segment", "register", "quantify"}
    assert cli.main(["run", "--config", str(run_folder / "c.yaml")]) == 1 and "resume or overwrite" in capsys.readouterr().err
    assert cli.main(["run", "--resume", "--config", str(run_folder / "c.yaml")]) == 0
    assert tables.read_bundle(spark, str(run_folder / "out/final")).obs.count() == 6
    assert (run_folder / "out/config.resolved.yaml").exists() and (run_folder / "out/run.log").exists()
    assert cli.main(["run", "--config", str(run_folder / "none.yaml")]) == 1 and "error:" in capsys.readouterr().err


def test_run_with_a_gray_image_and_all_segmentation_parameters(spark, tmp_path):
    """Real and simulated marks of one image, with rectangle, row detection by variance, exclusion and merge rules."""
    rng = np.random.default_rng(2)
    image = np.zeros((120, 200))
    yy, xx = np.mgrid[:120, :200]
    for r in (30, 80):
        for c in (30, 70, 110, 150):
            image[(yy - r) ** 2 + (xx - c) ** 2 < 100] = 0.9
    image[5:15, 5:15] = 0.9  # outside the rectangle
    np.save(tmp_path / "white.npy", image)
    cells = np.zeros(image.shape, int)
    for k, (r, c) in enumerate([(r, c) for r in (30, 80) for c in (70, 110, 150)], 1):
        cells[r - 4 : r + 5, c - 4 : c + 5] = k
    np.savez(tmp_path / "cells.npz", labels=cells)
    imzml.write_imzml(str(tmp_path / "a.imzML"), [(x, y, [100.0, 200.0], [float(v) for v in rng.uniform(1, 9, 2)]) for y in (1, 2) for x in (1, 2, 3)])
    (tmp_path / "merges.csv").write_text("row_number,source_labels,note\n1,\"2,3\",x\n")
    parameters = {
        "include_rectangle": [18, 18, 110, 190], "intensity_cutoff": 0.2, "top_hat_mode": "legacy_opening", "top_hat_radius": 1, "closing_size": 5, "post_closing_size": 1, "opening_size": 3,
        "min_peak_distance": 10, "peak_detection_mode": "legacy_global", "marker_connectivity": 2, "min_size": 30,
        "row_detection": {"method": "rolling_variance", "window_size": 2, "variance_threshold": 50.0, "thinning": 1}, "exclusion": {"min_column": 40},
    }
    tree = {
        "project": {"name": "d", "output_dir": "real"}, "input": {"imzml": "a.imzML", "laser_image": "white.npy", "cell_segmentation": "cells.npz"},
        "preprocessing": {"backend": "python", "normalization": "none", "min_occurrence": 0.0},
        "laser_segmentation": {"method": "real", "expected_rows": 2, "parameters": parameters}, "registration": {"orientation": "identity", "edge_policy": "error"},
        "quantification": {"method": "legacy_proportional", "boundary_margin": 50}, "clustering": {"enabled": False}, "qc": {"enabled": False},
    }
    pipeline = Pipeline(spark, cfg.resolve(tree, tmp_path))
    frames, _ = pipeline.run()
    assert frames["obs"].count() == 6 and (frames["obs"].toPandas().quantification_status == "quantified").all()
    marks = pipeline.store.tables("segment")["regions"].orderBy("row_number", "column_number").collect()
    assert [(r.row_number, r.column_number) for r in marks] == [(r, c) for r in (1, 2) for c in (2, 3, 4)]
    assert pipeline.store.manifest()["stages"]["segment"]["facts"]["object_count"] == 8
    tree["project"]["output_dir"], tree["laser_segmentation"] = "simulated", {**tree["laser_segmentation"], "method": "simulated", "radius": 6}
    simulated = Pipeline(spark, cfg.resolve(tree, tmp_path))
    assert simulated.run()[0]["obs"].count() == 6
    assert {round(r.centroid_col) for r in simulated.store.tables("segment")["regions"].collect()} == {70, 110, 150}
    tree["project"]["output_dir"] = "merged"
    tree["laser_segmentation"] = {**tree["laser_segmentation"], "method": "real", "merge_rules": "merges.csv"}
    merged = Pipeline(spark, cfg.resolve(tree, tmp_path))
    with pytest.raises(Exception, match="row"):  # two marks a row are too few for three pixels
        merged.run()
    assert "2_3" in {r.seg_label for r in merged.store.tables("segment")["regions"].collect()}


def test_images_of_files(spark, tmp_path):
    import struct
    import zlib

    rng = np.random.default_rng(3)

    def png(path, data, kind):
        def chunk(name, body):
            return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))

        lines = b"".join(b"\0" + row.tobytes() for row in data)
        head = struct.pack(">IIBBBBB", data.shape[1], data.shape[0], 8, kind, 0, 0, 0)
        path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b""))

    colour, gray = rng.integers(0, 256, (7, 9, 3), dtype=np.uint8), rng.integers(0, 256, (7, 9), dtype=np.uint8)
    png(tmp_path / "c.png", colour, 2)
    png(tmp_path / "g.png", gray, 0)
    np.save(tmp_path / "a.npy", gray / 7.0)
    for name, want in (("c.png", colour / 255.0 @ np.array(tables.GRAY)), ("g.png", gray.astype(float)), ("a.npy", gray / 7.0)):
        got = np.zeros((7, 9))
        for r in tables.read_image(spark, str(tmp_path / name), (1, 2, 5, 6), stripe=3).collect():
            got[r.row, r.col] = r.value
            assert r.inside == (1 <= r.row <= 5 and 2 <= r.col <= 6)
        assert got == pytest.approx(want)


def test_cardinal_backend_is_dispatched(spark, tmp_path):
    tree = {"project": {"name": "d", "output_dir": "out"}, "input": {"imzml": "a.imzML"}, "preprocessing": {"backend": "cardinal"}}
    with pytest.raises(ConfigError, match="cardinal_script"):
        cfg.resolve(tree, tmp_path)
    (tmp_path / "a.imzML").write_text("x")
    tree["preprocessing"]["cardinal_script"] = "run.R"
    with pytest.raises(SourceError, match="Rscript|not installed|failed"):
        Pipeline(spark, cfg.resolve(tree, tmp_path)).run(until="preprocess")


def test_top_hat_keeps_one_array_in_memory():
    import tracemalloc

    image = np.random.default_rng(5).random((400, 400))
    tracemalloc.start()
    im.opening(image, im._disk(10))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 5 * image.nbytes
