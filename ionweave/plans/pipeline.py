"""The full run as checkpointed stages.

preprocess -> segment -> register -> quantify -> [qc] -> [annotate] -> analyze -> [trajectory].
Each stage reads its predecessor's tables back from Parquet, which cuts lineage.
"""

from __future__ import annotations

import dataclasses
import json

import numpy as np
import pandas as pd
from pyspark.errors import PythonException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import RegionError, StageError
from ..model import MatrixBundle
from ..operators import analysis, annotate, imaging, preprocess, qc, quantify, regions, registration, trajectory
from ..session import cut
from ..sources import external, imzml, sinks, tables
from .store import StageStore, file_signature, stage_signature

STAGES = ("preprocess", "segment", "register", "quantify", "qc", "annotate", "analyze", "trajectory")


def bundle_tables(bundle: MatrixBundle) -> dict[str, DataFrame]:
    return {"obs": bundle.obs, "var": bundle.var, "x": bundle.x, **{f"layer_{k}": v for k, v in bundle.layers.items()}}


def table_bundle(frames: dict[str, DataFrame], meta: dict) -> MatrixBundle:
    layers = {k.removeprefix("layer_"): v for k, v in frames.items() if k.startswith("layer_")}
    return MatrixBundle(frames["obs"], frames["var"], frames["x"], layers, meta)


#: Label pixels that a segmenting task hands on at once.
_PIXELS = 1 << 20


def segment_file(spark: SparkSession, path: str, rectangle: list[int] | None, parameters: dict) -> tuple[DataFrame, dict]:
    """(row, col, label) of an image file's marks and facts, segmented in a task of its own; ``rectangle`` is (row0, col0, row1, col1), ends included."""
    imaging.check_parameters(**parameters)
    if rectangle is not None and (len(rectangle) != 4 or not all(isinstance(x, int) for x in rectangle)):
        raise RegionError("include_rectangle must have four integers")

    def run(batches):
        for batch in batches:
            for row in batch.to_dict("records"):
                image = tables.gray_image(row)
                mask = np.ones(image.shape, bool)
                if rectangle is not None:
                    r0, c0, r1, c1 = rectangle
                    mask[:] = False
                    mask[r0 : r1 + 1, c0 : c1 + 1] = True
                labels, facts = imaging.segment_image(image, mask, **parameters)
                yield pd.DataFrame({"row": [-1], "col": [-1], "label": [0], "facts": [json.dumps({**facts, "image_shape": image.shape})]})
                rows, cols = np.nonzero(labels)
                for at in range(0, len(rows), _PIXELS):
                    r, c = rows[at : at + _PIXELS], cols[at : at + _PIXELS]
                    yield pd.DataFrame({"row": r, "col": c, "label": labels[r, c], "facts": None})

    try:
        found = cut(tables.image_rows(spark, path).mapInPandas(run, "row int, col int, label long, facts string"))
    except PythonException as e:
        raise RegionError(f"cannot segment {path!r}: {str(e).strip().splitlines()[-1]}") from e
    return found.where("facts IS NULL").drop("facts"), json.loads(found.where("facts IS NOT NULL").first().facts)


class Pipeline:
    """Stages of one configuration.  Complete stages are reused; without ``resume`` the ones asked for must not exist yet, unless ``overwrite`` replaces them."""

    def __init__(self, spark: SparkSession, config: dict, overwrite: bool = False, resume: bool = True):
        self.spark, self.config, self.resume = spark, config, resume
        self.store = StageStore(spark, config["project"]["output_dir"], overwrite)

    def enabled(self) -> list[str]:
        c = self.config
        skip = {n for n, on in (("qc", c["qc"]["enabled"]), ("annotate", c["annotation"]["enabled"]), ("trajectory", c["trajectory"]["enabled"])) if not on}
        return [s for s in STAGES if s not in skip]

    def run(self, until: str | None = None) -> tuple[dict[str, DataFrame], dict]:
        """Run or reuse the stages in order, up to ``until``; returns the last one's tables and facts."""
        order = self.enabled()
        if until is not None:
            if until not in order:
                raise StageError(f"stage {until!r} is unknown or disabled")
            order = order[: order.index(until) + 1]
        for name in order:
            self.store.resume = self.resume or (until is not None and name != until)
            out = getattr(self, name)()
        return out

    def _stage(self, name: str, section: object, files: list[str | None], before: list[str], producer) -> tuple[dict[str, DataFrame], dict]:
        inputs = {f: file_signature(f)["sha256"] for f in files if f} | {b: self.store.digest(b) for b in before}
        return self.store.run(name, stage_signature(section, inputs), producer)

    def _bundle(self, name: str) -> MatrixBundle:
        return table_bundle(self.store.tables(name), dict(self.store.manifest()["stages"][name]["facts"]))

    def _before(self, name: str) -> str:
        """The last enabled stage before ``name`` that holds the cells."""
        chain = [s for s in self.enabled() if s in ("quantify", "qc", "annotate", "analyze", "trajectory")]
        return chain[chain.index(name) - 1]

    def preprocess(self):
        c, p = self.config["input"], self.config["preprocessing"]

        def produce():
            if p["backend"] == "cardinal":
                folder = f"{self.config['project']['output_dir']}/cardinal"
                bundle = external.run_external(self.spark, p["cardinal_script"], c["imzml"], folder, self.config["project"]["name"], tolerance=p["peak_tolerance"], unit=p["tolerance_unit"], snr=p["cardinal_snr"], overwrite=True)
            elif c["bundle"]:
                bundle = tables.read_bundle(self.spark, c["bundle"])
            elif c["h5ad"]:
                bundle = tables.read_h5ad(self.spark, c["h5ad"])
            else:
                bundle = imzml.read_imzml(self.spark, c["imzml"], self.config["project"]["name"], p["peak_tolerance"], p["tolerance_unit"], p["profile_bin_size"])
            m = p["matrix_removal"]
            removal = None
            if m["enabled"]:
                reference = tables.load_reference_mz(self.spark, m["reference_file"]) if m["reference_file"] else None
                removal = dict(method=m["method"], reference=reference, blanks=m["blank_datasets"], matrix_frequency=m["matrix_frequency"], tolerance=m["tolerance"], unit=m["unit"])
            preprocess.check_mz(bundle.var)
            bundle = preprocess.filter_features(bundle, p["min_occurrence"])
            if removal:
                bundle, _ = preprocess.remove_matrix_peaks(bundle, **removal)
            bundle = preprocess.normalize(bundle, p["normalization"], p["normalized_layer"])
            return bundle_tables(bundle), {}

        files = [c["bundle"], c["h5ad"], c["imzml"], p["matrix_removal"]["reference_file"]]
        return self._stage("preprocess", [c, p], files, [], produce)

    def segment(self):
        c, s = self.config["input"], self.config["laser_segmentation"]

        def produce():
            extra = dict(s["parameters"])
            shape, anchors = extra.pop("image_shape", None), extra.pop("anchors", None)
            rectangle, by, bounds = extra.pop("include_rectangle", None), extra.pop("row_detection", {}), extra.pop("exclusion", {})
            facts: dict = {}
            if anchors is not None:
                rows = self.spark.createDataFrame([(int(r), float(y), float(x)) for r, y, x in anchors], "row_number int, centroid_row double, centroid_col double")
            else:
                if not c["laser_image"]:
                    raise StageError("input.laser_image is required for segmentation")
                px, facts = segment_file(self.spark, c["laser_image"], rectangle, extra)
                shape = facts["image_shape"]
                rows = regions.detect_rows(regions.region_table(px), s["expected_rows"], **by)
                if s["expected_rows"]:
                    regions.check_row_count(rows, s["expected_rows"])
                rows = regions.exclude_regions(rows, **bounds)
            if s["method"] == "simulated":
                # rows that the bounds leave are numbered anew; there are thousands at most
                ends = rows.withColumn("row_number", F.dense_rank().over(Window.orderBy("row_number")))
                found = regions.simulate_marks(self._bundle("preprocess").obs, ends, tuple(shape), s["radius"])
                return {"labels": found.labels, "regions": found.regions}, {**facts, **found.diagnostics}
            if s["merge_rules"]:
                rows = regions.merge_regions(rows, tables.load_merge_rules(self.spark, s["merge_rules"]))
            return {"labels": px, "regions": rows}, facts

        before = ["preprocess"] if s["method"] == "simulated" else []
        return self._stage("segment", s, [c["laser_image"], s["merge_rules"]], before, produce)

    def register(self):
        r = self.config["registration"]

        def produce():
            found = registration.register(self._bundle("preprocess"), self.store.tables("segment")["regions"], r["orientation"], r["edge_policy"])
            return {**bundle_tables(found.bundle), "mapping": found.mapping, "report": found.report}, found.bundle.meta

        return self._stage("register", r, [], ["preprocess", "segment"], produce)

    def quantify(self):
        c, q = self.config["input"], self.config["quantification"]

        def produce():
            cells = tables.read_segmentation(self.spark, c["cell_segmentation"], c["trusted_pickle"])
            found = quantify.quantify_cells(self._bundle("register"), cells, self.store.tables("segment")["labels"], q["method"], q["boundary_margin"], q["unique_min_overlap"], q["dominant_min_overlap"], q["secondary_max_overlap"])
            bundle = dataclasses.replace(found.bundle, obs=found.bundle.obs.withColumns({"x": F.col("centroid_col"), "y": F.col("centroid_row")}))
            return {**bundle_tables(bundle), "overlaps": found.overlaps, "accepted": found.accepted, "rejected": found.rejected, "report": found.report}, bundle.meta

        return self._stage("quantify", q, [c["cell_segmentation"]], ["register", "segment"], produce)

    def qc(self):
        s = self.config["qc"]

        def produce():
            cells = self._bundle("quantify")
            scored = qc.detect_outliers(qc.spectral_qc(cells.obs, cells.x), s["outlier_contamination"], self.config["project"]["random_seed"])
            obs = cells.obs.join(scored, "obs_id")
            return {**bundle_tables(dataclasses.replace(cells, obs=obs)), "coverage": qc.coverage_report(cells.obs)}, cells.meta

        return self._stage("qc", [s, self.config["project"]["random_seed"]], [], ["quantify"], produce)

    def annotate(self):
        a, before = self.config["annotation"], self._before("annotate")

        def produce():
            cells = self._bundle(before)
            var = cells.var
            if a["hmdb_reference"]:
                var = annotate.annotate_hmdb(var, tables.load_annotation_table(self.spark, a["hmdb_reference"]), a["ion_mode"], a["hmdb_ppm"])
            if a["metaboscape_reference"]:
                var = annotate.annotate_metaboscape(var, tables.load_annotation_table(self.spark, a["metaboscape_reference"]), a["metaboscape_ppm"])
            return bundle_tables(dataclasses.replace(cells, var=var)), cells.meta

        return self._stage("annotate", a, [a["hmdb_reference"], a["metaboscape_reference"]], [before], produce)

    def analyze(self):
        c, a, before = self.config["clustering"], self.config["analysis"], self._before("analyze")
        seed = self.config["project"]["random_seed"]

        def produce():
            cells, more = self._bundle(before), {}
            if c["enabled"]:
                cells = analysis.cluster_cells(cells, c["n_neighbors"], c["resolution"], seed, "cluster", c["n_top_features"])
                groups = cells.obs.select("obs_id", "obs_ord", F.col("cluster").alias("grp"))
                sizes = [r["count"] for r in groups.groupBy("grp").count().collect()]
                if len(sizes) > 1 and min(sizes) > 1:
                    more["markers"] = analysis.rank_metabolites(cells.x, cells.var, groups)
            if a["cosg"]["enabled"]:
                groups = cells.obs.select("obs_id", "obs_ord", F.col(a["cosg"]["groupby"]).cast("string").alias("grp"))
                more["cosg"] = analysis.run_cosg(cells.x, cells.var, groups, a["cosg"]["n_genes"])
            if a["cnmf"]["enabled"]:
                n = a["cnmf"]
                spectra = analysis.factorize(cells, n["components"], seed=n["seed"], n_features=n["num_highvar_genes"])
                usage = analysis.consensus_usage(cells, spectra, n["selected_k"], n_features=n["num_highvar_genes"], seed=n["seed"])
                cells = dataclasses.replace(cells, obs=analysis.load_usage(cells.obs, usage))
                more["cnmf_spectra"] = spectra
            return {**bundle_tables(cells), **more}, cells.meta

        return self._stage("analyze", [c, a, seed], [], [before], produce)

    def trajectory(self):
        t, before = self.config["trajectory"], self._before("trajectory")

        def produce():
            cells = trajectory.fit_trajectory(self._bundle(before), tables.load_path(self.spark, t["path_file"]))
            more = {"trends": trajectory.feature_trends(cells, t["features"], t["points"])} if t["features"] else {}
            return {**bundle_tables(cells), **more}, cells.meta

        return self._stage("trajectory", t, [t["path_file"]], [before], produce)

    def finalize(self) -> str:
        """The last enabled stage's bundle as ``<output>/final``."""
        path = f"{self.config['project']['output_dir']}/final"
        sinks.write_bundle(self._bundle(self.enabled()[-1]), path)
        return path


