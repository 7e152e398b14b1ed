"""Run configuration: a strict YAML tree checked against one specification table."""

from __future__ import annotations

import os
import re
from pathlib import Path

import yaml

from ..errors import ConfigError
from ..operators.registration import EDGES, ORIENTATIONS

REQUIRED = object()


def _text(v):
    return v if isinstance(v, str) and v else _refuse("a non-empty string")


def _flag(v):
    return v if isinstance(v, bool) else _refuse("true or false")


def _one_of(*names):
    return lambda v: v if v in names else _refuse(f"one of {', '.join(map(str, names))}")


def _real(low=None, high=None, open_low=False, open_high=False):
    def check(v):
        if isinstance(v, bool) or not isinstance(v, (int, float)) or v != v:
            _refuse("a number")
        if low is not None and (v < low or open_low and v == low) or high is not None and (v > high or open_high and v == high):
            _refuse(f"within {low} and {high}")
        return float(v)

    return check


def _int(low=1):
    return lambda v: v if isinstance(v, int) and not isinstance(v, bool) and v >= low else _refuse(f"an integer of at least {low}")


def _list(item):
    return lambda v: [item(x) for x in v] if isinstance(v, list) else _refuse("a list")


def _mapping(v):
    return v if isinstance(v, dict) else _refuse("a mapping")


def _optional(check):
    return lambda v: None if v is None else check(v)


def _refuse(what: str):
    raise ConfigError(f"must be {what}")


PATH = "path"  # resolved against the folder of the YAML file

#: Section -> field -> (check, default), in the order of run files.
SPEC: dict = {
    "project": {"name": (_text, REQUIRED), "output_dir": (PATH, REQUIRED), "random_seed": (_int(0), 0)},
    "input": {"imzml": (PATH, None), "h5ad": (PATH, None), "bundle": (PATH, None), "laser_image": (PATH, None), "cell_segmentation": (PATH, None), "trusted_pickle": (_flag, False)},
    "preprocessing": {
        "backend": (_one_of("python", "cardinal"), "python"), "normalization": (_one_of("rms", "tic", "none"), "rms"), "normalized_layer": (_text, "normalized"),
        "min_occurrence": (_real(0, 1), 0.05), "peak_tolerance": (_real(0, None, True), 10.0), "tolerance_unit": (_one_of("ppm", "da"), "ppm"),
        "profile_bin_size": (_optional(_real(0, None, True)), None), "cardinal_snr": (_real(0, None, True), 3.0), "cardinal_script": (PATH, None),
        "matrix_removal": {
            "enabled": (_flag, False), "method": (_one_of("reference", "blank", "denovo"), "denovo"), "reference_file": (PATH, None), "blank_datasets": (_list(_text), []),
            "matrix_frequency": (_real(0, 1), 0.8), "tolerance": (_real(0, None, True), 10.0), "unit": (_one_of("ppm", "da"), "ppm"),
        },
    },
    "laser_segmentation": {"method": (_one_of("real", "simulated"), "real"), "radius": (_int(), 18), "expected_rows": (_optional(_int()), None), "parameters": (_mapping, {}), "merge_rules": (PATH, None)},
    "registration": {"orientation": (_one_of("auto", *ORIENTATIONS), "auto"), "edge_policy": (_one_of(*EDGES), "error")},
    "quantification": {
        "method": (_one_of("specificity_filtered", "legacy_proportional"), "specificity_filtered"), "boundary_margin": (_real(0), 20.0),
        "unique_min_overlap": (_real(0, 1), 0.10), "dominant_min_overlap": (_real(0, 1), 0.60), "secondary_max_overlap": (_real(0, 1), 0.15),
    },
    "qc": {"enabled": (_flag, True), "outlier_contamination": (_real(0, 0.5, True, True), 0.05)},
    "annotation": {"enabled": (_flag, False), "hmdb_reference": (PATH, None), "metaboscape_reference": (PATH, None), "ion_mode": (_one_of("pos", "neg"), "pos"), "hmdb_ppm": (_real(0, None, True), 5.0), "metaboscape_ppm": (_real(0, None, True), 3.0)},
    "clustering": {"enabled": (_flag, True), "n_neighbors": (_int(2), 15), "resolution": (_real(0, None, True), 0.6), "n_top_features": (_optional(_int()), None)},
    "trajectory": {"enabled": (_flag, False), "path_file": (PATH, None), "features": (_list(_text), []), "points": (_int(2), 100)},
    "analysis": {
        "cosg": {"enabled": (_flag, False), "groupby": (_text, "cluster"), "n_genes": (_int(), 20)},
        "cnmf": {"enabled": (_flag, False), "components": (_list(_int(2)), list(range(5, 20))), "selected_k": (_int(2), 14), "seed": (_int(0), 14), "num_highvar_genes": (_int(), 300)},
    },
}


def _expand(text: str) -> str:
    def value(m: re.Match) -> str:
        name = m[1] or m[2]
        if name not in os.environ:
            raise ConfigError(f"environment variable {name} is not set")
        return os.environ[name]

    return re.sub(r"\$(?:\{(\w+)\}|(\w+))", value, text)


def _resolve(spec: dict, given: object, base: Path, where: str) -> dict:
    if given is None:
        given = {}
    if not isinstance(given, dict):
        raise ConfigError(f"{where or 'the configuration'} must be a mapping")
    unknown = sorted(map(str, set(given) - set(spec)))
    if unknown:
        raise ConfigError(f"unknown keys in {where or 'the configuration'}: {unknown}")
    out = {}
    for name, rule in spec.items():
        at = f"{where}.{name}".lstrip(".")
        if isinstance(rule, dict):
            out[name] = _resolve(rule, given.get(name), base, at)
            continue
        check, default = rule
        if name not in given:
            if default is REQUIRED:
                raise ConfigError(f"{at} is required")
            out[name] = list(default) if isinstance(default, list) else dict(default) if isinstance(default, dict) else default
            continue
        value = given[name]
        if check is PATH:
            if value is not None and (not isinstance(value, str) or not value):
                raise ConfigError(f"{at} must be a path")
            out[name] = None if value is None else str((base / Path(_expand(value)).expanduser()).resolve())
            continue
        try:
            out[name] = check(value)
        except ConfigError as e:
            raise ConfigError(f"{at} {e}") from None
    return out


def resolve(tree: dict, base: str | Path = ".") -> dict:
    """The complete configuration with defaults, absolute paths and cross checks."""
    config = _resolve(SPEC, tree, Path(base).resolve(), "")
    sources = [k for k in ("imzml", "h5ad", "bundle") if config["input"][k]]
    if len(sources) != 1:
        raise ConfigError("input needs exactly one of imzml, h5ad and bundle")
    if config["preprocessing"]["backend"] == "cardinal" and not (config["preprocessing"]["cardinal_script"] and config["input"]["imzml"]):
        raise ConfigError("the cardinal backend needs input.imzml and preprocessing.cardinal_script, the R script to run")
    cnmf = config["analysis"]["cnmf"]
    if cnmf["enabled"] and cnmf["selected_k"] not in cnmf["components"]:
        raise ConfigError("analysis.cnmf.selected_k must be among the components")
    if config["trajectory"]["enabled"] and not config["trajectory"]["path_file"]:
        raise ConfigError("trajectory.path_file is required")
    note = config["annotation"]
    if note["enabled"] and not (note["hmdb_reference"] or note["metaboscape_reference"]):
        raise ConfigError("annotation needs a reference")
    return config


def load_config(path: str) -> dict:
    try:
        tree = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    except (OSError, yaml.YAMLError) as e:
        raise ConfigError(f"cannot read configuration {path!r}: {e}") from e
    return resolve(tree, Path(path).resolve().parent)


def write_resolved(config: dict, path: str) -> None:
    from ..sources.sinks import write_text

    write_text(path, yaml.safe_dump(config, sort_keys=False))
