"""Writers: bundles, results, single files replaced atomically."""

from __future__ import annotations

import contextlib
import json
import os
import tempfile
from functools import singledispatch
from pathlib import Path

from pyspark.sql import DataFrame

from ..errors import SourceError
from ..model import MatrixBundle, QuantificationResult, RegistrationResult, SegmentationResult


@contextlib.contextmanager
def atomic_path(target: str | Path):
    """A temporary sibling that replaces ``target`` on success and vanishes on failure."""
    target = Path(target)
    target.parent.mkdir(parents=True, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=target.parent, prefix=f".{target.name}.")
    os.close(handle)
    try:
        yield name
        os.replace(name, target)
    except BaseException:
        with contextlib.suppress(OSError):
            os.unlink(name)
        raise


def write_text(target: str | Path, text: str) -> None:
    with atomic_path(target) as tmp:
        Path(tmp).write_text(text, encoding="utf-8")


def write_json(target: str | Path, value: object) -> None:
    """JSON; mappings with other than text keys become arrays of pairs."""

    def plain(v):
        if isinstance(v, dict):
            if all(isinstance(k, str) for k in v):
                return {k: plain(x) for k, x in v.items()}
            return [[plain(k), plain(x)] for k, x in v.items()]
        if isinstance(v, (list, tuple)):
            return [plain(x) for x in v]
        return v.item() if hasattr(v, "item") else v

    write_text(target, json.dumps(plain(value), ensure_ascii=False, indent=2, sort_keys=False))


def write_csv(df: DataFrame, target: str | Path) -> None:
    """One CSV file and a ``.schema.json`` beside it that restores the types."""
    with atomic_path(target) as tmp:
        df.toPandas().to_csv(tmp, index=False)
    write_text(f"{target}.schema.json", df.schema.json())


def write_bundle(bundle: MatrixBundle, path: str) -> None:
    """Parquet tables and metadata; the metadata comes last and marks the bundle complete."""
    for name in ("obs", "var", "x"):
        getattr(bundle, name).write.mode("overwrite").parquet(f"{path}/{name}")
    for name, x in bundle.layers.items():
        x.write.mode("overwrite").parquet(f"{path}/layers/{name}")
    meta = json.dumps({**bundle.meta, "_layers": sorted(bundle.layers)}, ensure_ascii=False)
    bundle.obs.sparkSession.createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


@singledispatch
def write_results(result, path: str) -> None:
    raise SourceError(f"cannot write results of type {type(result).__name__}")


@write_results.register
def _(result: SegmentationResult, path: str) -> None:
    result.labels.write.mode("overwrite").parquet(f"{path}/labels")
    result.regions.write.mode("overwrite").parquet(f"{path}/regions")
    write_json(f"{path}/diagnostics.json", result.diagnostics)


@write_results.register
def _(result: RegistrationResult, path: str) -> None:
    write_bundle(result.bundle, f"{path}/registered")
    result.mapping.write.mode("overwrite").parquet(f"{path}/mapping")
    result.report.write.mode("overwrite").parquet(f"{path}/report")
    write_json(f"{path}/transform.json", result.transform)


@write_results.register
def _(result: QuantificationResult, path: str) -> None:
    write_bundle(result.bundle, f"{path}/cells")
    for name in ("overlaps", "accepted", "rejected", "report"):
        getattr(result, name).write.mode("overwrite").parquet(f"{path}/{name}")


@write_results.register
def _(result: MatrixBundle, path: str) -> None:
    write_bundle(result, path)
