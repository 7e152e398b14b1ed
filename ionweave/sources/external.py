"""Adapter for an external R preprocessing backend."""

from __future__ import annotations

import os
import shutil
import subprocess
import tempfile

from pyspark.sql import SparkSession

from ..errors import SourceError
from ..model import MatrixBundle, number
from .imzml import read_imzml


def run_external(spark: SparkSession, script: str, source: str, output: str, dataset_id: str, rscript: str = "Rscript", tolerance: float = 10, unit: str = "ppm", snr: float = 3, overwrite: bool = False) -> MatrixBundle:
    """Run ``script`` on an imzML pair, promote its output folder by rename, read the result.

    The output folder appears only complete; an existing one is kept unless ``overwrite``.
    """
    number("tolerance", tolerance, SourceError, above=0)
    number("snr", snr, SourceError, above=0)
    if shutil.which(rscript) is None:
        raise SourceError(f"the external backend needs {rscript!r}, which is not installed")
    if os.path.exists(output) and not overwrite:
        raise SourceError(f"output {output!r} exists; pass overwrite")
    parent = os.path.dirname(os.path.abspath(output))
    os.makedirs(parent, exist_ok=True)
    stage = tempfile.mkdtemp(dir=parent, prefix=".external-")
    try:
        done = subprocess.run([rscript, script, source, stage, str(tolerance), unit, str(snr)], capture_output=True, text=True)
        if done.returncode:
            raise SourceError(f"the external backend failed: {done.stderr[-500:]}")
        old = f"{stage}.old"
        if os.path.exists(output):
            os.replace(output, old)
        os.replace(stage, output)
        shutil.rmtree(old, ignore_errors=True)
    finally:
        shutil.rmtree(stage, ignore_errors=True)
    found = sorted(f for f in os.listdir(output) if f.lower().endswith(".imzml"))
    if len(found) != 1:
        raise SourceError("the external backend must leave exactly one imzML file")
    return read_imzml(spark, os.path.join(output, found[0]), dataset_id, tolerance, unit)
