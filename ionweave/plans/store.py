"""Checkpointed stages: content-addressed reuse and atomic promotion.

A stage's signature covers its configuration and the digests of its inputs.
The manifest is the commit point: a stage counts only when its record says
complete, its signature is the wanted one and its tables still have the
recorded content digests.
"""

from __future__ import annotations

import hashlib
import json
import logging
import os
import shutil
import uuid
from collections.abc import Callable
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import StageError
from ..sources.sinks import write_json

log = logging.getLogger("ionweave")


def content_digest(df: DataFrame) -> str:
    """Order-independent digest of a table: schema, row count and summed row hashes."""
    names = sorted(df.columns)
    h = [F.xxhash64(*[F.col(f"`{c}`") for c in names]), F.hash(*[F.col(f"`{c}`") for c in names])] if names else [F.lit(0), F.lit(0)]
    row = df.agg(F.count("*").alias("n"), *[F.sum(x.cast("decimal(38,0)")).alias(f"h{i}") for i, x in enumerate(h)]).first()
    text = f"{[(c, dict(df.dtypes)[c]) for c in names]}|{row.n}|{row.h0}|{row.h1}"
    return hashlib.sha256(text.encode()).hexdigest()


def file_signature(path: str) -> dict:
    """Size and SHA-256 of a file, or of all files of a folder."""
    files = sorted(p for p in Path(path).rglob("*") if p.is_file()) if os.path.isdir(path) else [Path(path)]
    digest, size = hashlib.sha256(), 0
    for f in files:
        with open(f, "rb") as data:
            while block := data.read(1 << 20):
                digest.update(block)
                size += len(block)
    return {"path": str(path), "size": size, "sha256": digest.hexdigest()}


def stage_signature(config: object, inputs: dict[str, object]) -> str:
    return hashlib.sha256(json.dumps({"config": config, "inputs": inputs}, sort_keys=True, default=str).encode()).hexdigest()


class StageStore:
    """Tables under ``root/stages/<name>/<version>`` as Parquet, facts and versions in the manifest.

    A version is written under a name of its own and counts from the moment the
    manifest names it, which is replaced atomically; a run that ends before leaves
    the old version in force.  Versions without a record are removed at the start.
    ``root`` must be a folder that driver and executors share.
    """

    def __init__(self, spark: SparkSession, root: str, overwrite: bool = False, resume: bool = True):
        self.spark, self.root, self.overwrite, self.resume = spark, Path(root), overwrite, resume
        self.root.mkdir(parents=True, exist_ok=True)
        known = {(name, r.get("version")) for name, r in self.manifest()["stages"].items()}
        for left in self.root.glob("stages/*/*"):
            if (left.parent.name, left.name) not in known:
                shutil.rmtree(left, ignore_errors=True)

    @property
    def manifest_path(self) -> Path:
        return self.root / "manifest.json"

    def manifest(self) -> dict:
        return json.loads(self.manifest_path.read_text()) if self.manifest_path.exists() else {"stages": {}}

    def _record(self, name: str, record: dict) -> None:
        manifest = self.manifest()
        manifest["stages"][name] = record
        write_json(self.manifest_path, manifest)

    def tables(self, name: str) -> dict[str, DataFrame]:
        record = self.manifest()["stages"][name]
        return {t: self.spark.read.parquet(str(self.folder(name, record["version"]) / t)) for t in record["tables"]}

    def folder(self, name: str, version: str) -> Path:
        return self.root / "stages" / name / version

    def _intact(self, name: str, record: dict) -> bool:
        try:
            return all(content_digest(df) == record["tables"][t] for t, df in self.tables(name).items())
        except Exception:
            return False

    def digest(self, name: str) -> str:
        return stage_signature(None, self.manifest()["stages"][name]["tables"])

    def run(self, name: str, signature: str, producer: Callable[[], tuple[dict[str, DataFrame], dict]]) -> tuple[dict[str, DataFrame], dict]:
        """(tables, facts) of the stage.

        A complete one with the wanted signature and content is reused under ``resume``;
        one that exists is else replaced under ``overwrite`` and refused without.
        """
        record = self.manifest()["stages"].get(name)
        complete = record is not None and record["status"] == "complete"
        if complete:
            if self.resume and record["signature"] == signature and self._intact(name, record):
                log.info("stage %s: reused", name)
                return self.tables(name), record["facts"]
            if not self.overwrite:
                raise StageError(f"stage {name!r} exists" + (" with other inputs or content; pass overwrite" if self.resume else "; pass resume or overwrite"))
        version = uuid.uuid4().hex
        folder = self.folder(name, version)
        try:
            frames, facts = producer()
            digests = {}
            for table, df in frames.items():
                df.write.parquet(str(folder / table))
                digests[table] = content_digest(self.spark.read.parquet(str(folder / table)))
            self._record(name, {"status": "complete", "signature": signature, "version": version, "tables": digests, "facts": facts, "finished": datetime.now(UTC).isoformat()})
        except BaseException as e:
            shutil.rmtree(folder, ignore_errors=True)
            if not complete:
                self._record(name, {"status": "failed", "signature": signature, "error": str(e)[:500]})
            raise
        if complete:
            shutil.rmtree(self.folder(name, record["version"]), ignore_errors=True)
        log.info("stage %s: complete", name)
        return self.tables(name), facts
