"""Rasters, reference tables and bundles."""

from __future__ import annotations

import io
import os

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import SourceError
from ..model import MatrixBundle, check_rows, not_finite


def load_labels(path: str, trusted_pickle: bool = False) -> np.ndarray:
    """A 2-D non-negative integer raster of .npy, or of .npz with the one array ``labels``.

    Pickled rasters are refused, trusted or not: they can run code when loaded.
    """
    kind = os.path.splitext(path)[1].lower()
    if kind in (".pkl", ".pickle"):
        raise SourceError("pickled segmentations are not loaded; save the raster as .npy")
    if kind not in (".npy", ".npz"):
        raise SourceError(f"unsupported segmentation format {kind!r}")
    try:
        data = np.load(path, allow_pickle=False)
        if kind == ".npz":
            if data.files != ["labels"]:
                raise SourceError("an .npz segmentation must hold only the array 'labels'")
            data = data["labels"]
    except (OSError, ValueError) as e:
        raise SourceError(f"cannot read segmentation {path!r}: {e}") from e
    if data.ndim != 2 or data.dtype.kind not in "iu":
        raise SourceError("a segmentation must be a two-dimensional integer array")
    if data.size and (data.min() < 0 or data.max() > np.iinfo(np.int64).max):
        raise SourceError("labels must lie between 0 and 2^63 - 1")
    return data


def raster_pixels(spark: SparkSession, array: np.ndarray, value: str = "label", stripe: int = 256) -> DataFrame:
    """(row, col, value) of an array, background of label rasters dropped; built by row stripes."""
    parts = []
    for at in range(0, array.shape[0], stripe):
        part = array[at : at + stripe]
        rows, cols = np.nonzero(part) if value == "label" else (x.ravel() for x in np.indices(part.shape))
        column = part[rows, cols].astype(np.int64 if value == "label" else np.float64)
        parts.append(pa.table({"row": (rows + at).astype(np.int32), "col": cols.astype(np.int32), value: column}))
    return spark.createDataFrame(pa.concat_tables(parts))


def read_segmentation(spark: SparkSession, path: str, trusted_pickle: bool = False) -> DataFrame:
    return raster_pixels(spark, load_labels(path, trusted_pickle))


#: Shares of red, green and blue in gray.
GRAY = (0.2125, 0.7154, 0.0721)


def image_rows(spark: SparkSession, path: str) -> DataFrame:
    """One row with the content of an image file, .npy or what Java decodes (JPEG, PNG, ...)."""
    if path.lower().endswith(".npy"):
        return spark.read.format("binaryFile").load(path).select("content")
    return spark.read.format("image").load(path).select("image.height", "image.width", "image.nChannels", "image.data")


def gray_image(row) -> np.ndarray:
    """A row of ``image_rows`` as a gray array: colours weighted into 0 to 1, arrays and gray files as stored."""
    if "content" in row:
        image = np.load(io.BytesIO(row["content"]), allow_pickle=False)
    else:
        image = np.frombuffer(row["data"], np.uint8).reshape(row["height"], row["width"], row["nChannels"])
        image = image[:, :, 0] if image.shape[2] == 1 else image[:, :, 2::-1] / 255.0 @ np.array(GRAY)  # stored blue first
    if image.ndim != 2:
        raise SourceError("an image must be two-dimensional")
    return image.astype(float)


def read_image(spark: SparkSession, path: str, rectangle: tuple[int, int, int, int] | None = None, stripe: int = 256) -> DataFrame:
    """(row, col, value, inside) of a gray image, decoded on an executor; ``rectangle`` (row0, col0, row1, col1) includes its ends."""

    def run(batches):
        for batch in batches:
            for row in batch.to_dict("records"):
                image = gray_image(row)
                for at in range(0, image.shape[0], stripe):
                    part = image[at : at + stripe]
                    rows, cols = np.indices(part.shape)
                    yield pd.DataFrame({"row": rows.ravel() + at, "col": cols.ravel(), "value": part.ravel()})

    px = image_rows(spark, path).mapInPandas(run, "row int, col int, value double")
    if rectangle is None:
        return px.withColumn("inside", F.lit(True))
    r0, c0, r1, c1 = rectangle
    return px.withColumn("inside", F.col("row").between(r0, r1) & F.col("col").between(c0, c1))


def _csv(spark: SparkSession, path: str, schema: str, sep: str = ",") -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True, sep=sep, enforceSchema=False, mode="FAILFAST")


def load_merge_rules(spark: SparkSession, path: str) -> DataFrame:
    """(row_number, source_labels) with labels joined by ``|``."""
    raw = spark.read.csv(path, header=True)
    missing = {"row_number", "source_labels"} - set(raw.columns)
    if missing:
        raise SourceError(f"merge rules are missing columns: {sorted(missing)}")
    rules = raw.select(F.col("row_number").try_cast("int").alias("row_number"), F.regexp_replace(F.regexp_replace("source_labels", "\\s+", ""), "[,_]", "|").alias("source_labels"))
    check_rows(rules, {"row_number must be a positive integer": F.col("row_number").isNull() | (F.col("row_number") < 1)}, SourceError)
    return rules


def load_reference_mz(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.csv(path, header=True)
    if "mz" not in raw.columns:
        raise SourceError("a matrix reference needs the column mz")
    mz = raw.select(F.col("mz").try_cast("double").alias("mz"))
    check_rows(mz, {"mz must be numeric, finite and positive": not_finite(F.col("mz")) | (F.col("mz") <= 0)}, SourceError)
    if mz.isEmpty():
        raise SourceError("a matrix reference must not be empty")
    return mz


def load_annotation_table(spark: SparkSession, path: str) -> DataFrame:
    """Comma for .csv, tab for anything else; all columns text, and ``ref_ord``, the place in the file.

    Splits of a file are not read in order, so the place is the split's start and
    the row within the task that reads it.
    """
    raw = spark.read.csv(path, header=True, sep="," if path.lower().endswith(".csv") else "\t")
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return raw.select("*", place.alias("ref_ord"))


def load_path(spark: SparkSession, path: str) -> list[tuple[float, float]]:
    """The points of a trajectory CSV with exactly the columns x, y."""
    raw = spark.read.csv(path, header=True)
    if raw.columns != ["x", "y"]:
        raise SourceError("a trajectory needs exactly the columns x,y")
    rows = [(r.x, r.y) for r in raw.select(F.col("x").try_cast("double").alias("x"), F.col("y").try_cast("double").alias("y")).collect()]
    if len(rows) < 2 or any(v is None or not np.isfinite(v) for r in rows for v in r):
        raise SourceError("a trajectory needs at least two finite points")
    return rows


def load_usage_table(spark: SparkSession, path: str) -> DataFrame:
    """Usage TSV: the first column is obs_id and stays text, so leading zeros survive."""
    raw = spark.read.csv(path, header=True, sep="\t")
    names = raw.columns
    if len(names) < 2 or len(set(names)) != len(names) or any(not n or n.startswith("_c") for n in names[1:]):
        raise SourceError("usage columns must be named and distinct")
    return raw.select(F.col(f"`{names[0]}`").alias("obs_id"), *[F.col(f"`{n}`").try_cast("double").alias(n) for n in names[1:]])


def read_bundle(spark: SparkSession, path: str) -> MatrixBundle:
    """A bundle written by ``sinks.write_bundle``."""
    import json

    try:
        meta = json.loads(spark.read.text(f"{path}/meta", wholetext=True).first().value)
        layers = {n: spark.read.parquet(f"{path}/layers/{n}") for n in meta.pop("_layers")}
        return MatrixBundle(*[spark.read.parquet(f"{path}/{t}") for t in ("obs", "var", "x")], layers, meta)
    except Exception as e:
        raise SourceError(f"cannot read bundle {path!r}: {e}") from e


def _h5_frame(group, what: str) -> dict[str, np.ndarray]:
    """The index and the plain columns of an annotation table; nested (categorical) columns are decoded."""
    name = group.attrs["_index"]
    out = {what: np.array([v.decode() if isinstance(v, bytes) else str(v) for v in group[name][()]], object)}
    for key in group:
        if key == name:
            continue
        column = group[key]
        if hasattr(column, "keys"):
            if {"codes", "categories"} <= set(column.keys()):
                names = [v.decode() if isinstance(v, bytes) else str(v) for v in column["categories"][()]]
                out[key] = np.array([names[c] if c >= 0 else None for c in column["codes"][()]], object)
            continue
        values = column[()]
        out[key] = np.array([v.decode() if isinstance(v, bytes) else v for v in values], object) if values.dtype.kind in "OS" else values
    return out


def read_h5ad(spark: SparkSession, path: str) -> MatrixBundle:
    """Bundle of an .h5ad file's X, obs, var and spatial coordinates; needs the optional package h5py."""
    try:
        import h5py
    except ImportError as e:
        raise SourceError("reading h5ad needs the optional package h5py; convert the file to a bundle") from e
    try:
        with h5py.File(path, "r") as f:
            obs, var = _h5_frame(f["obs"], "obs_id"), _h5_frame(f["var"], "feature_id")
            x = f["X"]
            if hasattr(x, "keys"):
                rows = np.repeat(np.arange(len(x["indptr"][()]) - 1), np.diff(x["indptr"][()]))
                cols, values = x["indices"][()], x["data"][()]
            else:
                dense = x[()]
                rows, cols = np.nonzero(dense)
                values = dense[rows, cols]
            if "obsm" in f and "spatial" in f["obsm"]:
                spatial = np.asarray(f["obsm"]["spatial"][()], float)
                obs |= {"x": spatial[:, 0], "y": spatial[:, 1]}
    except Exception as e:
        raise SourceError(f"cannot read h5ad {path!r}: {e}") from e
    obs["obs_ord"], var["feature_ord"] = np.arange(len(obs["obs_id"])), np.arange(len(var["feature_id"]))
    kept = values != 0
    x = {"obs_id": obs["obs_id"][rows[kept]], "feature_id": var["feature_id"][cols[kept]], "value": values[kept].astype(float)}
    return MatrixBundle(*[spark.createDataFrame(pa.table({k: pa.array(v) for k, v in t.items()})) for t in (obs, var, x)])


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, sha256) of the files under ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))
