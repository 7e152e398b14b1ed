"""imzML as a Spark data source: ``spark.read.format("imzml").load("run.imzML")``.

The driver reads the XML for coordinates, offsets, lengths and types; each
partition reads the byte ranges of its spectra from the .ibd beside it.
"""

from __future__ import annotations

import os
from dataclasses import dataclass
from xml.etree import ElementTree

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..errors import SourceError
from ..model import MatrixBundle
from ..operators.peaks import matrix_from_spectra

SCHEMA = "pixel_ord int, x int, y int, mz array<double>, intensity array<double>"
#: Controlled-vocabulary accessions of the imzML format.
_TYPES = {"MS:1000521": "<f4", "MS:1000523": "<f8", "MS:1000519": "<i4", "MS:1000522": "<i8"}
_MZ, _INTENSITY = "MS:1000514", "MS:1000515"
_X, _Y, _OFFSET, _LENGTH = "IMS:1000050", "IMS:1000051", "IMS:1000102", "IMS:1000103"
SPECTRA_PER_PARTITION = 2000


@dataclass
class Span:
    offset: int
    length: int
    kind: str


@dataclass
class SpectrumRange(InputPartition):
    first: int
    spectra: list


def _params(node) -> dict[str, str]:
    return {e.get("accession"): e.get("value") for e in node if e.tag.endswith("cvParam")}


def read_index(path: str) -> list[tuple[int, int, Span, Span]]:
    """(x, y, mz span, intensity span) per spectrum; z is dropped."""
    groups: dict[str, dict] = {}
    out = []
    try:
        for _, node in ElementTree.iterparse(path):
            tag = node.tag.rsplit("}")[-1]
            if tag == "referenceableParamGroup":
                groups[node.get("id")] = _params(node)
            elif tag == "spectrum":
                at: dict[str, str] = {}
                spans: dict[str, Span] = {}
                for e in node.iter():
                    kind = e.tag.rsplit("}")[-1]
                    if kind == "scan":
                        at |= _params(e)
                    elif kind == "binaryDataArray":
                        p = _params(e)
                        for r in e:
                            if r.tag.endswith("referenceableParamGroupRef"):
                                p |= groups.get(r.get("ref"), {})
                        which = "mz" if _MZ in p else "intensity" if _INTENSITY in p else None
                        number = next((t for a, t in _TYPES.items() if a in p), "<f4")
                        if which:
                            spans[which] = Span(int(p[_OFFSET]), int(p[_LENGTH]), number)
                out.append((int(at[_X]), int(at[_Y]), spans["mz"], spans["intensity"]))
                node.clear()
    except (ElementTree.ParseError, KeyError, ValueError, TypeError, OSError) as e:
        raise SourceError(f"cannot read imzML {path!r}: {e}") from e
    if not out:
        raise SourceError(f"imzML {path!r} has no pixels")
    return out


def _ibd(path: str) -> str:
    other = os.path.splitext(path)[0] + ".ibd"
    if not os.path.exists(path) or not os.path.exists(other):
        raise SourceError(f"imzML needs both {path!r} and {other!r}")
    return other


class ImzmlReader(DataSourceReader):
    def __init__(self, path: str, per_partition: int):
        self.path, self.per_partition = path, per_partition

    def partitions(self):
        _ibd(self.path)
        index = read_index(self.path)
        return [SpectrumRange(i, index[i : i + self.per_partition]) for i in range(0, len(index), self.per_partition)]

    def read(self, partition):
        with open(_ibd(self.path), "rb") as data:
            for k, (x, y, mz, intensity) in enumerate(partition.spectra, partition.first):
                values = []
                for span in (mz, intensity):
                    data.seek(span.offset)
                    values.append(np.frombuffer(data.read(span.length * np.dtype(span.kind).itemsize), span.kind).astype(float).tolist())
                yield k, x, y, values[0], values[1]


class ImzmlSource(DataSource):
    @classmethod
    def name(cls):
        return "imzml"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return ImzmlReader(self.options["path"], int(self.options.get("spectraPerPartition", SPECTRA_PER_PARTITION)))


def read_spectra(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(ImzmlSource)
    return spark.read.format("imzml").load(path)


def read_imzml(spark: SparkSession, path: str, dataset_id: str, tolerance: float = 10, unit: str = "ppm", profile_bin_size: float | None = None) -> MatrixBundle:
    """Bundle with observations p1.., features m1.. and a dataset column."""
    from pyspark.sql import functions as F

    _ibd(path)
    spectra = read_spectra(spark, path).withColumn("dataset", F.lit(dataset_id))
    return matrix_from_spectra(spectra, tolerance, unit, profile_bin_size)


def write_imzml(path: str, spectra: list[tuple[int, int, list[float], list[float]]]) -> None:
    """A small processed-mode imzML pair of (x, y, mz, intensity) rows."""
    rows, blob = [], b"\0" * 16
    for k, (x, y, mz, intensity) in enumerate(spectra):
        arrays = ""
        for kind, values in ((_MZ, mz), (_INTENSITY, intensity)):
            arrays += f'<binaryDataArray><cvParam accession="{kind}"/><cvParam accession="MS:1000523"/><cvParam accession="{_OFFSET}" value="{len(blob)}"/><cvParam accession="{_LENGTH}" value="{len(values)}"/></binaryDataArray>'
            blob += np.asarray(values, "<f8").tobytes()
        rows.append(f'<spectrum index="{k}"><scanList><scan><cvParam accession="{_X}" value="{x}"/><cvParam accession="{_Y}" value="{y}"/></scan></scanList><binaryDataArrayList>{arrays}</binaryDataArrayList></spectrum>')
    with open(path, "w") as f:
        f.write(f'<?xml version="1.0"?><mzML><run><spectrumList count="{len(rows)}">{"".join(rows)}</spectrumList></run></mzML>')
    with open(os.path.splitext(path)[0] + ".ibd", "wb") as f:
        f.write(blob)
