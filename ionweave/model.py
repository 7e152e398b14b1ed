"""Long-format data model.

A matrix of observations by features is three tables: ``obs`` (obs_id, obs_ord,
annotations), ``var`` (feature_id, feature_ord, mz, annotations) and ``x``
(obs_id, feature_id, value), which holds non-zero values only.  Order is carried
by ``obs_ord`` and ``feature_ord``, never by row position.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .errors import IonweaveError

PIXELS = "row INT, col INT, label BIGINT"
OVERLAP_COLUMNS = ("cell_id", "cell_label", "laser_label", "laser_obs_id", "occupied_pixels", "laser_area", "occupied_ratio")


@dataclass(frozen=True)
class MatrixBundle:
    obs: DataFrame
    var: DataFrame
    x: DataFrame
    layers: dict[str, DataFrame] = field(default_factory=dict)
    meta: dict[str, object] = field(default_factory=dict)

    def with_layer(self, name: str, x: DataFrame) -> MatrixBundle:
        return replace(self, layers={**self.layers, name: x})

    def matrix(self, layer: str | None = None) -> DataFrame:
        if layer is None:
            return self.x
        if layer not in self.layers:
            raise IonweaveError(f"layer {layer!r} does not exist; layers: {sorted(self.layers)}")
        return self.layers[layer]


@dataclass(frozen=True)
class SegmentationResult:
    labels: DataFrame
    regions: DataFrame
    diagnostics: dict


@dataclass(frozen=True)
class RegistrationResult:
    bundle: MatrixBundle
    mapping: DataFrame
    transform: dict
    report: DataFrame


@dataclass(frozen=True)
class QuantificationResult:
    bundle: MatrixBundle
    overlaps: DataFrame
    accepted: DataFrame
    rejected: DataFrame
    report: DataFrame


def require(df: DataFrame, columns: tuple[str, ...] | list[str], error=IonweaveError, what: str = "table") -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise error(f"{what} is missing columns: {missing}")


def number(name: str, value: object, error=IonweaveError, low: float | None = None, high: float | None = None, above: float | None = None) -> float:
    """A finite real number within the bounds; booleans are refused."""
    if isinstance(value, bool) or not isinstance(value, (int, float)) or not math.isfinite(value):
        raise error(f"{name} must be a finite number")
    if low is not None and value < low or high is not None and value > high or above is not None and value <= above:
        raise error(f"{name} is out of range: {value!r}")
    return float(value)


def whole(name: str, value: object, error=IonweaveError, low: int = 1, high: int | None = None) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or value < low or high is not None and value > high:
        raise error(f"{name} must be an integer of at least {low}")
    return value


def choice(name: str, value: object, allowed: tuple[str, ...], error=IonweaveError) -> str:
    if value not in allowed:
        raise error(f"{name} must be one of {', '.join(allowed)}")
    return str(value)


def check_rows(df: DataFrame, tests: dict[str, object], error=IonweaveError) -> None:
    """One aggregate job over ``df``: raises the first message whose condition some row meets."""
    if not tests:
        return
    row = df.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(f"t{i}") for i, c in enumerate(tests.values())]).first()
    for message, bad in zip(tests, row):
        if bad:
            raise error(message)


def not_finite(column):
    c = column.cast("double")
    return c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
