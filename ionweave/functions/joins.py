"""Range and nearest joins on a numeric key, as bucketed equi-joins.

A plain range predicate plans as a nested loop.  Here the key is cut into
buckets at least as wide as the tolerance; the smaller side goes to its bucket and both
neighbours, and the exact predicate runs on the pairs that meet.  ppm
tolerances are relative to the query, so they get logarithmic buckets.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import IonweaveError
from ..model import choice, number

UNITS = ("ppm", "da")
ULP = 2.220446049250313e-16


def distance_limit(mz: Column, tolerance: float, unit: str) -> Column:
    """Absolute limit at ``mz``: the tolerance itself, or mz * ppm / 10^6."""
    return F.lit(float(tolerance)) if unit == "da" else mz * F.lit(float(tolerance)) / F.lit(1e6)


def _bucket(mz: Column, tolerance: float, unit: str) -> Column:
    if unit == "da":
        return F.floor(mz / F.lit(max(tolerance, 1e-12) * (1 + 1e-9)))
    share = tolerance / 1e6
    if share >= 0.5:
        raise IonweaveError("a ppm tolerance must be below 500000")
    return F.floor(F.log(mz) / F.lit(max(-math.log1p(-share), 1e-12) * (1 + 1e-6) + 1e-14))


def candidate_pairs(queries: DataFrame, references: DataFrame, query_mz: str, reference_mz: str, tolerance: float, unit: str = "ppm", slack: bool = False) -> DataFrame:
    """Pairs with |reference - query| within the limit at the query.

    ``slack`` adds two units in the last place of both values.  The reference side is
    tripled; column names of the two sides must differ.
    """
    number("tolerance", tolerance, low=0)
    choice("unit", unit, UNITS)
    q, r = F.col(query_mz), F.col(reference_mz)
    limit = distance_limit(q, tolerance, unit)
    if slack and tolerance > 0:
        limit = limit + 2 * F.lit(ULP) * (F.pow(F.lit(2.0), F.floor(F.log2(q))) + F.pow(F.lit(2.0), F.floor(F.log2(r))))
    if tolerance == 0:
        return queries.join(references, q == r)
    b = _bucket(r, tolerance, unit)
    wide = references.withColumn("_b", F.explode(F.array(b - 1, b, b + 1)))
    return queries.withColumn("_b", _bucket(q, tolerance, unit)).join(wide, "_b").where(F.abs(r - q) <= limit).drop("_b")


def nearest(queries: DataFrame, axis: DataFrame, query_mz: str, axis_mz: str, axis_ord: str, keys: list[str], tolerance: float, unit: str = "ppm") -> DataFrame:
    """Each query's nearest axis entry within the tolerance; a tie takes the lower ``axis_ord``.

    Only entries within the tolerance can win, so the bucketed candidates hold
    the nearest one; ``min_by`` combines before the shuffle.
    """
    pairs = candidate_pairs(queries, axis, query_mz, axis_mz, tolerance, unit)
    rank = F.struct(F.abs(F.col(axis_mz) - F.col(query_mz)), F.col(axis_ord))
    payload = [c for c in queries.columns if c not in keys]
    row = F.struct(*[F.col(c) for c in payload], F.col(axis_mz), F.col(axis_ord))
    best = pairs.groupBy(*keys).agg(F.min_by(row, rank).alias("_r"))
    return best.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in [*payload, axis_mz, axis_ord]])
