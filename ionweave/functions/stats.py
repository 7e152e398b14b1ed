"""Statistics on long tables with implicit zeros, and tail probabilities."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..session import cut
from .ordering import ranged


def tied_rank(partition: list, order: str) -> Column:
    """Average rank of ties: rank + (ties - 1) / 2."""
    w = Window.partitionBy(*partition).orderBy(order)
    ties = Window.partitionBy(*partition, order)
    return F.rank().over(w) + (F.count("*").over(ties) - 1) / F.lit(2.0)


#: Rows of one task of a window or a set operation over a whole table.
TASK_ROWS = 500_000


def spread(df: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """``df`` of about ``rows`` rows dealt by ``keys`` into partitions of at most about ``TASK_ROWS``.

    A window over the keys needs no other shuffle then, and what a task sorts stays
    bounded whatever the number of shuffle partitions set.
    """
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, math.ceil(rows / TASK_ROWS)), *keys)


def benjamini_hochberg(df: DataFrame, partition: list[str], p: str, out: str) -> DataFrame:
    """Adds adjusted p-values: running minimum of p n / rank from the largest p down, within each group.

    Equal p-values of a group share their result, so distinct values with their
    counts are what is ordered.  They lie in range partitions of (group, p), each
    with windows of its own; counts and minima of the other partitions of a group
    are carried over their bounds, so a large group is no single task.
    """
    keys, df = [*partition, p], cut(df)  # p must be the same number when it is joined back
    values, _ = ranged(df.groupBy(*keys).agg(F.count("*").alias("_c")), keys)
    in_order, in_part = Window.partitionBy(*partition).orderBy("_part"), Window.partitionBy(*partition, "_part")

    def carried(rows: DataFrame, value, name: str, window) -> DataFrame:
        """``rows`` with ``name``: ``value`` per partition of a group, combined over the window of partitions."""
        return same_join(rows, rows.groupBy(*partition, "_part").agg(value.alias(name)).withColumn(name, window(F.col(name))), [*partition, "_part"])

    before, after = in_order.rowsBetween(Window.unboundedPreceding, -1), in_order.rowsBetween(1, Window.unboundedFollowing)
    ranked = carried(values, F.sum("_c"), "_below", lambda c: F.coalesce(F.sum(c).over(before), F.lit(0)))
    ranked = carried(ranked, F.sum("_c"), "_n", lambda c: F.sum(c).over(Window.partitionBy(*partition)))
    rank = F.col("_below") + F.sum("_c").over(in_part.orderBy(p).rowsBetween(Window.unboundedPreceding, 0))
    ranked = ranked.withColumn("_q", F.col(p) * F.col("_n") / rank)
    ranked = carried(ranked, F.min("_q"), "_later", lambda c: F.min(c).over(after))
    least = F.min("_q").over(in_part.orderBy(p).rowsBetween(0, Window.unboundedFollowing))
    adjusted = ranked.select(*keys, F.least(F.lit(1.0), least, F.col("_later")).alias(out))
    return same_join(df, adjusted, keys)


def same_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """``left`` with the further columns of ``right``, nulls of a key being equal."""
    names = {k: f"_key{i}" for i, k in enumerate(keys)}
    renamed = right.withColumnsRenamed(names)
    on = reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[names[k]]) for k in keys])
    return left.join(renamed, on).drop(*names.values())


@F.pandas_udf(DoubleType())
def normal_two_sided(z: pd.Series) -> pd.Series:
    return z.map(lambda v: math.erfc(abs(v) / math.sqrt(2)) if v is not None and not math.isnan(v) else float("nan"))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny, c = 1e-300, 1.0
    d = 1 / max(1 - (a + b) * x / (a + 1), tiny)
    h = d
    for m in range(1, 400):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + step * d
            c = 1 + step / c
            d = 1 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def student_two_sided(t: float, dof: float) -> float:
    """P(|T| >= |t|) by the regularised incomplete beta function."""
    if math.isnan(t) or math.isnan(dof) or dof <= 0:
        return float("nan")
    if math.isinf(t):
        return 0.0
    x, a, b = dof / (dof + t * t), dof / 2, 0.5
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return min(1.0, front * _beta_fraction(a, b, x) / a)
    return min(1.0, max(0.0, 1 - front * _beta_fraction(b, a, 1 - x) / b))


@F.pandas_udf(DoubleType())
def student_p(t: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series(np.array([student_two_sided(float("nan") if a is None else a, float("nan") if d is None else d) for a, d in zip(t, dof)], float))
