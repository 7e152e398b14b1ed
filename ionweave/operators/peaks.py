"""Peak axes: consensus grouping, nearest projection, profile binning, alignment."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import PreprocessError
from ..functions.joins import UNITS, distance_limit, nearest
from ..functions.ordering import ranged
from ..model import MatrixBundle, check_rows, choice, not_finite, number, require
from ..session import cut


def check_peaks(peaks: DataFrame) -> None:
    """Raise unless every peak has a positive finite m/z and a finite intensity."""
    require(peaks, ["pixel_ord", "mz", "intensity"], PreprocessError, "peaks")
    check_rows(peaks, {
        "mz must be finite and positive": not_finite(F.col("mz")) | (F.col("mz") <= 0),
        "intensity must be finite": not_finite(F.col("intensity")),
    }, PreprocessError)


def explode_spectra(spectra: DataFrame) -> DataFrame:
    """(pixel_ord, peak_ord, mz, intensity) of spectra with parallel arrays."""
    pairs = F.arrays_zip("mz", "intensity")
    return spectra.select("pixel_ord", F.posexplode(pairs).alias("peak_ord", "p")).select("pixel_ord", "peak_ord", "p.mz", "p.intensity")


def _fold(mz: list[float], n: list[int], span, state: tuple | None = None, known: dict | None = None):
    """Fold sorted distinct values, each ``n`` times: ([value, group, times], starts, end state, met).

    Group -1 is the one that ``state`` (first, total, count) carries in.  A start is
    (value, repeats left); where one is ``known``, the fold goes on as the known one
    did, and it ends there: ``met`` is that start.
    """
    first, total, count = state or (0.0, 0.0, 0)
    group, opened, rows, starts = -1, state is not None, [], {}
    for i, (value, left) in enumerate(zip(mz, n)):
        while left:
            center = (total + value) / (count + 1)
            if not opened or abs(first - center) > span(first) or abs(value - center) > span(value):
                if known is not None and (i, left) in known:
                    return rows, starts, None, (i, left)
                group += 1
                starts[i, left] = group
                first, total, count, opened = value, 0.0, 0, True
            # each repeat draws the centre nearer to the value: all join if the first value bears even that
            take = left if value - first <= span(first) * (1 - 1e-9) else 1
            total, count, left = total + take * value, count + take, left - take
            if rows and rows[-1][0] == i and rows[-1][1] == group:
                rows[-1][2] += take
            else:
                rows.append([i, group, take])
    return rows, starts, (first, total, count), None


def _fold_part(mz: list[float], n: list[int], span, state: tuple | None):
    """(rows, new groups, end state) of a partition into which ``state`` is carried.

    The partition's own fold, from its first value, is followed by the carried one
    only until both start a group at the same value.
    """
    rows, starts, end, _ = _fold(mz, n, span)
    if state is None:
        return rows, len(starts), end
    ahead, opened, own_end, met = _fold(mz, n, span, state, starts)
    if met is None:
        return ahead, len(opened), own_end
    shift = len(opened) - starts[met]
    # a value whose repeats straddle the meeting point has rows of both folds
    tail = [[i, group + shift, take] for i, group, take in rows if group >= starts[met]]
    return ahead + tail, len(starts) + shift, end


def consensus_groups(values: DataFrame, tolerance: float = 10, unit: str = "ppm") -> DataFrame:
    """(mz, n, group_id, center) per value of ``values(mz)`` and group it is in.

    Values are folded upwards: the centre of a group with one more value is the
    mean, and the value joins if it and the group's first member are both within their own limits of it.
    Distinct values with their multiplicity lie in range partitions, each folded by
    a task of its own, first as if it began a group.  The fold carried in from the
    partition before soon starts a group where that fold did, and from there on both are
    the same; only where they never meet does the end of a partition depend on the one
    before, and the partition after it is folded once more.  The driver holds one line per partition.
    """
    number("tolerance", tolerance, PreprocessError, low=0)
    choice("unit", unit, UNITS, PreprocessError)
    parts, ends = ranged(values.groupBy("mz").agg(F.count("*").alias("n")), ["mz"])
    order = [e["_part"] for e in ends]

    def folded(carried: dict[int, tuple | None], offsets: dict[int, int] | None = None, opened: dict[int, int] | None = None):
        """Per partition its end and number of new groups, or with ``offsets`` its rows."""

        def run(batches):
            frames = [b for b in batches if len(b)]
            if not frames:
                return
            pdf = pd.concat(frames).sort_values("mz")
            part = int(pdf["_part"].iloc[0])
            span = (lambda v: tolerance) if unit == "da" else (lambda v: v * tolerance / 1e6)
            mz = pdf.mz.tolist()
            rows, new, end = _fold_part(mz, pdf.n.tolist(), span, carried.get(part))
            if offsets is None:
                yield pd.DataFrame([(part, new, *end)], columns=["part", "new", "first", "total", "count"])
                return
            ids = [opened[part] if group < 0 else offsets[part] + group for _, group, _ in rows]
            yield pd.DataFrame({"mz": [mz[i] for i, _, _ in rows], "n": [take for _, _, take in rows], "group_id": np.array(ids, np.int32)})

        schema = "part int, new long, first double, total double, count long" if offsets is None else "mz double, n long, group_id int"
        return parts.mapInPandas(run, schema)

    state, lines = {part: None for part in order}, {}
    while order:
        lines = {r.part: r for r in folded(state).collect()}  # one line per partition
        now = {part: tuple(lines[before][2:5]) if before is not None else None for before, part in zip([None, *order], order)}
        if now == state:
            break
        state = now
    offsets, opened, total, last = {}, {}, 0, -1
    for part in order:
        offsets[part], opened[part] = total, last
        total += lines[part].new
        last = total - 1 if lines[part].new else last
    groups = cut(folded(state, offsets, opened))
    centers = groups.groupBy("group_id").agg((F.sum(F.col("mz") * F.col("n")) / F.sum("n")).alias("center"))
    return groups.join(centers, "group_id").select("mz", "n", "group_id", "center")


def consensus_axis(values: DataFrame, tolerance: float = 10, unit: str = "ppm") -> DataFrame:
    """(col_ord, mz): the centres, ascending."""
    groups = consensus_groups(values, tolerance, unit)
    return groups.select(F.col("group_id").alias("col_ord"), F.col("center").alias("mz")).distinct()


def project(peaks: DataFrame, axis: DataFrame, tolerance: float = 10, unit: str = "ppm") -> DataFrame:
    """(pixel_ord, col_ord, value): peaks summed on their nearest axis entry within the limit at the peak."""
    number("tolerance", tolerance, PreprocessError, above=0)
    choice("unit", unit, UNITS, PreprocessError)
    named = axis.select("col_ord", F.col("mz").alias("axis_mz"))
    keyed = peaks.select("pixel_ord", "peak_ord", "mz", "intensity")
    hit = nearest(keyed, named, "mz", "axis_mz", "col_ord", ["pixel_ord", "peak_ord"], tolerance, unit)
    return hit.groupBy("pixel_ord", "col_ord").agg(F.sum("intensity").alias("value"))


def bin_profiles(peaks: DataFrame, bin_size: float) -> tuple[DataFrame, DataFrame]:
    """(axis, values) on even bins from floor(min / size) * size; unused bins stay in the axis."""
    size = F.lit(number("bin_size", bin_size, PreprocessError, above=0))
    ends = peaks.agg((F.floor(F.min("mz") / size) * size).alias("start"), F.max("mz").alias("high"))
    binned = peaks.crossJoin(F.broadcast(ends))  # one row
    binned = binned.withColumn("col_ord", F.floor((F.col("mz") - F.col("start")) / size).cast("int"))
    values = binned.groupBy("pixel_ord", "col_ord").agg(F.sum("intensity").alias("value"))
    last = F.floor((F.col("high") - F.col("start")) / size).cast("int")
    axis = ends.where("start IS NOT NULL").select(F.explode(F.sequence(F.lit(0), last)).alias("col_ord"), "start")
    return axis.select("col_ord", (F.col("start") + (F.col("col_ord") + 0.5) * size).alias("mz")), values


def shared_axis(spectra: DataFrame) -> bool:
    """True if all spectra carry the same m/z array (its hash and length are compared first)."""
    row = spectra.agg(F.count_distinct(F.xxhash64("mz")).alias("h"), F.min(F.size("mz")).alias("a"), F.max(F.size("mz")).alias("b")).first()
    return row.h == 1 and row.a == row.b


def align_features(bundle: MatrixBundle, tolerance: float = 10, unit: str = "ppm") -> MatrixBundle:
    """Features merged on the consensus axis; values of a group add up; ids are m1, m2, ..."""
    groups = consensus_groups(bundle.var.select("mz"), tolerance, unit)
    named = bundle.var.select("feature_id", "mz").join(groups.select("mz", "group_id", "center").distinct(), "mz")
    new_id = F.concat(F.lit("m"), (F.col("group_id") + 1).cast("string"))
    var = groups.select(new_id.alias("feature_id"), F.col("group_id").alias("feature_ord"), F.col("center").alias("mz")).distinct()
    x = bundle.x.join(named.select("feature_id", new_id.alias("_new")), "feature_id").groupBy("obs_id", F.col("_new").alias("feature_id")).agg(F.sum("value").alias("value"))
    return MatrixBundle(bundle.obs, var, x, meta=dict(bundle.meta))


def matrix_from_spectra(spectra: DataFrame, tolerance: float = 10, unit: str = "ppm", bin_size: float | None = None) -> MatrixBundle:
    """Bundle of spectra (pixel_ord, x, y, mz[], intensity[], ...): binned, on their shared axis, or on the consensus axis."""
    peaks = explode_spectra(spectra)
    if bin_size is not None:
        axis, values = bin_profiles(peaks, bin_size)
    elif shared_axis(spectra):
        one = spectra.orderBy("pixel_ord").limit(1).select(F.posexplode("mz").alias("col_ord", "mz"))
        check_rows(one.withColumn("_p", F.lag("mz").over(Window.orderBy("col_ord"))), {"a shared m/z axis must be strictly increasing": F.col("mz") <= F.col("_p")}, PreprocessError)
        axis, values = one, peaks.select("pixel_ord", F.col("peak_ord").alias("col_ord"), F.col("intensity").alias("value"))
    else:
        axis = consensus_axis(peaks.select("mz"), tolerance, unit)
        values = project(peaks, axis, tolerance, unit)
    pixel, feature = F.concat(F.lit("p"), (F.col("pixel_ord") + 1).cast("string")), F.concat(F.lit("m"), (F.col("col_ord") + 1).cast("string"))
    obs = spectra.drop("mz", "intensity").withColumn("obs_id", pixel).withColumn("obs_ord", F.col("pixel_ord"))
    var = axis.select(feature.alias("feature_id"), F.col("col_ord").alias("feature_ord"), "mz")
    return MatrixBundle(obs, var, values.where("value <> 0").select(pixel.alias("obs_id"), feature.alias("feature_id"), "value"))
