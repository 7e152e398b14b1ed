"""Laser-mark segmentation of gray images.

An image is a unit of work: the steps are numpy on one image per task, many
images run in parallel, and results are pixel tables.  Floods run per connected
component, which is exact because the flood mask is the component.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..errors import RegionError
from ..model import number, require, whole


def _shifted(a: np.ndarray, dr: int, dc: int, fill) -> np.ndarray:
    out = np.full_like(a, fill)
    h, w = a.shape
    if abs(dr) < h and abs(dc) < w:
        out[max(0, -dr) : h - max(0, dr), max(0, -dc) : w - max(0, dc)] = a[max(0, dr) : h - max(0, -dr), max(0, dc) : w - max(0, -dc)]
    return out


def _disk(r: int) -> list[tuple[int, int]]:
    return [(y, x) for y in range(-r, r + 1) for x in range(-r, r + 1) if y * y + x * x <= r * r]


def _square(k: int) -> list[tuple[int, int]]:
    low = -(k // 2)
    return [(y, x) for y in range(low, low + k) for x in range(low, low + k)]


def _fold(best, a: np.ndarray, offsets) -> np.ndarray:
    """``best`` (np.minimum or np.maximum) of ``a`` and its shifts; one array is kept, whatever the footprint.

    Outside the image counts as what ``best`` ignores, so only the parts that overlap are compared.
    """
    h, w = a.shape
    blank = (best is np.minimum) if a.dtype == bool else (np.inf if best is np.minimum else -np.inf)
    out = np.full_like(a, blank)
    for dr, dc in offsets:
        if abs(dr) < h and abs(dc) < w:
            here = out[max(0, -dr) : h - max(0, dr), max(0, -dc) : w - max(0, dc)]
            best(here, a[max(0, dr) : h - max(0, -dr), max(0, dc) : w - max(0, -dc)], out=here)
    return out


def erode(a: np.ndarray, offsets) -> np.ndarray:
    return _fold(np.minimum, a, offsets)


def dilate(a: np.ndarray, offsets) -> np.ndarray:
    return _fold(np.maximum, a, [(-y, -x) for y, x in offsets])


def opening(a, offsets):
    return dilate(erode(a, offsets), offsets)


def closing(a, offsets):
    return erode(dilate(a, offsets), offsets)


def otsu(values: np.ndarray, bins: int = 256) -> float:
    """Bin centre that maximises the variance between the two sides."""
    counts, edges = np.histogram(values.ravel(), bins)
    centers = (edges[:-1] + edges[1:]) / 2
    low, high = np.cumsum(counts), np.cumsum(counts[::-1])[::-1]
    sums = counts * centers
    mean_low = np.cumsum(sums) / np.maximum(low, 1)
    mean_high = np.cumsum(sums[::-1])[::-1] / np.maximum(high, 1)
    between = low[:-1] * high[1:] * (mean_low[:-1] - mean_high[1:]) ** 2
    return float(centers[int(between.argmax())])


def label(mask: np.ndarray, connectivity: int = 2) -> np.ndarray:
    """Connected components numbered from 1 in raster order."""
    place = np.arange(1, mask.size + 1).reshape(mask.shape)
    steps = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if connectivity == 2 else [])
    pairs = []
    for dr, dc in steps:
        near = _shifted(mask, dr, dc, False) & mask
        pairs.append((place[near] - 1, _shifted(place, dr, dc, 0)[near] - 1))
    a, b = (np.concatenate([p[i] for p in pairs]) for i in (0, 1))
    root = np.arange(mask.size)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        for ends in (root[a], root[b], a, b):
            np.minimum.at(new, ends, low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    out = np.zeros(mask.size, np.int64)
    flat = mask.ravel()
    _, out[flat] = np.unique(root[flat], return_inverse=True)
    out[flat] += 1
    return out.reshape(mask.shape)


def boxes(parts: np.ndarray) -> list[tuple[slice, slice]]:
    """The bounding box of every label 1, 2, ..., from one pass over the foreground."""
    rows, cols = np.nonzero(parts)
    at, n = parts[rows, cols] - 1, int(parts.max(initial=0))
    low, high = np.full((2, n), max(parts.shape)), np.zeros((2, n), int)
    for axis, place in enumerate((rows, cols)):
        np.minimum.at(low[axis], at, place)
        np.maximum.at(high[axis], at, place + 1)
    return [(slice(a, b), slice(c, d)) for a, b, c, d in zip(low[0].tolist(), high[0].tolist(), low[1].tolist(), high[1].tolist())]


def clear_border(mask: np.ndarray) -> np.ndarray:
    parts = label(mask)
    edge = np.unique(np.concatenate([parts[0], parts[-1], parts[:, 0], parts[:, -1]]))
    return mask & ~np.isin(parts, edge[edge > 0])


def distance(mask: np.ndarray) -> np.ndarray:
    """Exact Euclidean distance to the background (to beyond the image if there is none)."""
    h, w = mask.shape
    up, down = np.zeros((h, w)), np.zeros((h, w))
    far = float(h + w)
    run = np.full(w, far)
    for r in range(h):
        run = np.where(mask[r], run + 1, 0)
        up[r] = run
    run = np.full(w, far)
    for r in range(h - 1, -1, -1):
        run = np.where(mask[r], run + 1, 0)
        down[r] = run
    column = np.minimum(up, down) ** 2
    best = column.copy()
    for d in range(1, w):
        if d * d >= best.max():
            break
        best = np.minimum(best, np.minimum(_shifted(column, 0, d, np.inf), _shifted(column, 0, -d, np.inf)) + d * d)
    return np.sqrt(best)


def local_maxima(height: np.ndarray, within: np.ndarray, min_distance: int) -> np.ndarray:
    """Peaks at least ``min_distance`` apart, higher first, earlier among equals."""
    reach = range(-min_distance, min_distance + 1)
    highest = dilate(dilate(height, [(d, 0) for d in reach]), [(0, d) for d in reach])
    peak = (height == highest) & within & (height > 0)
    rows, cols = np.nonzero(peak)
    order = np.lexsort((cols, rows, -height[rows, cols]))
    kept: list[tuple[int, int]] = []
    for i in order.tolist():
        r, c = int(rows[i]), int(cols[i])
        if all(max(abs(r - y), abs(c - x)) > min_distance for y, x in kept):
            kept.append((r, c))
    return np.array(kept, int).reshape(-1, 2)


def watershed(height: np.ndarray, markers: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Priority flood from the markers inside the mask, eight neighbours."""
    out = np.where(mask, markers, 0)
    heap, tick = [], 0
    for r, c in zip(*np.nonzero(out)):
        heap.append((height[r, c], tick, int(r), int(c)))
        tick += 1
    heapq.heapify(heap)
    h, w = mask.shape
    near = [(y, x) for y in (-1, 0, 1) for x in (-1, 0, 1) if y or x]
    while heap:
        _, _, r, c = heapq.heappop(heap)
        for y, x in near:
            i, j = r + y, c + x
            if 0 <= i < h and 0 <= j < w and mask[i, j] and not out[i, j]:
                out[i, j] = out[r, c]
                heapq.heappush(heap, (height[i, j], tick, i, j))
                tick += 1
    return out


PARAMETERS = dict(intensity_cutoff=0.2, top_hat_radius=10, top_hat_mode="enhance", closing_size=5, post_closing_size=1, opening_size=3, min_peak_distance=25, peak_detection_mode="per_component", marker_connectivity=2, min_size=30, threshold="otsu")


def check_parameters(**parameters) -> dict:
    unknown = sorted(set(parameters) - set(PARAMETERS))
    if unknown:
        raise RegionError(f"unknown parameters: {unknown}")
    p = {**PARAMETERS, **parameters}
    number("intensity_cutoff", p["intensity_cutoff"], RegionError)
    whole("top_hat_radius", p["top_hat_radius"], RegionError, low=0)
    for name in ("closing_size", "post_closing_size", "opening_size", "min_peak_distance", "min_size"):
        whole(name, p[name], RegionError)
    whole("marker_connectivity", p["marker_connectivity"], RegionError, high=2)
    if p["top_hat_mode"] not in ("enhance", "legacy_opening") or p["peak_detection_mode"] not in ("per_component", "legacy_global"):
        raise RegionError("top_hat_mode or peak_detection_mode is unknown")
    if p["threshold"] != "otsu":
        number("threshold", p["threshold"], RegionError)
    return p


def segment_image(image: np.ndarray, mask: np.ndarray | None = None, **parameters) -> tuple[np.ndarray, dict]:
    """(label raster, diagnostics) of one gray image."""
    p = check_parameters(**parameters)
    image = np.asarray(image, float)
    if image.ndim != 2 or not np.isfinite(image).all():
        raise RegionError("the image must be two-dimensional and finite")
    mask = np.ones(image.shape, bool) if mask is None else np.asarray(mask, bool)
    if mask.shape != image.shape:
        raise RegionError("image and mask must have one shape")
    work = np.where(mask & (image >= p["intensity_cutoff"]), image, 0.0)
    if p["top_hat_radius"]:
        opened = opening(work, _disk(p["top_hat_radius"]))
        work = work - opened if p["top_hat_mode"] == "enhance" else opened
    threshold = otsu(work) if p["threshold"] == "otsu" else float(p["threshold"])
    found = (work > threshold) & mask
    found = closing(found, _square(p["closing_size"])) & mask
    found = clear_border(found)
    found = closing(found, _square(p["post_closing_size"])) & mask
    found = opening(found, _square(p["opening_size"])) & mask
    height = distance(found)
    parts = label(found)
    markers = np.zeros(image.shape, bool)
    if p["peak_detection_mode"] == "per_component":
        for k, box in enumerate(boxes(parts), 1):
            own = parts[box] == k
            peaks = local_maxima(np.where(own, height[box], 0), own, p["min_peak_distance"])
            if not len(peaks):
                peaks = np.array([np.unravel_index(np.where(own, height[box], -1).argmax(), own.shape)])
            markers[peaks[:, 0] + box[0].start, peaks[:, 1] + box[1].start] = True
    else:
        peaks = local_maxima(height, found, p["min_peak_distance"])
        markers[peaks[:, 0], peaks[:, 1]] = True
    if not markers.any():
        raise RegionError("no marker was found")
    flooded = watershed(-height, label(markers, p["marker_connectivity"]), found)
    names, sizes = np.unique(flooded, return_counts=True)
    flooded[np.isin(flooded, names[sizes < p["min_size"]])] = 0
    objects = len(np.unique(flooded)) - int((flooded == 0).any())
    return flooded, {"threshold": threshold, "object_count": objects, "foreground_pixels": int(found.sum())}


def segment_images(pixels: DataFrame, **parameters) -> DataFrame:
    """(image_id, row, col, label) of ``pixels(image_id, row, col, value[, inside])``; an image per task."""
    require(pixels, ["image_id", "row", "col", "value"], RegionError, "pixels")
    check_parameters(**parameters)
    masked = "inside" in pixels.columns

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        shape = int(pdf.row.max()) + 1, int(pdf.col.max()) + 1
        image, mask = np.zeros(shape), np.zeros(shape, bool)
        image[pdf.row, pdf.col] = pdf.value
        mask[pdf.row, pdf.col] = pdf.inside if masked else True
        labels, _ = segment_image(image, mask, **parameters)
        rows, cols = np.nonzero(labels)
        return pd.DataFrame({"image_id": pdf.image_id.iloc[0], "row": rows, "col": cols, "label": labels[rows, cols]})

    kind = pixels.schema["image_id"].dataType.simpleString()
    return pixels.groupBy("image_id").applyInPandas(run, f"image_id {kind}, row int, col int, label long")
