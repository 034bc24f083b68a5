"""Probability maps to boxes: binarise, label, score, grow; fusion of scales and models.

A map is a row of image, height, width and values (array<float>, row-major). Maps are independent, so
all of it is one Arrow pass without a shuffle. Maps of one shape that follow each other are worked on
together, up to CELLS cells, or one map if it is larger.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.outlines import covered_means, covered_pixels, grown, outlines_of, polygon_list, ring_lengths, simplified_rings
from ..functions.polygons import POLYGON, min_area_rects, rects_corners, unclipped

#: How many cells of maps are worked on at once.
CELLS = 1 << 21


@dataclass(frozen=True)
class Settings:
    threshold: float = 0.3
    box_threshold: float = 0.4
    most_candidates: int = 300
    unclip_ratio: float = 1.5
    least_side: float = 3.0


def runs_of(masks: np.ndarray) -> np.ndarray:
    """(map, region, row, first column, column after the last) of the runs of a stack of masks, in order.

    Regions are 8-connected and numbered from 0 in each map, in the order in which a scan by rows meets them.
    """
    n, h, w = masks.shape
    grid = np.zeros((n, h + 1, w + 2), np.int8)  # nothing beside a row and below a map
    grid[:, :h, 1:-1] = masks
    step, wide = np.diff(grid.ravel()), w + 2
    start, end = np.flatnonzero(step == 1) + 1, np.flatnonzero(step == -1) + 1
    low = np.searchsorted(end + wide, start)  # runs of the row above that a run touches
    many = np.searchsorted(start + wide, end, side="right") - low
    a = np.repeat(np.arange(len(start)), many)
    b = np.arange(many.sum()) + np.repeat(low - np.cumsum(many) + many, many)
    first = np.arange(len(start))
    while True:
        least, new = np.minimum(first[a], first[b]), first.copy()
        np.minimum.at(new, first[a], least)
        np.minimum.at(new, first[b], least)
        while (new[new] != new).any():
            new = new[new]
        if (new == first).all():
            break
        first = new
    heads, which = np.unique(first, return_inverse=True)
    line = start // wide
    of = line // (h + 1)
    before = np.searchsorted(of[heads], np.arange(n))
    return np.stack([of, which - before[of], line % (h + 1), start % wide - 1, end % wide - 1], axis=1)


def label_regions(mask: np.ndarray) -> np.ndarray:
    """Labels from 1 of the 8-connected regions of a mask."""
    runs = runs_of(mask[None])
    out = np.zeros(mask.shape, int)
    out[mask.astype(bool)] = np.repeat(runs[:, 1] + 1, runs[:, 4] - runs[:, 3])
    return out


def inside(polygon: np.ndarray, h: int, w: int) -> tuple[tuple[slice, slice], np.ndarray]:
    """(bounds, mask): pixels of a map whose centre a polygon holds, looked at within the polygon's bounds."""
    low = np.clip(np.floor(polygon.min(axis=0)).astype(int), 0, (w, h)).tolist()
    high = np.clip(np.ceil(polygon.max(axis=0)).astype(int) + 1, 0, (w, h)).tolist()
    y, x = np.arange(low[1], high[1])[:, None], np.arange(low[0], high[0])[None, :]
    out = np.zeros((y.size, x.size), bool)
    p = polygon.tolist()
    for (x0, y0), (x1, y1) in zip(p, p[1:] + p[:1], strict=True):
        if y0 != y1:
            out ^= ((y0 > y) != (y1 > y)) & (x < (x1 - x0) * (y - y0) / (y1 - y0) + x0)
    return (slice(low[1], high[1]), slice(low[0], high[0])), out


def order_corners(c: np.ndarray) -> np.ndarray:
    """Top left, top right, bottom right, bottom left of rows of four corners: pairs by x, then by y."""
    c = np.take_along_axis(c, np.lexsort((c[..., 1], c[..., 0]), axis=-1)[..., None], axis=1)
    by_y = lambda pair: np.take_along_axis(pair, np.argsort(pair[..., 1], axis=1, kind="stable")[..., None], axis=1)
    left, right = by_y(c[:, :2]), by_y(c[:, 2:])
    return np.stack([left[:, 0], right[:, 0], right[:, 1], left[:, 1]], axis=1)


def boxes_of(maps: np.ndarray, settings: Settings = Settings(), matrix: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(map, score, corners) of the regions of a stack of maps, in order; in original pixels if a matrix for each map is given."""
    n, h, w = maps.shape
    runs = runs_of(maps > settings.threshold)
    runs = runs[runs[:, 1] < settings.most_candidates]
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    cuts = np.flatnonzero((np.diff(runs[:, :2], axis=0) != 0).any(axis=1)) + 1
    of = runs[np.concatenate(([0], cuts)), 0] if len(runs) else np.zeros(0, int)
    ends = np.concatenate([runs[:, [3, 2]], runs[:, [4, 2]] - (1, 0)], axis=1).astype(float)  # the hull stands on the ends of runs
    rects = min_area_rects([e.reshape(-1, 2) for e in np.split(ends, cuts)] if len(runs) else [])
    wide = rects[1].min(axis=1) >= settings.least_side
    of, corners = of[wide], order_corners(rects_corners(*(r[wide] for r in rects)))
    score = np.zeros(len(of))
    for i, (m, c) in enumerate(zip(of.tolist(), corners, strict=True)):
        bounds, covered = inside(c, h, w)
        score[i] = maps[m][bounds][covered].mean() if covered.any() else 0.0
    sure = ~(score < settings.box_threshold)
    of, score, corners = of[sure], score[sure], corners[sure]
    rects = min_area_rects(list(unclipped(corners, settings.unclip_ratio)))
    wide = rects[1].min(axis=1) >= settings.least_side + 2
    of, box = of[wide], order_corners(rects_corners(*(r[wide] for r in rects)))
    if matrix is not None:
        p = np.concatenate([box, np.ones((len(box), 4, 1))], axis=2) @ matrix.reshape(-1, 3, 3)[of].transpose(0, 2, 1)
        box = p[..., :2] / p[..., 2:]
    return of, score[wide], np.rint(box)


def _stacks(batch: pa.RecordBatch):
    """(place of the first, stack) of maps of one shape that follow each other in a batch of image, height, width and cells."""
    height, width = (batch.column(c).to_pylist() for c in ("height", "width"))
    offsets, cells = batch.column("cells").offsets.to_numpy(), batch.column("cells").values.to_numpy(zero_copy_only=False)
    i = 0
    while i < len(height):
        h, w, j = height[i], width[i], i + 1
        most = i + max(1, CELLS // max(1, h * w))
        while j < min(most, len(height)) and (height[j], width[j]) == (h, w):
            j += 1
        if (np.diff(offsets[i : j + 1]) != h * w).any():
            raise ValueError(f"a map of {h} x {w} has another number of values")
        yield i, cells[offsets[i] : offsets[j]].astype(float).reshape(j - i, h, w)
        i = j


def _numbered(of: np.ndarray) -> np.ndarray:
    """Numbers from 1 of rows of the same map, which lie together."""
    return (np.arange(len(of)) - np.searchsorted(of, of) + 1).astype(np.int32)


def detect(maps: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(image, k, score, flat): boxes of each map in the order of their regions."""

    def run(batches):
        for batch in batches:
            for at, stack in _stacks(batch):
                of, score, corners = boxes_of(stack, settings)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(of) + 1) * 8, pa.int32()), pa.array(corners.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("image").take(pa.array(of + at)), pa.array(_numbered(of)), pa.array(score), flat], ["image", "k", "score", "flat"])

    kind = maps.schema["image"].dataType.simpleString()
    return maps.select("image", "height", "width", F.col("values").alias("cells")).mapInArrow(run, f"image {kind}, k int, score double, flat array<double>")


def trace(maps: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(image, k, hole, polygon): the borders of what is above the threshold in each map, as pixels where they bend."""

    def run(batches):
        for batch in batches:
            for at, stack in _stacks(batch):
                of, hole, sizes, points = outlines_of(stack > threshold)
                place = pa.StructArray.from_arrays([pa.array(points[:, c].astype(float)) for c in (0, 1)], ["x", "y"])
                polygon = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), place)
                yield pa.RecordBatch.from_arrays([batch.column("image").take(pa.array(of + at)), pa.array(_numbered(of)), pa.array(hole), polygon], ["image", "k", "hole", "polygon"])

    kind = maps.schema["image"].dataType.simpleString()
    return maps.select("image", "height", "width", F.col("values").alias("cells")).mapInArrow(run, f"image {kind}, k int, hole boolean, polygon {POLYGON}")


def polygons_of(maps: np.ndarray, settings: Settings = Settings(unclip_ratio=2.0), matrix: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(map, score, polygon) of the borders of a stack of maps, in order: simplified at 0.002 of their length, scored, grown with round corners, in original pixels if a matrix for each map is given."""
    of, _, sizes, points = outlines_of(maps > settings.threshold)
    first = _numbered(of) <= settings.most_candidates
    points, of, sizes = points[np.repeat(first, sizes)].astype(float), of[first], sizes[first]
    points, sizes = simplified_rings(points, sizes, 0.002 * ring_lengths(points, sizes))
    keep = sizes > 3
    points, of, sizes = points[np.repeat(keep, sizes)], of[keep], sizes[keep]
    if not len(of):
        return of, np.zeros(0), []
    score = covered_means(points, sizes, of, maps)
    keep = ~(score < settings.box_threshold)
    points, of, sizes, score = points[np.repeat(keep, sizes)], of[keep], sizes[keep], score[keep]
    got = grown(points, sizes, settings.unclip_ratio)
    side = min_area_rects([np.zeros((0, 2)) if p is None else p for p in got])[1].min(axis=1, initial=np.inf)
    keep = np.array([p is not None for p in got], bool) & ~(side < settings.least_side + 2)
    of, score, got = of[keep], score[keep], [p for p, k in zip(got, keep.tolist(), strict=True) if k]
    if matrix is not None:
        many = np.array([len(p) for p in got], int)
        flat = np.concatenate([np.zeros((0, 2)), *got])
        q = (np.column_stack([flat, np.ones(len(flat))])[:, None, :] @ matrix.reshape(-1, 3, 3)[np.repeat(of, many)].transpose(0, 2, 1))[:, 0]
        got = np.split(q[:, :2] / q[:, 2:], np.cumsum(many)[:-1])
    return of, score, [np.rint(p) for p in got]


def detect_polygons(maps: DataFrame, settings: Settings = Settings(unclip_ratio=2.0)) -> DataFrame:
    """(image, k, score, polygon): polygons of any shape from each map, in the order of their borders.

    maps may have a column matrix (nine numbers by rows) from map to original pixels.
    """
    placed = "matrix" in maps.columns

    def run(batches):
        for batch in batches:
            for at, stack in _stacks(batch):
                matrix = np.array(batch.column("matrix").slice(at, len(stack)).to_pylist(), float) if placed else None
                of, score, polygons = polygons_of(stack, settings, matrix)
                yield pa.RecordBatch.from_arrays([batch.column("image").take(pa.array(of + at)), pa.array(_numbered(of)), pa.array(score), polygon_list(polygons)], ["image", "k", "score", "polygon"])

    kind = maps.schema["image"].dataType.simpleString()
    src = maps.select("image", "height", "width", F.col("values").alias("cells"), *(["matrix"] if placed else []))
    return src.mapInArrow(run, f"image {kind}, k int, score double, polygon {POLYGON}")


def ensemble(a: Column, b: Column, weight: float = 0.5) -> Column:
    """Weighted mean of two maps of one shape; different shapes are an error."""
    mixed = F.zip_with(a, b, lambda x, y: (weight * x + (1 - weight) * y).cast("float"))
    return F.when(F.size(a) == F.size(b), mixed).otherwise(F.raise_error(F.lit("maps of different shapes")).cast("array<float>"))


def resize(values: np.ndarray, h: int, w: int) -> np.ndarray:
    """Bilinear, pixel centres aligned."""
    y = np.clip((np.arange(h) + 0.5) * values.shape[0] / h - 0.5, 0, values.shape[0] - 1)
    x = np.clip((np.arange(w) + 0.5) * values.shape[1] / w - 0.5, 0, values.shape[1] - 1)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, values.shape[0] - 1), np.minimum(x0 + 1, values.shape[1] - 1)
    fy, fx = (y - y0)[:, None], (x - x0)[None, :]
    top = values[np.ix_(y0, x0)] * (1 - fx) + values[np.ix_(y0, x1)] * fx
    low = values[np.ix_(y1, x0)] * (1 - fx) + values[np.ix_(y1, x1)] * fx
    return top * (1 - fy) + low * fy


def fuse_scales(maps: list[np.ndarray], masks: list[np.ndarray]) -> np.ndarray:
    """Mask-weighted mean of maps brought to the first one's size; 0 where no mask covers."""
    h, w = maps[0].shape
    total, weight = np.zeros((h, w)), np.zeros((h, w))
    for v, m in zip(maps, masks, strict=True):
        k = resize(m.astype(float), h, w)
        total += resize(v, h, w) * k
        weight += k
    return np.where(weight > 0, total / np.maximum(weight, 1e-12), 0.0)


def fuse(maps: DataFrame) -> DataFrame:
    """(image, height, width, values): the maps of each image, in scales k, fused at the size of the least k.

    maps: image, k, height, width, values and mask (0 to 1: where the scale holds content). An image's
    maps meet in one task, which holds no more than them.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k")
        shape = [(int(h), int(w)) for h, w in zip(pdf["height"], pdf["width"], strict=True)]
        values, masks = ([np.asarray(v, float).reshape(s) for v, s in zip(pdf[c], shape, strict=True)] for c in ("cells", "mask"))
        out = fuse_scales(values, masks)
        return pd.DataFrame({"image": [pdf["image"].iloc[0]], "height": [out.shape[0]], "width": [out.shape[1]], "values": [out.ravel().tolist()]})

    kind = maps.schema["image"].dataType.simpleString()
    rows = maps.select("image", "k", "height", "width", F.col("values").alias("cells"), "mask")
    return rows.groupBy("image").applyInPandas(run, f"image {kind}, height int, width int, values array<double>")


def warp(values: np.ndarray, matrix: np.ndarray, h: int, w: int, nearest: bool = False) -> np.ndarray:
    """Values moved by a 3 x 3 matrix from their pixels to those of an h x w map; 0 where they don't reach."""
    y, x = np.mgrid[0:h, 0:w]
    sx, sy, sw = np.linalg.inv(matrix) @ np.stack([x.ravel(), y.ravel(), np.ones(h * w)])
    with np.errstate(divide="ignore", invalid="ignore"):
        sx, sy = sx / sw, sy / sw
    ok = np.isfinite(sx) & np.isfinite(sy) & (sx > -1) & (sy > -1) & (sx < values.shape[1]) & (sy < values.shape[0])
    out = np.zeros(h * w)
    padded = np.pad(values.astype(float), 1)
    sx, sy = sx[ok] + 1, sy[ok] + 1
    if nearest:
        out[ok] = padded[np.rint(sy).astype(int), np.rint(sx).astype(int)]
    else:
        x0, y0 = np.floor(sx).astype(int), np.floor(sy).astype(int)
        fx, fy = sx - x0, sy - y0
        top = padded[y0, x0] * (1 - fx) + padded[y0, x0 + 1] * fx
        low = padded[y0 + 1, x0] * (1 - fx) + padded[y0 + 1, x0 + 1] * fx
        out[ok] = top * (1 - fy) + low * fy
    return out.reshape(h, w)


def content_mask(h: int, w: int, matrix: np.ndarray, width: int, height: int) -> np.ndarray:
    """Where a map holds content: the original image's corners, brought into the map by the inverse of its matrix."""
    corners = np.array([[0, 0, 1], [width - 1, 0, 1], [width - 1, height - 1, 1], [0, height - 1, 1]], float) @ np.linalg.inv(matrix).T
    p = np.rint(np.clip(corners[:, :2] / corners[:, 2:], 0, (w - 1, h - 1)))
    mask = np.zeros((h, w))
    mask[covered_pixels(p, h, w)] = 1.0
    return mask


def align_scales(maps: list[np.ndarray], matrices: list[np.ndarray], width: int, height: int) -> np.ndarray:
    """Maps of an image in several scales, each with a matrix to original pixels, averaged in the first one's pixels where they hold content."""
    h, w = maps[0].shape
    total, weight = np.zeros((h, w)), np.zeros((h, w))
    for v, m in zip(maps, matrices, strict=True):
        to_base = np.linalg.inv(matrices[0]) @ m
        held = warp(content_mask(*v.shape, m, width, height), to_base, h, w, nearest=True)
        total += warp(v, to_base, h, w) * held
        weight += held
    return np.where(weight > 0, total / np.maximum(weight, 1e-12), 0.0)


def fuse_aligned(maps: DataFrame) -> DataFrame:
    """(image, height, width, values): align_scales() of each image's maps, in the pixels of the least k.

    maps: image, k, height, width, values, matrix (nine numbers by rows, map to original pixels),
    original_width and original_height. An image's maps meet in one task, which holds no more than them.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k")
        grids = [np.asarray(v, float).reshape(int(h), int(w)) for v, h, w in zip(pdf["cells"], pdf["height"], pdf["width"], strict=True)]
        matrices = [np.asarray(m, float).reshape(3, 3) for m in pdf["matrix"]]
        out = align_scales(grids, matrices, int(pdf["original_width"].iloc[0]), int(pdf["original_height"].iloc[0]))
        return pd.DataFrame({"image": [pdf["image"].iloc[0]], "height": [out.shape[0]], "width": [out.shape[1]], "values": [out.ravel().tolist()]})

    kind = maps.schema["image"].dataType.simpleString()
    rows = maps.select("image", "k", "height", "width", F.col("values").alias("cells"), "matrix", "original_width", "original_height")
    return rows.groupBy("image").applyInPandas(run, f"image {kind}, height int, width int, values array<double>")


def prediction_statistics(boxes: DataFrame) -> DataFrame:
    """Count and spread of scores and areas; boxes has score and area. Quantiles are exact, by ranges."""
    from .aggregate import quantiles_of

    q = quantiles_of(boxes, [], ["score", "area"], [0.5, 0.1])
    out = boxes.agg(F.count("*").alias("boxes"), F.avg("score").alias("score_mean"), F.min("score").alias("score_min")).join(q, F.lit(True), "left")
    return out.select("boxes", "score_mean", F.col("__q_score")[0].alias("score_median"), "score_min", F.col("__q_score")[1].alias("score_q10"), F.col("__q_area")[0].alias("area_median"), F.col("__q_area")[1].alias("area_q10"))
