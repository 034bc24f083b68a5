"""Image quality features and perceptual hashes of decoded pixels.

An image is a row of key, height, width and pixels: bytes of a row-major RGB (3 channels) or gray
(1 channel) array. Each is looked at on its own in one Arrow pass.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .probability_maps import label_regions, resize

FEATURES = ("brightness", "contrast", "blur_laplacian", "edge_density", "entropy", "saturation", "dark_fraction", "bright_fraction")


def gray_of(pixels: np.ndarray) -> np.ndarray:
    """Luma of an RGB array, rounded; a gray array as it is."""
    return pixels[..., 0].astype(float) if pixels.shape[-1] == 1 else np.rint(pixels[..., :3] @ np.array([0.299, 0.587, 0.114]))


def _shifted(x: np.ndarray, dy: int, dx: int) -> np.ndarray:
    p = np.pad(x, 1, mode="reflect") if min(x.shape) > 1 else np.pad(x, 1, mode="edge")
    return p[1 + dy : x.shape[0] + 1 + dy, 1 + dx : x.shape[1] + 1 + dx]


def edges_of(gray: np.ndarray, low: float = 100.0, high: float = 200.0) -> np.ndarray:
    """Edge pixels: gradient maxima above low that connect to one above high."""
    s = lambda a, b: _shifted(gray, a, b)
    gx = s(-1, 1) + 2 * s(0, 1) + s(1, 1) - s(-1, -1) - 2 * s(0, -1) - s(1, -1)
    gy = s(1, -1) + 2 * s(1, 0) + s(1, 1) - s(-1, -1) - 2 * s(-1, 0) - s(-1, 1)
    size = np.abs(gx) + np.abs(gy)
    way = np.round(np.arctan2(gy, gx) / (np.pi / 4)).astype(int) % 4
    steps = {0: (0, 1), 1: (1, 1), 2: (1, 0), 3: (1, -1)}
    peak = np.zeros(gray.shape, bool)
    for k, (dy, dx) in steps.items():
        peak |= (way == k) & (size > _shifted(size, -dy, -dx)) & (size >= _shifted(size, dy, dx))
    weak = peak & (size > low)
    if not weak.any():
        return weak
    labels = label_regions(weak)
    strong = np.unique(labels[weak & (size > high)])
    return weak & np.isin(labels, strong)


def shrink(values: np.ndarray, h: int, w: int) -> np.ndarray:
    """Means over the area that each pixel of the smaller image covers; pixels on a border count by share."""

    def weights(n: int, to: int) -> np.ndarray:
        edges = np.arange(to + 1) * n / to
        over = np.minimum(edges[1:, None], np.arange(1, n + 1)[None, :]) - np.maximum(edges[:-1, None], np.arange(n)[None, :])
        return np.maximum(over, 0) * to / n

    return weights(values.shape[0], h) @ values @ weights(values.shape[1], w).T


def gray_vector(gray: np.ndarray, side: int = 128) -> np.ndarray:
    """A square gray image as a vector, to correlate images of any size."""
    return resized(gray, side, side).ravel().astype(np.float32)


def resized(values: np.ndarray, h: int, w: int) -> np.ndarray:
    """Shrunk by area; a side that grows is interpolated."""
    small = shrink(values, min(h, values.shape[0]), min(w, values.shape[1]))
    return small if small.shape == (h, w) else resize(small, h, w)


def features_of(pixels: np.ndarray, longest: int = 512) -> dict[str, float]:
    """Features of an image, its longer side shrunk to longest; brightness, contrast and saturation from 0 to 1."""
    h, w = pixels.shape[:2]
    if max(h, w) > longest:
        scale = longest / max(h, w)
        pixels = np.rint(np.stack([shrink(pixels[..., c].astype(float), max(1, round(h * scale)), max(1, round(w * scale))) for c in range(pixels.shape[-1])], axis=-1))
    gray = gray_of(pixels)
    laplacian = sum(_shifted(gray, *d) for d in ((0, 1), (0, -1), (1, 0), (-1, 0))) - 4 * gray
    p = np.bincount(np.clip(np.rint(gray), 0, 255).astype(int).ravel(), minlength=256) / gray.size
    p = p[p > 0]
    top = pixels.max(axis=-1).astype(float)
    return {
        "brightness": float(gray.mean() / 255), "contrast": float(gray.std() / 255), "blur_laplacian": float(laplacian.var()), "edge_density": float(edges_of(gray).mean()), "entropy": float(-(p * np.log2(p)).sum()),
        "saturation": float(np.where(top > 0, (top - pixels.min(axis=-1)) / np.maximum(top, 1), 0).mean()), "dark_fraction": float((gray < 64).mean()), "bright_fraction": float((gray > 224).mean()),
    }


def perceptual_hash(gray: np.ndarray) -> int:
    """64 bits as a signed long: which low frequencies of the 32 x 32 image are above their median."""
    n = 32
    small = resized(gray, n, n)
    k = np.arange(n)
    basis = np.sqrt(2 / n) * np.cos(np.pi * (2 * k[None, :] + 1) * k[:, None] / (2 * n))
    basis[0] /= np.sqrt(2)
    low = (basis @ small @ basis.T)[:8, :8].ravel()
    bits = (low > np.median(low)).astype(np.uint8)
    return int(np.packbits(bits).view(">i8")[0])


def describe(images: DataFrame, key: str = "filename") -> DataFrame:
    """Quality features and phash of each image; an image that can't be read has read_error and nulls."""

    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                try:
                    x = np.frombuffer(r.pixels, np.uint8).reshape(r.height, r.width, -1)
                    rows.append((r.key, False, *features_of(x).values(), perceptual_hash(gray_of(x))))
                except (ValueError, TypeError):
                    rows.append((r.key, True, *[None] * (len(FEATURES) + 1)))
            out = pd.DataFrame(rows, columns=["key", "read_error", *FEATURES, "phash"])
            yield out.astype({"phash": "Int64"}).rename(columns={"key": key})

    src = images.select(images[key].alias("key"), "height", "width", "pixels")
    return src.mapInPandas(run, f"{key} {images.schema[key].dataType.simpleString()}, read_error boolean, {', '.join(f'{f} double' for f in FEATURES)}, phash long")


def upright(pixels: np.ndarray, orientation: int) -> np.ndarray:
    """Pixels as they are shown, by their EXIF orientation."""
    if orientation in (5, 6, 7, 8):
        pixels = pixels.swapaxes(0, 1)
    if orientation in (3, 4, 7, 8):
        pixels = pixels[::-1]
    return pixels[:, ::-1] if orientation in (2, 3, 6, 7) else pixels


def fingerprints(files: DataFrame, side: int = 128) -> DataFrame:
    """Of each row of read_images(), in one pass: size as shown, quality features, phash and the gray vector of side x side.

    A file without pixels has read_error and nulls; it never fails the others.
    """

    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                try:
                    x = np.frombuffer(r.pixels, np.uint8).reshape(int(r.height), int(r.width), -1)
                    x = upright(x[..., 2::-1] if x.shape[-1] > 1 else x, int(r.orientation))
                    gray = gray_of(x)
                    rows.append((*r[:4], False, x.shape[1], x.shape[0], *features_of(x).values(), perceptual_hash(gray), gray_vector(gray, side)))
                except (ValueError, TypeError):
                    rows.append((*r[:4], True, *[None] * (len(FEATURES) + 4)))
            out = pd.DataFrame(rows, columns=["path", "filename", "bytes", "sha256", "read_error", "width", "height", *FEATURES, "phash", "gray"])
            yield out.astype({"phash": "Int64", "width": "Int32", "height": "Int32"})

    src = files.select("path", "filename", "bytes", "sha256", "height", "width", "pixels", "orientation")
    return src.mapInPandas(run, f"path string, filename string, bytes long, sha256 string, read_error boolean, width int, height int, {', '.join(f'{f} double' for f in FEATURES)}, phash long, gray array<float>")


def split_errors(described: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Readable rows and failed ones."""
    return described.where("not read_error"), described.where("read_error")
