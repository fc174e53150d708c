"""Pixel kernels on square gray images given as arrays: Arrow batches, whole batches at once in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _images(s: pd.Series, side: int) -> np.ndarray:
    return np.stack([np.asarray(x, dtype=np.float64).reshape(side, side) for x in s]) if len(s) else np.zeros((0, side, side))


def laplacian_variance(images: np.ndarray) -> np.ndarray:
    """Variance of the 4-neighbour Laplacian; the border is reflected without its edge."""
    p = np.pad(images, ((0, 0), (1, 1), (1, 1)), mode="reflect")
    return (p[:, :-2, 1:-1] + p[:, 2:, 1:-1] + p[:, 1:-1, :-2] + p[:, 1:-1, 2:] - 4 * images).var(axis=(1, 2))


def blur_scores(images: np.ndarray) -> np.ndarray:
    """The overall score, or mostly that of the centre half where it is more than twice the overall one."""
    side = images.shape[1]
    overall, centre = laplacian_variance(images), laplacian_variance(images[:, side // 4 : side - side // 4, side // 4 : side - side // 4])
    return np.where(centre > 2 * overall, 0.7 * centre + 0.3 * overall, overall)


def _gauss(images: np.ndarray, size: int = 11, sigma: float = 1.5) -> np.ndarray:
    x = np.arange(size) - size // 2
    k = np.exp(-(x**2) / (2 * sigma**2))
    k /= k.sum()
    for axis in (1, 2):
        pad = [(0, 0)] * 3
        pad[axis] = (size // 2, size // 2)
        p = np.pad(images, pad, mode="reflect")
        n = images.shape[axis]
        images = sum(w * np.take(p, range(j, j + n), axis=axis) for j, w in enumerate(k))
    return images


def ssim_scores(a: np.ndarray, b: np.ndarray, c1: float = 6.5025, c2: float = 58.5225) -> np.ndarray:
    """Mean structural similarity with a Gaussian window of 11 and sigma 1.5; borders are mirrored without their edge."""
    ma, mb = _gauss(a), _gauss(b)
    va, vb, ab = _gauss(a * a) - ma**2, _gauss(b * b) - mb**2, _gauss(a * b) - ma * mb
    return (((2 * ma * mb + c1) * (2 * ab + c2)) / ((ma**2 + mb**2 + c1) * (va + vb + c2))).mean(axis=(1, 2))


def resized(images: np.ndarray, side: int) -> np.ndarray:
    """Square images at another size, by bilinear interpolation between pixel centres."""
    n = images.shape[1]
    if n == side:
        return images
    at = np.clip((np.arange(side) + 0.5) * n / side - 0.5, 0, n - 1)
    low = np.floor(at).astype(int)
    high, share = np.minimum(low + 1, n - 1), at - low
    rows = images[:, low] * (1 - share)[None, :, None] + images[:, high] * share[None, :, None]
    return rows[:, :, low] * (1 - share) + rows[:, :, high] * share


def edge_densities(images: np.ndarray, low: float = 50, high: float = 150) -> np.ndarray:
    """Share of pixels on edges: 3 x 3 Sobel gradients, only ridges across their direction, kept where they are over ``high`` or hang on such a pixel through pixels over ``low``."""
    p = np.pad(images, ((0, 0), (1, 1), (1, 1)), mode="edge")
    at = lambda y, x: p[:, 1 + y : p.shape[1] - 1 + y, 1 + x : p.shape[2] - 1 + x]
    gx = at(-1, 1) + 2 * at(0, 1) + at(1, 1) - at(-1, -1) - 2 * at(0, -1) - at(1, -1)
    gy = at(1, -1) + 2 * at(1, 0) + at(1, 1) - at(-1, -1) - 2 * at(-1, 0) - at(-1, 1)
    size = np.abs(gx) + np.abs(gy)
    m = np.pad(size, ((0, 0), (1, 1), (1, 1)))
    by = lambda y, x: m[:, 1 + y : m.shape[1] - 1 + y, 1 + x : m.shape[2] - 1 + x]
    flat, steep = np.abs(gy) <= np.abs(gx) * 0.4142135623730951, np.abs(gy) >= np.abs(gx) * 2.414213562373095
    falling = gx * gy < 0
    first = np.select([flat, steep, falling], [by(0, -1), by(-1, 0), by(-1, 1)], by(-1, -1))
    second = np.select([flat, steep, falling], [by(0, 1), by(1, 0), by(1, -1)], by(1, 1))
    ridge = (size > low) & (size > first) & (size >= second)
    edges = ridge & (size > high)
    while True:
        q = np.pad(edges, ((0, 0), (1, 1), (1, 1)))
        grown = ridge & np.logical_or.reduce([q[:, 1 + y : q.shape[1] - 1 + y, 1 + x : q.shape[2] - 1 + x] for y in (-1, 0, 1) for x in (-1, 0, 1)])
        if (grown == edges).all():
            return edges.mean(axis=(1, 2))
        edges = grown


def hash_of_pixels(images: np.ndarray) -> np.ndarray:
    """64-bit perceptual hash of 32 x 32 gray images: the 8 x 8 low frequencies against their median without the first."""
    n = images.shape[1]
    k = np.arange(n)
    basis = np.sqrt(2 / n) * np.cos(np.pi * (2 * k[None, :] + 1) * k[:, None] / (2 * n))
    basis[0] /= np.sqrt(2)
    low = (basis @ images @ basis.T)[:, :8, :8].reshape(len(images), 64)
    bits = (low > np.median(low[:, 1:], axis=1, keepdims=True)).astype(np.uint64)
    return (bits << np.arange(63, -1, -1, dtype=np.uint64)).sum(axis=1, dtype=np.uint64).view(np.int64)


def blur(rows: DataFrame, column: str, side: int) -> DataFrame:
    @F.pandas_udf(T.DoubleType())
    def score(s: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in s:
            yield pd.Series(blur_scores(_images(x, side)))

    return rows.withColumn("blur", score(column)).drop(column)


def ssim(rows: DataFrame, a: str, b: str, side: int, other_side: int | None = None) -> DataFrame:
    """Similarity of the images in columns ``a`` and ``b``; where their sides differ, both at the smaller one."""
    least = min(side, other_side or side)

    @F.pandas_udf(T.DoubleType())
    def score(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(ssim_scores(resized(_images(x, side), least), resized(_images(y, other_side or side), least)))

    return rows.withColumn("ssim", score(a, b)).drop(a, b)


def edge_density(rows: DataFrame, column: str, side: int) -> DataFrame:
    @F.pandas_udf(T.DoubleType())
    def score(s: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in s:
            yield pd.Series(edge_densities(_images(x, side)))

    return rows.withColumn("edge_density", score(column)).drop(column)


def phash(rows: DataFrame, column: str, side: int) -> DataFrame:
    @F.pandas_udf(T.LongType())
    def score(s: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in s:
            yield pd.Series(hash_of_pixels(_images(x, side)))

    return rows.withColumn("hash", score(column)).drop(column)
