"""Perceptual hash and pixel statistics of decoded images (the columns of the `image` source)."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType

from lumenary.functions.vector import IMAGE_DIM, PHASH_BITS

# Sizes of the hash grid and of the two working copies, and bins per histogram.
HASH_SIDE, HASH_LOW = 32, 8
COLOUR_SIDE, GRAY_SIDE = 128, 64
COLOUR_BINS, GRAY_BINS = 8, 16


def _lanczos(x: np.ndarray) -> np.ndarray:
    return np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0.0)


def _cubic(x: np.ndarray) -> np.ndarray:
    x = np.abs(x)
    near = (1.5 * x - 2.5) * x * x + 1
    far = ((-0.5 * x + 2.5) * x - 4) * x + 2
    return np.where(x < 1, near, np.where(x < 2, far, 0.0))


@lru_cache(maxsize=512)
def _resampling(source: int, target: int, kind: str) -> np.ndarray:
    """Row-stochastic (target x source) matrix; the kernel widens when the image shrinks."""
    scale = source / target
    width = max(scale, 1.0)
    centre = (np.arange(target) + 0.5) * scale
    offset = (np.arange(source) + 0.5 - centre[:, None]) / width
    weights = _lanczos(offset) if kind == "lanczos" else _cubic(offset)
    return weights / weights.sum(axis=1, keepdims=True)


def _resize(channel: np.ndarray, side: int, kind: str) -> np.ndarray:
    rows = _resampling(channel.shape[0], side, kind)
    cols = _resampling(channel.shape[1], side, kind)
    return np.clip(np.rint(rows @ channel @ cols.T), 0, 255)


def _pixels(height, width, channels, data) -> np.ndarray | None:
    """RGB planes as floats, or None when the record does not hold a whole image."""
    if not height or not width or height < 0 or width < 0 or data is None or channels not in (1, 3, 4):
        return None
    flat = np.frombuffer(data, dtype=np.uint8)
    if flat.size < height * width * channels:
        return None
    planes = flat[: height * width * channels].reshape(height, width, channels).astype(float)
    if channels == 1:
        return np.repeat(planes, 3, axis=2)
    return planes[:, :, 2::-1]  # the image source stores blue first


def _gray(rgb: np.ndarray) -> np.ndarray:
    return np.floor((rgb @ np.array([19595.0, 38470.0, 7471.0]) + 32768) / 65536)


@lru_cache(maxsize=4)
def _cosine_basis(n: int) -> np.ndarray:
    k = np.arange(n)[:, None]
    return 2 * np.cos(np.pi * k * (2 * np.arange(n) + 1) / (2 * n))


def _hash(rgb: np.ndarray) -> str:
    small = _resize(_gray(rgb), HASH_SIDE, "lanczos")
    basis = _cosine_basis(HASH_SIDE)
    low = (basis @ small @ basis.T)[:HASH_LOW, :HASH_LOW]
    bits = (low > np.median(low)).ravel()
    return f"{int(''.join('1' if b else '0' for b in bits), 2):0{PHASH_BITS // 4}x}"


def _histogram(values: np.ndarray, bins: int) -> np.ndarray:
    return np.histogram(values, bins=bins, range=(0, 1), density=True)[0]


def _statistics(rgb: np.ndarray, phash: str | None) -> np.ndarray:
    colour = np.stack([_resize(rgb[:, :, i], COLOUR_SIDE, "cubic") for i in range(3)], axis=2) / 255
    gray = _resize(_gray(rgb), GRAY_SIDE, "cubic") / 255
    bits = np.zeros(PHASH_BITS)
    if phash:
        number = int(phash, 16)
        bits = np.array([1.0 if number >> (PHASH_BITS - 1 - i) & 1 else -1.0 for i in range(PHASH_BITS)])
    parts = [_histogram(colour[:, :, i], COLOUR_BINS) for i in range(3)]
    parts += [_histogram(gray, GRAY_BINS), colour.mean(axis=(0, 1)), colour.std(axis=(0, 1))]
    parts += [[np.abs(np.diff(gray, axis=0)).mean(), np.abs(np.diff(gray, axis=1)).mean()], bits]
    vector = np.concatenate(parts)
    size = np.linalg.norm(vector)
    return vector / size if size else vector


def _rows(*columns: pa.Array):
    return zip(*[c.to_pylist() for c in columns])


@F.arrow_udf(StringType())
def _hash_batch(height: pa.Array, width: pa.Array, channels: pa.Array, data: pa.Array) -> pa.Array:
    found = (_pixels(*r) for r in _rows(height, width, channels, data))
    return pa.array([None if rgb is None else _hash(rgb) for rgb in found], pa.string())


@F.arrow_udf(ArrayType(DoubleType()))
def _statistics_batch(height: pa.Array, width: pa.Array, channels: pa.Array, data: pa.Array, phash: pa.Array) -> pa.Array:
    out = []
    for *image, key in _rows(height, width, channels, data, phash):
        rgb = _pixels(*image)
        out.append(np.zeros(IMAGE_DIM) if rgb is None else _statistics(rgb, key))
    return pa.array(out, pa.list_(pa.float64()))


def _parts(image: str) -> list[Column]:
    return [F.col(f"{image}.{x}") for x in ("height", "width", "nChannels", "data")]


def phash_images(images: DataFrame, image: str = "image") -> DataFrame:
    """Adds `phash`: 16 hex digits, null for an unreadable image."""
    return images.withColumn("phash", _hash_batch(*_parts(image)))


def image_features(images: DataFrame, image: str = "image") -> DataFrame:
    """Adds `features`: 112 entries (histograms, means, deviations, edges, hash bits), zero if unreadable."""
    return images.withColumn("features", _statistics_batch(*_parts(image), F.col("phash")))


def image_meta(images: DataFrame, image: str = "image") -> DataFrame:
    """Adds width, height and pixels; unreadable images are left out."""
    width, height = F.col(f"{image}.width"), F.col(f"{image}.height")
    return images.filter((width > 0) & (height > 0)).withColumns(
        {"width": width, "height": height, "pixels": width.cast("long") * height}
    )
