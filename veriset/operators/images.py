"""Content digests, perceptual hashes and pixel similarity of image files."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriset.functions import vectors


def content_digests(files: DataFrame) -> DataFrame:
    """Replace the bytes of each file by their SHA-256."""
    return files.withColumn("digest", F.sha2("content", 256)).drop("content")


@lru_cache(maxsize=256)
def lanczos_weights(size: int, target: int) -> np.ndarray:
    """(target x size) matrix of a three-lobe Lanczos resampling with antialiasing."""
    scale = size / target
    support = 3.0 * max(scale, 1.0)
    weights = np.zeros((target, size))
    for row in range(target):
        centre = (row + 0.5) * scale
        first, last = max(int(centre - support + 0.5), 0), min(int(centre + support + 0.5), size)
        x = (np.arange(first, last) - centre + 0.5) / max(scale, 1.0)
        lobes = np.where(np.abs(x) < 3.0, np.sinc(x) * np.sinc(x / 3.0), 0.0)
        weights[row, first:last] = lobes / lobes.sum()
    return weights


def _to_bytes(values: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(values + 0.5), 0, 255)


def _resized(plane: np.ndarray, height: int, width: int) -> np.ndarray:
    across = _to_bytes(plane @ lanczos_weights(plane.shape[1], width).T)
    return _to_bytes(lanczos_weights(plane.shape[0], height) @ across)


def _pixels(image) -> np.ndarray:
    """Height x width x RGB of one row of the image source, which stores BGR(A) or grey bytes."""
    shape = (image["height"], image["width"], image["nChannels"])
    stored = np.frombuffer(image["data"], dtype=np.uint8).reshape(shape).astype(np.float64)
    return np.repeat(stored, 3, axis=2) if shape[2] == 1 else stored[:, :, [2, 1, 0]]


def _grey(rgb: np.ndarray) -> np.ndarray:
    return np.floor(rgb @ np.array([19595.0, 38470.0, 7471.0]) / 65536.0 + 0.5)


def grey_grids(images: DataFrame) -> DataFrame:
    """(path, grid): each image as the 8 x 9 grey grid that the difference hash compares."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            grids = [
                _resized(_grey(_pixels(image)), vectors.GRID_ROWS, vectors.GRID_COLUMNS).ravel() for image in batch["image"]
            ]
            yield pd.DataFrame({"path": batch["path"], "grid": grids})

    rows = images.select(F.col("image.origin").alias("path"), F.struct("image.height", "image.width", "image.nChannels", "image.data").alias("image"))
    return rows.mapInPandas(run, "path string, grid array<double>")


def dhashes(images: DataFrame) -> DataFrame:
    return grey_grids(images).select("path", vectors.dhash_from_grid(F.col("grid")).alias("fp"))


def standard_pixels(images: DataFrame, size: int = 256) -> DataFrame:
    """(path, rgb, grey): every image at one size, RGB in [0, 1] and its channel mean."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            # One image at a time: the output is much larger than the stored image.
            for path, image in zip(batch["path"], batch["image"], strict=True):
                planes = _pixels(image)
                scaled = np.stack([_resized(planes[:, :, c], size, size) for c in range(3)], axis=2) / 255.0
                yield pd.DataFrame({"path": [path], "rgb": [scaled.ravel()], "grey": [scaled.mean(axis=2).ravel()]})

    rows = images.select(F.col("image.origin").alias("path"), F.struct("image.height", "image.width", "image.nChannels", "image.data").alias("image"))
    return rows.mapInPandas(run, "path string, rgb array<double>, grey array<double>")


def paired_pixels(images: DataFrame, pairs: DataFrame, size: int = 256) -> DataFrame:
    """Pixels of the images that (path_a, path_b) pairs name; the others are not decoded."""
    wanted = pairs.select(F.explode(F.array("path_a", "path_b")).alias("path")).distinct()
    return standard_pixels(images.join(wanted, F.col("image.origin") == F.col("path"), "left_semi"), size)


def pixel_similarity(pairs: DataFrame, pixels: DataFrame) -> DataFrame:
    """Add mean absolute RGB error and guarded grey correlation to (path_a, path_b) pairs."""
    for side in "ab":
        own = pixels.select(
            F.col("path").alias(f"path_{side}"), F.col("rgb").alias(f"rgb_{side}"), F.col("grey").alias(f"grey_{side}")
        )
        pairs = pairs.join(own, f"path_{side}")
    return (
        pairs.withColumn("rgb_mae", vectors.mean_absolute_error(F.col("rgb_a"), F.col("rgb_b")))
        .withColumn("gray_pixel_correlation", vectors.guarded_correlation(F.col("grey_a"), F.col("grey_b")))
        .drop("rgb_a", "rgb_b", "grey_a", "grey_b")
    )
