"""Pixel work: Spark moves the images, small NumPy helpers look at one image at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from loomframe.functions.vectors import doubles

# Grey weights for blue, green, red and the two 3 x 3 kernels.
GREY_WEIGHTS = (0.114, 0.587, 0.299)
LAPLACIAN = ((0, 1, 0), (1, -4, 1), (0, 1, 0))
SHARPEN = ((0, -1, 0), (-1, 5, -1), (0, -1, 0))


def pixels(row) -> np.ndarray:
    """Height x width x channels bytes of an image row."""
    return np.frombuffer(row.data, np.uint8).reshape(row.height, row.width, row.channels)


def to_grey(image: np.ndarray) -> np.ndarray:
    if image.shape[2] == 1:
        return image[:, :, 0]
    return np.rint(image[:, :, :3] @ np.array(GREY_WEIGHTS)).astype(np.uint8)


def filter3(image: np.ndarray, kernel) -> np.ndarray:
    """3 x 3 filter with mirrored borders (the edge itself is not repeated)."""
    padded = np.pad(image.astype(np.float64), 1, mode="reflect")
    h, w = image.shape
    return sum(kernel[i][j] * padded[i : i + h, j : j + w] for i in range(3) for j in range(3))


def _area_weights(old: int, new: int) -> np.ndarray:
    """Share of each old cell in each new cell."""
    edges = np.linspace(0, old, new + 1)
    cells = np.arange(old)
    overlap = np.minimum(edges[1:, None], cells + 1) - np.maximum(edges[:-1, None], cells)
    return np.clip(overlap, 0, None) / (old / new)


def area_means(image: np.ndarray, height: int, width: int) -> np.ndarray:
    return _area_weights(image.shape[0], height) @ image @ _area_weights(image.shape[1], width).T


def _per_image(df: DataFrame, fn: Callable, schema: str, keep: list[str]) -> DataFrame:
    """Apply ``fn(pixels, row) -> dict`` to every image of every batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [{**{k: getattr(r, k) for k in keep}, **fn(pixels(r), r)} for r in batch.itertuples(index=False)]
            if rows:
                yield pd.DataFrame(rows)

    return df.mapInPandas(run, schema)


def block_fingerprints(df: DataFrame, key: str, key_type: str, blocks: int = 16) -> DataFrame:
    """(key, fingerprint): block means against their median, as hex (Yang, Gu and Niu, 2006)."""

    def one(image: np.ndarray, _row) -> dict:
        means = area_means(to_grey(image).astype(np.float64), blocks, blocks).ravel()
        return {"fingerprint": np.packbits(means >= np.median(means)).tobytes().hex()}

    return _per_image(df, one, f"{key} {key_type}, fingerprint string", [key])


def sharpness(df: DataFrame, key: str, key_type: str, cut: float = 100.0) -> DataFrame:
    """(key, variance, is_blurred): variance of the Laplacian, blurred up to the cut."""

    def one(image: np.ndarray, _row) -> dict:
        variance = float(filter3(to_grey(image), LAPLACIAN).var())
        return {"variance": variance, "is_blurred": variance <= cut}

    return _per_image(df, one, f"{key} {key_type}, variance double, is_blurred boolean", [key])


def normalized_images(
    df: DataFrame, key: str, key_type: str, height: int, width: int, sharpen: bool = True, flip: str | None = None
) -> DataFrame:
    """(key, values): grey, flipped where the boolean column ``flip`` says so, resized, sharpened, scaled to 0..1."""

    def one(image: np.ndarray, row) -> dict:
        grey = to_grey(image)
        if flip is not None and getattr(row, flip):
            grey = grey[:, ::-1]
        small = np.rint(area_means(grey.astype(np.float64), height, width))
        if sharpen:
            small = np.clip(filter3(small, SHARPEN), 0, 255)
        return {"values": (small / 255.0).astype(np.float32).ravel().tolist()}

    return _per_image(df, one, f"{key} {key_type}, values array<float>", [key])


def vector_images(df: DataFrame, key: str, vector: str, side: int) -> DataFrame:
    """(key, height, width, channels, data): a vector of side * side numbers drawn as a grey image."""
    cells = F.transform(doubles(vector), lambda v: F.lpad(F.hex(_byte(v)), 2, "0"))
    return df.select(
        key,
        F.lit(side).alias("height"),
        F.lit(side).alias("width"),
        F.lit(1).alias("channels"),
        F.unhex(F.array_join(cells, "")).alias("data"),
    )


def _byte(v: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(255), F.floor(v * 100) + 128)).cast("int")
