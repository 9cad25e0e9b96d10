"""Image features from decoded pixels, as one Arrow-batched function."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Luma weights, working sizes and the scale of the sharpness score.
LUMA = (0.2126, 0.7152, 0.0722)
SCORE_SIDE = 128
HASH_WIDTH, HASH_HEIGHT = 9, 8
SHARPNESS_SCALE = 1_000_000.0
# Luma below and above which a pixel counts as too dark and too bright.
DARK_LUMA, BRIGHT_LUMA = 0.18, 0.92

FEATURES = T.StructType(
    [
        T.StructField("dhash_hex", T.StringType()),
        T.StructField("quality_score", T.DoubleType()),
        T.StructField("brightness", T.DoubleType()),
        T.StructField("color_variance", T.DoubleType()),
        T.StructField("exposure", T.DoubleType()),
    ]
)


def _shares(source: int, target: int) -> np.ndarray:
    """How many ``1/target`` parts of each source cell fall into each target cell."""
    start = np.arange(target)[:, None] * source
    cell = np.arange(source)[None, :] * target
    return np.clip(np.minimum(start + source, cell + target) - np.maximum(start, cell), 0, None).astype(float)


def area_resize(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """Area average of an (h, w, c) byte image, rounded half up.

    All products are whole numbers far below 2**53, so the floating-point sums are exact. Rows are
    taken a strip at a time, so a large image is never widened as a whole.
    """
    h, w, c = pixels.shape
    by_row = _shares(h, height)
    strips = np.empty((height, w * c))
    for y in range(height):
        used = np.flatnonzero(by_row[y])
        rows = pixels[used[0] : used[-1] + 1].reshape(len(used), w * c).astype(float)
        strips[y] = by_row[y, used] @ rows
    total = np.einsum("xw,ywc->yxc", _shares(w, width), strips.reshape(height, w, c), optimize=True)
    return np.floor(total / (h * w) + 0.5)


def rgb_of(height: int, width: int, channels: int, data: bytes) -> np.ndarray:
    """Bytes of Spark's image source (grey, BGR or BGRA, rows from the top) as RGB."""
    raw = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return np.repeat(raw, 3, axis=2) if channels == 1 else raw[:, :, 2::-1]


def luma(rgb: np.ndarray) -> np.ndarray:
    return rgb @ np.array(LUMA)


def dhash_hex(rgb: np.ndarray) -> str:
    """Signs of horizontal differences of the 9 by 8 grey image, row by row from the highest bit."""
    grey = np.floor(luma(area_resize(rgb, HASH_HEIGHT, HASH_WIDTH)) + 0.5)
    bits = (grey[:, :-1] < grey[:, 1:]).ravel()
    return np.packbits(bits).tobytes().hex()


def quality(rgb: np.ndarray) -> tuple[float, float, float, float]:
    """Variance of the Laplacian, mean luma in 0..1, mean variance of the three channels, and
    exposure: the share of the luma histogram between too dark and too bright."""
    small = area_resize(rgb, SCORE_SIDE, SCORE_SIDE)
    grey = luma(small) / 255.0
    inner = grey[1:-1, 1:-1]
    lap = grey[:-2, 1:-1] + grey[2:, 1:-1] + grey[1:-1, :-2] + grey[1:-1, 2:] - 4 * inner
    exposed = (grey >= DARK_LUMA) & (grey <= BRIGHT_LUMA)
    return (
        float(lap.var() * SHARPNESS_SCALE),
        float(grey.mean()),
        float(small.var(axis=(0, 1)).mean()),
        float(exposed.mean()),
    )


def _features_of(height, width, channels, data) -> tuple:
    if data is None or height is None or min(height, width) <= 0:
        return (None,) * 5
    rgb = rgb_of(int(height), int(width), int(channels), data)
    return (dhash_hex(rgb), *quality(rgb))


@F.pandas_udf(FEATURES)
def image_features(height: pd.Series, width: pd.Series, channels: pd.Series, data: pd.Series) -> pd.DataFrame:
    """Hash and scores of each image; all of them null when there are no pixels."""
    rows = [_features_of(*row) for row in zip(height, width, channels, data)]
    return pd.DataFrame(rows, columns=FEATURES.names)
