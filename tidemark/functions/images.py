"""Perceptual hashes of grey images that stand in rows as arrays of pixels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Low frequencies a side, so 64 bits; the side to which views are scaled; the least side of a view.
LOW, SCALED, LEAST = 8, 32, 16


def cosines(side: int) -> np.ndarray:
    """The lowest ``LOW`` rows of the cosine transform of ``side`` samples."""
    return np.cos(np.pi * np.arange(LOW)[:, None] * (2 * np.arange(side)[None] + 1) / (2 * side))


def hash_bits(grids: np.ndarray) -> np.ndarray:
    """Signed 64-bit hashes of n square images: a bit for each low frequency above the median of all but the mean, row by row."""
    c = cosines(grids.shape[1])
    low = (c @ grids @ c.T).reshape(len(grids), LOW * LOW)
    bits = low > np.median(low[:, 1:], axis=1, keepdims=True)
    return np.packbits(bits, axis=1).view(">i8").reshape(-1).astype(np.int64)


def scaled(grid: np.ndarray, side: int = SCALED) -> np.ndarray:
    """An image as ``side`` x ``side`` means of the areas that each pixel covers."""

    def weights(n: int) -> np.ndarray:
        edge = np.arange(side + 1) * n / side
        overlap = np.minimum(edge[1:, None], np.arange(1, n + 1)) - np.maximum(edge[:-1, None], np.arange(n))
        return np.maximum(overlap, 0) * side / n

    return weights(grid.shape[0]) @ grid @ weights(grid.shape[1]).T


def phash(pixels: Column, side: int) -> Column:
    """Hash of a ``side`` x ``side`` image, given row by row; null if it has another size or a value that is null or not finite."""

    def run(x: pd.Series) -> pd.Series:
        out = pd.array([None] * len(x), "Int64")
        good = [i for i, v in enumerate(x) if v is not None and len(v) == side * side and np.isfinite(np.asarray(v, float)).all()]
        if good:
            grids = np.stack([np.asarray(x.iloc[i], float) for i in good]).reshape(-1, side, side)
            out[good] = hash_bits(grids)
        return pd.Series(out)

    return F.pandas_udf(run, "long")(pixels)


def views(grid: np.ndarray) -> dict[str, np.ndarray]:
    """The parts of an image that survive usual reposts: whole, without a tenth or a fifth of each side, without the lowest 13 %, and the
    middle square; parts with a side under LEAST are left out, but for the whole."""
    h, w = grid.shape
    out = {"full": grid}
    for name, cut in (("center", 0.1), ("center60", 0.2)):
        dy, dx = int(h * cut), int(w * cut)
        out[name] = grid[dy : h - dy, dx : w - dx]
    side = min(h, w)
    top, left = (h - side) // 2, (w - side) // 2
    out |= {"top87": grid[: int(h * 0.87)], "square": grid[top : top + side, left : left + side]}
    return {k: v for k, v in out.items() if k == "full" or min(v.shape) >= LEAST}


def view_hashes(pixels: Column, width: Column) -> Column:
    """Map of the names of an image's views to their hashes, each view scaled to the same size; null if the pixels don't fill rows of ``width``."""

    def one(v, w) -> dict[str, int] | None:
        if v is None or w is None or w != w or w < 1 or not len(v) or len(v) % int(w) or not np.isfinite(own := np.asarray(v, float)).all():
            return None
        return {k: int(hash_bits(scaled(x)[None])[0]) for k, x in views(own.reshape(-1, int(w))).items()}

    def run(p: pd.Series, w: pd.Series) -> pd.Series:
        return pd.Series([one(*x) for x in zip(p, w, strict=True)], dtype=object)

    return F.pandas_udf(run, "map<string,long>")(pixels, width)
