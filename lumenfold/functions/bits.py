"""64-bit hashes written in hex; the perceptual hash of a grey image."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Waves in each direction that a hash looks at.
WAVES = 8


def cosines(side: int) -> np.ndarray:
    """Rows: the first WAVES cosines over ``side`` places."""
    return np.cos(np.pi * np.outer(np.arange(WAVES), 2 * np.arange(side) + 1) / (2 * side))


def hashes(images: np.ndarray) -> list[str]:
    """Of each square image: its low waves by two matrix products, all images at once; a bit is set where a wave is above the median of the 64."""
    c = cosines(images.shape[1])
    low = (c @ images @ c.T).reshape(len(images), WAVES * WAVES)
    bits = low > np.median(low, axis=1, keepdims=True)
    return [row.tobytes().hex() for row in np.packbits(bits, axis=1)]


def _perceptual(images: pd.Series) -> pd.Series:
    found = pd.Series([None] * len(images), dtype=object)
    sizes = images.map(lambda x: -1 if x is None else len(x))
    for n in sizes.unique():
        side = int(round(max(n, 0) ** 0.5))
        if side >= WAVES and side * side == n:
            at = np.flatnonzero(sizes == n)
            x = np.stack(images.iloc[at]).astype(np.float64).reshape(len(at), side, side)
            good = np.isfinite(x).all(axis=(1, 2))
            found.iloc[at[good]] = hashes(x[good]) if good.any() else []
    return found


def perceptual_hash(image: Column) -> Column:
    """The hash of a grey image, an array of its rows' values one after the other: 16 hex digits, the lowest wave first.

    Null for what is no square of WAVES or more a side, and for what holds values that aren't finite. A change of brightness or
    contrast changes at most the first bit, as do copies of another size few.
    """
    return F.pandas_udf(_perceptual, "string")(image.cast("array<double>"))


def bits_of(hex16: Column) -> Column:
    """The 64 bits as a signed number; null for what is no hex of 64 bits."""
    good = hex16.rlike("^[0-9a-fA-F]{1,16}$")
    return F.when(good, F.conv(hex16, 16, -10).cast("bigint"))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def band(bits: Column, index: int, n_bands: int) -> Column:
    """One of ``n_bands`` parts of the 64 bits. Two values within n_bands - 1 bits share a part at least."""
    low, high = index * 64 // n_bands, (index + 1) * 64 // n_bands
    return F.shiftrightunsigned(bits, low).bitwiseAND(F.lit((1 << (high - low)) - 1))
