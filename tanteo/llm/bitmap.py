"""A set of hashes as a bitmap of a bounded size: what it does not have is not in the set."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits for each hash, and the most bits of all (128 MB). Where the set is larger, more other hashes are found as well.
BITS_EACH, MAX_BITS = 16, 1 << 30
_ROW = 1 << 15


def bitmap_of(hashes: DataFrame, column: str) -> np.ndarray:
    """The bitmap of a column of 64-bit hashes; ``hashes`` is counted, then read. Only the bitmap comes to the driver."""
    bits, wanted = _ROW, BITS_EACH * hashes.count()
    while bits < min(wanted, MAX_BITS):
        bits *= 2
    place = F.col(column).bitwiseAND(F.lit(bits - 1)).alias("place")
    parts = hashes.select(place).groupBy(F.shiftright("place", 15).alias("row")).agg(
        F.bitmap_construct_agg(F.col("place").bitwiseAND(F.lit(_ROW - 1))).alias("bitmap"))
    out = np.zeros((bits // _ROW, _ROW // 8), np.uint8)
    for row, bitmap in parts.toLocalIterator():
        out[row] = np.frombuffer(bitmap, np.uint8)
    return out.ravel()


def has(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = hashes.astype(np.uint64) & np.uint64(len(bitmap) * 8 - 1)
    return (bitmap[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
