"""Filters of bounded size for sets of 64-bit hashes: two bits a hash, built by Spark, read by numpy.

What is in the set is always found; of what isn't, a small part is found too, and all of it once a
filter is overfull.  Callers must stay right, if slower, with such finds.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Least and most bytes of a filter, and the bits a hash that it is sized by.
LEAST_BYTES, MOST_BYTES, BITS = 1 << 20, 16 << 20, 24


def filter_bytes_for(n: int, most: int = MOST_BYTES) -> int:
    """A power of two between the limits for ``n`` hashes."""
    size = min(LEAST_BYTES, most)
    while size < most and 8 * size < BITS * n:
        size *= 2
    return size


def make_filter(hashes: DataFrame, filter_bytes: int) -> np.ndarray:
    """A bit set of ``filter_bytes`` (a power of two) for the column ``h``, put together from 64-bit cells."""
    bits = 8 * filter_bytes
    places = F.array(F.col("h").bitwiseAND(bits - 1), F.shiftrightunsigned("h", 32).bitwiseAND(bits - 1))
    cells = hashes.select(F.explode(places).alias("p")).select(F.shiftright("p", 6).alias("cell"), F.expr("shiftleft(1L, cast(p & 63 as int))").alias("bit")).groupBy("cell").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(filter_bytes // 8, np.int64)
    out[cells.column("cell").to_numpy()] = cells.column("bits").to_numpy()
    return out


def in_filter(cells: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of ``hashes`` a filter finds."""
    h, last = hashes.astype(np.uint64), np.uint64(64 * len(cells) - 1)
    found = np.ones(len(h), bool)
    for p in (h & last, (h >> np.uint64(32)) & last):
        found &= (cells[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63)).astype(np.int64)) & 1 > 0
    return found
