"""MinHash signatures of k-mers, to deal them into buckets.

The mixers wrap at 64 bits, which Spark's checked arithmetic doesn't, so they run in Arrow batches of NumPy integers.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql.functions import pandas_udf

# The mixers' multipliers and shift, and the odd constant that joins the two minima.
FIRST_MIX = (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)
SECOND_MIX = (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F)
SHIFT = 33
JOIN = 0x9E3779B97F4A7C15


def mix(x: np.ndarray, multipliers: tuple[int, int]) -> np.ndarray:
    shift = np.uint64(SHIFT)
    for m in multipliers:
        x = (x ^ (x >> shift)) * np.uint64(m)
    return x ^ (x >> shift)


def signatures(kmers: np.ndarray, k: int, w: int) -> np.ndarray:
    """Of all words of w bases of each k-mer, the least first mix joined with the least second mix."""
    if k < w:
        raise ValueError("k must be at least w")
    kmers = kmers.astype(np.uint64)
    keep = np.uint64((1 << 2 * w) - 1)
    words = [(kmers >> np.uint64(2 * i)) & keep for i in range(k - w + 1)]
    low = [np.minimum.reduce([mix(x, m) for x in words]) for m in (FIRST_MIX, SECOND_MIX)]
    return low[0] ^ (low[1] * np.uint64(JOIN))


def bucket_of(k: int, w: int, buckets: int):
    """A column function: the bucket, 0 to ``buckets`` - 1, of each k-mer."""
    if k < w:
        raise ValueError("k must be at least w")

    @pandas_udf("int")
    def bucket(kmers: pd.Series) -> pd.Series:
        return pd.Series((signatures(kmers.to_numpy(np.int64), k, w) % np.uint64(buckets)).astype(np.int32))

    return bucket
