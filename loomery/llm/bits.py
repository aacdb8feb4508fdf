"""Sets of hash buckets as bit maps of a fixed number of bits: what a scan may hold of any table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bit_map(buckets: DataFrame, bits: int) -> np.ndarray:
    """2**bits bits with those of the column ``bucket`` set, as 64-bit words; 2**bits / 8 bytes, whatever the table holds."""
    word = buckets.groupBy(F.shiftright("bucket", 6).cast("int").alias("word"))
    rows = word.agg(F.bit_or(F.expr("shiftleft(1L, cast(bucket & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(max(1, 1 << bits >> 6), np.uint64)
    out[rows["word"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return out


def holds(words: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    """Which of ``buckets`` are set."""
    return (words[buckets >> 6] >> (buckets & 63).astype(np.uint64)) & np.uint64(1) > 0
