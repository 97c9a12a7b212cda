"""The most frequent keys of a counted table, as many as a fixed bound lets in."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def coarse(value: Column) -> Column:
    """The value with all but its eight highest bits cleared."""
    shift = F.greatest(F.length(F.bin(value)) - 8, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift)


def frequent(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, int, int, int]:
    """Of (key, c): keys and counts of the most frequent, by key; the least count among them; all keys; all counts.

    The least count is read off a histogram of counts (128 levels for each
    power of two), so that at most ``most`` rows reach the driver; no sort.
    """
    levels = counts.groupBy(coarse(F.col("c")).alias("level")).agg(F.count("*").alias("keys"), F.sum("c").alias("total")).collect()
    least, taken = 1 << 62, 0
    for r in sorted(levels, key=lambda r: -r["level"]):
        if taken + r["keys"] > most:
            break
        least, taken = r["level"], taken + r["keys"]
    rows = counts.filter(F.col("c") >= least).select("key", "c").toPandas()
    keys, n = rows["key"].to_numpy(np.int64).view(np.uint64), rows["c"].to_numpy(np.int64)
    order = np.argsort(keys)
    return keys[order], n[order], least, sum(r["keys"] for r in levels), sum(r["total"] for r in levels)
