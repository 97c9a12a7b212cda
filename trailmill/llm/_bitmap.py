"""Bitmaps of hashes, of a size that does not depend on the data."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bitmap(hashes: DataFrame, size: int) -> np.ndarray:
    """A bitmap of ``size`` bits (a power of two) with those of a column of hashes set; size / 64 rows reach the driver at most."""
    spot = F.pmod(F.col("hash"), F.lit(size))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (spot % 64).cast("int"))
    words = hashes.groupBy(F.floor(spot / 64).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    packed = np.zeros(size // 64, np.int64)
    packed[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return np.unpackbits(packed.view(np.uint8), bitorder="little").view(bool)
