"""A bounded bit array that says which keys may be in a table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits for each key, at least 1 MB, and never more than 16 MB.
BITS_PER_KEY, LEAST_BITS, MOST_BITS = 32, 1 << 23, 1 << 27


def membership(keys: DataFrame, places: list[Column]) -> np.ndarray:
    """A bit array (of 32-bit words) with the given places, non-negative modulo its size, set for every row.

    Its size is bounded, the table need not be: with more keys than it was made
    for it lets more others pass, but never misses a key.
    """
    size = 1 << max(LEAST_BITS, min(MOST_BITS, keys.count() * BITS_PER_KEY)).bit_length() - 1
    place = keys.select(F.explode(F.array(*[F.pmod(p, F.lit(size)) for p in places])).alias("p"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("p", F.lit(32)).cast("int"))
    words = place.groupBy(F.shiftright("p", 5).alias("w")).agg(F.bit_or(bit).alias("v")).toPandas()
    bits = np.zeros(size >> 5, np.uint32)
    bits[words["w"].to_numpy(np.int64)] = words["v"].to_numpy(np.int64).astype(np.uint32)
    return bits


def may_hold(bits: np.ndarray, *places: np.ndarray) -> np.ndarray:
    """Which rows may be keys, by the same places."""
    found = np.ones(len(places[0]), bool)
    for place in places:
        p = place % (len(bits) << 5)
        found &= ((bits[p >> 5] >> (p & 31).astype(np.uint32)) & 1).astype(bool)
    return found
