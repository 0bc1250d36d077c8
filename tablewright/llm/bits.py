"""Bit tables: sets of 64-bit keys in a bounded number of bits, true for every member and for few others."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bits for each key, and bits of the largest table (16 MB).
BITS_EACH = 16
MOST_BITS = 1 << 27


@dataclass
class BitTable:
    """Two bits per key."""

    bits: np.ndarray

    def has(self, keys: np.ndarray) -> np.ndarray:
        last = np.uint64(len(self.bits) * 64 - 1)
        found = np.ones(len(keys), bool)
        for place in (keys & last, (keys >> np.uint64(32)) & last):
            found &= (self.bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1
        return found


def bit_table(rows: DataFrame, key: Column, most_bits: int = MOST_BITS) -> BitTable:
    """Table of a column of well-mixed longs. Its bits are set in Spark and gathered by 64-bit slots, of which there
    are at most ``most_bits`` / 64, whatever the number of rows."""
    entries = rows.count()
    n = 1 << min(max(1, entries * BITS_EACH - 1).bit_length(), most_bits.bit_length() - 1)
    n = max(n, 64)
    places = F.array(key.bitwiseAND(F.lit(n - 1)), F.shiftrightunsigned(key, 32).bitwiseAND(F.lit(n - 1)))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("place").bitwiseAND(F.lit(63)).cast("int"))
    slots = (
        rows.select(F.explode(places).alias("place")).groupBy(F.shiftright("place", 6).alias("slot")).agg(F.bit_or(bit).alias("bits")).toArrow()
    )
    bits = np.zeros(n // 64, np.uint64)
    bits[slots["slot"].to_numpy()] = slots["bits"].to_numpy().view(np.uint64)
    return BitTable(bits)
