"""Bits of integer keys."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def bit_at(c: Column, position: int) -> Column:
    return F.getbit(c, F.lit(position)) == 1


def bit_mask(bits: int) -> int:
    return (1 << bits) - 1


def radix_bits(threads: int) -> int:
    """Bits of a radix partitioning: the natural logarithm of the threads, rounded up, 1 at least."""
    return max(1, math.ceil(math.log(threads)))


def radix_id(c: Column, bits: int) -> Column:
    """The key's low bits, as a partition number."""
    return c.bitwiseAND(F.lit(bit_mask(bits)))
