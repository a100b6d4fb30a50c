"""Seeded hashes that turn row keys into reproducible pseudo-random draws.

Draws depend only on the key and the seed, so a retried task repeats them and the
result does not depend on partitioning. ``portable=True`` uses md5, which other SQL
engines compute identically; the default uses the cheaper xxhash64.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HEX_DIGITS = 13
BITS = 4 * HEX_DIGITS
SCALE = float(2**BITS)


def hash_key(*parts: Column | str | int) -> Column:
    """Text key ``a|b|c`` of columns and literals."""
    cols = [p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.concat_ws("|", *cols)


def hash_bits(*parts: Column | str | int, portable: bool = False) -> Column:
    """52 pseudo-random bits as a BIGINT."""
    key = hash_key(*parts)
    if portable:
        return F.conv(F.substring(F.md5(key), 1, HEX_DIGITS), 16, 10).cast("bigint")
    return F.shiftrightunsigned(F.xxhash64(key), 64 - BITS)


def hash_unit(*parts: Column | str | int, portable: bool = False) -> Column:
    """Uniform double strictly between 0 and 1 (up to rounding at the upper end)."""
    return (hash_bits(*parts, portable=portable).cast("double") + F.lit(0.5)) / F.lit(SCALE)
