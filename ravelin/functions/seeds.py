"""Seeds and seeded orders that any engine with crc32 and md5 can repeat."""

from __future__ import annotations

import zlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def seed_for(base: int, key: str) -> int:
    """A seed for a named part of a run."""
    return (base + zlib.crc32(key.encode())) % (2**31 - 1)


def seed_column(base: int, key: Column) -> Column:
    return F.pmod(F.lit(base).cast("long") + F.crc32(key.cast("binary")), F.lit(2**31 - 1))


def draw_key(seed: Column | int, *parts: Column) -> Column:
    """A sort key that looks random: md5 of seed and parts, joined by bars."""
    first = seed if isinstance(seed, Column) else F.lit(seed)
    return F.md5(F.concat_ws("|", first.cast("string"), *[p.cast("string") for p in parts]).cast("binary"))


def unit(key: Column) -> Column:
    """The first 32 bits of a draw key as a number in [0, 1)."""
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
