"""Rounding, confidence and hash-based numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(value: Column, digits: int = 6) -> Column:
    """Half-up rounding without negative zero."""
    return F.round(value, digits) + F.lit(0.0)


def confidence_pct(probability: Column) -> Column:
    """Percent to two decimals, ties to the even neighbour."""
    return F.rint(probability * 100 * 100) / 100


def seeded_hash(seed: int, *keys: Column) -> Column:
    """md5 of ``seed:key:key``; the only source of "random" picks, so a rerun repeats them."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys]))


def hash_int(digest: Column, start: int = 1) -> Column:
    """Eight hex digits of a digest as a BIGINT."""
    return F.conv(F.substring(digest, start, 8), 16, 10).cast("bigint")


def unit_interval(digest: Column, start: int = 1) -> Column:
    return hash_int(digest, start) / F.lit(float(1 << 32))
