"""Seeded hashes that other engines reproduce, for repeatable sampling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seeded_hash(key: Column | str, seed: int) -> Column:
    """Hex digest of seed and key: a uniform, stable order of the rows."""
    column = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}:"), column.cast("string")))


def unit_interval(digest: Column) -> Column:
    """The digest as a number in [0, 1), from its first 32 bits."""
    return hex_number(digest, 1, 8).cast("double") / F.lit(4294967296.0)


def hex_number(digest: Column, start: int, digits: int) -> Column:
    """``digits`` hex digits of the digest as a bigint."""
    return F.conv(F.substring(digest, start, digits), 16, 10).cast("bigint")
