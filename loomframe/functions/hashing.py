"""Seeded hash order: the deterministic stand-in for random draws."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def hash_hex(seed: str, *parts: Column | str) -> Column:
    """md5 of ``seed:part:part...`` as 32 hex digits."""
    return F.md5(F.concat_ws(":", F.lit(seed), *[F.col(p) if isinstance(p, str) else p for p in parts]))


def hex_to_long(digits: Column) -> Column:
    """First eight hex digits as a non-negative bigint."""
    return F.conv(F.substring(digits, 1, 8), 16, 10).cast("bigint")


def hash_long(seed: str, *parts: Column | str) -> Column:
    """Bounded hash in 0 .. 2^32-1."""
    return hex_to_long(hash_hex(seed, *parts))
