"""Seeded orders and content hashes that Spark, DuckDB and Python all compute alike."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seeded(seed: str, *parts: Column | str) -> Column:
    """SHA-256 of seed and parts, joined by zero bytes, as hex."""
    return F.sha2(F.concat_ws("\u0000", F.lit(seed), *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts]), 256)


def rank_key(seed: str, *parts: Column | str) -> Column:
    """The first 16 hex digits of the seeded hash; sorts like the number they spell."""
    return F.substring(seeded(seed, *parts), 1, 16)


def bucket(seed: str, buckets: int, *parts: Column | str) -> Column:
    """A number from 0 to buckets - 1 from the seeded hash."""
    return F.pmod(F.conv(F.substring(seeded(seed, *parts), 1, 8), 16, 10).cast("bigint"), F.lit(buckets))


def plain_hex(value: Column | str) -> Column:
    """A hash without blanks, case or the name of its kind before it."""
    return F.regexp_replace(F.lower(F.trim(F.col(value) if isinstance(value, str) else value)), "^sha256:", "")
