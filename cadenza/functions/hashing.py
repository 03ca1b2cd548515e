"""Deterministic pseudo-randomness: md5 gives the same stream in every engine and on every run."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def seeded_hash(id_col: str | Column, seed: int) -> Column:
    """32 hex digits that order rows pseudo-randomly for one seed."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.md5(F.concat(c.cast("string"), F.lit(f":{seed}")))


def hash_fraction(digest: Column) -> Column:
    """The leading 32 bits of a digest as a number in [0, 1)."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def hash_int(digest: Column, modulus: Column | int) -> Column:
    """A number in [0, modulus) from the leading 28 bits of a digest."""
    m = F.lit(modulus) if isinstance(modulus, int) else modulus
    return F.conv(F.substring(digest, 1, 7), 16, 10).cast("bigint") % m
