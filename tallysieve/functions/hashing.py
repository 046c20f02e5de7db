"""Seeded, engine-independent hashes: the same bucket on every cluster and in any SQL engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallysieve.functions.columns import as_col


def hash_bucket(text: Column | str, salt: str = "", modulus: int = 1000) -> Column:
    """First eight bytes of SHA-256(salt + text), little-endian, modulo `modulus`."""
    digest = F.sha2(F.concat(F.lit(salt), as_col(text)), 256)
    reversed_hex = F.concat(*[F.substring(digest, start, 2) for start in range(15, 0, -2)])
    return (F.conv(reversed_hex, 16, 10).cast("decimal(20,0)") % modulus).cast("int")


def order_hash(seed: int | str, *parts: Column | str) -> Column:
    """Hex digest used as a reproducible random order."""
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), *[as_col(p).cast("string") for p in parts]), 256)


def draw_index(seed: int | str, size: Column, *parts: Column | str) -> Column:
    """Uniform index in [0, size) from 60 hash bits."""
    prefix = F.substring(order_hash(seed, *parts), 1, 15)
    return F.conv(prefix, 16, 10).cast("bigint") % size
