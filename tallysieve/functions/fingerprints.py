"""Bit fingerprints: sorted set-bit arrays for joins, packed 64-bit words for comparison."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallysieve.functions.columns import as_col

WIDTH = 2048
WORDS = WIDTH // 64


def token_bit(token: Column, width: int = WIDTH) -> Column:
    """Bit position of a text token: first 32 bits of its MD5 modulo the width."""
    return (F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("bigint") % width).cast("int")


def token_bits(tokens: Column, width: int = WIDTH) -> Column:
    return F.sort_array(F.array_distinct(F.transform(tokens, lambda t: token_bit(t, width))))


def pack_words(bits: Column | str, words: int = WORDS) -> Column:
    """Set-bit positions -> array<bigint> of 64-bit words.

    Vectorised over Arrow batches: as nested lambdas in the JVM this costs
    bits x words calls per row and dominated whole queries.
    """

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def pack(batch: pd.Series) -> pd.Series:
        arrays = batch.to_numpy()
        lengths = np.fromiter((len(a) for a in arrays), dtype="int64", count=len(arrays))
        marks = np.zeros((len(arrays), words * 64), dtype=bool)
        if lengths.sum():
            marks[np.repeat(np.arange(len(arrays)), lengths), np.concatenate(arrays).astype("int64")] = True
        packed = np.packbits(marks, axis=1, bitorder="little").view("<i8")
        return pd.Series(list(packed))

    return pack(as_col(bits))


def common_bits(a: Column | str, b: Column | str) -> Column:
    """Shared set bits of two packed fingerprints.

    A fold, not an unrolled sum: thousands of generated operations per row would pass
    the size limit of the JIT compiler and run interpreted.
    """
    shared = F.zip_with(as_col(a), as_col(b), lambda x, y: F.bit_count(x.bitwiseAND(y)))
    return F.aggregate(shared, F.lit(0), lambda acc, n: acc + n)


def tanimoto_from_common(common: Column, size_a: Column, size_b: Column) -> Column:
    union = size_a + size_b - common
    return F.when(union > 0, common / union).otherwise(F.lit(0.0))


def tanimoto(a: Column | str, b: Column | str, size_a: Column, size_b: Column) -> Column:
    """common / (size_a + size_b - common), with the common bits folded only once."""
    union = lambda n: size_a + size_b - n
    ratio = F.transform(
        F.array(common_bits(a, b)), lambda n: F.when(union(n) > 0, n / union(n)).otherwise(F.lit(0.0))
    )
    return F.element_at(ratio, 1)


def tanimoto_bits(a: Column | str, b: Column | str) -> Column:
    """Tanimoto of two set-bit arrays (small inputs; joins use packed words)."""
    a, b = as_col(a), as_col(b)
    return tanimoto_from_common(F.size(F.array_intersect(a, b)), F.size(a), F.size(b))


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def unpack_bytes(packed: pd.Series) -> pd.Series:
    """Bytes with little bit order -> sorted set-bit positions (ingest of packed archives)."""
    return packed.map(
        lambda raw: None
        if raw is None
        else np.flatnonzero(np.unpackbits(np.frombuffer(raw, dtype=np.uint8), bitorder="little")).astype("int32")
    )
