"""Vectors as arrays: distances, sign bits, Hamming distance. All in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD_BITS = 64


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, x: total + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_distance(a: Column, b: Column) -> Column:
    gap = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    return F.sqrt(_sum(F.transform(gap, lambda d: d * d)))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; null where a vector has no length."""
    size = norm(a) * norm(b)
    return F.when(size > 0, 1 - dot(a, b) / size)


def sign_words(a: Column) -> Column:
    """A bit for each component, set where it is above 0, packed into 64-bit words, the first component lowest."""
    count = F.ceil(F.size(a) / F.lit(WORD_BITS)).cast("int")

    def word(i: Column) -> Column:
        part = F.slice(a, i * WORD_BITS + 1, WORD_BITS)
        bits = F.transform(part, lambda x, j: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), j)).otherwise(F.lit(0).cast("bigint")))
        return F.aggregate(bits, F.lit(0).cast("bigint"), lambda total, b: total.bitwiseOR(b))

    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), word)).otherwise(F.array().cast("array<bigint>"))


def hamming(a: Column, b: Column) -> Column:
    """Number of differing bits of two arrays of words."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda total, n: total + n)
