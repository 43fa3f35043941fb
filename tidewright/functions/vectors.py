"""Vector expressions over array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Signed; 0 where lengths differ or a norm vanishes."""
    size = norm(a) * norm(b)
    return F.when((F.size(a) != F.size(b)) | (size <= 1e-12), 0.0).otherwise(dot(a, b) / size)


def similarity(a: Column, b: Column) -> Column:
    """Cosine clamped to 0..1; null where a vector is null or empty, lengths differ or the product of the norms vanishes."""
    fit = a.isNotNull() & b.isNotNull() & (F.size(a) > 0) & (F.size(a) == F.size(b)) & (norm(a) * norm(b) > 1.1920929e-07)
    return F.when(fit, F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(a, b) / (norm(a) * norm(b)))))


def signature_distance(a: Column, b: Column) -> Column:
    """1 less the dot product, within 0..1; a half where a signature is missing or lengths differ."""
    fit = a.isNotNull() & b.isNotNull() & (F.size(a) == F.size(b)) & (F.size(a) > 0)
    return F.when(fit, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - dot(a, b)))).otherwise(0.5)


def sign_bits(v: Column) -> Column:
    """Packed sign bits: bit i of word i div 64 is set where component i is above 0."""
    words = F.ceil(F.size(v) / 64).cast("int")

    def word(w):
        bit = lambda s, i: F.when(F.get(v, w * 64 + i) > 0, s.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), i))).otherwise(s)
        return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("bigint"), bit)

    return F.transform(F.sequence(F.lit(0), words - 1), word)


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of the words that both have."""
    n = F.least(F.size(a), F.size(b))
    return F.aggregate(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def normalized(v: Column, least: float = 1e-8) -> Column:
    """The vector at length 1; null where it's empty, has a component that isn't finite, or is shorter than `least`."""
    size = norm(v)
    return F.when((F.size(v) > 0) & ~F.isnan(size) & (size < float("inf")) & (size >= least), F.transform(v, lambda x: x.cast("double") / size))


def is_unit(v: Column, tolerance: float = 1e-6) -> Column:
    size = norm(v)
    return F.coalesce((F.size(v) > 0) & ~F.isnan(size) & (F.abs(size - 1) <= tolerance), F.lit(False))
