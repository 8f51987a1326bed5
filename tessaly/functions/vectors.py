"""Vectors as arrays of doubles: sums run left to right, so thresholds see one order of summation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product over the shorter length."""
    n = F.least(F.size(a), F.size(b))
    pairs = F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x * y)
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def bound(c: Column, use: Callable[[Column], Column]) -> Column:
    """use(c) with c computed once, however often it stands there."""
    return F.transform(F.array(c), use)[0]


def unit(v: Column) -> Column:
    """Scaled to length 1; a zero vector stays."""
    return bound(v, lambda t: bound(norm(t), lambda n: F.when(n > 0, F.transform(t, lambda x: x / n)).otherwise(t)))


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector is zero."""
    return bound(a, lambda x: bound(b, lambda y: bound(norm(x) * norm(y), lambda n: F.when(n > 0, dot(x, y) / n).otherwise(F.lit(0.0)))))


def mean_unit(vectors: Column, dim: int) -> Column:
    """Unit vector of the mean of unit vectors; zeros for none."""
    zero = F.array_repeat(F.lit(0.0), dim)
    total = F.aggregate(F.transform(vectors, unit), zero, lambda s, v: F.zip_with(s, v, lambda x, y: x + y))
    return F.when(F.size(vectors) > 0, unit(F.transform(total, lambda x: x / F.size(vectors)))).otherwise(zero)


def hashing(text: Column, grams: Column, dim: int = 256) -> Column:
    """Signed counts of grams: the first byte of a gram's digest is its bucket, the fifth one's parity its sign."""
    if dim != 256:
        raise ValueError("the first byte of a digest names one of 256 buckets")
    code = lambda g, a: F.conv(F.substring(F.md5(g.cast("binary")), a, 2), 16, 10).cast("int")
    found = F.transform(grams, lambda g: F.struct(code(g, 1).alias("b"), F.when(code(g, 9) % 2 == 0, 1.0).otherwise(-1.0).alias("s")))
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda k: F.aggregate(F.filter(found, lambda x: x["b"] == k), F.lit(0.0), lambda t, x: t + x["s"]))
