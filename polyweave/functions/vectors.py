"""Vector functions on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from polyweave.functions import fixed as X


def dot(a: Column, b: Column) -> Column:
    """Inner product, accumulated in double precision."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def unit(a: Column, least: float = 1e-9) -> Column:
    norm = F.sqrt(dot(a, a)) + least
    return F.transform(a, lambda x: x.cast("double") / norm)


def fuse(first: Column, second: Column, weights: tuple = X.FUSE) -> Column:
    return first * weights[0] + second * weights[1]


def stack(*blocks: Column) -> Column:
    """Vectors end to end, then of unit length."""
    return unit(F.concat(*blocks))


def mean_pool(tokens: Column, mask: Column, dim: int) -> Column:
    """Mean of the token vectors whose mask is not 0, per dimension; null where none is."""
    kept = F.filter(F.arrays_zip(tokens.alias("t"), mask.alias("m")), lambda x: x["m"] != 0)
    zero = F.array_repeat(F.lit(0.0), dim)
    total = F.aggregate(kept, zero, lambda s, x: F.zip_with(s, x["t"], lambda a, b: a + b.cast("double")))
    return F.when(F.size(kept) > 0, F.transform(total, lambda x: x / F.size(kept)))


def rounded(x: Column, digits: int) -> Column:
    """A double scaled, brought to the nearest integer (halves away from zero) and scaled back, as SQL engines in C do; a zero keeps its sign, as in -0.0."""
    scaled = x * float(10**digits)
    near = F.when(F.abs(scaled % 1.0) == 0.5, scaled + F.signum(scaled) * 0.5).otherwise(F.rint(scaled)) / float(10**digits)
    return F.when(F.abs(near) < float("inf"), near).otherwise(x)
