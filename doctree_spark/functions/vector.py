"""Column expressions on vectors (arrays of numbers); sums are in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """Length one; a zero vector stays."""
    # bound by an outer lambda, the length is computed once and not for every number
    sized = F.array(F.struct(doubles(v).alias("v"), F.sqrt(dot(v, v)).alias("size")))
    return F.get(F.transform(sized, lambda t: F.when(t['size'] > 0, F.transform(t.v, lambda x: x / t['size'])).otherwise(t.v)), F.lit(0))


def added(vectors: Column, size: int) -> Column:
    """Sum of an array of vectors, in its order."""
    zero = F.array_repeat(F.lit(0.0), size)
    return F.aggregate(vectors, zero, lambda s, v: F.zip_with(s, v, lambda x, y: x + y.cast("double")))
