"""Vector arithmetic as column expressions over arrays, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Least norm that a vector is divided by.
EPSILON = 1e-12


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(doubles(a), doubles(b), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalize(v: Column) -> Column:
    length = F.greatest(norm(v), F.lit(EPSILON))
    return F.transform(F.arrays_zip(doubles(v).alias("x"), F.array_repeat(length, F.size(v)).alias("n")), lambda z: z["x"] / z["n"])


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(doubles(a), doubles(b), lambda x, y: x - y)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(doubles(a), doubles(b), lambda x, y: x + y)


def squared_distance(a: Column, b: Column) -> Column:
    steps = F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y))
    return F.aggregate(steps, F.lit(0.0), lambda total, x: total + x)


def bucket(value: Column, cutoffs: list[float]) -> Column:
    """The number of cutoffs below the value; a value equal to a cutoff is in the lower bucket."""
    return sum((F.lit(float(c)) < value).cast("int") for c in cutoffs) if cutoffs else F.lit(0)


def rounded(v: Column, digits: int = 4) -> Column:
    """``v`` rounded for comparison; negative zeros become zeros."""
    return F.transform(v, lambda x: F.round(x, digits) + F.lit(0.0))
