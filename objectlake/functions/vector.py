"""Vectors as columns of array<double>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def _double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(_double(a), _double(b), lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where the lengths differ or a norm is 0; within -1 and 1."""
    scale = norm(a) * norm(b)
    return F.when((F.size(a) != F.size(b)) | (scale == 0), 0.0).otherwise(F.greatest(F.least(dot(a, b) / scale, F.lit(1.0)), F.lit(-1.0)))


def euclidean(a: Column, b: Column) -> Column:
    """Infinity where the lengths differ."""
    return F.when(F.size(a) != F.size(b), float("inf")).otherwise(F.sqrt(_sum(F.zip_with(_double(a), _double(b), lambda x, y: (x - y) * (x - y)))))


def quantize(v: Column) -> Column:
    """Numbers from -1 to 1 as 0 to 255, cut to whole numbers."""
    return F.transform(_double(v), lambda x: F.greatest(F.lit(0.0), F.least(F.lit(255.0), (x + 1) * 127.5)).cast("int"))


def dequantize(q: Column) -> Column:
    return F.transform(q, lambda x: x / 127.5 - 1)


def normalized(v: Column) -> Column:
    n = norm(v)
    return F.when(n == 0, _double(v)).otherwise(F.transform(_double(v), lambda x: x / n))
