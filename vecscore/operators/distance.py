"""Squared Euclidean distance of quantised vectors, in 64-bit integers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from vecscore.functions.schema import DIMS


def squared_distance(a: str = "q", b: str = "c", dims: int = DIMS) -> Column:
    """Between the columns a0.. and b0.. of one row."""
    each = [(F.col(f"{a}{d}").cast("bigint") - F.col(f"{b}{d}")) for d in range(dims)]
    return reduce(lambda x, y: x + y, [x * x for x in each])


def array_distance(a: str, b: str) -> Column:
    """Between two arrays of numbers of any length."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("bigint") - y) * (x.cast("bigint") - y)), F.lit(0).cast("bigint"), lambda s, x: s + x)
