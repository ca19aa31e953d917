"""Dense vectors in array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product, summed in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(a: Column) -> Column:
    """To length one; a zero vector stays."""
    size = F.sqrt(dot(a, a))
    return F.transform(a, lambda x: x.cast("double") / F.when(size == 0, F.lit(1.0)).otherwise(size))
