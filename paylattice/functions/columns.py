"""Column expressions used by several operators; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def draw(seed: int, *keys: str | Column) -> Column:
    """Uniform 60-bit integer that depends only on the seed and the row's keys.

    Unlike rand() it gives the same value when a task is run again or data is re-split.
    """
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *keys).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def dot(a: str | Column, b: str | Column) -> Column:
    """Inner product of two numeric arrays of one length, in double precision."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def zeros(width: int) -> Column:
    return F.array_repeat(F.lit(0.0).cast("float"), width)


def softplus(x: Column) -> Column:
    """log(1 + exp(x)) without overflow."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def unit(vector: str | Column) -> Column:
    """Vector divided by its length; a zero vector stays zero."""
    length = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    return F.transform(vector, lambda x: F.coalesce(F.try_divide(x.cast("double"), length), F.lit(0.0)))
