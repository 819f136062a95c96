"""Vector distances as Spark expressions, and exact nearest neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def distance(a: Column, b: Column, metric: str) -> Column:
    """L2, Cosine (1 - cos; NULL for a zero vector) or Inner (negated product), in double precision."""
    if metric == "L2":
        return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))))
    if metric == "Inner":
        return -dot(a, b)
    if metric == "Cosine":
        return F.lit(1.0) - F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
    raise ValueError(f"unknown distance {metric!r}")


def nearest(df: DataFrame, column: str, vector: list[float], metric: str, limit: int, ties: list[str], name: str = "_distance") -> DataFrame:
    """The ``limit`` rows nearest to ``vector``; every task keeps its best ones only.  Rows of another dimension are an error."""
    if limit <= 0:
        raise ValueError("limit must be positive")
    size = F.size(column)
    checked = F.when(size == len(vector), distance(F.col(column), F.array(*[F.lit(float(x)) for x in vector]), metric)).when(
        size.isNotNull() & (size >= 0), F.raise_error(F.lit(f"{column} has not {len(vector)} dimensions")).cast("double")
    )
    return df.withColumn(name, checked).where(F.col(name).isNotNull()).orderBy(F.col(name), *ties).limit(limit)
