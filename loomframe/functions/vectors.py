"""Expressions over array columns of numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F


def _add(a: Column, b: Column) -> Column:
    return a + b


def doubles(v: Column | str) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), _add)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalize(v: Column) -> Column:
    """Unit-length vector; the length is computed once per row."""
    lengths = F.transform(F.array(norm(v)), lambda n: F.transform(v, lambda x: x / n))
    return F.element_at(lengths, 1)


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def sum_vectors(df, by: Sequence[str], vector: str, out: str = "vector"):
    """Element-wise sum per group as partial aggregates, one per dimension and group."""
    parts = df.select(*by, F.posexplode(doubles(vector)).alias("dim", "x"))
    sums = parts.groupBy(*by, "dim").agg(F.sum("x").alias("x"))
    packed = sums.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("dim", "x"))).alias("cells"))
    return packed.select(*by, F.transform("cells", lambda c: c["x"]).alias(out))
