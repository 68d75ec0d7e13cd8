"""Rows in ascending id order over many tasks, with bounds that a retry cannot change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def id_bounds(docs: DataFrame, id_col: str, parts: int) -> list[int]:
    """At most ``parts - 1`` ascending cut values; part ``i`` holds ids from cut ``i - 1`` up to below cut ``i``.

    The cuts are approximate quantiles of the ids (a narrow scan of one column); rows are never lost to the
    approximation, parts only differ in size. Nulls lie in part 0.
    """
    probabilities = [i / parts for i in range(1, parts)]
    if not probabilities:
        return []
    row = docs.agg(F.percentile_approx(F.col(id_col), probabilities, max(10_000, 20 * parts)).alias("q")).first()
    return sorted(set(row["q"] or []))


def part_of(id_col: Column, bounds: list[int]) -> Column:
    """Number of the part of an id: the count of bounds that are not above it, found by halving."""

    def pick(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(id_col >= F.lit(bounds[middle]), pick(middle + 1, high)).otherwise(pick(low, middle))

    if len(bounds) <= 64:
        return pick(0, len(bounds)).cast("int")
    # Nested branches of many bounds would outgrow generated code; an array keeps the plan small.
    array = F.array(*[F.lit(b) for b in bounds])
    return F.coalesce(F.size(F.filter(array, lambda b: b <= id_col)), F.lit(0)).cast("int")


def parts_for(docs: DataFrame) -> int:
    """Parts to cut the ids into: the session's shuffle partitions."""
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
