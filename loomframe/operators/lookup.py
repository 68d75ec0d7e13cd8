"""Lookups and joins against dictionaries, bands and centers."""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from loomframe.functions.hashing import hash_long
from loomframe.plans.checkpoints import materialize
from loomframe.plans.lookups import lookup_join
from loomframe.plans.ordered import join_stats, row_numbers


def encode(df: DataFrame, dictionary: DataFrame, label: str, code: str = "code") -> DataFrame:
    """Attach the code of each label; the dictionary holds a label once, so a hot label splits cleanly."""
    return lookup_join(df, dictionary.select(label, code), [label])


def decode(df: DataFrame, dictionary: DataFrame, code: str, label: str) -> DataFrame:
    return lookup_join(df, dictionary.select(code, label), [code])


def new_rows(df: DataFrame, state: DataFrame) -> DataFrame:
    """Rows of ``df`` that the state does not hold, nulls matching nulls; repeats inside ``df`` stay."""
    return join_stats(df, state.select(*df.columns).distinct(), df.columns, "left_anti")


def band_names(values: Sequence[Column], bands: Sequence[tuple[str, Sequence[tuple[float, float]]]]) -> Column:
    """Name of the last band whose (min, max) ranges hold every value, ``[?]`` when none does."""
    name = F.lit("[?]")
    for label, ranges in bands:
        inside = F.lit(True)
        for value, (low, high) in zip(values, ranges):
            inside = inside & value.between(low, high)
        name = F.when(inside, F.lit(label)).otherwise(name)
    return name


def nearest_vector(vector: Column, centers: Sequence[tuple[Any, Sequence[float]]]) -> Column:
    """Label of the nearest center (least squared distance, ties by label); the centers are one constant array."""
    table = F.array(*[F.struct(F.lit(label).alias("label"), F.array(*[F.lit(float(x)) for x in center]).alias("center")) for label, center in centers])

    def rated(entry: Column) -> Column:
        squares = F.zip_with(vector, entry["center"], lambda x, c: (x - c) * (x - c))
        return F.struct(F.aggregate(squares, F.lit(0.0), lambda a, x: a + x).alias("distance"), entry["label"].alias("label"))

    return F.array_min(F.transform(table, rated))["label"]


def rejected_draws(
    positives: DataFrame, left: str, right: str, n_left: int, n_right: int, wanted: int, seed: str, least_free: float = 1e-3
) -> DataFrame:
    """``wanted`` hashed (left, right) code pairs that are not positives, in draw order.

    Rounds of draws, each as large as the share of free pairs asks for, go on where the last one stopped, so the
    result does not depend on their sizes. Where fewer than ``least_free`` of all pairs are free, drawing and rejecting
    is no way to find them, and an error is raised.
    """
    spark = positives.sparkSession
    inside = F.col(left).between(0, n_left - 1) & F.col(right).between(0, n_right - 1)
    known = materialize(positives.select(left, right).distinct())
    free = 1 - known.filter(inside).count() / (n_left * n_right) if n_left and n_right else 0.0
    if free < least_free:
        raise ValueError(f"only {free:.2g} of all pairs are no positives: too few to draw")
    start, have, valid = 0, 0, None
    while have < wanted or valid is None:
        stop = start + max(16, math.ceil(1.1 * (wanted - have) / free))
        draws = spark.range(start, stop).select(
            F.col("id").alias("draw"),
            (hash_long(f"{seed}-l", "id") % n_left).alias(left),
            (hash_long(f"{seed}-r", "id") % n_right).alias(right),
        )
        fresh = materialize(draws.join(known, [left, right], "left_anti"))
        valid = fresh if valid is None else valid.unionByName(fresh)
        start, have = stop, have + fresh.count()
    return row_numbers(valid, ["draw"]).filter(F.col("rn") <= wanted).select("rn", left, right)
