"""Aggregations that stay partial on the map side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from loomframe.plans.gram import product_sums
from loomframe.plans.ordered import join_stats, row_numbers
from loomframe.plans.quantiles import fit_statistics


def class_distribution(df: DataFrame, label: str) -> DataFrame:
    """(label, n, percent)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("percent", F.col("n") * 100.0 / counts.agg(F.sum("n")).scalar())


def item_counts(df: DataFrame, item: str) -> DataFrame:
    return df.groupBy(item).agg(F.count(F.lit(1)).alias("n"))


def first_seen_codes(df: DataFrame, label: str, position: Sequence[str], start: int = 0) -> DataFrame:
    """(label, code): distinct labels numbered in order of first appearance."""
    first = df.groupBy(label).agg(F.min(F.struct(*position)).alias("first_position"))
    return row_numbers(first, ["first_position"], out="place").select(label, (F.col("place") - 1 + start).alias("code"))


def sorted_codes(df: DataFrame, label: str, counted: str | None = None) -> DataFrame:
    """(label, code): distinct labels numbered in alphabetical order from 0; ``counted`` names a column for their rows."""
    distinct = df.groupBy(label).agg(F.count(F.lit(1)).alias(counted)) if counted else df.select(label).distinct()
    return row_numbers(distinct, [label], out="place").select(label, (F.col("place") - 1).alias("code"), *([counted] if counted else []))


def resample_target(df: DataFrame, label: str, factor: float) -> DataFrame:
    """One row: class count median and floor(factor * median); the median sees one row per class."""
    counts = item_counts(df, label)
    median = counts.agg(F.percentile("n", 0.5).alias("median"))
    return median.withColumn("target", F.floor(F.col("median") * F.lit(factor)).cast("bigint"))


def column_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, n_null, mean, std, min, max, q25, q50, q75): moments come with the rough pass of the quartiles."""
    names = ("n_null", "mean", "std", "min", "max")
    rows = df.select(*[F.col(c).alias(f"x{i}") for i, c in enumerate(columns)])
    also = {}
    for i in range(len(columns)):
        x = F.col(f"x{i}")
        for name, e in zip(names, (F.count_if(x.isNull()), F.avg(x), F.stddev_samp(x), F.min(x).cast("double"), F.max(x).cast("double"))):
            also[f"{name}_{i}"] = e
    q, values = fit_statistics(rows, {f"x{i}": [0.25, 0.5, 0.75] for i in range(len(columns))}, also)
    table = [(c, *[values[f"{name}_{i}"] for name in names], *[q.get((f"x{i}", p)) for p in (0.25, 0.5, 0.75)]) for i, c in enumerate(columns)]
    return df.sparkSession.createDataFrame(table, "feature string, n_null long, mean double, std double, min double, max double, q25 double, q50 double, q75 double")


def correlations(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """(a, b, r) Pearson correlation of every named pair over the rows that have both; null without variance.

    One pass of matrix products over the named columns, however many pairs there are.
    """
    left, right = list(dict.fromkeys(a for a, _ in pairs)), list(dict.fromkeys(b for _, b in pairs))
    sums, _ = product_sums(df, left, right)
    cells = sums.select("i", F.posexplode(F.arrays_zip("n", "sx", "sxx", "sy", "syy", "sxy")).alias("j", "c")).select("i", "j", "c.*")
    spread = (F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n")) * (F.col("syy") - F.col("sy") * F.col("sy") / F.col("n"))
    r = F.when((F.col("n") > 0) & (spread > 0), (F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")) / F.sqrt(spread))
    wanted = df.sparkSession.createDataFrame([(a, b, left.index(a), right.index(b)) for a, b in pairs], "a string, b string, i int, j int")
    return wanted.join(cells.select("i", "j", r.alias("r")), ["i", "j"], "left").select("a", "b", "r")


def population_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, mean, std) with the population standard deviation."""
    cells = df.agg(
        *[
            F.struct(F.lit(c).alias("feature"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("std")).alias(f"_{i}")
            for i, c in enumerate(columns)
        ]
    )
    return cells.select(F.explode(F.array(*cells.columns)).alias("c")).select("c.*")


def vector_centroids(df: DataFrame, group: str, vector: str) -> DataFrame:
    """(group, dim, mean, n): mean of every vector entry (0-based) per group, for vectors of any length."""
    entries = df.select(group, F.posexplode(F.col(vector)).alias("dim", "value"))
    return entries.groupBy(group, "dim").agg(F.avg(F.col("value").cast("double")).alias("mean"), F.count(F.lit(1)).alias("n"))


def rates_of_total(df: DataFrame, group: str, hit: Column) -> DataFrame:
    """(group, attempts, writes, attempt_rate, write_rate): shares of all attempts and of all writes."""
    counts = df.groupBy(group).agg(F.count(F.lit(1)).alias("attempts"), F.count_if(hit).alias("writes"))
    total, written = counts.agg(F.sum("attempts")).scalar(), counts.agg(F.sum("writes")).scalar()
    return counts.withColumns(
        {"attempt_rate": F.col("attempts") / total, "write_rate": F.col("writes") / written}
    )


def ids_per_class(df: DataFrame, group: str, item: str) -> DataFrame:
    """(group, item, total): distinct items of each class as rows, with the class total."""
    distinct = df.select(group, item).distinct()
    return join_stats(distinct, distinct.groupBy(group).agg(F.count(F.lit(1)).alias("total")), [group])


def column_profiles(df: DataFrame, column: str, value: str) -> DataFrame:
    """Projection profile of a (row, column, value) matrix: sum and max per column."""
    return df.groupBy(column).agg(F.sum(value).alias("total"), F.max(value).alias("peak"))


def tile_stats(df: DataFrame, x: str, y: str, value: str, width: int, height: int, levels: int, flat: float) -> DataFrame:
    """Mean and population std per tile of a 2^level grid; ``is_flat`` below the std cut."""
    per_level = df.withColumn("level", F.explode(F.sequence(F.lit(1), F.lit(levels))))
    side = F.pow(F.lit(2), F.col("level"))
    tiles = per_level.withColumns(
        {
            "tile_x": F.floor(F.col(x) * side / width).cast("int"),
            "tile_y": F.floor(F.col(y) * side / height).cast("int"),
        }
    )
    stats = tiles.groupBy("level", "tile_x", "tile_y").agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    return stats.withColumn("is_flat", F.col("std") < flat)


def occurrences(train: DataFrame, validation: DataFrame, item: str) -> DataFrame:
    """(item, n): the validation count replaces the train count of a shared item."""
    t = train.groupBy(item).agg(F.count(F.lit(1)).alias("n_train"))
    v = validation.groupBy(item).agg(F.count(F.lit(1)).alias("n_val"))
    return t.join(v, item, "full").select(item, F.coalesce("n_val", "n_train").alias("n"))
