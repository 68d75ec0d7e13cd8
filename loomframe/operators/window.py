"""Ranks, quotas, runs and top-k."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from loomframe.plans.ordered import hashed_row_numbers, join_stats, previous_values, row_numbers, running_sums

_GROUP_LIMIT = 1000  # up to here Spark cuts each group map-side before the shuffle


def quota(df: DataFrame, by: Sequence[str], order: Sequence[str | Column], n: int, out: str = "rn") -> DataFrame:
    """First n rows of each class. Small quotas never move more than n rows per class and task."""
    if n > _GROUP_LIMIT:
        return row_numbers(df, order, by, out).filter(F.col(out) <= n)
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("bigint")).filter(F.col(out) <= n)


def surplus_move(df: DataFrame, by: str, order: Sequence[str], final: int, source: str, target: str) -> DataFrame:
    """Each class keeps its first ``final`` rows in ``source``; later rows get ``target``. Too few rows raise."""
    short = df.groupBy(by).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") < final).limit(5).collect()
    if short:
        raise ValueError(f"classes with fewer than {final} samples, e.g. {[r[by] for r in short]}")
    ranked = row_numbers(df, order, [by])
    return ranked.withColumn("split", F.when(F.col("rn") > final, F.lit(target)).otherwise(F.lit(source)))


def local_maxima(df: DataFrame, by: Sequence[str], position: str, value: str, compat: bool = False) -> DataFrame:
    """Interior points above both neighbours; ``position`` is unique inside a series, which may be of any length.

    ``compat`` leaves out the first interior point and reports an index one too low.
    """
    numbered = row_numbers(df, [position], by, out="index")
    before = previous_values(numbered, value, [position], by, out="_before")
    both = previous_values(before, value, [F.col(position).desc()], by, out="_after")
    peak = (F.col(value) > F.col("_before")) & (F.col(value) > F.col("_after"))
    marked = both.filter(peak).drop("_before", "_before_exists", "_after", "_after_exists")
    marked = marked.withColumn("index", F.col("index").cast("bigint") - 1)
    return marked.filter(F.col("index") > 1).withColumn("index", F.col("index") - 1) if compat else marked


def collapse_repeats(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Keep a row only when its value differs from the row before it (nulls compare equal)."""
    seen = previous_values(df, value, order, by, out="before")
    return seen.filter(~F.col("before_exists") | ~F.col(value).eqNullSafe(F.col("before"))).drop(
        "before", "before_exists"
    )


def near_group_max(df: DataFrame, by: Sequence[str], value: str, share: float) -> DataFrame:
    """Rows above ``share`` of their group's maximum."""
    peak = df.groupBy(*by).agg(F.max(value).alias("group_max"))
    return join_stats(df, peak, by).filter(F.col(value) > F.col("group_max") * F.lit(share)).drop("group_max")


def cumulative_share(df: DataFrame, value: str, tie: str, share: float) -> DataFrame:
    """Rows by value descending, flagged important while the sum before the row is under share * total."""
    total = df.agg(F.sum(value)).scalar()
    summed = running_sums(df, [value], [F.col(value).desc(), F.col(tie)])
    before = F.col(f"cum_{value}") - F.col(value)
    return summed.withColumn("important", before < total * F.lit(share))


def pair_numbers(df: DataFrame, by: Sequence[str], order: Sequence[str], offset: int = 0) -> DataFrame:
    """Consecutive rows form pairs: ``pair`` counts from 1 + offset, ``side`` is A then B."""
    ranked = row_numbers(df, order, by)
    return ranked.withColumns(
        {
            "pair": F.ceil(F.col("rn") / 2) + offset,
            "side": F.when(F.col("rn") % 2 == 1, F.lit("A")).otherwise(F.lit("B")),
        }
    )


def complete_pairs(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows of pairs that still have both sides."""
    keys = [*by, "pair"]
    whole = df.groupBy(*keys).agg(F.count_distinct("side").alias("sides"))
    return join_stats(df, whole.filter("sides = 2").select(*keys), keys, "left_semi")


def flag_repeats(df: DataFrame, key: str, order: str) -> DataFrame:
    """``first_id`` of each key's earliest row, and ``is_duplicate`` on all others."""
    firsts = df.groupBy(key).agg(F.min(order).alias("first_id"))
    return join_stats(df, firsts, [key]).withColumn("is_duplicate", F.col(order) != F.col("first_id"))


def first_by_priority(df: DataFrame, by: Sequence[str], name: str, priority: Sequence[str]) -> DataFrame:
    """The first name in priority order that a group has (groups with none of them are left out)."""
    place = F.array_position(F.array(*[F.lit(p) for p in priority]), F.col(name))
    known = df.filter(F.col(name).isin(*priority))
    best = known.groupBy(*by).agg(F.min(place).alias("_place"))
    return best.select(*by, F.element_at(F.array(*[F.lit(p) for p in priority]), F.col("_place").cast("int")).alias(name))


def natural_number(name: Column | str) -> Column:
    """First run of digits in a name, as a number."""
    return F.regexp_extract(name, r"(\d+)", 1).cast("bigint")


def shuffled(df: DataFrame, key: Sequence[str], seed: str, out: str = "place") -> DataFrame:
    """Every row with its place in the seeded shuffle."""
    return hashed_row_numbers(df, seed, key, out=out)


def sample_fraction(df: DataFrame, key: Sequence[str], share: float, seed: str) -> DataFrame:
    """Exactly round(share * n) rows in seeded order."""
    wanted = df.agg(F.round(F.count(F.lit(1)) * F.lit(share)).cast("bigint")).scalar()
    return hashed_row_numbers(df, seed, key, out="_place").filter(F.col("_place") <= wanted).drop("_place")


def top_label_share(df: DataFrame, label: str, share: float) -> DataFrame:
    """(label, n, rn) of the first floor(share * distinct) labels by count."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    keep = counts.agg(F.floor(F.count(F.lit(1)) * F.lit(share)).cast("bigint")).scalar()
    return row_numbers(counts, [F.desc("n"), F.col(label)]).filter(F.col("rn") <= keep)
