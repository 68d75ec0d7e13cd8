"""Split register: saved train/validation rows that grow without moving, and its leak audit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from loomframe.operators.lookup import new_rows
from loomframe.operators.aggregate import occurrences
from loomframe.plans.ordered import hashed_row_numbers, row_numbers
from loomframe.functions.scalar import is_numeric

TRAIN, VALIDATION = "train", "validation"


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: do both frames hold the same rows as often, whatever their order?"""
    cols = a.columns
    counted = a.select(*cols, F.lit(1).alias("_d")).unionByName(b.select(*cols, F.lit(-1).alias("_d")))
    off = counted.groupBy(*cols).agg(F.sum("_d").alias("_d")).filter("_d <> 0")
    return off.agg((F.count(F.lit(1)) == 0).alias("same"))


def ceil_share(share: float, n: int | Column):
    """ceil(share * n) guarded against a product a hair above a whole number."""
    return F.ceil(F.round(F.lit(share) * n, 9))


def save_split(df: DataFrame, order: Sequence[str], train_share: float) -> DataFrame:
    """First ceil(share * n) rows in the given order are train, the rest validation."""
    n = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    ranked = row_numbers(df, order)
    is_train = F.col("rn") <= ceil_share(train_share, n)
    return ranked.withColumn("part", F.when(is_train, TRAIN).otherwise(VALIDATION)).drop("rn")


def check_manual(parts: dict[str, DataFrame]) -> DataFrame:
    """A hand-made split: exactly the two parts, merged into one register."""
    if set(parts) != {TRAIN, VALIDATION}:
        raise KeyError(f"a split needs the parts {TRAIN!r} and {VALIDATION!r}, got {sorted(parts)}")
    return parts[TRAIN].withColumn("part", F.lit(TRAIN)).unionByName(parts[VALIDATION].withColumn("part", F.lit(VALIDATION)))


def update_split(state: DataFrame, incoming: DataFrame, key: Sequence[str], train_share: float, seed: str) -> DataFrame:
    """Register after new rows arrived: old rows keep their part, the new ones restore the share.

    The new rows are put in seeded order; the last k go to train, the rest to validation. k brings the
    train part to ceil(share * all rows), clamped to the number of new rows. (columns..., part, is_new)
    """
    columns = [c for c in state.columns if c != "part"]
    fresh = new_rows(incoming.select(*columns), state.select(*columns))
    old = state.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("part") == TRAIN).alias("k")).first()
    n_new = fresh.count()
    target = state.sparkSession.range(1).select(ceil_share(train_share, F.lit(old["n"] + n_new))).first()[0]
    n_train = min(max(target - old["k"], 0), n_new)
    ranked = hashed_row_numbers(fresh, seed, key)
    placed = ranked.withColumn(
        "part", F.when(F.col("rn") > n_new - n_train, TRAIN).otherwise(VALIDATION)
    ).select(*columns, "part", F.lit(True).alias("is_new"))
    return state.select(*columns, "part", F.lit(False).alias("is_new")).unionByName(placed)


def split_report(register: DataFrame) -> DataFrame:
    """(part, n, n_new, share)."""
    total = register.agg(F.count(F.lit(1)).alias("n")).scalar()
    return register.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_new").alias("n_new")).withColumn(
        "share", F.col("n") / total
    )


def path_columns(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Columns without a trailing label: the last one is a label when every value is numeric."""
    last = columns[-1]
    text = F.col(last).cast("string")
    non_numeric = df.filter(~is_numeric(text) | text.isNull()).limit(1).count()
    return list(columns) if non_numeric else list(columns[:-1])


def flatten_samples(register: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(part, sample): the path columns stacked into one."""
    return register.select("part", F.explode(F.array(*[F.col(c).cast("string") for c in columns])).alias("sample"))


def leaks(samples: DataFrame) -> DataFrame:
    """Samples that sit in both parts."""
    by_part = samples.groupBy("sample").agg(
        F.max((F.col("part") == TRAIN).cast("int")).alias("t"), F.max((F.col("part") == VALIDATION).cast("int")).alias("v")
    )
    return by_part.filter("t = 1 AND v = 1").select("sample")


def leak_report(register: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: found_leaks, total_leaks, train_samples, validation_samples."""
    samples = flatten_samples(register, path_columns(register, columns))
    found = leaks(samples).agg(F.count(F.lit(1)).alias("n")).scalar()
    return samples.agg(
        F.count_if(F.col("part") == TRAIN).alias("train_samples"),
        F.count_if(F.col("part") == VALIDATION).alias("validation_samples"),
    ).select((found > 0).alias("found_leaks"), found.alias("total_leaks"), "train_samples", "validation_samples")


def sample_counts(samples: DataFrame) -> DataFrame:
    """(sample, n): the validation count replaces the train count of a shared sample."""
    part = F.col("part")
    return occurrences(
        samples.filter(part == TRAIN).select("sample"), samples.filter(part == VALIDATION).select("sample"), "sample"
    )
