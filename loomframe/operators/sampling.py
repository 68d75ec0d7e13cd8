"""Exact splits, folds, resampling and batches in seeded hash order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from loomframe.functions.hashing import hash_hex, hash_long
from loomframe.operators.state import ceil_share
from loomframe.plans.ordered import hashed_row_numbers, join_stats, row_numbers


def _count(df: DataFrame) -> Column:
    return df.agg(F.count(F.lit(1)).alias("n")).scalar()


def split_exact(df: DataFrame, key: Sequence[str], test_share: float, seed: str, out: str = "part") -> DataFrame:
    """Exactly ceil(share * n) rows are test, the rest train."""
    ranked = hashed_row_numbers(df, seed, key, out="_place")
    is_test = F.col("_place") <= ceil_share(test_share, _count(df))
    return ranked.withColumn(out, F.when(is_test, "test").otherwise("train")).drop("_place")


def split_classes(df: DataFrame, label: str, train_share: float, seed: str, out: str = "part") -> DataFrame:
    """Whole classes go to train (ceil(share * classes) of them) or test."""
    classes = df.select(label).distinct()
    ranked = hashed_row_numbers(classes, seed, [label], out="_place")
    is_train = F.col("_place") <= ceil_share(train_share, _count(classes))
    parts = ranked.select(label, F.when(is_train, "train").otherwise("test").alias(out))
    return join_stats(df, parts, [label])


def draw_with_replacement(df: DataFrame, label: str, key: str, sizes: DataFrame, per_class: int, seed: str) -> DataFrame:
    """``per_class`` draws for every class in ``sizes`` (label, n): (label, draw, key).

    Draws come from a distributed range, and meet the members on (class, member number), so neither a
    large class nor a large sample lands in one task.
    """
    members = hashed_row_numbers(df.select(label, key), seed, [key], [label])
    classes = row_numbers(sizes, [label], out="_class")
    n_classes = classes.count()
    draws = df.sparkSession.range(n_classes * per_class).select(
        (F.floor(F.col("id") / per_class) + 1).alias("_class"), (F.col("id") % per_class + 1).alias("draw")
    )
    picks = join_stats(draws, classes, ["_class"]).select(
        label, "draw", (hash_long(f"{seed}-draw", F.col(label), F.col("draw")) % F.col("n") + 1).alias("rn")
    )
    return join_stats(picks, members, [label, "rn"]).select(label, "draw", key)


def class_sizes(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def bootstrap_classes(df: DataFrame, label: str, key: str, per_class: int, seed: str) -> DataFrame:
    """Each class resampled with replacement to the same size, then shuffled: (label, draw, key, place)."""
    drawn = draw_with_replacement(df, label, key, class_sizes(df, label), per_class, seed)
    return hashed_row_numbers(drawn, f"{seed}-mix", [label, "draw"], out="place")


def oversample_minority(df: DataFrame, label: str, key: str, seed: str) -> DataFrame:
    """All rows once, plus draws that lift the smallest class to the size of the largest: (label, key, is_extra)."""
    sizes = class_sizes(df, label)
    edge = sizes.agg(
        F.min(F.struct("n", F.col(label).alias("v"))).alias("low"), F.max("n").alias("high")
    ).first()
    originals = df.select(label, key, F.lit(False).alias("is_extra"))
    missing = edge["high"] - edge["low"]["n"]
    if missing == 0:
        return originals
    smallest = F.col(label).eqNullSafe(F.lit(edge["low"]["v"]))
    extras = draw_with_replacement(df.filter(smallest), label, key, sizes.filter(smallest), missing, seed)
    return originals.unionByName(extras.select(label, key, F.lit(True).alias("is_extra")))


def contiguous_folds(df: DataFrame, order: Sequence[str], k: int, out: str = "fold") -> DataFrame:
    """Fold 0..k-1 in row order; the first n % k folds hold one row more."""
    n = _count(df)
    size, extra = F.floor(n / k), n % k
    r = F.col("_rn") - 1
    wide = extra * (size + 1)
    fold = F.when(r < wide, F.floor(r / (size + 1))).otherwise(extra + F.floor((r - wide) / F.greatest(size, F.lit(1))))
    return row_numbers(df, order, out="_rn").withColumn(out, fold.cast("int")).drop("_rn")


def stratified_folds(df: DataFrame, label: str, order: Sequence[str], k: int, out: str = "fold") -> DataFrame:
    """Contiguous folds inside each class, sized as if the classes lay end to end and rows were dealt in turn.

    Classes are laid out in order of first appearance.
    """
    classes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct(*order)).alias("_first"))
    before = Window.orderBy("_first").rowsBetween(Window.unboundedPreceding, -1)  # one row per class
    offsets = classes.select(label, "_n", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    ranked = join_stats(row_numbers(df, order, [label], out="_rn"), offsets, [label])
    fold, upto = F.lit(k - 1), F.lit(0)
    bounds = []
    for i in range(k):
        dealt = F.floor((F.col("_start") + F.col("_n") - 1 - i) / k) - F.floor((F.col("_start") - 1 - i) / k)
        upto = upto + dealt
        bounds.append((i, upto))
    for i, bound in reversed(bounds[:-1]):
        fold = F.when(F.col("_rn") - 1 < bound, F.lit(i)).otherwise(fold)
    return ranked.withColumn(out, fold).drop("_rn", "_n", "_start")


def stratified_shuffles(
    df: DataFrame, label: str, key: Sequence[str], repeats: int, test_share: float, seed: str
) -> DataFrame:
    """Repeated class-wise random splits: (columns..., repeat, part) with round(share * class size) test rows."""
    sizes = class_sizes(df, label)
    repeated = df.withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    ranked = hashed_row_numbers(repeated, seed, ["repeat", *key], ["repeat", label], out="_place")
    joined = join_stats(ranked, sizes, [label])
    is_test = F.col("_place") <= F.round(F.col("n") * F.lit(test_share))
    return joined.withColumn("part", F.when(is_test, "test").otherwise("train")).drop("_place", "n")


def permuted_copies(df: DataFrame, key: str, tags: str, copies: int, seed: str) -> DataFrame:
    """``copies`` rows per item, the tag list in a new seeded order each time."""
    rows = df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))
    salt = F.concat_ws(":", F.lit(seed), F.col(key).cast("string"), F.col("copy").cast("string"))
    mixed = F.array_sort(
        F.transform(tags, lambda t: F.struct(F.md5(F.concat_ws(":", salt, t)).alias("h"), t.alias("t")))
    )
    return rows.withColumn(tags, F.transform(mixed, lambda m: m["t"]))


# Primes below 2^31: each is coprime to any smaller number of codes, so its multiples visit every code.
WALK_STEPS = [2147483647, 2147483629, 2147483587, 2147483579]


def foreign_tags(own: Column, key: str, n_tags: int, width: int, seed: str) -> Column:
    """``width`` different tag codes out of 0..n_tags (below 2^31) that the item does not have, fewer if there are fewer.

    Each item walks the codes from a seeded start with a seeded step; ``width`` steps and one per own tag
    are enough, whatever the number of tags.
    """
    n = n_tags + 1
    start = hash_long(seed, key) % n
    step = F.element_at(F.array(*[F.lit(p).cast("bigint") for p in WALK_STEPS]), (hash_long(seed + "-step", key) % len(WALK_STEPS) + 1).cast("int"))
    places = F.sequence(F.lit(0), F.least(F.lit(n), F.size(own) + width) - 1).cast("array<bigint>")
    walk = F.transform(places, lambda i: (start + i * step) % n)
    return F.slice(F.array_except(walk, own), 1, width)


def batch_ids(df: DataFrame, order: Sequence[str], size: int, out: str = "batch") -> DataFrame:
    """floor(i / size): the last batch may be smaller."""
    return row_numbers(df, order, out="_rn").withColumn(out, F.floor((F.col("_rn") - 1) / size)).drop("_rn")


def dummy_samples(spark, n: int, seed: str) -> DataFrame:
    """n pairs of made-up file names with a seeded 0/1 label, in seeded order (a test generator)."""
    rows = spark.range(n).select(
        F.concat(F.lit("path/to/sample-"), F.col("id"), F.lit("-A")).alias("sample_a"),
        F.concat(F.lit("path/to/sample-"), F.col("id"), F.lit("-B")).alias("sample_b"),
        (hash_long(seed, "id") % 2).cast("string").alias("label"),
    )
    return rows.orderBy(hash_hex(f"{seed}-order", "sample_a"))
