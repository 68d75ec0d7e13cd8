"""Sample pairs: positives inside a class, negatives across classes."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from loomframe.functions.hashing import hash_hex, hash_long
from loomframe.operators.window import pair_numbers, quota
from loomframe.plans.checkpoints import materialize
from loomframe.plans.ordered import hashed_row_numbers, join_stats, next_matching


def class_pairs(df: DataFrame, label: str, key: str, per_class: int, seed: str) -> DataFrame:
    """All unordered pairs among the first ``per_class`` members of each class in seeded order.

    (label, a_pos, b_pos, a_id, b_id), per_class * (per_class - 1) / 2 rows for a full class. The quota
    bounds the work per class whatever the class size; partners are listed by index, not by a self join
    over the class.
    """
    members = quota(
        df.select(label, key).withColumn("_h", hash_hex(seed, key)), [label], ["_h", key], per_class, "pos"
    ).drop("_h")
    present = members.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    firsts = join_stats(members, present, [label]).filter(F.col("pos") < F.col("n"))
    slots = firsts.select(
        label,
        F.col("pos").alias("a_pos"),
        F.col(key).alias("a_id"),
        F.explode(F.sequence(F.col("pos") + 1, F.col("n").cast("int"))).alias("pos"),
    )
    return join_stats(slots, members, [label, "pos"]).select(
        label, "a_pos", F.col("pos").alias("b_pos"), "a_id", F.col(key).alias("b_id")
    )


def paired_members(df: DataFrame, label: str, key: str, seed: str) -> DataFrame:
    """Members of each class paired off in seeded order: (label, a_id, b_id), every member in one pair at most.

    An odd last member of a class has no partner. The output grows with the rows, whatever the class sizes.
    """
    ranked = hashed_row_numbers(df.select(label, key), seed, [key], [label])
    sides = ranked.groupBy(label, F.floor((F.col("rn") + 1) / 2).alias("_pair")).agg(
        F.max(F.when(F.col("rn") % 2 == 1, F.col(key))).alias("a_id"), F.max(F.when(F.col("rn") % 2 == 0, F.col(key))).alias("b_id")
    )
    return sides.filter("b_id IS NOT NULL").select(label, "a_id", "b_id")


def random_class_pairs(df: DataFrame, label: str, key: str, per_class: int, seed: str) -> DataFrame:
    """``per_class`` draws of two different members per class, repeats allowed: (label, draw, a_id, b_id).

    Classes with a single member give no pairs. Draws carry member numbers and meet the members on
    (class, number), so a large class spreads over all tasks.
    """
    members = hashed_row_numbers(df.select(label, key), seed, [key], [label])
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    draws = sizes.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(per_class))))
    first = hash_long(f"{seed}-a", F.col(label), F.col("draw")) % F.col("n")
    step = hash_long(f"{seed}-b", F.col(label), F.col("draw")) % (F.col("n") - 1)
    picks = draws.select(label, "draw", first.alias("first"), ((first + 1 + step) % F.col("n")).alias("second"))

    def fetch(name: str, out: str):
        side = members.select(F.col(label).alias("_l"), (F.col("rn") - 1).alias("_i"), F.col(key).alias(out))
        return side, (F.col(label) == F.col("_l")) & (F.col(name) == F.col("_i"))

    a_side, a_on = fetch("first", "a_id")
    b_side, b_on = fetch("second", "b_id")
    with_a = picks.join(a_side, a_on).drop("_l", "_i")
    return with_a.join(b_side, b_on).select(label, "draw", "a_id", "b_id")


def even_share(n: int, ratio: float) -> int:
    """ratio * n rounded down to an even number."""
    wanted = round(n * ratio, 9)
    return int(wanted - wanted % 2)


def negative_pairs(positives: DataFrame, label: str, ratio: float, seed: str) -> DataFrame:
    """Cross-class pairs (draw, a_id, b_id, a_label, b_label) from a list of (label, a_id, b_id) positives.

    The positives are put in seeded order. Draw j takes one image of row j, and one of the nearest
    later row (wrapping around) of another class.
    """
    key = [label, "a_id", "b_id"]
    ranked = materialize(hashed_row_numbers(positives.select(*key), seed, key, out="place"))
    n = ranked.count()
    wanted = even_share(n, ratio)
    if n < wanted:
        raise ValueError("a ratio above one would reuse rows")
    if wanted and ranked.select(label).distinct().limit(2).count() < 2:
        raise ValueError("negative pairs need positives of two classes at least")
    # The list is laid out twice so that the search for another class can run past its end.
    twice = ranked.unionByName(ranked.withColumn("place", F.col("place") + n))
    starts = _class_changes(twice, label)
    first = starts.filter(F.col("place") <= wanted)
    partner = ranked.select(
        F.col("place").alias("_p"), F.col(label).alias("b_label"), F.col("a_id").alias("_c"), F.col("b_id").alias("_d")
    )
    matched = first.withColumn("_next", (F.col("next_change") - 1) % n + 1).join(partner, F.col("_next") == F.col("_p"))
    coin = lambda side: hash_long(f"{seed}-{side}", "place") % 2 == 0
    return matched.select(
        F.col("place").alias("draw"),
        F.when(coin("a"), F.col("a_id")).otherwise(F.col("b_id")).alias("neg_a_id"),
        F.when(coin("b"), F.col("_c")).otherwise(F.col("_d")).alias("neg_b_id"),
        F.col(label).alias("a_label"),
        "b_label",
    ).withColumnsRenamed({"neg_a_id": "a_id", "neg_b_id": "b_id"})


def _class_changes(df: DataFrame, label: str) -> DataFrame:
    """``next_change``: place of the nearest later row that starts a run of another class."""
    prior = df.select((F.col("place") + 1).alias("place"), F.col(label).alias("_prior"))
    marked = df.join(prior, "place", "left").withColumn(
        "starts", F.col("_prior").isNotNull() & (F.col("_prior") != F.col(label))
    )
    return next_matching(marked.drop("_prior"), "starts", "place", ["place"], out="next_change")


def unique_pairs(df: DataFrame, key: str, first_code: int) -> DataFrame:
    """Consecutive rows as positive pairs with class codes of their own: (label, a_id, b_id).

    An odd last row has no partner and is left out.
    """
    numbered = pair_numbers(df.select(key), [], [key])
    sides = numbered.groupBy("pair").agg(
        F.max(F.when(F.col("side") == "A", F.col(key))).alias("a_id"),
        F.max(F.when(F.col("side") == "B", F.col(key))).alias("b_id"),
    )
    return sides.filter("b_id IS NOT NULL").select((F.col("pair") - 1 + first_code).alias("label"), "a_id", "b_id")


def evaluation_batch(
    positives: DataFrame, label: str, size: int, positive_share: float, seed: str, uniques: DataFrame | None = None
) -> DataFrame:
    """Labelled evaluation pairs (kind, a_id, b_id, target) of exactly ``size`` rows.

    Uniques count inside the size: without them positives are floor(share * size) and negatives the
    rest; with them negatives are floor((1 - share) * size) and positives what is left. Positives are
    drawn with repeats. Negatives may also use the unique pairs as a source.
    """
    positives = materialize(positives)
    n_unique = uniques.count() if uniques is not None else 0
    if n_unique:
        n_negative = math.floor(round((1 - positive_share) * size, 9))
        n_positive = size - n_negative - n_unique
    else:
        n_positive = math.floor(round(positive_share * size, 9))
        n_negative = size - n_positive
    if n_positive < 0:
        raise ValueError("the unique pairs and negatives alone exceed the batch")
    key = [label, "a_id", "b_id"]
    ranked = hashed_row_numbers(positives.select(*key), seed, key, out="place")
    n = positives.count()
    draws = positives.sparkSession.range(n_positive).select((hash_long(f"{seed}-p", "id") % n + 1).alias("place"))
    drawn = join_stats(draws, ranked, ["place"]).select(
        F.lit("positive").alias("kind"), "a_id", "b_id", F.lit(1).alias("target")
    )
    pool = positives.select(*key)
    if n_unique:
        pool = pool.unionByName(uniques.select(*key))
        extra = uniques.select(F.lit("unique").alias("kind"), "a_id", "b_id", F.lit(1).alias("target"))
        drawn = drawn.unionByName(extra)
    if n_negative > even_share(n + n_unique, 1.0):
        raise ValueError("the batch asks for more negatives than there are positive pairs to draw from")
    chosen = negative_pairs(pool, label, 1.0, f"{seed}-n").filter(F.col("draw") <= n_negative).select(
        F.lit("negative").alias("kind"), "a_id", "b_id", F.lit(0).alias("target")
    )
    return drawn.unionByName(chosen)
