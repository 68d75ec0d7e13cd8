"""Vector search, tag queries and pair decisions."""

from __future__ import annotations

from collections.abc import Sequence
from math import exp

from pyspark.sql import Column, DataFrame, functions as F

from loomframe.functions.vectors import dot, doubles, l2_normalize, norm, squared_distance, sum_vectors
from loomframe.plans.ordered import join_stats


def normalized(df: DataFrame, vector: str) -> DataFrame:
    return df.withColumn(vector, l2_normalize(doubles(vector)))


def find_similar(df: DataFrame, key: str, vector: str, name, n: int, least: bool = False) -> DataFrame:
    """The n items closest to a named one, itself included; ``least`` gives the n furthest, furthest first.

    One vector travels as a constant; each task keeps n rows. An unknown name gives no rows.
    """
    probe = df.filter(F.col(key) == F.lit(name)).select(doubles(vector).alias("v")).limit(1).collect()
    scored = df.select(key, F.lit(None).cast("double").alias("score")).limit(0)
    if probe:
        scored = df.select(key, dot(doubles(vector), F.lit(probe[0]["v"])).alias("score"))
    order = [F.asc("score"), F.desc(key)] if least else [F.desc("score"), F.asc(key)]
    return scored.orderBy(*order).limit(n)


def tag_query(items: DataFrame, key: str, vector: str, tags: DataFrame, tag_key: str, tag_vector: str, codes: Sequence[int], slots: int) -> DataFrame:
    """(key, score) of every item against the normalised sum of tag vectors; missing slots use code 0."""
    padded = [*codes, *[0] * (slots - len(codes))]
    weights = tags.filter(F.col(tag_key).isin(*set(padded))).select(
        F.lit(1).alias("q"), tag_key, doubles(tag_vector).alias("v")
    )
    times = F.create_map(*[F.lit(x) for c in sorted(set(padded)) for x in (c, float(padded.count(c)))])
    scaled = weights.select("q", F.transform("v", lambda x: x * F.element_at(times, F.col(tag_key))).alias("v"))
    row = sum_vectors(scaled, ["q"], "v").first()
    if row is None:
        return items.select(key, F.lit(None).cast("double").alias("score")).limit(0)
    query = l2_normalize(F.lit(row["vector"]))
    return items.select(key, dot(doubles(vector), query).alias("score"))


def euclidean(a: Column, b: Column) -> Column:
    """Distance with a floor that keeps its square root away from zero."""
    return F.sqrt(F.greatest(squared_distance(a, b), F.lit(1e-7)))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def weighted_mix(a: Column, b: Column, weights: tuple[float, float]) -> Column:
    """Softmax-weighted sum of two scores."""
    top = [exp(w - max(weights)) for w in weights]
    return a * F.lit(top[0] / sum(top)) + b * F.lit(top[1] / sum(top))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def pair_vectors(pairs: DataFrame, items: DataFrame, key: str, vector: str) -> DataFrame:
    """Pairs (a_id, b_id, ...) with both vectors as ``va`` and ``vb``."""
    a = items.select(F.col(key).alias("a_id"), doubles(vector).alias("va"))
    b = items.select(F.col(key).alias("b_id"), doubles(vector).alias("vb"))
    return join_stats(join_stats(pairs, a, ["a_id"]), b, ["b_id"])


def decide(probability: Column, target: Column, cut: float = 0.5) -> dict[str, Column]:
    """0 below the cut, else 1, and whether that misses the target."""
    decision = F.when(probability < cut, 0).otherwise(1)
    return {"decision": decision, "is_mismatch": decision != target}
