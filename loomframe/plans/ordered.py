"""Exact ranks, running sums and neighbours over groups of any size.

A plain window puts each group (or, without ``partitionBy``, the whole table) into one task. Here
every group is cut into chunks that follow the wanted order; a chunk fits a task, per-chunk totals
are tiny, and adding the totals of the earlier chunks to the in-chunk result gives the exact answer.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from loomframe.functions.hashing import hash_hex
from loomframe.plans.checkpoints import materialize

_ROW_BITS = 33  # monotonically_increasing_id: partition index above, row number below


def join_stats(df: DataFrame, stats: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join a grouped table back on its keys, nulls matching nulls.

    ``stats`` has one row per key, so a hot key only splits the left side (AQE skew join); the
    choice between broadcast and shuffle is left to the measured size. Keys that hold no null are
    compared plainly, which keeps a partitioning on them usable.
    """
    nullable = {f.name: f.nullable and not f.name.startswith("_seq_") for f in df.schema}
    renamed = stats.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[c for c in stats.columns if c not in keys])
    condition = None
    for key in keys:
        left, right = F.col(key), F.col(f"_k_{key}")
        match = left.eqNullSafe(right) if nullable[key] else left == right
        condition = match if condition is None else condition & match
    return df.join(renamed, condition, how).drop(*[f"_k_{k}" for k in keys])


def _order(order: Sequence[str | Column]) -> list[Column]:
    return [F.col(o) if isinstance(o, str) else o for o in order]


def _keyed(df: DataFrame, by: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Group columns as keys without nulls, so that a window and the join after it share one shuffle."""
    keys = {f"_seq_b{i}": F.coalesce(F.concat(F.lit("v"), F.col(c).cast("string")), F.lit("n")) for i, c in enumerate(by)}
    return df.withColumns(keys) if keys else df, list(keys)


def sorted_chunks(df: DataFrame, order: Sequence[str | Column], by: Sequence[str] = ()) -> DataFrame:
    """Range-sort by (by, order) and tag rows with ``_seq_chunk`` and ``_seq_offset``.

    The sort splits on the full key, so a hot ``by`` value spreads over many chunks as long as
    ``order`` ends in a unique column. The checkpoint pins rows to chunks across retries.
    """
    tagged = df.orderBy(*[F.col(b) for b in by], *_order(order)).withColumn("_seq_m", F.monotonically_increasing_id())
    pinned = materialize(tagged)
    return (
        pinned.withColumn("_seq_chunk", F.shiftright("_seq_m", _ROW_BITS))
        .withColumn("_seq_offset", F.col("_seq_m").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)))
        .drop("_seq_m")
    )


def _before(value: str, by: Sequence[str]) -> Column:
    """Sum of ``value`` over the earlier chunks of the same group (one row per chunk)."""
    window = Window.partitionBy(*by).orderBy("_seq_chunk").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(window), F.lit(0))


def row_numbers(df: DataFrame, order: Sequence[str | Column], by: Sequence[str] = (), out: str = "rn") -> DataFrame:
    """``row_number()`` in any order. ``order`` must end in a unique column."""
    keyed, by = _keyed(df, by)
    chunks = sorted_chunks(keyed, order, by)
    sizes = chunks.groupBy(*by, "_seq_chunk").agg(F.min("_seq_offset").alias("_seq_first"), F.count(F.lit(1)).alias("_seq_n"))
    starts = sizes.select(*by, "_seq_chunk", "_seq_first", _before("_seq_n", by).alias("_seq_before"))
    joined = join_stats(chunks, starts, [*by, "_seq_chunk"])
    return joined.withColumn(out, F.col("_seq_offset") - F.col("_seq_first") + F.col("_seq_before") + 1).drop(
        "_seq_chunk", "_seq_offset", "_seq_first", "_seq_before", *by
    )


def hashed_row_numbers(
    df: DataFrame, seed: str, key: Sequence[str], by: Sequence[str] = (), out: str = "rn", digits: int = 4
) -> DataFrame:
    """``row_number()`` in seeded md5 order of ``key``, ties by ``key``.

    The leading hex digits cut every group into up to 16^digits even chunks, so no sort of the whole
    table and no checkpoint is needed.
    """
    (keyed, by), key = _keyed(df, by), list(key)
    base = keyed.withColumn("_seq_h", hash_hex(seed, *key)).withColumn("_seq_chunk", F.substring("_seq_h", 1, digits))
    sizes = base.groupBy(*by, "_seq_chunk").agg(F.count(F.lit(1)).alias("_seq_n"))
    starts = sizes.select(*by, "_seq_chunk", _before("_seq_n", by).alias("_seq_before"))
    local = F.row_number().over(Window.partitionBy(*by, "_seq_chunk").orderBy("_seq_h", *key))
    joined = join_stats(base.withColumn("_seq_rn", local), starts, [*by, "_seq_chunk"])
    return joined.withColumn(out, F.col("_seq_rn") + F.col("_seq_before")).drop(
        "_seq_h", "_seq_chunk", "_seq_rn", "_seq_before", *by
    )


def running_sums(
    df: DataFrame, values: Sequence[str], order: Sequence[str | Column], by: Sequence[str] = ()
) -> DataFrame:
    """Inclusive running sum of each value in order, as ``cum_<value>``."""
    keyed, by = _keyed(df, by)
    chunks = sorted_chunks(keyed, order, by)
    sums = chunks.groupBy(*by, "_seq_chunk").agg(*[F.sum(v).alias(f"_seq_s_{v}") for v in values])
    starts = sums.select(*by, "_seq_chunk", *[_before(f"_seq_s_{v}", by).alias(f"_seq_b_{v}") for v in values])
    window = Window.partitionBy(*by, "_seq_chunk").orderBy("_seq_offset").rowsBetween(Window.unboundedPreceding, 0)
    local = chunks.select("*", *[F.sum(v).over(window).alias(f"_seq_l_{v}") for v in values])
    joined = join_stats(local, starts, [*by, "_seq_chunk"])
    for v in values:
        joined = joined.withColumn(f"cum_{v}", F.col(f"_seq_l_{v}") + F.col(f"_seq_b_{v}")).drop(f"_seq_l_{v}", f"_seq_b_{v}")
    return joined.drop("_seq_chunk", "_seq_offset", *by)


def previous_values(
    df: DataFrame, value: str, order: Sequence[str | Column], by: Sequence[str] = (), out: str = "previous"
) -> DataFrame:
    """``lag(value)`` plus ``<out>_exists``, which is false on the first row of a group."""
    keyed, by = _keyed(df, by)
    chunks = sorted_chunks(keyed, order, by)
    boxed = chunks.withColumn("_seq_box", F.struct(F.col(value).alias("v")))
    lasts = boxed.groupBy(*by, "_seq_chunk").agg(F.max_by("_seq_box", "_seq_offset").alias("_seq_last"))
    edge = Window.partitionBy(*by).orderBy("_seq_chunk")
    carried = lasts.select(*by, "_seq_chunk", F.lag("_seq_last").over(edge).alias("_seq_carry"))
    local = Window.partitionBy(*by, "_seq_chunk").orderBy("_seq_offset")
    joined = join_stats(boxed.withColumn("_seq_prev", F.lag("_seq_box").over(local)), carried, [*by, "_seq_chunk"])
    box = F.coalesce("_seq_prev", "_seq_carry")
    return (
        joined.withColumn(out, box.getField("v"))
        .withColumn(f"{out}_exists", box.isNotNull())
        .drop("_seq_chunk", "_seq_offset", "_seq_box", "_seq_prev", "_seq_carry", *by)
    )


def next_matching(
    df: DataFrame, marked: str, value: str, order: Sequence[str | Column], by: Sequence[str] = (), out: str = "next"
) -> DataFrame:
    """``value`` of the nearest later row with ``marked`` true (null when there is none)."""
    keyed, by = _keyed(df, by)
    chunks = sorted_chunks(keyed, order, by).withColumn("_seq_hit", F.when(F.col(marked), F.struct(F.col(value).alias("v"))))
    firsts = chunks.groupBy(*by, "_seq_chunk").agg(F.min_by("_seq_hit", F.when(F.col(marked), F.col("_seq_offset"))).alias("_seq_first"))
    # Backwards: Spark reads a frame that ends at the last row anew for each row, which squares the work of a chunk.
    later = Window.partitionBy(*by).orderBy(F.desc("_seq_chunk")).rowsBetween(Window.unboundedPreceding, -1)
    carried = firsts.select(*by, "_seq_chunk", F.last("_seq_first", ignorenulls=True).over(later).alias("_seq_carry"))
    ahead = Window.partitionBy(*by, "_seq_chunk").orderBy(F.desc("_seq_offset")).rowsBetween(Window.unboundedPreceding, -1)
    local = F.last("_seq_hit", ignorenulls=True).over(ahead)
    joined = join_stats(chunks.withColumn("_seq_near", local), carried, [*by, "_seq_chunk"])
    return joined.withColumn(out, F.coalesce("_seq_near", "_seq_carry").getField("v")).drop(
        "_seq_chunk", "_seq_offset", "_seq_hit", "_seq_near", "_seq_carry", *by
    )
