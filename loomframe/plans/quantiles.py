"""Exact linear-interpolated quantiles of columns too large for one aggregation buffer."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_
from typing import Any

from pyspark.sql import Column, DataFrame, Window, functions as F

from loomframe.plans.ordered import join_stats, running_sums, sorted_chunks


def unpivot(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Long form (by..., feature, value) of numeric columns; no columns give no rows."""
    if not cols:
        return df.select(*by, F.lit(None).cast("string").alias("feature"), F.lit(None).cast("double").alias("value")).limit(0)
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in cols])
    return df.select(*by, F.explode(pairs).alias("_seq_p")).select(*by, "_seq_p.feature", "_seq_p.value")


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """(by..., feature, prob, value), nulls skipped; exact, for all columns and probabilities together.

    Grouped quantiles sort all distinct values; without groups see ``fit_statistics``.
    """
    if by:
        return _sorted_quantiles(df, cols, probs, by)
    found, _ = fit_statistics(df, {c: probs for c in cols})
    rows = [(c, float(p), found[c, float(p)]) for c in cols for p in probs if (c, float(p)) in found]
    return df.sparkSession.createDataFrame(rows, "feature string, prob double, value double")


_RANK_ERROR = 1e-4  # of the approximate pass; brackets reach three times as far


def fit_statistics(df: DataFrame, wanted: Mapping[str, Sequence[float]], also: Mapping[str, Column] | None = None) -> tuple[dict[tuple[str, float], float], dict[str, Any]]:
    """({(column, probability): value}, {name: value}): exact quantiles and other aggregates for several fitted steps.

    Three passes answer them all, whatever their number. The rough one brackets every wanted rank and brings the
    aggregates ``also``. The second counts the values below each bracket, the third shuffles only those inside one,
    which are then ranked. Should a bracket miss its rank, all distinct values are sorted instead. A column without values has no
    quantiles.
    """
    also, reach = also or {}, 3 * _RANK_ERROR
    cols = list(wanted)
    numbers = {c: F.col(c).cast("double") for c in cols}
    edges = {c: [min(max(p + side * reach, 0.0), 1.0) for p in wanted[c] for side in (-1, 1)] for c in cols}
    rough = df.agg(
        *[e for c in cols for e in (F.count(numbers[c]).alias(f"n_{c}"), F.percentile_approx(numbers[c], edges[c] or [0.5], int(1 / _RANK_ERROR)).alias(f"q_{c}"))],
        *[e.alias(f"a_{name}") for name, e in also.items()],
        F.lit(0).alias("_none"),
    ).first()
    values = {name: rough[f"a_{name}"] for name in also}
    brackets = []  # (column, probability, low, high, rank)
    for c in cols:
        for j, p in enumerate(wanted[c] if rough[f"n_{c}"] else []):
            low, high = (None if edges[c][2 * j + k] in (0.0, 1.0) and edges[c][2 * j + k] == k else rough[f"q_{c}"][2 * j + k] for k in (0, 1))
            brackets.append((c, float(p), low, high, float(p) * (rough[f"n_{c}"] - 1)))
    if not brackets:
        return {}, values
    cells, below = [], []
    for cell, (c, _, low, high, _) in enumerate(brackets):
        x = numbers[c]
        inside = x.isNotNull()
        inside = inside if low is None else inside & (x >= low)
        inside = inside if high is None else inside & (x <= high)
        cells.append(F.when(inside, F.struct(F.lit(cell).alias("cell"), x.alias("value"))))
        below.append(F.lit(0) if low is None else F.count_if(x < low))
    under = df.agg(*below).first()
    hits = df.filter(reduce(or_, [c.isNotNull() for c in cells]))  # a plain filter ahead of the arrays
    rows = hits.select(F.explode(F.filter(F.array(*cells), lambda c: c.isNotNull())).alias("c")).select("c.*")
    counts = rows.groupBy("cell", "value").agg(F.count(F.lit(1)).alias("n"))
    ranks = F.create_map(*[F.lit(v) for cell, (*_, rank) in enumerate(brackets) for v in (cell, rank - under[cell])])
    summed = running_sums(counts, ["n"], ["value"], ["cell"])
    at, start = F.element_at(ranks, F.col("cell")), F.col("cum_n") - F.col("n")
    holds = lambda r: F.when((r >= start) & (r < F.col("cum_n")), F.col("value"))
    ends = {r["cell"]: (r["a"], r["b"]) for r in summed.groupBy("cell").agg(F.max(holds(F.floor(at))).alias("a"), F.max(holds(F.ceil(at))).alias("b")).collect()}
    if any(None in ends.get(cell, (None,)) for cell in range(len(brackets))):
        every = sorted({p for c in cols for p in wanted[c]})
        found = {(r["feature"], r["prob"]): r["value"] for r in _sorted_quantiles(df, cols, every, ()).collect()}
        return {(c, p): found[c, p] for c, p, *_ in brackets}, values
    return {(c, p): ends[cell][0] + (ends[cell][1] - ends[cell][0]) * (rank - int(rank)) for cell, (c, p, _, _, rank) in enumerate(brackets)}, values


def _sorted_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], by: Sequence[str]) -> DataFrame:
    """Equal values are counted before the sort, chunk totals locate the wanted ranks, and only the
    chunks that hold them are scanned again."""
    keys = [*by, "feature"]
    counts = unpivot(df, cols, by).filter(F.col("value").isNotNull()).groupBy(*keys, "value").agg(
        F.count(F.lit(1)).alias("n")
    )
    chunks = sorted_chunks(counts, ["value"], keys)
    ordered = Window.partitionBy(*keys).orderBy("_seq_chunk")
    sizes = chunks.groupBy(*keys, "_seq_chunk").agg(F.sum("n").alias("_seq_n"))
    placed = sizes.select(
        *keys,
        "_seq_chunk",
        F.sum("_seq_n").over(ordered.rowsBetween(Window.unboundedPreceding, 0)).alias("_seq_upto"),
        (F.sum("_seq_n").over(ordered.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_seq_n")).alias("_seq_before"),
        F.sum("_seq_n").over(Window.partitionBy(*keys)).alias("_seq_total"),
    )
    wanted = placed.withColumn("prob", F.explode(F.array(*[F.lit(float(p)) for p in probs]))).withColumn(
        "_seq_pos", F.col("prob") * (F.col("_seq_total") - 1)
    )
    lo, hi = F.floor("_seq_pos"), F.ceil("_seq_pos")
    wanted = wanted.filter(
        ((lo >= F.col("_seq_before")) & (lo < F.col("_seq_upto"))) | ((hi >= F.col("_seq_before")) & (hi < F.col("_seq_upto")))
    ).select(*keys, "_seq_chunk", "_seq_before", "prob", "_seq_pos")
    needed = join_stats(chunks, wanted.select(*keys, "_seq_chunk").distinct(), [*keys, "_seq_chunk"], "left_semi")
    local = Window.partitionBy(*keys, "_seq_chunk").orderBy("_seq_offset").rowsBetween(Window.unboundedPreceding, 0)
    local_sums = needed.withColumn("_seq_cum", F.sum("n").over(local))
    rows = join_stats(local_sums, wanted, [*keys, "_seq_chunk"])
    start, stop = F.col("_seq_before") + F.col("_seq_cum") - F.col("n"), F.col("_seq_before") + F.col("_seq_cum")
    at_lo = F.max(F.when((lo >= start) & (lo < stop), F.col("value")))
    at_hi = F.max(F.when((hi >= start) & (hi < stop), F.col("value")))
    share = F.max(F.col("_seq_pos") - F.floor("_seq_pos"))
    return rows.groupBy(*keys, "prob").agg((at_lo + (at_hi - at_lo) * share).alias("value"))
