"""Feature engineering: ``fit_*`` learns a small parameter table on train rows, ``apply`` is a projection.

Parameter tables hold (feature, stat, value): a few rows per column, so applying reads them once on the
driver and bakes the numbers into the plan as constants. No row of data is joined or shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from loomframe.operators.window import top_label_share
from loomframe.plans.checkpoints import materialize
from loomframe.plans.ordered import join_stats, row_numbers
from loomframe.plans.quantiles import fit_statistics

SCALERS = ("standard", "minmax", "robust")


def _params(df: DataFrame) -> dict[str, dict[str, float]]:
    out: dict[str, dict[str, float]] = {}
    for r in df.collect():
        out.setdefault(r["feature"], {})[r["stat"]] = r["value"]
    return out


def _long(stats: DataFrame, cells: Sequence[tuple[str, str]]) -> DataFrame:
    """One row of aggregates ``<i>`` as (feature, stat, value)."""
    rows = F.array(
        *[
            F.struct(F.lit(f).alias("feature"), F.lit(s).alias("stat"), F.col(f"_{i}").cast("double").alias("value"))
            for i, (f, s) in enumerate(cells)
        ]
    )
    return stats.select(F.explode(rows).alias("r")).select("r.*")


def cut(c: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Right-closed bins (a, b]; outside the edges and null give null."""
    out = F.lit(None).cast("string")
    for low, high, label in reversed(list(zip(edges, edges[1:], labels))):
        out = F.when((c > low) & (c <= high), F.lit(label)).otherwise(out)
    return out


def fit_equal_width(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    stats = df.agg(*[e.alias(f"_{2 * i + j}") for i, c in enumerate(columns) for j, e in enumerate((F.min(c), F.max(c)))])
    return _long(stats, [(c, s) for c in columns for s in ("min", "max")])


def equal_width_bin(c: Column, low: float, high: float, bins: int) -> Column:
    """0-based bin of n equal right-closed bins over [low, high]; the low edge is inside bin 0, null has no bin."""
    width = (high - low) / bins
    if width == 0:
        return F.when(c.isNotNull(), F.lit((bins - 1) // 2))
    inside = F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.ceil((c - low) / width) - 1)).cast("int")
    return F.when(c.isNotNull(), inside)


def fit_whiskers(df: DataFrame, columns: Sequence[str], low: float = 0.26, high: float = 0.76, reach: float = 1.5) -> DataFrame:
    """Lower and upper caps: quartile-like quantiles stretched by ``reach`` times their distance."""
    return fit_together(df, whiskers=columns, low=low, high=high, reach=reach)["whiskers"]


def _table(df: DataFrame, rows: Sequence[tuple[str, str, float]]) -> DataFrame:
    return df.sparkSession.createDataFrame([(f, s, float(v)) for f, s, v in rows], "feature string, stat string, value double")


def fit_together(
    df: DataFrame, medians: Sequence[str] = (), whiskers: Sequence[str] = (), scalers: Mapping[str, str] | None = None,
    marker: float | None = None, low: float = 0.26, high: float = 0.76, reach: float = 1.5,
) -> dict[str, DataFrame]:
    """Parameter tables ``medians``, ``whiskers`` and ``scalers`` of several steps, fitted in three passes over the rows (one without quantiles).

    ``scalers`` names a kind per column. All steps see the rows as they are: a step that builds on another's result
    is fitted in a second call. ``marker`` stands for a missing value in ``medians``.
    """
    scalers = scalers or {}
    if set(scalers.values()) - set(SCALERS):
        raise ValueError(f"kind must be one of {SCALERS}")
    present = [F.when(~_missing(F.col(c), marker), F.col(c)).cast("double").alias(f"m_{c}") for c in medians]
    used = dict.fromkeys([*whiskers, *scalers])
    rows = df.select(*present, *[F.col(c).alias(f"x_{c}") for c in used])
    probs: dict[str, list[float]] = {f"m_{c}": [0.5] for c in medians}
    for c in whiskers:
        probs.setdefault(f"x_{c}", []).extend([low, high])
    for c, kind in scalers.items():
        if kind == "robust":
            probs.setdefault(f"x_{c}", []).extend([0.25, 0.5, 0.75])
    probs = {c: list(dict.fromkeys(float(p) for p in ps)) for c, ps in probs.items()}
    picks = {"standard": lambda c: (F.avg(c), F.stddev_pop(c)), "minmax": lambda c: (F.min(c), F.max(c) - F.min(c))}
    also = {f"{stat}_{c}": e.cast("double") for c, kind in scalers.items() if kind != "robust" for stat, e in zip(("center", "scale"), picks[kind](f"x_{c}"))}
    if probs:
        q, moments = fit_statistics(rows, probs, also)
    else:
        q, moments = {}, rows.agg(*[e.alias(name) for name, e in also.items()], F.lit(0).alias("_none")).first().asDict()
    out = {"medians": [(c, "fill", q[f"m_{c}", 0.5]) for c in medians if (f"m_{c}", 0.5) in q], "whiskers": [], "scalers": []}
    for c in whiskers:
        if (f"x_{c}", float(low)) in q:
            a, b = q[f"x_{c}", float(low)], q[f"x_{c}", float(high)]
            out["whiskers"] += [(c, "low", a - (b - a) * reach), (c, "high", b + (b - a) * reach)]
    for c, kind in scalers.items():
        if kind == "robust":
            center, scale_ = (q[f"x_{c}", 0.5], q[f"x_{c}", 0.75] - q[f"x_{c}", 0.25]) if (f"x_{c}", 0.5) in q else (None, None)
        else:
            center, scale_ = moments[f"center_{c}"], moments[f"scale_{c}"]
        if center is not None:  # a column without values has no parameters
            out["scalers"] += [(c, "center", center), (c, "scale", scale_ or 1.0)]
    return {name: _table(df, rows) for name, rows in out.items()}


def cap(df: DataFrame, params: DataFrame) -> DataFrame:
    """Values beyond the whiskers become the whisker; nulls stay."""
    out = {
        f: F.when(F.col(f) > p["high"], F.lit(p["high"])).when(F.col(f) < p["low"], F.lit(p["low"])).otherwise(F.col(f))
        for f, p in _params(params).items()
    }
    return df.withColumns(out)


def fit_scaler(df: DataFrame, columns: Sequence[str], kind: str) -> DataFrame:
    """(feature, stat in center/scale, value); a zero scale becomes one, so constants map to zero."""
    return fit_together(df, scalers={c: kind for c in columns})["scalers"]


def scale(df: DataFrame, params: DataFrame) -> DataFrame:
    return df.withColumns(
        {f: (F.col(f) - F.lit(p["center"])) / F.lit(p["scale"]) for f, p in _params(params).items()}
    )


def _missing(c: Column, marker: float | str | None) -> Column:
    return c.isNull() if marker is None else c.eqNullSafe(F.lit(marker))


def fit_median(df: DataFrame, columns: Sequence[str], marker: float | None = None) -> DataFrame:
    """Exact medians of the present values."""
    return fit_together(df, medians=columns, marker=marker)["medians"]


def fit_most_frequent(df: DataFrame, column: str, marker: str | float | None = None) -> DataFrame:
    """(feature, stat, value) with the most frequent present value, the smallest on ties."""
    counts = df.filter(~_missing(F.col(column), marker)).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    best = counts.agg(F.min(F.struct((-F.col("n")).alias("n"), F.col("value"))).alias("b"))
    return best.select(F.lit(column).alias("feature"), F.lit("fill").alias("stat"), F.col("b.value").alias("value"))


def impute(df: DataFrame, params: DataFrame, marker: float | str | None = None) -> DataFrame:
    return df.withColumns(
        {f: F.when(_missing(F.col(f), marker), F.lit(p["fill"])).otherwise(F.col(f)) for f, p in _params(params).items()}
    )


def fit_categories(df: DataFrame, column: str) -> DataFrame:
    """(column, code): the distinct values in ascending order, numbered from 0; a null is a category, the last one."""
    return _codes(row_numbers(df.select(column).distinct(), [F.col(column).asc_nulls_last()]), column)


def fit_top_labels(df: DataFrame, column: str, share: float) -> DataFrame:
    """(column, code): the first floor(share * distinct) labels by count, numbered from 0."""
    return _codes(top_label_share(df, column, share), column)


def _codes(ranked: DataFrame, column: str) -> DataFrame:
    return materialize(ranked.select(column, (F.col("rn") - 1).cast("int").alias("code")))


def one_hot(df: DataFrame, dictionaries: Mapping[str, DataFrame], out: str) -> DataFrame:
    """``out``: one sparse vector per row, the indicators of each column's fitted categories one after the other.

    ``dictionaries`` holds (column, code) tables of any size. A value outside its dictionary sets none of the
    column's indicators. The dictionaries are joined, never listed, and the vector is one column however many
    categories there are.
    """
    keep, codes, vectors = df.columns, [f"_code_{i}" for i in range(len(dictionaries))], [f"_hot_{i}" for i in range(len(dictionaries))]
    for code, (column, dictionary) in zip(codes, dictionaries.items()):
        n = dictionary.count()
        df = join_stats(df, dictionary.select(column, F.col("code").alias(code)), [column], "left")
        # The size goes along as an attribute; the code after the last one stands for unknown values and is left out.
        attribute = {"ml_attr": {"type": "nominal", "num_vals": max(n, 1)}}
        df = df.withColumn(code, F.coalesce(F.col(code), F.lit(max(n, 1))).cast("double").alias(code, metadata=attribute))
    encoder = OneHotEncoder(inputCols=codes, outputCols=vectors, handleInvalid="keep", dropLast=True)
    coded = encoder.fit(df).transform(df)
    return VectorAssembler(inputCols=vectors, outputCol=out).transform(coded).select(*keep, out)


def yeo_johnson(c: Column, lam: float | Column) -> Column:
    """Power transform for one exponent (Yeo and Johnson, 2000)."""
    if isinstance(lam, Column):
        up = F.when(lam == 0, F.log1p(c)).otherwise((F.pow(c + 1, lam) - 1) / lam)
        down = F.when(lam == 2, -F.log1p(-c)).otherwise(-(F.pow(1 - c, 2 - lam) - 1) / (2 - lam))
    else:
        up = F.log1p(c) if lam == 0 else (F.pow(c + 1, F.lit(lam)) - 1) / lam
        down = -F.log1p(-c) if lam == 2 else -(F.pow(1 - c, F.lit(2 - lam)) - 1) / (2 - lam)
    return F.when(c >= 0, up).otherwise(down)


def _power_moments(grid: Sequence[Sequence[float]]):
    """Task function: per column and exponent (n, mean, squared deviations) of the transformed values, and the Jacobian's sum."""

    def transformed(x: np.ndarray, lam: float) -> np.ndarray:
        y, up = np.empty_like(x), ~(x < 0)
        a, b = x[up], -x[~up]
        y[up] = np.log1p(a) if lam == 0 else (np.power(a + 1, lam) - 1) / lam
        y[~up] = -np.log1p(b) if lam == 2 else -(np.power(b + 1, 2 - lam) - 1) / (2 - lam)
        return y

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict = {}
        with np.errstate(all="ignore"):
            for batch in batches:
                for i, lams in enumerate(grid):
                    x = batch.column(i).drop_null().to_numpy(zero_copy_only=False)
                    if not len(x):
                        continue
                    jacobian = float((np.sign(x) * np.log1p(np.abs(x))).sum())
                    for j, lam in enumerate(lams):
                        y = transformed(x, lam)
                        n, m, d, g = found.get((i, j), (0, 0.0, 0.0, 0.0))
                        own = y[0] + (y - y[0]).mean()  # exact where all values are equal, as are the steps below
                        step, both = (own - m if n else 0.0), n + len(y)
                        spread = ((y - own) ** 2).sum() + step * step * n * len(y) / both
                        found[i, j] = both, (m + step * len(y) / both if n else own), d + spread, g + jacobian
        rows = [(i, j, n, float(m), float(d), g) for (i, j), (n, m, d, g) in found.items()]
        if rows:  # one per column and exponent leaves the task
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows), kinds)], ["i", "j", "n", "m", "d", "g"])

    return run


def _likelihoods(df: DataFrame, grid: Mapping[str, Sequence[float]]) -> dict[str, list[tuple[float, float | None]]]:
    """(exponent, log-likelihood) of every grid exponent; None where the values do not vary.

    Batches of a column are raised to all exponents as arrays, and a task passes on one row per column and exponent.
    """
    numbers = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(grid)])
    parts = numbers.mapInArrow(_power_moments(list(grid.values())), "i int, j int, n long, m double, d double, g double")
    sums = parts.groupBy("i", "j").agg(F.sum("n").alias("n"), F.sum("g").alias("g"), F.min("m").alias("low"), F.collect_list(F.struct("n", "m", "d")).alias("tasks"))
    offset = F.aggregate("tasks", F.lit(0.0), lambda t, p: t + p["n"] * (p["m"] - F.col("low"))) / F.col("n")
    centered = sums.withColumn("mean", F.col("low") + offset)
    deviations = F.aggregate("tasks", F.lit(0.0), lambda t, p: t + p["d"] + p["n"] * (p["m"] - F.col("mean")) * (p["m"] - F.col("mean")))
    rows = centered.select("i", "j", "n", "g", deviations.alias("d")).collect()
    names, found = list(grid), {}
    for r in rows:
        name = names[r["i"]]
        lam, variance = grid[name][r["j"]], r["d"] / r["n"]
        found.setdefault(name, []).append((lam, -r["n"] / 2 * math.log(variance) + (lam - 1) * r["g"] if variance > 0 and variance < math.inf else None))
    return found


def fit_yeo_johnson(df: DataFrame, columns: Sequence[str], tolerance: float = 5e-4) -> DataFrame:
    """Exponent of maximum likelihood per column, then mean and std of the transformed values.

    Each round is one pass for all columns over a grid around the best exponents so far, then the grid
    narrows tenfold.
    """
    df = materialize(df.select(*columns))  # the passes read the narrow columns, not their source
    step, span, centers = 0.5, 6, {c: 1.0 for c in columns}
    while True:
        grid = {c: [round(centers[c] + i * step, 10) for i in range(-span, span + 1)] for c in columns}
        for c, scored in _likelihoods(df, grid).items():
            rated = [(ll, -abs(lam - centers[c]), lam) for lam, ll in scored if ll is not None and ll == ll]
            if rated:  # a constant column keeps exponent one
                centers[c] = max(rated)[2]
        if step <= tolerance:
            break
        step, span = step / 10, 10
    values = {c: yeo_johnson(F.col(c).cast("double"), centers[c]) for c in columns}
    exprs = [e for c in columns for e in (F.lit(centers[c]), F.avg(values[c]), F.stddev_pop(values[c]))]
    stats = df.agg(*[e.alias(f"_{i}") for i, e in enumerate(exprs)])
    return _long(stats, [(c, s) for c in columns for s in ("lambda", "mean", "std")])


def apply_yeo_johnson(df: DataFrame, params: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            f: (yeo_johnson(F.col(f).cast("double"), p["lambda"]) - p["mean"]) / (p["std"] or 1.0)
            for f, p in _params(params).items()
        }
    )


def count_true(conditions: Sequence[Column]) -> Column:
    """How many conditions hold; null counts as false."""
    return sum((F.coalesce(c, F.lit(False)).cast("int") for c in conditions), F.lit(0))


def count_status(count: Column) -> Column:
    """Status code of a match count: five or more 1, three or four 2, one or two 3, none 0."""
    return F.when(count >= 5, 1).when(count >= 3, 2).when(count >= 1, 3).otherwise(0)


def sign_code(high: Column, low: Column) -> Column:
    """-1, 0 or 1 by the sign of the difference."""
    return F.signum((high - low).cast("double")).cast("int")


def first_set_code(indicators_by_group: Sequence[tuple[int, Column]], codes: Mapping[int, int]) -> Column:
    """Code of the first set indicator whose group has one, else 0."""
    hits = [F.when(c == 1, F.lit(codes[g])) for g, c in indicators_by_group if g in codes]
    return F.coalesce(*hits, F.lit(0))


def row_sum(columns: Sequence[str]) -> Column:
    """Sum across columns, nulls skipped."""
    return sum((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns), F.lit(0.0))


def polynomial(columns: Sequence[str], degree: int = 2) -> dict[str, Column]:
    """Bias, columns and all products up to the degree, in the usual order."""
    out = {"1": F.lit(1.0)}
    for d in range(1, degree + 1):
        for combo in combinations_with_replacement(columns, d):
            term = F.lit(1.0)
            for c in combo:
                term = term * F.col(c)
            out["*".join(combo)] = term
    return out
