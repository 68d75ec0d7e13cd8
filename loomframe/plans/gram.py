"""Sums of products of many columns in one pass."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

PILOT = 100  # rows that tell where the values lie, so that large offsets cost no digits


def _sums(n_left: int, n_right: int, shifts: Sequence[float]):
    """Task function: per left column the sums over rows in which it and a right column are present."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            there = np.stack([c.is_valid().to_numpy(zero_copy_only=False) for c in batch.columns], axis=1).astype(float)
            values = np.stack(columns, axis=1).astype(float) - np.asarray(shifts)
            values[there == 0] = 0.0
            x, y, in_x, in_y = values[:, :n_left], values[:, n_left:], there[:, :n_left], there[:, n_left:]
            part = np.concatenate([in_x.T @ in_y, x.T @ in_y, (x * x).T @ in_y, in_x.T @ y, in_x.T @ (y * y), x.T @ y], axis=1)
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(n_left), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "sums"])

    return run


def product_sums(df: DataFrame, left: Sequence[str], right: Sequence[str], shift: bool = True) -> tuple[DataFrame, list[float]]:
    """((i, n, sx, sxx, sy, syy, sxy), shifts): for each left column arrays of sums over the right ones.

    The sums run over rows where both columns are present, of values less their column's shift. Each task multiplies
    blocks of rows as matrices and passes on one row per left column; these are added up by column, so neither the plan
    nor a row's work has an expression per pair.
    """
    columns = [*left, *right]
    numbers = df.select(*[F.col(c).cast("double").alias(f"c{k}") for k, c in enumerate(columns)])
    shifts = [0.0] * len(columns)
    if shift and columns:
        pilot = numbers.limit(PILOT).agg(*[F.avg(c).alias(c) for c in numbers.columns]).first()
        shifts = [float(v) if v is not None and np.isfinite(v) else 0.0 for v in pilot]
    parts = numbers.mapInArrow(_sums(len(left), len(right), shifts), "i int, sums array<double>")
    added = parts.groupBy("i").agg(vector_to_array(Summarizer.sum(array_to_vector(F.col("sums")))).alias("sums"))
    names = ["n", "sx", "sxx", "sy", "syy", "sxy"]
    return added.select("i", *[F.slice("sums", k * len(right) + 1, len(right)).alias(name) for k, name in enumerate(names)]), shifts
