"""Row and column clean-up as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from loomframe.functions.hashing import hash_long
from loomframe.operators.aggregate import correlations
from loomframe.plans.ordered import hashed_row_numbers


def replace_value(column: Column | str, target: Any, value: Any) -> Column:
    """One value for another; a null target matches nulls."""
    c = F.col(column) if isinstance(column, str) else column
    return F.when(c.eqNullSafe(F.lit(target)), F.lit(value)).otherwise(c)


def null_category(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Nulls become their own category ``NA-<col>``; booleans become ``<col>-TRUE`` / ``<col>-FALSE``."""
    types = dict(df.dtypes)
    out = {}
    for name in columns:
        c = F.col(name)
        if types[name] == "boolean":
            c = F.when(c, f"{name}-TRUE").when(~c, f"{name}-FALSE")
        out[name] = F.coalesce(c.cast("string"), F.lit(f"NA-{name}"))
    return df.withColumns(out)


def encode_bool(column: str) -> Column:
    return F.col(column).cast("int")


def decode_bool(column: str) -> Column:
    return F.col(column).cast("boolean")


def column_range(df: DataFrame, first: str | int, last: str | int | None = None) -> DataFrame:
    """Columns from ``first`` to ``last``: names are inclusive, positions follow Python slices."""
    names = df.columns
    start = names.index(first) if isinstance(first, str) else first
    stop = names.index(last) + 1 if isinstance(last, str) else last
    return df.select(*names[start:stop])


def map_values(column: str, mapping: Mapping[Any, Any], keep_unmapped: bool) -> Column:
    """Constant mapping; unmapped values stay or become null."""
    pairs = [F.lit(x) for item in mapping.items() for x in item]
    hit = F.element_at(F.create_map(*pairs), F.col(column))
    return F.coalesce(hit, F.col(column)) if keep_unmapped else hit


def split_on_substring(df: DataFrame, column: str, needle: str) -> tuple[DataFrame, DataFrame]:
    """(rows without the substring, rows with it)."""
    hit = F.coalesce(F.col(column).contains(needle), F.lit(False))
    return df.filter(~hit), df.filter(hit)


def exclude_values(df: DataFrame, column: str, values: Sequence[Any]) -> DataFrame:
    """Rows without the listed values; null rows stay."""
    return df.filter(F.col(column).isNull() | ~F.col(column).isin(*values)) if values else df


def frequent_terms(df: DataFrame, term: str, minimum: int, stop_terms: Sequence[str] = ()) -> DataFrame:
    """(term, n) of terms seen at least ``minimum`` times; stop terms removed before counting."""
    kept = exclude_values(df, term, stop_terms)
    return kept.groupBy(term).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= minimum)


def inject_nulls(df: DataFrame, key: Sequence[str], columns: Sequence[str], share: float, seed: str) -> DataFrame:
    """Null one hashed column in exactly round(share * n) hashed rows."""
    wanted = df.agg(F.round(F.count(F.lit(1)) * F.lit(share)).cast("bigint")).scalar()
    ranked = hashed_row_numbers(df, seed, key, out="_rank")
    column_no = hash_long(f"{seed}-col", *key) % len(columns)
    hit = F.col("_rank") <= wanted
    blanked = {c: F.when(hit & (column_no == i), F.lit(None)).otherwise(F.col(c)) for i, c in enumerate(columns)}
    return ranked.withColumns(blanked).drop("_rank")


def correlated_columns(
    df: DataFrame, label: str, columns: Sequence[str], threshold: float, signed: bool = False
) -> list[str]:
    """Columns whose correlation with the label reaches the threshold (one job, one small row)."""
    rows = correlations(df, [(c, label) for c in columns]).collect()
    size = (lambda r: r) if signed else abs
    kept = {r["a"] for r in rows if r["r"] is not None and size(r["r"]) >= threshold}
    return [c for c in columns if c in kept]


def prefix_columns(df: DataFrame, prefix: str, columns: Sequence[str]) -> DataFrame:
    return df.withColumnsRenamed({c: f"{prefix}{c}" for c in columns})


def first_entries(column: Column, k: int) -> Column:
    """First k list entries (all of them when the list is shorter)."""
    return F.slice(column, 1, k)


def pick_crew(crew: Column, max_writers: int = 3) -> dict[str, Column]:
    """From an array of {name, job, department}: last director, last producer, first writers, lower-cased.

    The writing department wins over the producer job, and the director job over both.
    """
    director = lambda c: F.lower(c["job"]) == "director"
    writing = lambda c: F.lower(c["department"]) == "writing"
    producer = lambda c: F.lower(c["job"]) == "producer"
    last_name = lambda people: F.lower(F.try_element_at(people, F.lit(-1))["name"])
    writers = F.filter(crew, lambda c: writing(c) & ~director(c))
    return {
        "director": last_name(F.filter(crew, director)),
        "producer": last_name(F.filter(crew, lambda c: producer(c) & ~writing(c) & ~director(c))),
        "writers": F.transform(first_entries(writers, max_writers), lambda c: F.lower(c["name"])),
    }


def two_level(column: Column, cut: float, high: int = 255, low: int = 0) -> Column:
    """``high`` from the cut on, else ``low``."""
    return F.when(column >= cut, F.lit(high)).otherwise(F.lit(low))


def near_ratio(width: Column, height: Column, ratio: float, tolerance: float) -> Column:
    """True where width / height is within the tolerance of the wanted ratio."""
    return F.abs(F.lit(ratio) - width / height) < tolerance
