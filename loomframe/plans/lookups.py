"""Join a long table with a dictionary."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from loomframe.plans.checkpoints import materialize
from loomframe.plans.ordered import join_stats

FREQUENT_ROWS = 200_000  # entries of a dictionary that are broadcast, the most frequent ones
FREQUENT_BYTES = 64  # a longer label is not broadcast


def lookup_join(df: DataFrame, table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join with a table that holds each key once.

    Spark broadcasts the table if it measures below ``spark.sql.autoBroadcastJoinThreshold``; beyond, both
    sides are shuffled and hot keys are split at run time.
    """
    return join_stats(df, table, keys)


def frequent(table: DataFrame, label: str, n: str) -> DataFrame:
    """The ``FREQUENT_ROWS`` entries with the largest ``n``, stored: few enough to be broadcast, whatever the corpus."""
    short = table.filter(F.octet_length(label) <= FREQUENT_BYTES)
    return materialize(short.orderBy(F.desc(n), label).limit(FREQUENT_ROWS))


def without_frequent(df: DataFrame, common: DataFrame, label: str) -> DataFrame:
    """The rows whose label has no entry in ``common``; they are few, and have to move to the rest of the dictionary."""
    return join_stats(df, F.broadcast(common.select(label)), [label], "left_anti")


def whole_key(column: str) -> Column:
    """A key without nulls, so that rows partitioned by it can be joined on it where they are."""
    return F.coalesce(F.concat(F.lit("v"), F.col(column).cast("string")), F.lit("n"))
